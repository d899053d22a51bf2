import pytest

from tidemark.session import shared_folder, work_path


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, name, default=None):
        assert name == "spark.checkpoint.dir"
        return self.value or default


class Session:
    def __init__(self, master, folder=None):
        self.conf = Conf(folder)
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"test-{master}"})()


def test_the_cluster_names_the_folder():
    assert shared_folder(Session("yarn", "hdfs://x/cp")) == "hdfs://x/cp"
    assert work_path(Session("yarn", "hdfs://x/cp/"), "t").startswith("hdfs://x/cp/tidemark/t-")


def test_only_a_local_session_falls_back():
    local = Session("local[2]")
    assert shared_folder(local) == shared_folder(local)
    with pytest.raises(ValueError):
        shared_folder(Session("yarn"))
