"""The queries made of the temporal join: what they write in between, and what goes through the driver."""

import datetime
import os
import time

import pytest

from tidemark.operators import temporal
from tidemark.plans import risk
from tidemark.plans.synthetic import QUERIES, histories
from tidemark.session import shared_folder

SCHEMA = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp"


@pytest.fixture
def lines(spark, tmp_path):
    """Part 1 moves between two suppliers whose classes change; each part has two states that fold into one."""
    at = lambda month, day: datetime.datetime(1997, month, day)
    rows = [
        (1, 1, 7, 1, 10.0, at(1, 5)), (2, 1, 7, 3, 700.0, at(4, 9)), (3, 1, 8, 6, 550.0, at(5, 2)), (4, 1, 8, 1, 20.0, at(8, 1)),
        (5, 2, 9, 1, 10.0, at(1, 7)), (6, 2, 9, 6, 10.0, at(2, 7)), (7, 2, None, 4, 10.0, at(3, 7)),
    ]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_the_audit_of_folded_repeats_reads_files(spark, lines, monkeypatch):
    # It reads the history once to count it, twice to find hot keys and once to compare its rows.
    read, audit = [], histories.audit_every_row_is_a_change

    def noted(frame, *args):
        read.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return audit(frame, *args)

    monkeypatch.setattr(histories, "audit_every_row_is_a_change", noted)
    found = QUERIES["q8_repeats_after_folding"](spark, lines).collect()
    assert sorted((r.issue_id, r.valid_from) for r in found) == [("1", datetime.date(1997, 8, 1)), ("2", datetime.date(1997, 2, 7))]
    assert len(read) == 1 and "Join" not in read[0] and "Window" not in read[0]


@pytest.mark.parametrize("name", [
    "q8_repeats_after_folding", "a1_a3_audits_of_the_join", "q17_time_in_state", "q6_a5_risk_history_published", "q7_risk_history",
    "q8_f2_silver_risk_history",
])
def test_no_history_goes_through_the_driver(spark, lines, name, monkeypatch):
    made = []

    def noted(*args):
        made.append(temporal.temporal_join(*args))
        return made[-1]

    for module in (histories, risk):
        monkeypatch.setattr(module, "temporal_join", noted)
    found = QUERIES[name](spark, lines)
    assert made
    for frame in [*made, found]:
        frame.collect()
        assert "BroadcastExchange" not in frame._jdf.queryExecution().executedPlan().toString()


def shuffled(spark):
    """Names of the shuffles' files on disk."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {os.path.basename(f) for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


@pytest.mark.parametrize("name", [
    "q8_f2_silver_risk_history", "j6_temporal_join_theta", "q6_a5_risk_history_published", "q8_repeats_after_folding", "q7_risk_history",
    "a1_a3_audits_of_the_join",
])
def test_what_a_step_has_used_goes(spark, lines, tmp_path, name):
    folder = f"{shared_folder(spark)}/tidemark"
    tables = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    there, before = tables(), shuffled(spark)
    QUERIES[name](spark, lines).write.parquet(str(tmp_path / "out"))
    left = {t.rpartition("-")[0] for t in tables() - there}
    # The histories, and what only the join's own steps read.
    assert left and not left & {"part_history", "supplier_history", "held", "points", "answered", "numbered", "starting", "matched"}
    until = time.time() + 20
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled(spark) - before
