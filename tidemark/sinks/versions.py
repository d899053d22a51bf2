"""Tables that change all at once: each write is a new folder, and a log says which folders count.

    path/data/commit=<id>/...    rows, never changed once written
    path/log/<number>.json       one small file per version: its commit, and whether it replaces what came before

A writer first writes its folder and then renames its finished log file to the next number, which fails if another
writer has taken that number; it then takes the one after. So a job that dies before the rename has changed nothing that
anybody sees. A reader looks at the log once and is bound to the folders of that version, whatever is written meanwhile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

COMMIT = "commit"
LOG = "version long, commit string, replaces boolean"


class Entry(NamedTuple):
    version: int
    commit: str
    replaces: bool


def write_rows(frame: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Writes rows that no version has yet; returns their commit."""
    commit = uuid.uuid4().hex
    frame.write.partitionBy(*partition_by).parquet(_folder(path, commit))
    return commit


def add_version(spark: SparkSession, path: str, commit: str, replaces: bool = True) -> int:
    """Makes a commit count: in place of all rows so far, or beside them. Returns the version."""
    file_system, base = _file_system(spark, path)
    log = base(f"{path}/log")
    file_system.mkdirs(log)
    version = _newest(spark, path)
    while True:
        version += 1
        entry = base(f"{path}/log/.{commit}")
        out = file_system.create(entry, True)
        out.write(bytearray(json.dumps(Entry(version, commit, replaces)._asdict()).encode()))
        out.close()
        if _renamed(spark, entry, base(f"{path}/log/{version:020}.json")):
            return version


def history(spark: SparkSession, path: str) -> list[Entry]:
    """The versions of a table in order; as many as there were writes since `forget`."""
    if not _newest(spark, path):
        return []
    rows = spark.read.schema(LOG).json(f"{path}/log").collect()
    return sorted(Entry(*row) for row in rows)


def commits(spark: SparkSession, path: str, version: int | None = None) -> list[Entry]:
    """The writes that make up a version, by default the newest."""
    known = [e for e in history(spark, path) if version is None or e.version <= version]
    if not known or version not in (None, known[-1].version):
        raise ValueError(f"{path} has no version {'at all' if version is None else version}")
    begins = max((i for i, e in enumerate(known) if e.replaces), default=0)
    return known[begins:]


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the newest; later writes don't change what is read."""
    return read_commits(spark, path, [e.commit for e in commits(spark, path, version)]).drop(COMMIT)


def read_commits(spark: SparkSession, path: str, which: Sequence[str]) -> DataFrame:
    """The rows of some commits, with theirs as a column."""
    return spark.read.option("basePath", f"{path}/data").parquet(*[_folder(path, c) for c in which])


def replace(frame: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Replaces the table, and reads the version that came of it."""
    spark = frame.sparkSession
    version = add_version(spark, path, write_rows(frame, path, partition_by))
    return read_version(spark, path, version)


def forget(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Deletes rows that the newest `keep` versions don't need, and the log of what they replaced.

    Rows of writers that are still at work, or died, are left alone: `discard_rows` is for those.
    """
    known = history(spark, path)
    if len(known) <= keep:
        return
    needed = commits(spark, path, known[-keep].version)[0].version
    file_system, base = _file_system(spark, path)
    for entry in known:
        if entry.version < needed:
            # Once without its log entry, a folder is unknown to all readers to come.
            file_system.delete(base(f"{path}/log/{entry.version:020}.json"), False)
            discard_rows(spark, path, entry.commit)


def discard_rows(spark: SparkSession, path: str, commit: str) -> None:
    file_system, base = _file_system(spark, path)
    file_system.delete(base(_folder(path, commit)), True)


def _folder(path: str, commit: str) -> str:
    return f"{path}/data/{COMMIT}={commit}"


def _file_system(spark: SparkSession, path: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _newest(spark: SparkSession, path: str) -> int:
    file_system, base = _file_system(spark, path)
    if not file_system.exists(base(f"{path}/log")):
        return 0
    names = [f.getPath().getName() for f in file_system.listStatus(base(f"{path}/log"))]
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)


def _renamed(spark: SparkSession, source, target) -> bool:
    """Whether the file could be renamed; not if there is one of that name."""
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    qualified = source.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified
    try:
        context.rename(qualified(source), qualified(target), options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True
