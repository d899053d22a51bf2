"""Sets of uploaded files: completeness, checks, names and digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import sha256
from tidemark.operators.slices import running_count, running_sum
from tidemark.session import runs_on_executors, written

runs_on_executors(__name__)


def check_not_empty(files: DataFrame, set_key: str, order: str, name: str, size: str) -> DataFrame:
    """One row per set with an empty file: the set and a reason that names the first such file."""
    empty = files.where(F.col(size) == 0).groupBy(set_key).agg(F.min_by(name, order).alias("_name"))
    return empty.select(set_key, F.format_string("file '%s' is empty", "_name").alias("reject_reason"))


def check_has_files(sets: DataFrame, files: DataFrame, set_key: str) -> DataFrame:
    """Sets without any file (or, with converted rows, without any output)."""
    missing = sets.join(files.select(set_key), set_key, "left_anti")
    return missing.select(set_key, F.lit("the set has no files").alias("reject_reason"))


def settle(sets: DataFrame, set_key: str, verdicts: Sequence[DataFrame]) -> DataFrame:
    """Add `status` (`ok` or `rejected`) and `reject_reason` to each set.

    A set is taken whole or not at all: one verdict against it is enough, the first in the list
    gives the reason. Every verdict has one row per set.
    """
    settled, reasons = sets, []
    for rank, verdict in enumerate(verdicts):
        reasons.append(f"_reason{rank}")
        settled = settled.join(
            verdict.select(set_key, F.col("reject_reason").alias(reasons[-1])), set_key, "left"
        )
    reason = F.coalesce(*reasons)
    return settled.select(
        *sets.columns,
        F.when(reason.isNull(), "ok").otherwise("rejected").alias("status"),
        reason.alias("reject_reason"),
    )


def accepted(rows: DataFrame, settled: DataFrame, set_key: str) -> DataFrame:
    """The rows that belong to accepted sets."""
    return rows.join(settled.where(F.col("status") == "ok").select(set_key), set_key, "left_semi")


def set_digest(files: DataFrame, set_key: str, content: str | Column) -> DataFrame:
    """(set, sha256): one hash over all files of a set that does not depend on their order.

    It is the sha256 of the concatenated, sorted sha256 hex digests of the files. The file bodies
    are hashed where they are read; only their 64 characters travel. Those are sorted per set and
    streamed through the second hash, so a set of any size takes constant memory.
    """
    bodies = F.col(content) if isinstance(content, str) else content
    key_type = files.schema[set_key].dataType
    schema = T.StructType([T.StructField(set_key, key_type), T.StructField("sha256", T.StringType())])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for frame in frames:
            done: list[tuple] = []
            keys = frame[set_key].to_numpy()
            bounds = [0, *(1 + (keys[1:] != keys[:-1]).nonzero()[0]), len(keys)]
            for start, end in zip(bounds, bounds[1:]):
                if start == end:
                    continue
                if state is None or keys[start] != current:
                    if state is not None:
                        done.append((current, state.hexdigest()))
                    current, state = keys[start], hashlib.sha256()
                state.update("".join(frame["_digest"].iloc[start:end]).encode())
            if done:
                yield pd.DataFrame(done, columns=[set_key, "sha256"])
        if state is not None:
            yield pd.DataFrame([(current, state.hexdigest())], columns=[set_key, "sha256"])

    digests = files.where(F.col(set_key).isNotNull()).select(set_key, sha256(bodies).alias("_digest"))
    ordered = digests.repartition(F.col(set_key)).sortWithinPartitions(set_key, "_digest")
    return ordered.mapInPandas(fold, schema)


def safe_names(files: DataFrame, set_key: str, order: str, name: str) -> DataFrame:
    """Add `safe_name`: no directories, and no name twice within a set.

    Files take their names in upload order. A taken name gets the first free suffix `_1`, `_2`, ...
    before its extension; a real file called `x_1` may already hold one of those. Names can get in
    each other's way only if they agree up to such suffixes and the extension (a family). In a
    family of one name the n-th file simply gets suffix n - 1.

    In a family that mixes several names and repeats one, each file first takes the number of files
    of its name before it. Where two names come to the same file name, the earlier file keeps it, and
    the number is taken for the other name from that file on; its files then take the n-th free
    number. That goes on until no file name is wanted twice. A name is only ever lost to an earlier
    file, so that this ends with what taking names one after the other gives. Rounds are as many as a
    file loses names, not as there are files, and a large family is worked on by several tasks.
    """
    bare = F.coalesce(F.nullif(F.regexp_extract(name, r"([^/]+)/*$", 1), F.lit("")), F.lit("upload"))
    split = (
        files.withColumn("_bare", bare)
        .withColumn("_suffix", F.regexp_extract("_bare", r"^.+(\.[^.]+)$", 1))
        .withColumn("_stem", F.expr("left(_bare, length(_bare) - length(_suffix))"))
        .withColumn("_root", F.regexp_replace("_stem", r"(_[0-9]+)+$", ""))
    )
    family = [set_key, "_root", "_suffix"]
    shapes = split.groupBy(*family, "_bare").agg(F.count(F.lit(1)).alias("_n")).groupBy(*family).agg(
        F.count(F.lit(1)).alias("_names"), F.sum("_n").alias("_files")
    )
    # Each branch below takes its part of this.
    known = written(split.join(shapes, family), "families")
    clash = F.col("_files") > F.col("_names")
    single = F.col("_names") == 1

    plain = known.where(~clash).withColumn("safe_name", F.col("_bare"))
    numbered = running_count(known.where(clash & single), [*family], [order], "_rank")
    suffixed = numbered.withColumn(
        "safe_name",
        F.when(F.col("_rank") == 1, F.col("_bare")).otherwise(
            F.concat("_stem", F.lit("_"), (F.col("_rank") - 1).cast("string"), "_suffix")
        ),
    )
    mixed = running_sum(known.where(clash & ~single), family, [order], F.lit(1).cast("long"), "_at")
    mixed = written(running_sum(mixed, [*family, "_bare"], ["_at"], F.lit(1).cast("long"), "_rank"), "mixed")
    columns = [*files.columns, "safe_name"]
    undisputed = plain.select(*columns).unionByName(suffixed.select(*columns))
    if mixed.isEmpty():
        return undisputed
    chosen = _free_numbers(mixed.select(*family, "_bare", "_stem", "_at", (F.col("_rank") - 1).alias("_rank")), family)
    settled = mixed.join(chosen.select(*family, "_at", "safe_name"), [*family, "_at"])
    return undisputed.unionByName(settled.select(*columns))


def _free_numbers(files: DataFrame, family: list[str]) -> DataFrame:
    """The files (family, _bare, _stem, _at, _rank) with the `safe_name` that each ends up with.

    `_at` numbers a family's files in order, `_rank` those of one bare name from 0.
    """
    group, taken = [*family, "_bare"], None
    numbered_name = F.concat("_stem", F.lit("_"), F.col("_number").cast("string"), "_suffix")
    name = F.when(F.col("_number") == 0, F.col("_bare")).otherwise(numbered_name)
    while True:
        number = files.withColumn("_number", F.col("_rank")) if taken is None else _after_taken(files, taken, family)
        named = written(number.withColumn("safe_name", name), "names")
        wanted = named.groupBy(*family, "safe_name").agg(F.min("_at").alias("_by"), F.count(F.lit(1)).alias("_files"))
        wanted = wanted.where("_files > 1").select(*family, "safe_name", "_by")
        lost = named.join(wanted, [*family, "safe_name"]).where("_at > _by").select(*group, "_number", "_by")
        lost = written(lost if taken is None else lost.unionByName(taken), "taken")
        lost = lost.groupBy(*group, "_number").agg(F.min("_by").alias("_by"))
        if taken is not None and lost.exceptAll(taken).isEmpty() or taken is None and lost.isEmpty():
            return named
        taken = written(lost, "taken")


def _after_taken(files: DataFrame, taken: DataFrame, family: list[str]) -> DataFrame:
    """Adds `_number`: the `_rank`-th number that is free for the file.

    `taken` has numbers of a bare name (group) that files from `_by` on can't have.
    """
    group = [*family, "_bare"]
    # How many files of the group come before `_by`: none of them minds.
    both = files.select(*group, "_at", F.lit(1).cast("long").alias("_file")).unionByName(
        taken.select(*group, F.col("_by").alias("_at"), F.lit(0).cast("long").alias("_file"), "_number"), allowMissingColumns=True
    )
    counted = running_sum(both, group, ["_at", "_file"], F.col("_file"), "_before")
    rows = counted.where("_file = 0").select(*group, "_number", "_before")
    schema = T.StructType([*rows.schema.fields[:-2], T.StructField("_rank", T.LongType())])

    def skipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A step per taken number: which file would come to it, and whether it can't have it.
        current, n = None, 0
        for batch in batches:
            ranks, kept = [], []
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for i, (*key, number, before) in enumerate(zip(*columns)):
                if key != current:
                    current, n = key, 0
                if number - n >= before:
                    ranks.append(number - n)
                    kept.append(i)
                    n += 1
            some = batch.take(pa.array(kept, pa.int32()))
            yield pa.RecordBatch.from_arrays([*some.columns[:-2], pa.array(ranks, pa.int64())], names=schema.names)

    # From `_rank` on a file's number is one more.
    skips = rows.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group, "_number").mapInArrow(skipped, schema)
    later = files.withColumn("_skip", F.lit(0).cast("long")).unionByName(
        skips.withColumn("_skip", F.lit(1).cast("long")), allowMissingColumns=True
    )
    # At one rank the skips come first.
    order = F.when(F.col("_skip") == 1, 0).otherwise(1)
    moved = running_sum(later.withColumn("_order", order), group, ["_rank", "_order"], F.col("_skip"), "_skipped")
    return moved.where("_skip = 0").withColumn("_number", F.col("_rank") + F.col("_skipped")).select(*files.columns, "_number")


def complete_sets(
    parts: DataFrame,
    commits: DataFrame,
    set_key: str,
    part_ts: str,
    truncated: str,
    as_of: Column,
    timeout: Column,
) -> tuple[DataFrame, DataFrame]:
    """Which sets are whole: (parts of complete sets, one status per set).

    `complete`: committed, with parts, none of them cut off. `truncated` and `empty`: committed
    but unusable. `abandoned`: not committed and idle for longer than `timeout` at `as_of`.
    `open`: may still be completed. Parts travel once, as a count per set.
    """
    seen = parts.groupBy(set_key).agg(
        F.count(F.lit(1)).alias("parts"),
        F.bool_or(truncated).alias("_cut"),
        F.max(part_ts).alias("last_part"),
    )
    committed = commits.select(set_key).distinct().withColumn("_committed", F.lit(True))
    sets = seen.join(committed, set_key, "full_outer")
    status = (
        F.when(F.col("_committed") & F.col("parts").isNull(), "empty")
        .when(F.col("_committed") & F.col("_cut"), "truncated")
        .when(F.col("_committed"), "complete")
        .when(F.col("last_part") < as_of - timeout, "abandoned")
        .otherwise("open")
    )
    statuses = sets.select(
        set_key, F.coalesce("parts", F.lit(0)).alias("parts"), "last_part", status.alias("status")
    )
    whole = statuses.where(F.col("status") == "complete").select(set_key)
    return parts.join(whole, set_key, "left_semi"), statuses


def part_counts(files: DataFrame, set_key: str) -> DataFrame:
    """How many files each set has stored."""
    return files.groupBy(set_key).agg(F.count(F.lit(1)).alias("files"))
