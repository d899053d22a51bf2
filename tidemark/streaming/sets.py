"""Assembling upload sets from a stream of parts and commits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.session import runs_on_executors

runs_on_executors(__name__)

MESSAGE = "set_id string, at timestamp, kind string, truncated boolean"
"""What arrives: `kind` is `part` or `commit`."""

STATUS = "set_id string, parts long, last_part timestamp, status string"


LATE = "late"
"""Not a verdict: parts that came for a set with one."""


class Assembly(StatefulProcessor):
    """One set: how many parts came, when the last one did, whether any was cut off.

    The parts themselves are written as they arrive and never enter the state, so its size does
    not depend on that of a set. A set ends with its commit or, after `timeout_ms` without a
    part, as abandoned. Then only a mark stays, for `remember_ms` after the last message, so that what comes
    later gets no second verdict: its parts are counted in a row of their own, and a second commit is ignored.
    """

    def __init__(self, timeout_ms: int, remember_ms: int):
        self.timeout_ms, self.remember_ms = timeout_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState(
            "progress", "parts long, last_part timestamp, truncated boolean, finished boolean, timer long"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.progress.get()
        parts, last, cut, finished, timer = known if known is not None else (0, None, False, False, None)
        committed, latest, came = False, None, 0
        for frame in rows:
            newest = frame["at"].max()
            latest = newest if latest is None else max(latest, newest)
            arrived = frame[frame["kind"] == "part"]
            if len(arrived):
                newest = arrived["at"].max()
                came += len(arrived)
                last = newest if last is None else max(pd.Timestamp(last), newest)
                cut = bool(cut or arrived["truncated"].any())
            committed |= bool((frame["kind"] == "commit").any())
        if finished:
            if came:
                yield _status(key[0], came, last, LATE)
        else:
            parts += came
            if committed:
                yield _status(key[0], parts, last, "truncated" if cut else "complete" if parts else "empty")
            finished = committed
        due = _millis(latest) + self.remember_ms if finished else _millis(last) + self.timeout_ms + 1 if last is not None else None
        if due is None:
            return
        # Never in the past, or the timer would not fire.
        due = max(due, timerValues.getCurrentWatermarkInMs() + 1, timer if finished and known and known[3] else 0)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        # The last part that came late is no longer the set's.
        kept = known[1] if known is not None and known[3] else last
        self.progress.update((parts, None if kept is None else pd.Timestamp(kept).to_pydatetime(), cut, finished, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.progress.get()
        if known is None:
            return
        parts, last, cut, finished, timer = known
        if finished:
            self.progress.clear()
            return
        yield _status(key[0], parts, last, "abandoned")
        due = timerValues.getCurrentWatermarkInMs() + self.remember_ms
        self.handle.registerTimer(due)
        self.progress.update((parts, last, cut, True, due))

    def close(self) -> None:
        pass


def assemble_stream(
    messages: DataFrame, timeout_seconds: float, late: str, remember_seconds: float = 7 * 86_400
) -> DataFrame:
    """One verdict per finished set, as `complete_sets` gives it in batch; needs the RocksDB store.

    Rows of status `late` are no verdicts: they count the parts that a batch brought for sets that had one.

    Args:
        messages: A stream of MESSAGE rows.
        timeout_seconds: Idle time, by the messages' own clock, after which a set is abandoned.
        late: How much later than others a message may arrive, such as "10 minutes".
        remember_seconds: How long, by the same clock, a finished set is known after its last message. What comes for it
            after that begins a new set.
    """
    return (
        messages.withWatermark("at", late)
        .groupBy("set_id")
        .transformWithStateInPandas(
            Assembly(int(timeout_seconds * 1000), int(remember_seconds * 1000)),
            outputStructType=STATUS,
            outputMode="append",
            timeMode="eventTime",
        )
    )


def finished(statuses: DataFrame) -> DataFrame:
    """The sets that readers may see."""
    return statuses.where(F.col("status") == "complete").select("set_id")


def _status(set_id, parts, last, status) -> pd.DataFrame:
    last = pd.Timestamp(last) if last is not None else pd.NaT
    return pd.DataFrame(
        {"set_id": [set_id], "parts": [parts], "last_part": [last], "status": [status]}
    )


def _millis(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)
