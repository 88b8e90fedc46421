"""Detections that arrive in any order as merged islands, by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ISLANDS = "stem string, onset_ms double, offset_ms double, n bigint"


def joined(islands: list[tuple[float, float, int]], tolerance: float) -> list[tuple[float, float, int]]:
    """Unions of intervals; gaps up to the tolerance are closed, and the numbers of intervals are added."""
    out: list[tuple[float, float, int]] = []
    for a, b, n in sorted(islands):
        if out and a <= out[-1][1] + tolerance:
            a, b, n = out.pop()[0], max(b, last[1]), n + last[2]
        out.append((a, b, n))
        last = out[-1]
    return out


class Merge(StatefulProcessor):
    """Islands of each recording; those that have had no new interval until the watermark passes their time and the wait are given out and forgotten."""

    def __init__(self, tolerance: float, wait_ms: int):
        self.tolerance, self.wait = tolerance, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.islands = handle.getMapState("islands", "onset_ms double", "offset_ms double, n bigint")
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """An interval touches the islands of its recording only; the recording's timer moves on."""
        new, last = [], 0
        for x in rows:
            new += [(float(a), float(b), 1) for a, b in zip(x["onset_ms"], x["offset_ms"], strict=True)]
            last = max(last, int(x["at"].max().timestamp() * 1000))
        held = [(k[0], v[0], v[1]) for k, v in self.islands.iterator()]
        kept = joined(held + new, self.tolerance)
        for k in {a for a, _, _ in held} - {a for a, _, _ in kept}:
            self.islands.removeKey((k,))
        for island in set(kept) - set(held):
            self.islands.updateValue((island[0],), island[1:])
        was = self.due.get()[0] if self.due.exists() else None
        due = max(was or 0, last + self.wait)
        if due != was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(due)
            self.due.update((due,))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = sorted((k[0], v[0], v[1]) for k, v in self.islands.iterator())
        self.islands.clear()
        self.due.clear()
        yield pd.DataFrame({"stem": [key[0]] * len(out), "onset_ms": [x[0] for x in out], "offset_ms": [x[1] for x in out], "n": [x[2] for x in out]})

    def close(self) -> None:
        pass


def merged_stream(units: DataFrame, tolerance: float = 50.0, late: str = "10 minutes", wait_ms: int = 60_000) -> DataFrame:
    """W08, X03 on a stream of units (stem, onset_ms, offset_ms, at): the islands of a recording, each once, when `wait_ms` have passed since its last unit by the watermark.

    In whatever order units come within that time, islands are those of operators.intervals.merged() over all of them. Units without an interval are dropped, and so are those later than the watermark.
    The session must use the state store STORE. A recording's islands are its state; a unit that is read again after a failure is counted once, as state and output are committed together.
    """
    rows = units.where("onset_ms IS NOT NULL AND offset_ms IS NOT NULL AND stem IS NOT NULL").withWatermark("at", late).select("stem", "onset_ms", "offset_ms", "at")
    return rows.groupBy("stem").transformWithStateInPandas(statefulProcessor=Merge(tolerance, wait_ms), outputStructType=ISLANDS, outputMode="Append", timeMode="EventTime")
