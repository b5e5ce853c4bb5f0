"""Sliding rates from panes: every event is counted once, in the pane of one step it falls into.

The state of a key is its panes, at most as many as a window and the lateness have steps. A timer
at the end of a window sums the window's panes; panes that no later window needs are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class PaneCounts(StatefulProcessor):
    """Emits (key, window_start in ms, n, panes) of the windows with more than ``limit`` events."""

    def __init__(self, key: str, step_ms: int, steps: int, limit: int):
        self.key, self.step, self.steps, self.limit = key, step_ms, steps, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "start long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        for frame in rows:
            start, n = np.unique(frame["event_ms"].to_numpy() // self.step * self.step, return_counts=True)
            for s, k in zip(start.tolist(), n.tolist(), strict=True):
                counts[s] = counts.get(s, 0) + k
        for s, k in counts.items():
            old = self.panes.getValue((s,))[0] if self.panes.containsKey((s,)) else 0
            self.panes.updateValue((s,), (old + k,))
            if not old:  # the ends of the windows that hold this pane
                for i in range(1, self.steps + 1):
                    self.handle.registerTimer(s + i * self.step)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        begin = end - self.steps * self.step
        held = {s[0]: n[0] for s, n in self.panes.iterator()}
        total = sum(n for s, n in held.items() if begin <= s < end)
        for s in held:
            if s <= begin:  # later windows start after it
                self.panes.removeKey((s,))
        if total > self.limit:
            yield pd.DataFrame({self.key: [key[0]], "start_ms": [begin], "n": [total], "panes": [len(held)]})


def sliding_rates_by_panes(events: DataFrame, key: str, time: str, limit: int, step_s: int, steps: int, lateness: str) -> DataFrame:
    """(key, window_start, n, panes): windows of ``steps`` steps, one beginning at each step, with more than ``limit`` events.

    ``panes`` is the number of panes the key held when the window closed. Events behind the
    watermark are dropped.
    """
    stamped = events.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", lateness).withColumn("event_ms", F.unix_millis("_ts"))
    out = T.StructType([T.StructField(key, events.schema[key].dataType), T.StructField("start_ms", T.LongType()), T.StructField("n", T.LongType()), T.StructField("panes", T.LongType())])
    found = stamped.select(key, "_ts", "event_ms").groupBy(key).transformWithStateInPandas(
        statefulProcessor=PaneCounts(key, 1000 * step_s, steps, limit), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return found.select(key, F.timestamp_millis("start_ms").alias("window_start"), "n", "panes")
