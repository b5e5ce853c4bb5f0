"""Rolling and cumulative anomalies of a stream of daily rows, kept in state per series.

A series' rows wait in its state until the watermark has passed their day, whatever order they
arrive in; a day that is sent again while it waits is replaced. A timer per waiting day then
releases them in order. The state of a series is the waiting days (at most the lateness) and the
last 29 released rows of its year. Rows behind the watermark are dropped, as their day is final.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
INPUTS = ("temp_anomaly", "precip_anomaly", "snow_anomaly")
OUTPUTS = ("rolling_7d_temp_anomaly", "rolling_30d_temp_anomaly", "rolling_7d_precip_anomaly", "cumulative_precip_anomaly", "rolling_7d_snow_anomaly")
SHORT, LONG = 7, 30
DAY = 86_400_000


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Stateful processors need the RocksDB store; a query keeps the setting it was started with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _mean(values: list[float | None]) -> float | None:
    some = [v for v in values if v is not None]
    return sum(some) / len(some) if some else None


def _sum(values: list[float | None]) -> float | None:
    some = [v for v in values if v is not None]
    return sum(some) if some else None


class Trailing:
    """The released rows of one year of a series that later rows still need."""

    def __init__(self, year: int = 0, total: float | None = None, rows: list | None = None):
        self.year, self.total, self.rows = year, total, rows or []

    def push(self, year: int, values: tuple[float | None, ...]) -> tuple[float | None, ...]:
        """The five figures of the next row."""
        if year != self.year:
            self.year, self.total, self.rows = year, None, []
        self.rows = [*self.rows[1 - LONG :], values]
        temp, precip, snow = ([r[k] for r in self.rows] for k in range(3))
        if values[1] is not None:
            self.total = (self.total or 0.0) + values[1]
        return (_mean(temp[-SHORT:]), _mean(temp), _sum(precip[-SHORT:]), None if values[1] is None else self.total, _sum(snow[-SHORT:]))


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


class RollingAnomalies(StatefulProcessor):
    """Emits each day of a series once it is final, with its rolling and cumulative figures."""

    def __init__(self, keys: list[str], time: str):
        self.keys, self.time = keys, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        values = T.StructType([T.StructField(c, T.DoubleType()) for c in INPUTS])
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day long", values)
        self.trailing = handle.getListState("trailing", values)
        self.year = handle.getValueState("year", "year int, total double, done long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if any(k is None or k != k for k in key):
            return iter(())
        done = self.year.get()[2] if self.year.exists() else -(2**62)
        for frame in rows:
            days = pd.to_datetime(frame[self.time]).to_numpy().astype("datetime64[D]").astype("int64")
            for day, *values in zip(days.tolist(), *(frame[c] for c in INPUTS), strict=True):
                if day > done:
                    self.waiting.updateValue((day,), tuple(_number(v) for v in values))
                    self.handle.registerTimer(day * DAY)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY
        if self.waiting.containsKey((day,)):
            values = tuple(self.waiting.getValue((day,)))
            self.waiting.removeKey((day,))
            year, total, _ = self.year.get() if self.year.exists() else (0, None, None)
            t = Trailing(year, total, [tuple(r) for r in self.trailing.get()] if self.trailing.exists() else [])
            date = pd.Timestamp(day, unit="D")
            figures = t.push(date.year, values)
            self.trailing.put(t.rows[1 - LONG :])
            self.year.update((t.year, t.total, day))
            names = [*self.keys, self.time, *INPUTS, *OUTPUTS]
            yield pd.DataFrame([(*key, date.date(), *values, *figures)], columns=names)


def rolling_stream(anomalies: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """Stream of (keys, time, anomalies) rows with the figures of each day, once the day is final.

    Rows with a null key only move the watermark. A missing anomaly stays missing and is passed over by the figures.
    """
    stamped = anomalies.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", lateness)
    fields = [T.StructField(k, anomalies.schema[k].dataType) for k in keys]
    out = T.StructType([*fields, T.StructField(time, T.DateType()), *[T.StructField(c, T.DoubleType()) for c in (*INPUTS, *OUTPUTS)]])
    # a day is released by the timer of that day; timers of one series fire in order of time
    # (null keys are left to the processor: a filter on them would be moved below the watermark)
    return stamped.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=RollingAnomalies(keys, time), outputStructType=out, outputMode="Append", timeMode="EventTime")
