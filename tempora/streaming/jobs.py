"""Streaming jobs. The aggregations are the same functions for bounded and unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tempora.streaming.snapshot import Snapshot


def as_stream(spark: SparkSession, folder: str, file_glob: str) -> DataFrame:
    """Parquet files of a folder as a stream with the schema of what is there."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(folder)


def month_windows(rows: DataFrame, time: str) -> DataFrame:
    """Add ``window_start``/``window_end`` of the calendar month, half-open.

    ``window()`` has no month unit, so the month start itself is the event time.
    """
    start = F.date_trunc("month", F.col(time).cast("timestamp"))
    return rows.withColumn("window_start", start).withColumn(
        "window_end", F.add_months("window_start", 1).cast("timestamp"))


def monthly_stream(rows: DataFrame, keys: list[str], time: str, value: str, lateness: str = "1 day") -> DataFrame:
    """Mean and count per key and calendar month, tagged with year and month.

    On a stream a month is emitted once a later month has arrived and ``lateness`` has passed;
    rows of an already emitted month are dropped. 32 days of lateness keep one month open. On a
    batch every month is returned.
    """
    tagged = month_windows(rows.filter(F.col(value).isNotNull()), time)
    if tagged.isStreaming:
        tagged = tagged.withWatermark("window_start", lateness)
    agg = tagged.groupBy(*keys, "window_start", "window_end").agg(F.avg(value).alias("mean"), F.count(value).alias("count"))
    return agg.select(*keys, F.year("window_start").alias("year"), F.month("window_start").alias("month"), "mean", "count")


def sliding_rates(events: DataFrame, key: str, time: str, limit: int, width: str = "10 seconds", slide: str = "1 second",
                  lateness: str = "10 seconds") -> DataFrame:
    """Keys with more than ``limit`` events in a sliding window."""
    e = events.withColumn("_ts", F.col(time).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("_ts", lateness)
    counts = e.groupBy(key, F.window("_ts", width, slide).alias("w")).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > limit).select(key, F.col("w.start").alias("window_start"), "n")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything available, append to Parquet and stop."""
    q = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def merge_stream(
    stream: DataFrame, keys: list[str], time: str, start: str, folder: str, checkpoint: str, order: str | None = None,
) -> StreamingQuery:
    """Newest-wins merge of a stream into a :class:`~tempora.streaming.snapshot.Snapshot`.

    Each batch commits its own rows and reads nothing that is stored; a batch that is repeated
    after a restart changes nothing. The row with the largest ``order`` wins, of equal ones the
    later batch's. Years with many deltas are compacted on the way.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        snapshot = Snapshot(batch.sparkSession, folder, keys, time, (order,) if order else (), start)
        snapshot.append(batch, batch_id, "stream")
        snapshot.compact()

    return (
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Current state of a merged snapshot."""
    return Snapshot.open(spark, folder).read()
