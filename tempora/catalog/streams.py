"""Streaming queries, run over all available data and read back from their sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog.base import B0, B1, SPEC, query, with_sql
from tempora.catalog.climate import CITY_ENRICHED, CUR, city_ytd
from tempora.operators import climatology as C
from tempora.session import shared_dir, shared_table
from tempora.sources import star
from tempora.streaming import jobs, panes, rolling

MONTHLY = """WITH o AS (SELECT o_orderpriority AS priority, date_trunc('month', o_orderdate) AS m, o_totalprice AS v FROM orders)
  SELECT priority, CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month, avg(v) AS mean, count(v) AS count FROM o"""


def _orders(spark, path):
    return jobs.as_stream(spark, path, "orders.parquet").select(
        F.col("o_orderpriority").alias("priority"), "o_orderdate", "o_totalprice")


@query(
    "stream_monthly_means", "ST1 ST2 ST3",
    MONTHLY + " WHERE m < (SELECT date_trunc('month', max(o_orderdate)) FROM orders) GROUP BY priority, m", "mean",
)
def _(spark, path):
    out = shared_dir(spark, "monthly")
    stream = jobs.monthly_stream(_orders(spark, path), ["priority"], "o_orderdate", "o_totalprice")
    jobs.run_available(stream, out, f"{out}-checkpoint")
    return spark.read.parquet(out)


@query("batch_monthly_means", "ST3", MONTHLY + " GROUP BY priority, m", "mean")
def _(spark, path):
    rows = spark.read.parquet(f"{path}/orders.parquet").withColumnRenamed("o_orderpriority", "priority")
    return jobs.monthly_stream(rows, ["priority"], "o_orderdate", "o_totalprice")


@query(
    "calendar_month_windows", "ST1 ST2",
    """SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day,
      CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS next_first_day FROM orders""",
)
def _(spark, path):
    w = jobs.month_windows(spark.read.parquet(f"{path}/orders.parquet"), "o_orderdate")
    return w.select(F.to_date("window_start").alias("first_day"), F.to_date("window_end").alias("next_first_day")).distinct()


RATES_SQL = """WITH w AS (SELECT event_type, unnest(range(0, 10)) AS k, ts FROM events),
      c AS (SELECT event_type, date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)) AS window_start, count(*) AS n FROM w GROUP BY ALL)
      SELECT event_type, strftime(window_start, '%Y-%m-%d %H:%M') AS window_start, n FROM c WHERE n > 40
        AND window_start + INTERVAL 10 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""


@query(
    "stream_sliding_rates", "ST5",
    RATES_SQL,
)
def _(spark, path):
    # the events are minutes apart, so ten one-second steps become ten one-hour steps
    out = shared_dir(spark, "rates")
    events = jobs.as_stream(spark, path, "events.parquet").select("event_type", "ts")
    rates = jobs.sliding_rates(events, "event_type", "ts", 40, "10 hours", "1 hour", "1 hour")
    jobs.run_available(rates, out, f"{out}-checkpoint")
    return spark.read.parquet(out).select(
        "event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n")


@query("stream_pane_rates", "ST5", RATES_SQL)
def _(spark, path):
    # every event is counted once, in its one-hour pane; a window is a sum of ten panes in state
    out = shared_dir(spark, "pane-rates")
    events = jobs.as_stream(spark, path, "events.parquet").select("event_type", "ts")
    with rolling.state_store(spark):
        jobs.run_available(panes.sliding_rates_by_panes(events, "event_type", "ts", 40, 3600, 10, "1 hour"), out, f"{out}-checkpoint")
    return spark.read.parquet(out).select(
        "event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n")


@query(
    "stream_merge_snapshot", "ST4 I10",
    """SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
      arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS orderkey, arg_max(o_totalprice, {'d': o_orderdate, 'k': o_orderkey}) AS price
      FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' GROUP BY ALL""",
    "price",
)
def _(spark, path):
    # three arrivals in an order that has nothing to do with the orders' dates
    landed, out = shared_dir(spark, "landed"), shared_dir(spark, "snapshot")
    rows = star.table(spark, path, "orders").filter(F.col("o_orderdate") >= F.lit("1996-03-01").cast("timestamp_ntz")).select(
        "o_custkey", F.trunc("o_orderdate", "month").alias("month"), F.struct("o_orderdate", "o_orderkey").alias("placed"),
        F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"), F.pmod(F.hash("o_orderkey"), F.lit(3)).alias("arrival"))
    keys = ["o_custkey", "month"]
    for k in range(3):
        rows.filter(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(landed)
        stream = spark.readStream.schema(rows.drop("arrival").schema).parquet(landed)
        jobs.merge_stream(stream, keys, "month", "1996-03-01", out, f"{out}-checkpoint", "placed").awaitTermination()
    return jobs.read_snapshot(spark, out).select("o_custkey", "month", "orderkey", "price")


@query(
    "stream_daily_anomaly_rolling", "ST3 W1 W2 W3 W4",
    with_sql(CITY_ENRICHED) + f" SELECT city, time, {', '.join((*rolling.INPUTS, *rolling.OUTPUTS))} FROM enriched",
    " ".join((*rolling.INPUTS, *rolling.OUTPUTS)),
)
def _(spark, path):
    """Daily rows arrive in three landings, series up to twelve days apart; the stream is restarted for each."""
    landed, out = shared_dir(spark, "landed"), shared_dir(spark, "rolling")
    clim = shared_table(C.daily_climatology(city_ytd(spark, path, B0, B1), SPEC, ("city",)), "climatology")
    days = shared_table(city_ytd(spark, path, CUR, CUR), "days")
    ahead = F.pmod(F.hash("city"), F.lit(2)) * 12
    arrival = F.least(F.floor((F.dayofyear("time") + ahead) / 130), F.lit(2))
    for k in range(3):
        days.filter(arrival == k).write.mode("append").parquet(landed)
        if k == 2:  # nothing comes after: a row without an entity moves the watermark past the last day
            days.agg(F.max(SPEC.time).alias("time")).select(
                *[(F.date_add("time", 60) if c == "time" else F.lit(None)).cast(days.schema[c].dataType).alias(c) for c in days.columns]
            ).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(days.schema).parquet(landed)
        joined = C.daily_anomalies(stream, clim, SPEC, ("city",)).select("city", "time", *rolling.INPUTS)
        with rolling.state_store(spark):
            jobs.run_available(rolling.rolling_stream(joined, ["city"], "time", "20 days"), out, f"{out}-checkpoint")
    return spark.read.parquet(out)
