"""Observation tables derived from the star-schema Parquet tables."""

from __future__ import annotations

from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.numeric import clean_sentinel
from tempora.session import stored_once


_SHARED: ContextVar[bool] = ContextVar("one_daily_pass", default=False)


def one_daily_pass(f):
    """For results composed of many others: all of them read one stored daily table.

    The table is made once per application for one state of its input files.
    """
    @wraps(f)
    def run(*args):
        token = _SHARED.set(True)
        try:
            return f(*args)
        finally:
            _SHARED.reset(token)

    return run


# The tables' columns. Reading with a schema saves a job per table that would only open footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}.parquet")


def raw_observations(
    spark: SparkSession, path: str, first_year: int | None = None, last_year: int | None = None
) -> DataFrame:
    """One row per line item: entity, day and measures, fill value -999 still in place.

    The year bounds are ranges on the stored timestamp and so reach the Parquet scan. The
    supplier table is joined as a plain scan and without a hint: its size is then known to the
    optimizer, which broadcasts it below the size threshold, and otherwise both sides are
    shuffled and adaptive execution splits skewed supplier keys. Nation and region have a fixed
    size (25 and 5 rows) and are broadcast.
    """
    li = table(spark, path, "lineitem")
    ship = F.col("l_shipdate")
    if first_year is not None:
        li = li.filter(ship >= F.lit(f"{first_year}-01-01").cast("timestamp_ntz"))
    if last_year is not None:
        li = li.filter(ship < F.lit(f"{last_year + 1}-01-01").cast("timestamp_ntz"))
    supplier = table(spark, path, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, path, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, path, "region").select("r_regionkey", "r_name")
    place = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    temp = (F.col("l_extendedprice") - 50000.0) / 2000.0
    return (
        li.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("r_name").alias("city"),
            ship.cast("date").alias("time"),
            F.when(F.col("l_orderkey") % 97 == 0, F.lit(-999.0)).otherwise(temp).alias("temperature_2m_mean"),
            F.col("l_quantity").alias("precipitation_sum"),
            F.col("l_discount").alias("snowfall_sum"),
            (F.col("l_tax") * 8640.0).alias("sunshine_duration"),
            "l_returnflag",
            "l_linestatus",
        )
    )


def daily_from_rows(rows: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """Cleaned rows to one row per (entity, day); a map-side combined aggregate."""
    keys = ["city", "time", *(extra_keys or [])]
    return rows.groupBy(*keys).agg(
        F.avg("temperature_2m_mean").alias("temperature_2m_mean"),
        F.min("temperature_2m_mean").alias("temperature_2m_min"),
        F.max("temperature_2m_mean").alias("temperature_2m_max"),
        F.sum("precipitation_sum").alias("precipitation_sum"),
        F.sum("snowfall_sum").alias("snowfall_sum"),
        F.sum("sunshine_duration").alias("sunshine_duration"),
        F.max("precipitation_sum").alias("wind_speed_10m_max"),
        (F.sum(F.col("snowfall_sum") * F.col("precipitation_sum")) / 10.0).alias("et0_fao_evapotranspiration"),
    )


def city_daily(
    spark: SparkSession, path: str, first_year: int | None = None, last_year: int | None = None
) -> DataFrame:
    """One row per (entity, day)."""
    if not _SHARED.get():
        return daily_from_rows(clean_sentinel(raw_observations(spark, path, first_year, last_year)))
    stored = stored_once(
        spark, "daily", [f"{path}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")],
        lambda: daily_from_rows(clean_sentinel(raw_observations(spark, path))))
    if first_year is not None:
        stored = stored.filter(F.col("time") >= F.lit(f"{first_year}-01-01").cast("date"))
    if last_year is not None:
        stored = stored.filter(F.col("time") < F.lit(f"{last_year + 1}-01-01").cast("date"))
    return stored
