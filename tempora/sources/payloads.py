"""JSON payloads to rows: parallel arrays, maps of maps and sparse statistics cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parameter name in the map-of-maps payload -> observation column.
POWER_PARAMETERS = {
    "T2M": "temperature_2m_mean",
    "T2M_MIN": "temperature_2m_min",
    "T2M_MAX": "temperature_2m_max",
    "PRECTOTCORR": "precipitation_sum",
    "WS2M": "wind_speed_10m_max",
}
# Measures the map-of-maps source never supplies.
POWER_ABSENT = ("snowfall_sum", "sunshine_duration", "et0_fao_evapotranspiration")


def columnar_daily(df: DataFrame, payload: str, measures: list[str], keep: list[str] = ()) -> DataFrame:
    """``{"daily": {"time": [...], measure: [...]}}`` to one row per day."""
    schema = "daily struct<time:array<string>," + ",".join(f"{m}:array<double>" for m in measures) + ">"
    daily = F.from_json(payload, f"struct<{schema.replace('daily ', 'daily:', 1)}>")["daily"]
    parsed = df.select(*keep, daily.alias("d"))
    zipped = F.arrays_zip(F.col("d.time").alias("time"), *[F.col(f"d.{m}").alias(m) for m in measures])
    rows = parsed.select(*keep, F.explode(zipped).alias("r"))
    return rows.select(*keep, F.col("r.time").try_cast("date").alias("time"), *[F.col(f"r.{m}").alias(m) for m in measures])


def parameter_maps(df: DataFrame, payload: str, keep: list[str] = ()) -> DataFrame:
    """``{"properties": {"parameter": {name: {yyyymmdd: value}}}}`` to one row per day.

    The days are the union over all parameters; a parameter without the day gives NULL.
    """
    schema = "struct<properties:struct<parameter:map<string,map<string,double>>>>"
    parsed = df.select(*keep, F.from_json(payload, schema)["properties"]["parameter"].alias("p"))
    maps = {n: F.try_element_at("p", F.lit(n)) for n in POWER_PARAMETERS}
    empty = F.array().cast("array<string>")
    days = F.array_distinct(F.concat(*[F.coalesce(F.map_keys(m), empty) for m in maps.values()]))
    rows = parsed.select(*keep, "p", F.explode(days).alias("k"))
    values = [F.try_element_at(F.try_element_at("p", F.lit(n)), F.col("k")).alias(c) for n, c in POWER_PARAMETERS.items()]
    absent = [F.lit(None).cast("double").alias(c) for c in POWER_ABSENT]
    return rows.select(*keep, F.to_date("k", "yyyyMMdd").alias("time"), *values, *absent)


def statistics_cube(df: DataFrame, payload: str, keep: list[str] = (), value: str = "hdd") -> DataFrame:
    """Sparse index/value cube to (month, value): missing cells are skipped, ``yyyyMM`` gets its dash."""
    schema = (
        "struct<dimension:struct<time:struct<category:struct<index:map<string,int>>>>,value:map<string,double>>"
    )
    parsed = df.select(*keep, F.from_json(payload, schema).alias("c"))
    rows = parsed.select(
        *keep, F.explode("c.dimension.time.category.index").alias("label", "pos"), F.col("c.value").alias("v"))
    month = F.regexp_replace("label", r"^(\d{4})(\d{2})$", "$1-$2")
    cell = F.try_element_at("v", F.col("pos").cast("string"))
    return rows.select(*keep, month.alias("month"), cell.alias(value)).filter(F.col(value).isNotNull())
