"""Registry and the SQL building blocks shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.spec import ObservationSpec

SPEC = ObservationSpec(
    baseline=(1995, 1999), summary_baseline=(1995, 1999), current_year=2001, cutoff="11-04",
)
B0, B1 = SPEC.baseline


@dataclass(frozen=True)
class Query:
    name: str
    operators: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def rounded(df: DataFrame, names: list[str]) -> DataFrame:
    """Six decimals. The two engines sum doubles in different orders, so exact half-way cases are
    moved off the rounding boundary by 1e-9 on both sides."""
    return df.withColumns({n: F.round(F.col(n) + F.lit(1e-9), 6) + F.lit(0.0) for n in names}) if names else df


def rounded_sql(sql: str, names: list[str]) -> str:
    if not names:
        return sql
    cols = ", ".join(f"round({n} + 1e-9, 6) + 0.0 AS {n}" for n in names)
    return f"SELECT * REPLACE ({cols}) FROM ({sql}) AS q"


def query(name: str, ops: str, sql: str | None = None, doubles: str = ""):
    """Register a query. ``doubles`` lists the columns that are compared at six decimals."""
    names = doubles.split()

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, path: str) -> DataFrame:
            return rounded(fn(spark, path), names)

        run.__name__ = name
        REGISTRY[name] = Query(name, tuple(ops.split()), run, rounded_sql(sql.strip(), names) if sql else None)
        return fn

    return wrap


MEASURES_SQL = (
    "temperature_2m_mean", "temperature_2m_min", "temperature_2m_max", "precipitation_sum",
    "snowfall_sum", "sunshine_duration", "wind_speed_10m_max", "et0_fao_evapotranspiration",
)

_DAILY_AGGS = """
    avg(temperature_2m_mean) AS temperature_2m_mean, min(temperature_2m_mean) AS temperature_2m_min,
    max(temperature_2m_mean) AS temperature_2m_max, sum(precipitation_sum) AS precipitation_sum,
    sum(snowfall_sum) AS snowfall_sum, sum(sunshine_duration) AS sunshine_duration,
    max(precipitation_sum) AS wind_speed_10m_max,
    sum(snowfall_sum * precipitation_sum) / 10.0 AS et0_fao_evapotranspiration
"""

RAW = """
raw_obs AS (
  SELECT r_name AS city, CAST(l_shipdate AS DATE) AS time,
    CASE WHEN l_orderkey % 97 = 0 THEN -999.0 ELSE (l_extendedprice - 50000.0) / 2000.0 END AS temperature_2m_mean,
    l_quantity AS precipitation_sum, l_discount AS snowfall_sum, l_tax * 8640.0 AS sunshine_duration,
    l_returnflag, l_linestatus
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
obs AS (
  SELECT * REPLACE (CASE WHEN temperature_2m_mean <> -999.0 THEN temperature_2m_mean END AS temperature_2m_mean)
  FROM raw_obs)"""

CITY = RAW + f""",
city_all AS (SELECT city, time, {_DAILY_AGGS} FROM obs GROUP BY city, time),
city_cal AS (SELECT *, CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month,
  strftime(time, '%m-%d') AS month_day FROM city_all),
city_ytd AS (SELECT * FROM city_cal WHERE month_day <= '{SPEC.cutoff}')"""

_AVGS = ", ".join(f"avg({m}) AS {m}" for m in MEASURES_SQL)

REGION = CITY + f""",
region_all AS (SELECT time, year, month, month_day, {_AVGS} FROM city_cal GROUP BY time, year, month, month_day),
region_ytd AS (SELECT * FROM region_all WHERE month_day <= '{SPEC.cutoff}')"""

MATRIX = CITY + f""",
monthly AS (SELECT city, year, month, avg(temperature_2m_mean) AS mean_temp, count(temperature_2m_mean) AS days
  FROM city_cal WHERE temperature_2m_mean IS NOT NULL GROUP BY city, year, month),
base AS (SELECT city, month, avg(mean_temp) AS baseline_mean, coalesce(stddev_samp(mean_temp), 0.0) AS baseline_std
  FROM monthly WHERE year BETWEEN {B0} AND {B1} GROUP BY city, month),
matrix AS (SELECT m.city, m.year, m.month, m.mean_temp, m.days, b.baseline_mean, b.baseline_std,
  m.mean_temp - b.baseline_mean AS anomaly,
  CASE WHEN b.baseline_std > 0 THEN (m.mean_temp - b.baseline_mean) / b.baseline_std END AS z_score
  FROM monthly m LEFT JOIN base b ON m.city = b.city AND m.month = b.month)"""


def with_sql(*parts: str) -> str:
    """One WITH clause from named blocks; each block is a comma-separated list of CTEs."""
    return "WITH " + ",".join(p.strip() for p in parts)
