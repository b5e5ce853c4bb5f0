"""Extremes, top lists and comparisons over result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def extreme_months(matrix: DataFrame, entity: str, keep: int = 2) -> DataFrame:
    """Warmest and coldest months per (entity, year) with the runner-up; a partition has 12 rows.

    Equal anomalies are ordered by month.
    """
    rows = matrix.filter(F.col("anomaly").isNotNull())
    w = Window.partitionBy(entity, "year")
    ranked = rows.withColumns({
        "_warm": F.row_number().over(w.orderBy(F.col("anomaly").desc(), "month")),
        "_cold": F.row_number().over(w.orderBy("anomaly", "month")),
    })
    both = F.array(
        F.struct(F.lit("warmest").alias("extreme"), F.col("_warm").alias("rank")),
        F.struct(F.lit("coldest").alias("extreme"), F.col("_cold").alias("rank")),
    )
    return ranked.withColumn("_e", F.explode(both)).select("*", "_e.extreme", "_e.rank").filter(
        F.col("rank") <= keep).drop("_warm", "_cold", "_e")


def extreme_years(annual: DataFrame, keys: list[str], by: str, carry: list[str]) -> DataFrame:
    """Warmest and coldest year per key with the carried columns; the earlier year wins a tie."""
    row = F.struct("year", by, *carry)
    hot = F.struct(F.col(by), (-F.col("year")).alias("y"))
    cold = F.struct(F.col(by), F.col("year").alias("y"))
    return annual.filter(F.col(by).isNotNull()).groupBy(*keys).agg(
        F.max_by(row, hot).alias("warmest"), F.min_by(row, cold).alias("coldest"))


def top_by_abs(df: DataFrame, column: str, n: int, ties: list[str]) -> DataFrame:
    """The ``n`` rows of largest magnitude; Spark keeps n rows per task and merges those."""
    return df.orderBy(F.abs(F.round(column, 6)).desc_nulls_last(), *ties).limit(n)


def _last_years(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("year").desc())
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def recent_extremes(annual: DataFrame, keys: list[str], value: str, years: int = 10) -> DataFrame:
    """Warmest and coldest among the last ``years`` rows of each key."""
    e = extreme_years(_last_years(annual, keys, years), keys, value, [])
    return e.select(
        *keys, F.col("warmest.year").alias("warmest_year"), F.col(f"warmest.{value}").alias("warmest"),
        F.col("coldest.year").alias("coldest_year"), F.col(f"coldest.{value}").alias("coldest"))


def positives_among_last(annual: DataFrame, keys: list[str], value: str, years: int = 10) -> DataFrame:
    return _last_years(annual, keys, years).groupBy(*keys).agg(
        F.count_if(F.col(value) > 0).alias("positive"), F.count("*").alias("years"))


def latest_month_extremes(monthly: DataFrame, entity: str, zscore: str) -> DataFrame:
    """Most and least anomalous entity of the latest month that has at least two entities.

    One map-side combined aggregate per month, then the latest of those few rows.
    """
    z = F.col(zscore)
    by_month = monthly.groupBy("year", "month").agg(
        F.min_by(entity, F.struct((-z).alias("z"), F.col(entity).alias("e"))).alias(f"warmest_{entity}"),
        F.max(z).alias("warmest_z"),
        F.min_by(entity, F.struct(z.alias("z"), F.col(entity).alias("e"))).alias(f"coldest_{entity}"),
        F.min(z).alias("coldest_z"), F.count("*").alias("entities"))
    return by_month.filter("entities >= 2").orderBy(F.desc("year"), F.desc("month")).limit(1)


def year_on_year(annual: DataFrame, keys: list[str], value: str) -> DataFrame:
    prev = F.lag(value).over(Window.partitionBy(*keys).orderBy("year"))
    return annual.withColumn("previous", prev).withColumn("change", F.col(value) - F.col("previous"))


def latest_versus_others(annual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every other year of a slice against its latest year.

    The latest row travels along a window over the slice (one row per year), which replaces the
    self-join.
    """
    w = Window.partitionBy(*keys)
    latest = F.max(F.struct(F.col("year"), F.col(value).alias("v"))).over(w)
    return (
        annual.withColumn("_l", latest).filter(F.col("year") != F.col("_l.year"))
        .withColumns({
            "latest_year": F.col("_l.year"), "other_year": F.col("year"),
            "latest_temp": F.col("_l.v"), "other_temp": F.col(value), "delta": F.col("_l.v") - F.col(value),
        }).drop("_l")
    )
