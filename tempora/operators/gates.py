"""Quality gates: every gate yields rows (check, value, threshold, passed) and the first failing reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(facts: DataFrame, keys: list[str], checks: list[tuple[str, Column, float, Column]]) -> DataFrame:
    """Turn wide facts into one row per check, in order, with the reason of the first failure."""
    cells = [
        F.struct(
            F.lit(i).alias("position"), F.lit(n).alias("check"), v.cast("double").alias("value"),
            F.lit(float(t)).alias("threshold"), F.coalesce(ok, F.lit(True)).alias("passed"),
        ) for i, (n, v, t, ok) in enumerate(checks)
    ]
    wide = facts.select(*keys, F.array(*cells).alias("c"))
    failed = F.filter("c", lambda x: ~x["passed"])
    return (
        wide.withColumn("first_failure", F.when(F.size(failed) > 0, F.element_at(failed, 1)["check"]))
        .select(*keys, "first_failure", F.explode("c").alias("c"))
        .select(*keys, "c.check", "c.value", "c.threshold", "c.passed", "first_failure")
    )


def month_counters(
    monthly: DataFrame, keys: list[str], min_days: int = 5, max_temp_z: float = 3.5, max_precip_z: float = 3.5
) -> DataFrame:
    """Sparse completed months and months with an extreme z-score.

    The latest month is still running and is not counted as sparse.
    """
    sparse = F.struct(F.col("month"), F.col("days"))
    return monthly.groupBy(*keys).agg(
        F.max("month").alias("latest_month"),
        F.count_if(F.col("days") < min_days).alias("_sparse"),
        F.max_by(sparse, "month").alias("_last"),
        F.count_if(F.abs("temp_zscore") > max_temp_z).alias("n_extreme_temp_months"),
        F.count_if(F.abs("precip_zscore") > max_precip_z).alias("n_extreme_precip_months"),
    ).select(
        *keys,
        (F.col("_sparse") - F.when(F.col("_last.days") < min_days, 1).otherwise(0)).cast("long").alias("n_weak_months"),
        "n_extreme_temp_months", "n_extreme_precip_months",
    )


def weather_gate(
    summary: DataFrame, monthly: DataFrame, keys: list[str], min_days: int = 10, min_month_days: int = 5,
    max_temp_z: float = 5.0, max_precip_z: float = 5.0, max_month_temp_z: float = 3.5, max_month_precip_z: float = 3.5,
) -> DataFrame:
    """Days observed, z-scores (skipped when missing), sparse and extreme months, in this order.

    Summary and monthly counters meet by union and regrouping, so the gate needs no join and
    works with or without key columns.
    """
    counters = month_counters(monthly, keys, min_month_days, max_month_temp_z, max_month_precip_z)
    names = ["days_observed", "temp_zscore", "precip_zscore", "n_weak_months", "n_extreme_temp_months", "n_extreme_precip_months"]
    both = summary.select(*keys, *names[:3]).unionByName(counters, allowMissingColumns=True)
    facts = both.groupBy(*keys).agg(*[F.max(n).alias(n) for n in names])
    c = F.col
    return _rows(facts, keys, [
        ("days_observed", c(names[0]), min_days, c(names[0]) >= min_days),
        ("temp_zscore", c(names[1]), max_temp_z, F.abs(names[1]) <= max_temp_z),
        ("precip_zscore", c(names[2]), max_precip_z, F.abs(names[2]) <= max_precip_z),
        ("weak_months", c(names[3]), 0, c(names[3]) == 0),
        ("extreme_temp_months", c(names[4]), 0, c(names[4]) == 0),
        ("extreme_precip_months", c(names[5]), 0, c(names[5]) == 0),
    ])


def model_gate(metrics: DataFrame, keys: list[str] | None = None, max_mse: float = 50.0, min_r2: float = 0.65) -> DataFrame:
    return _rows(metrics, keys or [], [
        ("mse", F.col("mse"), max_mse, F.col("mse") <= max_mse),
        ("r2", F.col("r2"), min_r2, F.col("r2") >= min_r2),
    ])


def month_slice_gate(
    annual: DataFrame, keys: list[str], expected_years: int, min_days: int, max_abs_z: float
) -> DataFrame:
    """Number of years, thinnest slice and largest absolute z-score of each slice."""
    facts = annual.groupBy(*keys).agg(
        F.count("*").alias("years"), F.min("days_observed").alias("min_days"), F.max(F.abs("zscore")).alias("max_z"))
    return _rows(facts, keys, [
        ("years_included", F.col("years"), expected_years, F.col("years") == expected_years),
        ("min_days", F.col("min_days"), min_days, F.col("min_days") >= min_days),
        ("max_abs_z", F.col("max_z"), max_abs_z, F.col("max_z") <= max_abs_z),
    ])


def short_history_tag(summary: DataFrame, years: str, min_years: int = 5) -> DataFrame:
    """Warning text for histories too short to give a reliable deviation."""
    return summary.withColumn(
        "data_quality_warning",
        F.when(F.col(years) < min_years, F.format_string("only %d year(s) of history", F.col(years))),
    )
