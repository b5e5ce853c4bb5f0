"""Single-month histories per entity: cut at the same day every year, with their own baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.calendar import month_cutoff_slice, month_name, trailing_years
from tempora.functions.numeric import ratio
from tempora.spec import ObservationSpec


def with_own_baseline(annual: DataFrame, keys: list[str]) -> DataFrame:
    """Anomaly and z-score against the mean and deviation of the slice's own years.

    A zero or undefined deviation gives z-score 0.
    """
    w = Window.partitionBy(*keys)
    return annual.withColumns({
        "baseline_mean": F.avg("mean_temp_c").over(w),
        "baseline_std": F.coalesce(F.stddev_samp("mean_temp_c").over(w), F.lit(0.0)),
    }).withColumn("anomaly_c", F.col("mean_temp_c") - F.col("baseline_mean")).withColumn(
        "zscore", F.coalesce(ratio(F.col("anomaly_c"), F.col("baseline_std")), F.lit(0.0))
    )


def fill_own_baseline(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Stored annual rows: lenient casts, drop unusable rows, fill only missing anomaly and z."""
    w = Window.partitionBy(*keys)
    typed = stored.withColumns({
        "year": F.col("year").try_cast("double"),
        "mean_temp_c": F.col("mean_temp_c").try_cast("double"),
        "anomaly_c": F.col("anomaly_c").try_cast("double"),
        "zscore": F.col("zscore").try_cast("double"),
    }).dropna(subset=["year", "mean_temp_c"])
    mean, std = F.avg("mean_temp_c").over(w), F.stddev_samp("mean_temp_c").over(w)
    return (
        typed.withColumns({"_m": mean, "_s": std, "year": F.col("year").cast("int")})
        .withColumn("anomaly_c", F.coalesce("anomaly_c", F.col("mean_temp_c") - F.col("_m")))
        .withColumn("zscore", F.coalesce("zscore", ratio(F.col("anomaly_c"), F.col("_s")), F.lit(0.0)))
        .drop("_m", "_s")
    )


def month_histories(daily: DataFrame, spec: ObservationSpec, window_years: int = 90, min_years: int = 1) -> DataFrame:
    """All entities and calendar months at once: annual rows of the cut slice with own baseline.

    Every step partitions on (entity, month), so the daily table is shuffled once.
    """
    keys = [spec.entity, "month"]
    src = (
        daily.filter(F.col(spec.entity).isNotNull() & F.col(spec.time).isNotNull() & F.col(spec.temp).isNotNull())
        .select(spec.entity, spec.time, spec.temp)
        .withColumns({"year": F.year(spec.time), "month": F.month(spec.time)})
    )
    annual = (
        month_cutoff_slice(src, keys[:1], spec.time)
        .groupBy(*keys, "year").agg(
            F.avg(spec.temp).alias("mean_temp_c"),
            F.count(spec.time).alias("days_observed"),
            F.max("cutoff_day").alias("cutoff_day"),
            F.max("last_observation").alias("last_observation"),
        )
    )
    out = with_own_baseline(trailing_years(annual, keys, window_years), keys)
    if min_years > 1:
        out = out.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter(F.col("_n") >= min_years).drop("_n")
    return out


def month_slice(daily: DataFrame, spec: ObservationSpec, entity: str, month: int, window_years: int = 90) -> DataFrame:
    """One entity and month. Both filters come first and are matched without regard to case."""
    one = daily.filter((F.lower(spec.entity) == entity.lower()) & (F.month(spec.time) == month))
    return month_histories(one, spec, window_years)


def month_slice_from_matrix(matrix: DataFrame, month: int, entity_col: str, entity: str | None = None) -> DataFrame:
    """Fixed-baseline variant: the rows of one month of the anomaly matrix in the slice's schema."""
    rows = matrix.filter(F.col("month") == month)
    if entity is not None:
        rows = rows.filter(F.col(entity_col) == entity)
    return rows.withColumnsRenamed({
        "mean_temp": "mean_temp_c", "days": "days_observed", "anomaly": "anomaly_c", "z_score": "zscore",
    }).select(entity_col, "year", "month", "mean_temp_c", "days_observed", "anomaly_c", "zscore")


def slice_summary(annual: DataFrame, keys: list[str]) -> DataFrame:
    """Window, baseline, latest and extreme years of each slice, one row per key.

    Without stored cutoff the latest year's day count serves, limited to the month length.
    """
    latest_days = F.max_by("days_observed", "year")
    cutoff = F.max("cutoff_day") if "cutoff_day" in annual.columns else latest_days
    by_anomaly = F.struct("anomaly_c", (-F.col("year")).alias("y"))
    coldest = F.struct("anomaly_c", F.col("year").alias("y"))
    out = annual.groupBy(*keys).agg(
        F.min("year").alias("start_year"),
        F.max("year").alias("end_year"),
        F.count("*").alias("years_included"),
        cutoff.alias("_cut"),
        F.avg("mean_temp_c").alias("baseline_mean"),
        F.coalesce(F.stddev_samp("mean_temp_c"), F.lit(0.0)).alias("baseline_std"),
        F.max_by("mean_temp_c", "year").alias("latest_mean_temp"),
        F.max_by("anomaly_c", "year").alias("latest_anomaly"),
        F.max_by("zscore", "year").alias("latest_zscore"),
        F.max_by("year", by_anomaly).alias("warmest_year"),
        F.max("anomaly_c").alias("warmest_anomaly"),
        F.min_by("year", coldest).alias("coldest_year"),
        F.min("anomaly_c").alias("coldest_anomaly"),
    )
    length = F.dayofmonth(F.last_day(F.make_date("end_year", F.col("month"), F.lit(1))))
    cut = F.greatest(F.lit(1), F.least(F.col("_cut").cast("int"), length))
    return out.withColumns({
        "month_name": month_name(F.col("month")),
        "cutoff_day": cut,
        "execution_date": F.make_date("end_year", F.col("month"), cut),
    }).drop("_cut")


def stored_or_derived(stored: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """Stored slices win; keys without a stored slice come from the derived table."""
    missing = derived.join(stored.select(*keys).distinct(), keys, "left_anti")
    cols = [c for c in stored.columns if c in derived.columns]
    return stored.select(*cols).unionByName(missing.select(*cols))
