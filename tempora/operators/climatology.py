"""Region aggregation, baselines, anomalies and rolling statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.calendar import with_year_month_day, ytd_slice
from tempora.functions.numeric import between_years, ratio
from tempora.spec import ObservationSpec


def region_daily(daily: DataFrame, spec: ObservationSpec, cutoff: str | None = None) -> DataFrame:
    """Unweighted mean over entities of every measure present, one row per day."""
    src = daily if cutoff is None else ytd_slice(with_year_month_day(daily, spec.time), cutoff)
    out = src.groupBy(spec.time).agg(*[F.avg(c).alias(c) for c in spec.present(daily)])
    return with_year_month_day(out, spec.time)


def entity_daily(daily: DataFrame, spec: ObservationSpec, cutoff: str) -> DataFrame:
    """Year-to-date slice of the entity table with year and month-day columns."""
    known = daily.filter(F.col(spec.entity).isNotNull())
    return ytd_slice(with_year_month_day(known, spec.time), cutoff)


def daily_climatology(daily: DataFrame, spec: ObservationSpec, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Mean and sample deviation per group and month-day over the baseline years."""
    aggs = [
        F.avg(spec.temp).alias("climatology_temp_mean"),
        F.stddev_samp(spec.temp).alias("climatology_temp_std"),
        F.avg(spec.precip).alias("climatology_precip_mean"),
        F.stddev_samp(spec.precip).alias("climatology_precip_std"),
    ]
    if spec.snow in daily.columns:
        aggs += [
            F.avg(spec.snow).alias("climatology_snow_mean"),
            F.stddev_samp(spec.snow).alias("climatology_snow_std"),
        ]
    if spec.sun in daily.columns:
        aggs.append(F.avg(spec.sun).alias("climatology_sunshine_mean"))
    return (
        daily.filter(between_years(F.col("year"), spec.baseline))
        .groupBy(*group_cols, "month_day").agg(*aggs)
    )


def rolling(agg: Column, width: int | None, group_cols: tuple[str, ...], time: str) -> Column:
    """A trailing row window that restarts every calendar year; ``width`` None means cumulative.

    One partition is one year of one daily series, at most 366 rows.
    """
    start = Window.unboundedPreceding if width is None else 1 - width
    w = Window.partitionBy(*group_cols, "year").orderBy(time).rowsBetween(start, Window.currentRow)
    return agg.over(w)


def with_rolling_anomalies(df: DataFrame, spec: ObservationSpec, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """7- and 30-row rolling and cumulative figures of the anomaly columns."""
    t, p = F.col("temp_anomaly"), F.col("precip_anomaly")
    cols = {
        "rolling_7d_temp_anomaly": rolling(F.avg(t), 7, group_cols, spec.time),
        "rolling_30d_temp_anomaly": rolling(F.avg(t), 30, group_cols, spec.time),
        "rolling_7d_precip_anomaly": rolling(F.sum(p), 7, group_cols, spec.time),
        # a missing day has no cumulative value, the following day continues the sum
        "cumulative_precip_anomaly": F.when(p.isNotNull(), rolling(F.sum(p), None, group_cols, spec.time)),
    }
    if "snow_anomaly" in df.columns:
        cols["rolling_7d_snow_anomaly"] = rolling(F.sum("snow_anomaly"), 7, group_cols, spec.time)
    return df.withColumns(cols)


def daily_anomalies(
    daily: DataFrame, climatology: DataFrame, spec: ObservationSpec, group_cols: tuple[str, ...] = ()
) -> DataFrame:
    """Left-join the climatology on (group, month-day) and derive anomalies; ``daily`` may be a stream.

    The climatology has up to 366 rows per entity, so it carries no broadcast hint; Spark
    broadcasts it when it is below the size threshold.
    """
    joined = daily.join(climatology, [*group_cols, "month_day"], "left")
    cols = {
        "temp_anomaly": F.col(spec.temp) - F.col("climatology_temp_mean"),
        "precip_anomaly": F.col(spec.precip) - F.col("climatology_precip_mean"),
    }
    if spec.snow in daily.columns and "climatology_snow_mean" in climatology.columns:
        cols["snow_anomaly"] = F.col(spec.snow) - F.col("climatology_snow_mean")
    return joined.withColumns(cols)


def apply_daily_climatology(
    daily: DataFrame, climatology: DataFrame, spec: ObservationSpec, group_cols: tuple[str, ...] = ()
) -> DataFrame:
    """Daily anomalies with their rolling and cumulative figures."""
    return with_rolling_anomalies(daily_anomalies(daily, climatology, spec, group_cols), spec, group_cols)


def current_daily_anomalies(
    daily: DataFrame, spec: ObservationSpec, group_cols: tuple[str, ...] = ()
) -> DataFrame:
    """Enriched daily rows of the current year against the baseline climatology."""
    clim = daily_climatology(daily, spec, group_cols)
    current = daily.filter(F.col("year") == spec.current_year)
    return apply_daily_climatology(current, clim, spec, group_cols)


def monthly_totals(daily: DataFrame, spec: ObservationSpec, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Monthly mean temperature and sums per group, year and month; an empty sum is zero."""
    aggs = [
        F.avg(spec.temp).alias("temp_mean"),
        F.coalesce(F.sum(spec.precip), F.lit(0.0)).alias("precip_total"),
        F.count(spec.time).alias("days"),
    ]
    if spec.snow in daily.columns:
        aggs.append(F.coalesce(F.sum(spec.snow), F.lit(0.0)).alias("snowfall_total"))
    if spec.sun in daily.columns:
        aggs.append(F.coalesce(F.sum(spec.sun), F.lit(0.0)).alias("sunshine_total"))
    return daily.groupBy(*group_cols, "year", F.month(spec.time).alias("month")).agg(*aggs)


def monthly_baseline(monthly: DataFrame, spec: ObservationSpec, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Aggregate of the aggregate: mean and deviation per month over the summary baseline."""
    return (
        monthly.filter(between_years(F.col("year"), spec.summary_baseline))
        .groupBy(*group_cols, "month").agg(
            F.avg("temp_mean").alias("climatology_temp_mean"),
            F.stddev_samp("temp_mean").alias("climatology_temp_std"),
            F.avg("precip_total").alias("climatology_precip_mean"),
            F.stddev_samp("precip_total").alias("climatology_precip_std"),
        )
    )


def monthly_anomalies(daily: DataFrame, spec: ObservationSpec, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Monthly anomaly and z-score of the current year.

    The baseline is read from a window over (group, month), whose partitions hold one row per
    year, so the source is scanned once and nothing is joined.
    """
    monthly = monthly_totals(daily, spec, group_cols)
    w = Window.partitionBy(*group_cols, "month")
    base = between_years(F.col("year"), spec.summary_baseline)
    t, p = F.when(base, F.col("temp_mean")), F.when(base, F.col("precip_total"))
    return (
        monthly.withColumns({
            "climatology_temp_mean": F.avg(t).over(w),
            "climatology_temp_std": F.stddev_samp(t).over(w),
            "climatology_precip_mean": F.avg(p).over(w),
            "climatology_precip_std": F.stddev_samp(p).over(w),
        })
        .filter(F.col("year") == spec.current_year)
        .withColumnsRenamed({"temp_mean": "current_temp_mean", "precip_total": "current_precip_total"})
        .withColumns({
            "temp_anomaly": F.col("current_temp_mean") - F.col("climatology_temp_mean"),
            "precip_anomaly": F.col("current_precip_total") - F.col("climatology_precip_mean"),
        })
        .withColumns({
            "temp_zscore": ratio(F.col("temp_anomaly"), F.col("climatology_temp_std")),
            "precip_zscore": ratio(F.col("precip_anomaly"), F.col("climatology_precip_std")),
        })
    )


def monthly_means(daily: DataFrame, spec: ObservationSpec) -> DataFrame:
    """Mean and count of the non-missing temperatures per entity, year and month.

    Rows without a temperature are dropped first, so a month without any has no row.
    """
    return (
        daily.filter(F.col(spec.entity).isNotNull() & F.col(spec.temp).isNotNull())
        .groupBy(F.col(spec.entity), F.year(spec.time).alias("year"), F.month(spec.time).alias("month"))
        .agg(F.avg(spec.temp).alias("mean_temp"), F.count(spec.temp).alias("days"))
    )


def baseline_stats(monthly: DataFrame, spec: ObservationSpec) -> DataFrame:
    """Mean and deviation of the monthly means over the baseline years; one year gives deviation 0."""
    return (
        monthly.filter(between_years(F.col("year"), spec.baseline))
        .groupBy(spec.entity, "month").agg(
            F.avg("mean_temp").alias("baseline_mean"),
            F.coalesce(F.stddev_samp("mean_temp"), F.lit(0.0)).alias("baseline_std"),
        )
    )


def with_anomaly(df: DataFrame) -> DataFrame:
    """Anomaly and z-score from mean_temp, baseline_mean and baseline_std; NULL without a baseline."""
    anomaly = F.col("mean_temp") - F.col("baseline_mean")
    return df.withColumn("anomaly", anomaly).withColumn(
        "z_score", F.when(F.col("baseline_std") > 0, ratio(F.col("anomaly"), F.col("baseline_std")))
    )


def join_baseline(monthly: DataFrame, baseline: DataFrame, spec: ObservationSpec) -> DataFrame:
    """Side-input form: left join of a stored baseline table on (entity, month)."""
    return with_anomaly(monthly.join(baseline, [spec.entity, "month"], "left"))


def monthly_anomaly_matrix(monthly: DataFrame, spec: ObservationSpec) -> DataFrame:
    """Entity x month matrix for all years from monthly means.

    Equals ``join_baseline(monthly, baseline_stats(monthly))`` but reads the source once: the
    baseline is a window over (entity, month), one row per year.
    """
    w = Window.partitionBy(spec.entity, "month")
    base = F.when(between_years(F.col("year"), spec.baseline), F.col("mean_temp"))
    n = F.count(base).over(w)
    return with_anomaly(
        monthly.withColumns({
            "baseline_mean": F.avg(base).over(w),
            "baseline_std": F.when(n > 0, F.coalesce(F.stddev_samp(base).over(w), F.lit(0.0))),
        })
    ).select(spec.entity, "year", "month", "mean_temp", "days", "baseline_mean", "baseline_std", "anomaly", "z_score")


def rounded_matrix(matrix: DataFrame, digits: int = 2) -> DataFrame:
    """Presentation form of the matrix; rounding happens here and nowhere earlier."""
    cols = ["mean_temp", "baseline_mean", "baseline_std", "anomaly", "z_score"]
    return matrix.withColumns({c: F.round(c, digits) for c in cols})
