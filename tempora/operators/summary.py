"""Annual tables, year-to-date summaries, rankings and threshold days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.calendar import with_year_month_day, ytd_slice
from tempora.functions.numeric import between_years, ratio
from tempora.spec import ObservationSpec

# (threshold name, column, operator, limit) as counted on the region's daily mean extremes
DEFAULT_THRESHOLDS = (
    ("frost_days", "tmin", "<", 0.0),
    ("hot_days", "tmax", ">", 25.0),
    ("tropical_nights", "tmin", ">", 20.0),
    ("cold_nights", "tmin", "<", -15.0),
)


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def annual_summary(daily_ytd: DataFrame, spec: ObservationSpec, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row per group and year: mean temperature, sums and day count of the slice."""
    optional = (
        (spec.snow, "ytd_total_snowfall", _total),
        (spec.sun, "ytd_total_sunshine", _total),
        (spec.wind, "ytd_mean_wind_speed", F.avg),
        (spec.et0, "ytd_total_et0", _total),
    )
    aggs = [
        F.avg(spec.temp).alias("ytd_mean_temp"),
        _total(spec.precip).alias("ytd_total_precip"),
        F.count(spec.time).alias("days"),
    ]
    aggs += [fn(c).alias(name) for c, name, fn in optional if c in daily_ytd.columns]
    return daily_ytd.groupBy(*group_cols, "year").agg(*aggs)


def weather_summary(annual: DataFrame, spec: ObservationSpec, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Current year against the baseline, one row per group, in a single conditional aggregate.

    Groups without a row for the current year are left out.
    """
    base = between_years(F.col("year"), spec.summary_baseline)
    cur = F.col("year") == spec.current_year

    def b_mean(c: str) -> Column:
        return F.avg(F.when(base, F.col(c)))

    def b_std(c: str) -> Column:
        return F.stddev_samp(F.when(base, F.col(c)))

    def now(c: str) -> Column:
        return F.max(F.when(cur, F.col(c)))

    aggs = [
        now("days").alias("days_observed"),
        now("ytd_mean_temp").alias("ytd_mean_temp"),
        now("ytd_total_precip").alias("ytd_total_precip"),
        b_mean("ytd_mean_temp").alias("expected_temp_mean"),
        b_std("ytd_mean_temp").alias("expected_temp_std"),
        b_mean("ytd_total_precip").alias("expected_precip_mean"),
        b_std("ytd_total_precip").alias("expected_precip_std"),
    ]
    have = set(annual.columns)
    if "ytd_total_snowfall" in have:
        aggs += [now("ytd_total_snowfall").alias("snowfall_total"), b_mean("ytd_total_snowfall").alias("snowfall_baseline_mean")]
    if "ytd_total_sunshine" in have:
        aggs += [now("ytd_total_sunshine").alias("_sun"), b_mean("ytd_total_sunshine").alias("_sun_base")]
    if "ytd_mean_wind_speed" in have:
        aggs.append(now("ytd_mean_wind_speed").alias("mean_wind"))
    if "ytd_total_et0" in have:
        aggs.append(now("ytd_total_et0").alias("total_et0"))

    out = annual.groupBy(*group_cols).agg(*aggs).filter(F.col("days_observed").isNotNull())
    out = out.withColumn("current_year", F.lit(spec.current_year))
    for label, value, mean, std in (
        ("temp", "ytd_mean_temp", "expected_temp_mean", "expected_temp_std"),
        ("precip", "ytd_total_precip", "expected_precip_mean", "expected_precip_std"),
    ):
        dev = F.col(value) - F.col(mean)
        out = out.withColumns({
            f"{label}_deviation": dev,
            f"{label}_percent_deviation": ratio(dev, F.abs(F.col(mean))) * 100.0,
            f"{label}_zscore": ratio(dev, F.col(std)),
        })
    if "ytd_total_snowfall" in have:
        out = out.withColumn("snowfall_deviation", F.col("snowfall_total") - F.col("snowfall_baseline_mean"))
    if "ytd_total_sunshine" in have:
        out = out.withColumns({
            "sunshine_hours": F.round(F.col("_sun") / 3600.0, 1),
            "sunshine_baseline_hours": F.round(F.col("_sun_base") / 3600.0, 1),
            "sunshine_deviation_hours": F.round((F.col("_sun") - F.col("_sun_base")) / 3600.0, 1),
        }).drop("_sun", "_sun_base")
    return out


def latest_metrics(current_daily: DataFrame, spec: ObservationSpec, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Climatology of the slice and the figures of the latest row, one row per group."""
    t = F.col(spec.time)

    def last(c: str, name: str) -> Column:
        return F.max_by(F.col(c), t).alias(name)

    aggs = [
        F.max(t).alias("latest_time"),
        F.avg("climatology_temp_mean").alias("climatology_ytd_mean"),
        F.sum("climatology_precip_mean").alias("climatology_ytd_total"),
        last("temp_anomaly", "latest_daily_temp_anomaly"),
        last("rolling_7d_temp_anomaly", "latest_7d_temp_anomaly"),
        last("rolling_30d_temp_anomaly", "latest_30d_temp_anomaly"),
        last("precip_anomaly", "latest_daily_precip_anomaly"),
        last("rolling_7d_precip_anomaly", "latest_7d_precip_anomaly"),
        last("cumulative_precip_anomaly", "latest_cumulative_precip_anomaly"),
    ]
    if "snow_anomaly" in current_daily.columns:
        aggs += [
            last("snow_anomaly", "latest_daily_snow_anomaly"),
            last("rolling_7d_snow_anomaly", "latest_7d_snow_anomaly"),
        ]
    return current_daily.groupBy(*group_cols).agg(*aggs)


def trend_direction(df: DataFrame, dead_band: float = 0.5) -> DataFrame:
    """+1 when the latest week runs above the season by more than the dead band, -1 below, else 0."""
    gap = F.col("latest_7d_temp_anomaly") - F.col("temp_deviation")
    return df.withColumn(
        "trend_direction", F.when(gap > dead_band, 1).when(gap < -dead_band, -1).otherwise(0)
    )


def ranked_by_abs(summary: DataFrame, kind: str, deviation: str, zscore: str, entity: str) -> DataFrame:
    """Entities ordered by the absolute z-score; a missing z goes last, ties by name.

    The order is a range-partitioned sort, not a window over the whole table.
    """
    return summary.select(
        F.lit(kind).alias("ranking"), entity,
        F.col(deviation).alias("anomaly"), F.col(zscore).alias("z_score"),
    ).orderBy(F.abs("z_score").desc_nulls_last(), entity)


def combined_ranking(summary: DataFrame, entity: str) -> DataFrame:
    score = F.when(
        F.col("temp_zscore").isNotNull() & F.col("precip_zscore").isNotNull(),
        F.greatest(F.abs("temp_zscore"), F.abs("precip_zscore")),
    )
    return summary.select(
        entity, score.alias("combined_score"),
        F.col("temp_zscore").alias("temperature_z"), F.col("precip_zscore").alias("precipitation_z"),
    ).orderBy(F.col("combined_score").desc_nulls_last(), entity)


def city_rankings(summary: DataFrame, entity: str) -> dict[str, DataFrame]:
    return {
        "temperature": ranked_by_abs(summary, "temperature", "temp_deviation", "temp_zscore", entity),
        "precipitation": ranked_by_abs(summary, "precipitation", "precip_deviation", "precip_zscore", entity),
        "combined": combined_ranking(summary, entity),
    }


def extreme_entities(summary: DataFrame, entity: str) -> DataFrame:
    """Entity with the strongest recent warm-up and entity with the largest precipitation deficit."""
    warm = F.struct(F.col("latest_7d_temp_anomaly").alias("v"))
    return summary.agg(
        F.min_by(entity, F.struct((-warm["v"]).alias("v"), F.col(entity).alias("e"))).alias("warmest_entity"),
        F.max("latest_7d_temp_anomaly").alias("warmest_7d_anomaly"),
        F.min_by(entity, F.struct(F.col("precip_deviation").alias("v"), F.col(entity).alias("e"))).alias("driest_entity"),
        F.min("precip_deviation").alias("driest_deviation"),
    )


def _hit(col: str, op: str, limit: float) -> Column:
    return F.col(col) < limit if op == "<" else F.col(col) > limit


def region_extremes(daily: DataFrame, spec: ObservationSpec) -> DataFrame:
    """Region mean of the daily minimum and maximum over entities in the year-to-date slice."""
    src = ytd_slice(with_year_month_day(daily, spec.time), spec.cutoff)
    return src.groupBy("year", spec.time).agg(
        F.avg(spec.temp_min).alias("tmin"), F.avg(spec.temp_max).alias("tmax")
    )


def threshold_counts(extremes: DataFrame, thresholds=DEFAULT_THRESHOLDS) -> DataFrame:
    """Days per year beyond each threshold."""
    return extremes.groupBy("year").agg(*[F.count_if(_hit(c, op, x)).alias(n) for n, c, op, x in thresholds])


def threshold_days(daily: DataFrame, spec: ObservationSpec, thresholds=DEFAULT_THRESHOLDS) -> DataFrame | None:
    """Current count, mean of the per-year baseline counts and their difference, one row per metric.

    None when the table has no minimum or maximum column.
    """
    if not {spec.temp_min, spec.temp_max} <= set(daily.columns):
        return None
    per_year = threshold_counts(region_extremes(daily, spec), thresholds)
    names = [n for n, *_ in thresholds]
    base = between_years(F.col("year"), spec.baseline)
    pairs = per_year.agg(*[
        F.struct(
            F.lit(n).alias("metric"),
            F.coalesce(F.sum(F.when(F.col("year") == spec.current_year, F.col(n))), F.lit(0)).cast("long").alias("current"),
            F.coalesce(F.avg(F.when(base, F.col(n))), F.lit(0.0)).alias("mean"),
        ).alias(n) for n in names
    ])
    return pairs.select(F.explode(F.array(*names)).alias("m")).select(
        "m.metric", "m.current",
        F.round("m.mean", 1).alias("baseline_mean"),
        F.round(F.col("m.current") - F.col("m.mean"), 1).alias("anomaly"),
    )
