"""Monthly degree days: year to date, October-April season, recent months and publication lag."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.calendar import month_label
from tempora.functions.numeric import between_years

SEASON_START, SEASON_END = 10, 4


def monthly_degree_days(daily: DataFrame, geo: str, time: str, temp: str, threshold: float = 18.0) -> DataFrame:
    """Sum of the shortfall below the threshold per (geo, ``yyyy-MM``)."""
    return (
        daily.filter(F.col(temp).isNotNull())
        .groupBy(geo, F.date_format(time, "yyyy-MM").alias("month"))
        .agg(F.sum(F.greatest(F.lit(0.0), F.lit(threshold) - F.col(temp))).alias("hdd"))
    )


def _parts(series: DataFrame, geo: str) -> DataFrame:
    """Year, month number, heating season and the latest month of each series.

    One series has one row per month, so its window partition stays small.
    """
    y, m = F.split("month", "-")[0].cast("int"), F.split("month", "-")[1].cast("int")
    return (
        series.withColumns({"year": y, "mo": m, "last": F.max("month").over(Window.partitionBy(geo))})
        .withColumns({
            "last_year": F.split("last", "-")[0].cast("int"),
            "last_mo": F.split("last", "-")[1].cast("int"),
            "season": F.when(F.col("mo") >= SEASON_START, F.col("year"))
            .when(F.col("mo") <= SEASON_END, F.col("year") - 1),
        })
    )


def ytd_degree_days(series: DataFrame, geo: str, baseline: tuple[int, int]) -> DataFrame:
    """Latest year with data against the mean of the same calendar months in the baseline years."""
    p = _parts(series, geo)
    same = Window.partitionBy(geo, "mo")
    flagged = p.withColumn("in_ytd", F.max(F.col("year") == F.col("last_year")).over(same))
    per_year = flagged.filter("in_ytd").groupBy(geo, "year", "last_year", "last_mo").agg(
        F.sum("hdd").alias("total"), F.count("*").alias("n"))
    now = F.col("year") == F.col("last_year")
    base = F.when(between_years(F.col("year"), baseline), F.col("total"))
    full = F.col("last_mo") == 12
    return per_year.groupBy(geo, "last_year", "last_mo").agg(
        F.sum(F.when(now, F.col("n"))).alias("months"),
        F.sum(F.when(now, F.col("total"))).alias("total_hdd"),
        F.coalesce(F.avg(base), F.lit(0.0)).alias("baseline_mean"),
    ).select(
        geo,
        F.when(full, F.concat(F.lit("Full year "), F.col("last_year").cast("string")))
        .otherwise(F.concat(F.lit("Jan–"), month_label(F.col("last_mo")), F.lit(" "), F.col("last_year").cast("string")))
        .alias("label"),
        "months", "total_hdd", "baseline_mean",
        (F.col("total_hdd") - F.col("baseline_mean")).alias("anomaly"),
    )


def season_degree_days(
    series: DataFrame, geo: str, baseline: tuple[int, int], complete_seasons_only: bool = False
) -> DataFrame:
    """Most recent October-April season with data against the same months of the baseline seasons.

    A baseline month counts when both its own year and its season's first year lie in the
    baseline, which leaves the last season with its autumn months only;
    ``complete_seasons_only`` drops baseline seasons that lack a month.
    """
    p = _parts(series, geo)
    first = F.col("last_year") - F.when(F.col("last_mo") < SEASON_START, 1).otherwise(0)
    by_geo = Window.partitionBy(geo)
    p = p.withColumns({
        "has_first": F.max(F.coalesce(F.col("season") == first, F.lit(False))).over(by_geo),
        "has_prev": F.max(F.coalesce(F.col("season") == first - 1, F.lit(False))).over(by_geo),
    }).withColumn(
        "ref", F.when(F.col("has_first"), first).when(F.col("has_prev"), first - 1).otherwise(F.col("last_year") - 1)
    )
    in_ref = F.coalesce(F.col("season") == F.col("ref"), F.lit(False))
    p = p.withColumn("wanted", F.max(in_ref).over(Window.partitionBy(geo, "mo")))
    counted = between_years(F.col("year"), baseline) & between_years(F.col("season"), baseline)
    per_season = p.filter("season is not null and wanted").groupBy(geo, "ref", "season").agg(
        F.sum("hdd").alias("total"), F.count("*").alias("n"),
        F.sum(F.when(counted, F.col("hdd"))).alias("base_total"),
        F.count_if(counted).alias("base_n"),
    )
    now = F.col("season") == F.col("ref")
    ref_months = F.max(F.when(now, F.col("n"))).over(Window.partitionBy(geo))
    usable = F.col("base_n") > 0
    if complete_seasons_only:
        usable = usable & (F.col("base_n") == F.col("ref_months"))
    found = per_season.withColumn("ref_months", ref_months).groupBy(geo, "ref").agg(
        F.sum(F.when(now, F.col("n"))).alias("months_included"),
        F.sum(F.when(now, F.col("total"))).alias("total_hdd"),
        F.avg(F.when(usable, F.col("base_total"))).alias("baseline_mean"),
    )
    # a series without any heating month still gets its row of zeros
    every = p.groupBy(geo).agg(F.max("ref").alias("ref"))
    out = every.join(found, [geo, "ref"], "left").fillna(0, ["months_included"]).fillna(
        0.0, ["total_hdd", "baseline_mean"])
    return out.select(
        geo,
        F.concat(F.col("ref").cast("string"), F.lit("/"),
                 F.lpad(((F.col("ref") + 1) % 100).cast("string"), 2, "0")).alias("label"),
        "months_included", "total_hdd", "baseline_mean",
        (F.col("total_hdd") - F.col("baseline_mean")).alias("anomaly"),
    )


def recent_months(series: DataFrame, geo: str, count: int = 12) -> DataFrame:
    w = Window.partitionBy(geo).orderBy(F.col("month").desc())
    return series.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= count).drop("rn")


def publication_lag(series: DataFrame, geo: str, today: date) -> DataFrame:
    """Latest month of each series and its distance to ``today`` in months."""
    last = series.groupBy(geo).agg(F.max("month").alias("data_through"), F.count("*").alias("observations"))
    y, m = F.split("data_through", "-")[0].cast("int"), F.split("data_through", "-")[1].cast("int")
    return last.withColumn("data_lag_months", F.lit(today.year * 12 + today.month) - (y * 12 + m))


def empty_as_zeros(summary: DataFrame) -> DataFrame:
    """A single all-zero row when the series, and so the summary, is empty."""
    count = F.count("*")
    return summary.agg(
        F.when(count == 0, F.lit("n/a")).otherwise(F.max("label")).alias("label"),
        count.alias("series"),
        F.coalesce(F.sum("total_hdd"), F.lit(0.0)).alias("total_hdd"),
        F.coalesce(F.sum("anomaly"), F.lit(0.0)).alias("anomaly"),
    )
