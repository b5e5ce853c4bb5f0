"""Calendar columns and time slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# English month names in calendar order.
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)
MONTH_LABELS = tuple(n[:3] for n in MONTH_NAMES)


def with_calendar(df: DataFrame, time: str = "time") -> DataFrame:
    t = F.col(time)
    return df.withColumns({
        "year": F.year(t),
        "month": F.month(t),
        "day": F.dayofmonth(t),
        "day_of_year": F.dayofyear(t),
        "month_day": F.date_format(t, "MM-dd"),
    })


def with_year_month_day(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumns({"year": F.year(time), "month_day": F.date_format(time, "MM-dd")})


def year_range(time: Column, first: int, last: int) -> Column:
    """Whole calendar years as a plain date range, so that the scan can prune on it."""
    return (time >= F.lit(f"{first}-01-01").cast("date")) & (time < F.lit(f"{last + 1}-01-01").cast("date"))


def ytd_slice(df: DataFrame, cutoff: str) -> DataFrame:
    """Rows of every year up to the cutoff month-day, compared as text so 02-29 keeps its place."""
    return df.filter(F.col("month_day") <= F.lit(cutoff))


def month_cutoff_slice(df: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """Per key and calendar month, keep the days up to the day of the latest observation.

    Adds ``cutoff_day`` and ``last_observation``. The window holds one row per calendar day of
    one month over all years, and its partitioning is reused by a following ``groupBy`` on the
    same keys plus year.
    """
    w = Window.partitionBy(*keys, "month")
    return (
        df.withColumn("last_observation", F.max(time).over(w))
        .withColumn("cutoff_day", F.dayofmonth("last_observation"))
        .filter(F.dayofmonth(time) <= F.col("cutoff_day"))
    )


def execution_cutoff_day(execution_date: Column, month: Column) -> Column:
    """Day of the execution date in its own month, otherwise the length of ``month`` that year."""
    month_end = F.last_day(F.make_date(F.year(execution_date), month, F.lit(1)))
    return F.when(F.month(execution_date) == month, F.dayofmonth(execution_date)).otherwise(
        F.dayofmonth(month_end)
    )


def trailing_years(df: DataFrame, keys: list[str], years: int) -> DataFrame:
    """Keep the last ``years`` calendar years before and including the latest year of each key.

    Runs on tables with one row per key and year, so a window partition is a few dozen rows.
    """
    w = Window.partitionBy(*keys)
    return (
        df.withColumn("_latest", F.max("year").over(w))
        .filter(F.col("year") > F.col("_latest") - F.lit(years))
        .drop("_latest")
    )


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES]), month)


def month_label(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in MONTH_LABELS]), month)


def circular_days(target_doy: Column, reach: int = 7) -> Column:
    """The days of year (1..366) whose circular distance to ``target_doy`` is within ``reach``.

    The circle has 365 days, so day 366 lies at distance 0 from day 1.
    """
    def near(d: Column) -> Column:
        gap = F.abs(d - target_doy)
        return F.least(gap, F.lit(365) - gap) <= reach

    return F.filter(F.sequence(F.lit(1), F.lit(366)), near)
