"""Climatology, anomaly and matrix queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog.base import B0, B1, CITY, MATRIX, MEASURES_SQL, REGION, SPEC, query, with_sql
from tempora.operators import climatology as C
from tempora.sources import star

M = " ".join(MEASURES_SQL)
CUR = SPEC.current_year


def matrix(spark, path):
    return C.monthly_anomaly_matrix(C.monthly_means(star.city_daily(spark, path), SPEC), SPEC)


@query(
    "monthly_anomaly_matrix", "A10 A1 A2 J3 P6",
    with_sql(MATRIX) + " SELECT * FROM matrix",
    "mean_temp baseline_mean baseline_std anomaly z_score",
)
def _(spark, path):
    return matrix(spark, path)


CLIM = f"""
    avg(temperature_2m_mean) AS climatology_temp_mean, stddev_samp(temperature_2m_mean) AS climatology_temp_std,
    avg(precipitation_sum) AS climatology_precip_mean, stddev_samp(precipitation_sum) AS climatology_precip_std,
    avg(snowfall_sum) AS climatology_snow_mean, stddev_samp(snowfall_sum) AS climatology_snow_std,
    avg(sunshine_duration) AS climatology_sunshine_mean"""
CLIM_COLS = (
    "climatology_temp_mean climatology_temp_std climatology_precip_mean climatology_precip_std "
    "climatology_snow_mean climatology_snow_std climatology_sunshine_mean"
)


def _clim_sql(src: str, keys: str) -> str:
    return f"SELECT {keys}, {CLIM} FROM {src} WHERE year BETWEEN {B0} AND {B1} GROUP BY {keys}"


def _enriched_sql(src: str, group: str) -> str:
    """Anomalies and rolling figures of the current year; ``group`` is '' or 'city'."""
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    on = f"USING ({g}month_day)"

    def w(n):
        lo = "UNBOUNDED PRECEDING" if n is None else f"{n - 1} PRECEDING"
        return f"OVER ({part}ORDER BY time ROWS BETWEEN {lo} AND CURRENT ROW)"

    return f"""
enriched AS (
  SELECT *, avg(temp_anomaly) {w(7)} AS rolling_7d_temp_anomaly, avg(temp_anomaly) {w(30)} AS rolling_30d_temp_anomaly,
    sum(precip_anomaly) {w(7)} AS rolling_7d_precip_anomaly,
    CASE WHEN precip_anomaly IS NOT NULL THEN sum(precip_anomaly) {w(None)} END AS cumulative_precip_anomaly,
    sum(snow_anomaly) {w(7)} AS rolling_7d_snow_anomaly
  FROM (SELECT d.* EXCLUDE (month), c.* EXCLUDE ({g}month_day),
      temperature_2m_mean - climatology_temp_mean AS temp_anomaly,
      precipitation_sum - climatology_precip_mean AS precip_anomaly,
      snowfall_sum - climatology_snow_mean AS snow_anomaly
    FROM {src} d LEFT JOIN ({_clim_sql(src, g + 'month_day')}) c {on}
    WHERE year = {CUR}))"""


ENRICHED_COLS = (
    f"{M} {CLIM_COLS} temp_anomaly precip_anomaly snow_anomaly rolling_7d_temp_anomaly rolling_30d_temp_anomaly "
    "rolling_7d_precip_anomaly cumulative_precip_anomaly rolling_7d_snow_anomaly"
)
CITY_ENRICHED = CITY + "," + _enriched_sql("city_ytd", "city")
REGION_ENRICHED = REGION + "," + _enriched_sql("region_ytd", "")


def city_ytd(spark, path, first=None, last=None):
    return C.entity_daily(star.city_daily(spark, path, first, last), SPEC, SPEC.cutoff)


def region_ytd(spark, path, first=None, last=None):
    return C.region_daily(star.city_daily(spark, path, first, last), SPEC, SPEC.cutoff)


def city_current(spark, path):
    """Current year against the climatology; each side scans only its own years of the raw rows."""
    clim = C.daily_climatology(city_ytd(spark, path, B0, B1), SPEC, ("city",))
    return C.apply_daily_climatology(city_ytd(spark, path, CUR, CUR), clim, SPEC, ("city",))


def region_current(spark, path):
    clim = C.daily_climatology(region_ytd(spark, path, B0, B1), SPEC)
    return C.apply_daily_climatology(region_ytd(spark, path, CUR, CUR), clim, SPEC)


@query(
    "monthly_means", "A1 P6 F18",
    with_sql(MATRIX) + " SELECT * FROM monthly", "mean_temp",
)
def _(spark, path):
    return C.monthly_means(star.city_daily(spark, path), SPEC)


@query(
    "baseline_stats", "A2 P5",
    with_sql(MATRIX) + " SELECT * FROM base", "baseline_mean baseline_std",
)
def _(spark, path):
    # only the baseline years are read from the scan
    return C.baseline_stats(C.monthly_means(star.city_daily(spark, path, B0, B1), SPEC), SPEC)


@query(
    "matrix_side_input_join", "J3 A10",
    with_sql(MATRIX) + " SELECT * FROM matrix",
    "mean_temp baseline_mean baseline_std anomaly z_score",
)
def _(spark, path):
    base = C.baseline_stats(C.monthly_means(star.city_daily(spark, path, B0, B1), SPEC), SPEC)
    monthly = C.monthly_means(star.city_daily(spark, path), SPEC)
    return C.join_baseline(monthly, base, SPEC).select(
        "city", "year", "month", "mean_temp", "days", "baseline_mean", "baseline_std", "anomaly", "z_score")


@query(
    "matrix_rounded_ordered", "P10 T-9",
    with_sql(MATRIX) + """ SELECT city, year, month, days, round(mean_temp + 1e-9, 2) + 0.0 AS mean_temp,
      round(baseline_mean + 1e-9, 2) + 0.0 AS baseline_mean, round(baseline_std + 1e-9, 2) + 0.0 AS baseline_std,
      round(anomaly + 1e-9, 2) + 0.0 AS anomaly, round(z_score + 1e-9, 2) + 0.0 AS z_score FROM matrix""",
    "mean_temp baseline_mean baseline_std anomaly z_score",
)
def _(spark, path):
    cols = ["mean_temp", "baseline_mean", "baseline_std", "anomaly", "z_score"]
    shifted = matrix(spark, path).withColumns({c: F.col(c) + F.lit(1e-9) for c in cols})
    return C.rounded_matrix(shifted).orderBy("city", "year", "month")


@query("region_daily", "A3", with_sql(REGION) + " SELECT * EXCLUDE (month) FROM region_ytd", M)
def _(spark, path):
    return region_ytd(spark, path)


@query("entity_daily_ytd", "A4 P1 P2", with_sql(CITY) + " SELECT * EXCLUDE (month) FROM city_ytd", M)
def _(spark, path):
    return city_ytd(spark, path)


@query(
    "daily_climatology_region", "A7 P5",
    with_sql(REGION) + " " + _clim_sql("region_ytd", "month_day"), CLIM_COLS,
)
def _(spark, path):
    return C.daily_climatology(region_ytd(spark, path, B0, B1), SPEC)


@query(
    "daily_climatology", "A7 P5",
    with_sql(CITY) + " " + _clim_sql("city_ytd", "city, month_day"), CLIM_COLS,
)
def _(spark, path):
    return C.daily_climatology(city_ytd(spark, path, B0, B1), SPEC, ("city",))


@query("daily_anomaly_rolling", "W4 W1 W2 W3 J1", with_sql(CITY_ENRICHED) + " SELECT * FROM enriched", ENRICHED_COLS)
def _(spark, path):
    return city_current(spark, path)


@query("daily_anomaly_rolling_region", "W4 W1 W2 W3 J1",
       with_sql(REGION_ENRICHED) + " SELECT * FROM enriched", ENRICHED_COLS)
def _(spark, path):
    return region_current(spark, path)


def _monthly_sql(src: str, group: str) -> str:
    g = f"{group}, " if group else ""
    return f"""
monthly_per_year AS (SELECT {g}year, month, avg(temperature_2m_mean) AS temp_mean,
  coalesce(sum(precipitation_sum), 0.0) AS precip_total, count(time) AS days,
  coalesce(sum(snowfall_sum), 0.0) AS snowfall_total, coalesce(sum(sunshine_duration), 0.0) AS sunshine_total
  FROM {src} GROUP BY {g}year, month),
monthly_base AS (SELECT {g}month, avg(temp_mean) AS climatology_temp_mean, stddev_samp(temp_mean) AS climatology_temp_std,
  avg(precip_total) AS climatology_precip_mean, stddev_samp(precip_total) AS climatology_precip_std
  FROM monthly_per_year WHERE year BETWEEN {B0} AND {B1} GROUP BY {g}month),
monthly_anom AS (SELECT m.* EXCLUDE (temp_mean, precip_total), temp_mean AS current_temp_mean,
  precip_total AS current_precip_total, b.* EXCLUDE ({g}month),
  temp_mean - climatology_temp_mean AS temp_anomaly, precip_total - climatology_precip_mean AS precip_anomaly,
  (temp_mean - climatology_temp_mean) / nullif(climatology_temp_std, 0) AS temp_zscore,
  (precip_total - climatology_precip_mean) / nullif(climatology_precip_std, 0) AS precip_zscore
  FROM monthly_per_year m LEFT JOIN monthly_base b USING ({g}month) WHERE year = {CUR})"""


MONTHLY_COLS = (
    "current_temp_mean current_precip_total snowfall_total sunshine_total climatology_temp_mean climatology_temp_std "
    "climatology_precip_mean climatology_precip_std temp_anomaly precip_anomaly temp_zscore precip_zscore"
)
CITY_MONTHLY = CITY + "," + _monthly_sql("city_ytd", "city")
REGION_MONTHLY = REGION + "," + _monthly_sql("region_ytd", "")


def city_monthly(spark, path):
    return C.monthly_anomalies(city_ytd(spark, path), SPEC, ("city",))


def region_monthly(spark, path):
    return C.monthly_anomalies(region_ytd(spark, path), SPEC)


@query("monthly_anomalies", "A9 A8 J2", with_sql(CITY_MONTHLY) + " SELECT * FROM monthly_anom", MONTHLY_COLS)
def _(spark, path):
    return city_monthly(spark, path)


@query("monthly_anomalies_region", "A9 A8 J2", with_sql(REGION_MONTHLY) + " SELECT * FROM monthly_anom", MONTHLY_COLS)
def _(spark, path):
    return region_monthly(spark, path)


@query(
    "monthly_baseline", "A8",
    with_sql(CITY_MONTHLY) + " SELECT * FROM monthly_base",
    "climatology_temp_mean climatology_temp_std climatology_precip_mean climatology_precip_std",
)
def _(spark, path):
    monthly = C.monthly_totals(city_ytd(spark, path, B0, B1), SPEC, ("city",))
    return C.monthly_baseline(monthly, SPEC, ("city",))
