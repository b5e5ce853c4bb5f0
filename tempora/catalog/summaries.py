"""Year-to-date summaries, rankings, threshold days, month slices and degree days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tempora.catalog import climate
from tempora.catalog.base import B0, B1, CITY, MATRIX, REGION, SPEC, query, with_sql
from tempora.functions import calendar as cal
from tempora.operators import degree_days as D
from tempora.operators import month_slice as MS
from tempora.operators import summary as S
from tempora.sources import star

CUR = SPEC.current_year

ANNUAL_COLS = "ytd_mean_temp ytd_total_precip ytd_total_snowfall ytd_total_sunshine ytd_mean_wind_speed ytd_total_et0"


def _annual_sql(src: str, group: str) -> str:
    g = f"{group}, " if group else ""
    return f"""
annual AS (SELECT {g}year, avg(temperature_2m_mean) AS ytd_mean_temp, coalesce(sum(precipitation_sum), 0.0) AS ytd_total_precip,
  count(time) AS days, coalesce(sum(snowfall_sum), 0.0) AS ytd_total_snowfall,
  coalesce(sum(sunshine_duration), 0.0) AS ytd_total_sunshine, avg(wind_speed_10m_max) AS ytd_mean_wind_speed,
  coalesce(sum(et0_fao_evapotranspiration), 0.0) AS ytd_total_et0
  FROM {src} GROUP BY {g}year)"""


def _summary_sql(group: str) -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    b = f"FILTER (WHERE year BETWEEN {B0} AND {B1})"
    c = f"FILTER (WHERE year = {CUR})"
    return f"""
summary0 AS (SELECT {g}max(days) {c} AS days_observed, max(ytd_mean_temp) {c} AS ytd_mean_temp,
  max(ytd_total_precip) {c} AS ytd_total_precip, avg(ytd_mean_temp) {b} AS expected_temp_mean,
  stddev_samp(ytd_mean_temp) {b} AS expected_temp_std, avg(ytd_total_precip) {b} AS expected_precip_mean,
  stddev_samp(ytd_total_precip) {b} AS expected_precip_std,
  max(ytd_total_snowfall) {c} AS snowfall_total, avg(ytd_total_snowfall) {b} AS snowfall_baseline_mean,
  max(ytd_total_sunshine) {c} AS sun, avg(ytd_total_sunshine) {b} AS sun_base,
  max(ytd_mean_wind_speed) {c} AS mean_wind, max(ytd_total_et0) {c} AS total_et0
  FROM annual {gb}),
summary AS (SELECT * EXCLUDE (sun, sun_base), {CUR} AS current_year,
  ytd_mean_temp - expected_temp_mean AS temp_deviation,
  (ytd_mean_temp - expected_temp_mean) / nullif(abs(expected_temp_mean), 0) * 100.0 AS temp_percent_deviation,
  (ytd_mean_temp - expected_temp_mean) / nullif(expected_temp_std, 0) AS temp_zscore,
  ytd_total_precip - expected_precip_mean AS precip_deviation,
  (ytd_total_precip - expected_precip_mean) / nullif(abs(expected_precip_mean), 0) * 100.0 AS precip_percent_deviation,
  (ytd_total_precip - expected_precip_mean) / nullif(expected_precip_std, 0) AS precip_zscore,
  snowfall_total - snowfall_baseline_mean AS snowfall_deviation,
  round(sun / 3600.0, 1) AS sunshine_hours, round(sun_base / 3600.0, 1) AS sunshine_baseline_hours,
  round((sun - sun_base) / 3600.0, 1) AS sunshine_deviation_hours
  FROM summary0 WHERE days_observed IS NOT NULL)"""


SUMMARY_COLS = (
    "ytd_mean_temp ytd_total_precip expected_temp_mean expected_temp_std expected_precip_mean expected_precip_std "
    "snowfall_total snowfall_baseline_mean mean_wind total_et0 temp_deviation temp_percent_deviation temp_zscore "
    "precip_deviation precip_percent_deviation precip_zscore snowfall_deviation sunshine_hours "
    "sunshine_baseline_hours sunshine_deviation_hours"
)
CITY_SUMMARY = CITY + "," + _annual_sql("city_ytd", "city") + "," + _summary_sql("city")
REGION_SUMMARY = REGION + "," + _annual_sql("region_ytd", "") + "," + _summary_sql("")
LATEST_COLS = (
    "climatology_ytd_mean climatology_ytd_total latest_daily_temp_anomaly latest_7d_temp_anomaly "
    "latest_30d_temp_anomaly latest_daily_precip_anomaly latest_7d_precip_anomaly latest_cumulative_precip_anomaly "
    "latest_daily_snow_anomaly latest_7d_snow_anomaly"
)


def _latest_sql(group: str) -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    pairs = [
        ("temp_anomaly", "latest_daily_temp_anomaly"), ("rolling_7d_temp_anomaly", "latest_7d_temp_anomaly"),
        ("rolling_30d_temp_anomaly", "latest_30d_temp_anomaly"), ("precip_anomaly", "latest_daily_precip_anomaly"),
        ("rolling_7d_precip_anomaly", "latest_7d_precip_anomaly"),
        ("cumulative_precip_anomaly", "latest_cumulative_precip_anomaly"),
        ("snow_anomaly", "latest_daily_snow_anomaly"), ("rolling_7d_snow_anomaly", "latest_7d_snow_anomaly"),
    ]
    lasts = ", ".join(f"arg_max_null({c}, time) AS {n}" for c, n in pairs)
    return f"""
latest AS (SELECT {g}max(time) AS latest_time, avg(climatology_temp_mean) AS climatology_ytd_mean,
  sum(climatology_precip_mean) AS climatology_ytd_total, {lasts} FROM enriched {gb})"""


CITY_LATEST = climate.CITY_ENRICHED + "," + _latest_sql("city")
REGION_LATEST = climate.REGION_ENRICHED + "," + _latest_sql("")
CITY_FULL = (
    CITY_LATEST + "," + _annual_sql("city_ytd", "city") + "," + _summary_sql("city")
    + ", full_summary AS (SELECT * FROM summary JOIN latest USING (city))"
)


def city_annual(spark, path):
    return S.annual_summary(climate.city_ytd(spark, path), SPEC, ("city",))


def region_annual(spark, path):
    return S.annual_summary(climate.region_ytd(spark, path), SPEC)


def city_summary(spark, path):
    return S.weather_summary(city_annual(spark, path), SPEC, ("city",))


def region_summary(spark, path):
    return S.weather_summary(region_annual(spark, path), SPEC)


def city_full_summary(spark, path):
    latest = S.latest_metrics(climate.city_current(spark, path), SPEC, ("city",))
    return city_summary(spark, path).join(latest, "city")


@query("annual_summary", "A5", with_sql(REGION, _annual_sql("region_ytd", "")) + " SELECT * FROM annual", ANNUAL_COLS)
def _(spark, path):
    return region_annual(spark, path)


@query("annual_summary_by_entity", "A6", with_sql(CITY, _annual_sql("city_ytd", "city")) + " SELECT * FROM annual", ANNUAL_COLS)
def _(spark, path):
    return city_annual(spark, path)


@query("ytd_summary", "A11 A12", with_sql(REGION_SUMMARY) + " SELECT * FROM summary", SUMMARY_COLS)
def _(spark, path):
    return region_summary(spark, path)


@query("ytd_summary_by_entity", "A13 A11 A12", with_sql(CITY_SUMMARY) + " SELECT * FROM summary", SUMMARY_COLS)
def _(spark, path):
    return city_summary(spark, path)


@query("latest_metrics", "A14 W5", with_sql(REGION_LATEST) + " SELECT * FROM latest", LATEST_COLS)
def _(spark, path):
    return S.latest_metrics(climate.region_current(spark, path), SPEC)


@query("latest_metrics_by_entity", "A14 W5", with_sql(CITY_LATEST) + " SELECT * FROM latest", LATEST_COLS)
def _(spark, path):
    return S.latest_metrics(climate.city_current(spark, path), SPEC, ("city",))


@query(
    "trend_direction", "W8",
    with_sql(CITY_FULL) + """ SELECT city, temp_deviation, latest_7d_temp_anomaly,
      CASE WHEN latest_7d_temp_anomaly - temp_deviation > 0.5 THEN 1
           WHEN latest_7d_temp_anomaly - temp_deviation < -0.5 THEN -1 ELSE 0 END AS trend_direction FROM full_summary""",
    "temp_deviation latest_7d_temp_anomaly",
)
def _(spark, path):
    return S.trend_direction(city_full_summary(spark, path)).select(
        "city", "temp_deviation", "latest_7d_temp_anomaly", "trend_direction")


@query(
    "extreme_entities", "T-5",
    with_sql(CITY_FULL) + """ SELECT
      (SELECT city FROM full_summary ORDER BY latest_7d_temp_anomaly DESC, city LIMIT 1) AS warmest_entity,
      max(latest_7d_temp_anomaly) AS warmest_7d_anomaly,
      (SELECT city FROM full_summary ORDER BY precip_deviation, city LIMIT 1) AS driest_entity,
      min(precip_deviation) AS driest_deviation FROM full_summary""",
    "warmest_7d_anomaly driest_deviation",
)
def _(spark, path):
    return S.extreme_entities(city_full_summary(spark, path), "city")


@query(
    "city_rankings", "T-1",
    with_sql(CITY_SUMMARY) + """ SELECT 'temperature' AS ranking, city, temp_deviation AS anomaly, temp_zscore AS z_score
      FROM summary UNION ALL SELECT 'precipitation', city, precip_deviation, precip_zscore FROM summary""",
    "anomaly z_score",
)
def _(spark, path):
    r = S.city_rankings(city_summary(spark, path), "city")
    return r["temperature"].unionByName(r["precipitation"])


@query(
    "city_ranking_combined", "T-2",
    with_sql(CITY_SUMMARY) + """ SELECT city, greatest(abs(temp_zscore), abs(precip_zscore)) AS combined_score,
      temp_zscore AS temperature_z, precip_zscore AS precipitation_z FROM summary""",
    "combined_score temperature_z precipitation_z",
)
def _(spark, path):
    return S.city_rankings(city_summary(spark, path), "city")["combined"]


THRESHOLDS = (
    ("frost_days", "tmin", "<", -15.0),
    ("hot_days", "tmax", ">", 20.0),
    ("tropical_nights", "tmin", ">", -10.0),
    ("cold_nights", "tmin", "<", -18.0),
)
THRESHOLD_SQL = CITY + f""",
extremes AS (SELECT year, time, avg(temperature_2m_min) AS tmin, avg(temperature_2m_max) AS tmax
  FROM city_ytd GROUP BY year, time),
counts AS (SELECT year, {', '.join(f'count(*) FILTER (WHERE {c} {op} {x}) AS {n}' for n, c, op, x in THRESHOLDS)}
  FROM extremes GROUP BY year)"""


@query("threshold_day_counts", "A15", with_sql(THRESHOLD_SQL) + " SELECT * FROM counts")
def _(spark, path):
    return S.threshold_counts(S.region_extremes(star.city_daily(spark, path), SPEC), THRESHOLDS)


@query(
    "threshold_days", "A16",
    with_sql(THRESHOLD_SQL) + " " + " UNION ALL ".join(
        f"""SELECT '{n}' AS metric, CAST(coalesce(sum({n}) FILTER (WHERE year = {CUR}), 0) AS BIGINT) AS current,
        round(coalesce(avg({n}) FILTER (WHERE year BETWEEN {B0} AND {B1}), 0.0), 1) AS baseline_mean,
        round(coalesce(sum({n}) FILTER (WHERE year = {CUR}), 0)
          - coalesce(avg({n}) FILTER (WHERE year BETWEEN {B0} AND {B1}), 0.0), 1) AS anomaly FROM counts"""
        for n, *_ in THRESHOLDS),
    "baseline_mean anomaly",
)
def _(spark, path):
    return S.threshold_days(star.city_daily(spark, path), SPEC, THRESHOLDS)


# month slices -----------------------------------------------------------------------------------

WINDOW_YEARS = 6
SLICES = CITY + f""",
sl0 AS (SELECT city, month, year, time, temperature_2m_mean AS t FROM city_cal WHERE temperature_2m_mean IS NOT NULL),
cut AS (SELECT city, month, max(time) AS last_observation, CAST(day(max(time)) AS INTEGER) AS cutoff_day
  FROM sl0 GROUP BY city, month),
sl1 AS (SELECT s.city, s.month, s.year, avg(t) AS mean_temp_c, count(*) AS days_observed, c.cutoff_day, c.last_observation
  FROM sl0 s JOIN cut c ON s.city = c.city AND s.month = c.month WHERE day(s.time) <= c.cutoff_day
  GROUP BY s.city, s.month, s.year, c.cutoff_day, c.last_observation),
sl2 AS (SELECT * FROM sl1 QUALIFY year > max(year) OVER (PARTITION BY city, month) - {WINDOW_YEARS}),
sl3 AS (SELECT *, avg(mean_temp_c) OVER (PARTITION BY city, month) AS baseline_mean,
  coalesce(stddev_samp(mean_temp_c) OVER (PARTITION BY city, month), 0.0) AS baseline_std,
  count(*) OVER (PARTITION BY city, month) AS n FROM sl2),
slices AS (SELECT * EXCLUDE (n), mean_temp_c - baseline_mean AS anomaly_c,
  coalesce((mean_temp_c - baseline_mean) / nullif(baseline_std, 0), 0.0) AS zscore FROM sl3 WHERE n >= 2)"""
SLICE_COLS = "mean_temp_c baseline_mean baseline_std anomaly_c zscore"


def slices(spark, path):
    return MS.month_histories(star.city_daily(spark, path), SPEC, WINDOW_YEARS, min_years=2)


@query("month_slices_all_entities", "A20 A17 P3 P4 W6", with_sql(SLICES) + " SELECT * FROM slices", SLICE_COLS)
def _(spark, path):
    return slices(spark, path)


@query("month_slice", "A17 I3", with_sql(SLICES) + " SELECT * FROM slices WHERE city = 'ASIA' AND month = 3", SLICE_COLS)
def _(spark, path):
    return MS.month_slice(star.city_daily(spark, path), SPEC, "asia", 3, WINDOW_YEARS)


@query(
    "month_slice_fixed_baseline", "A18 P7",
    with_sql(MATRIX) + """ SELECT city, year, month, mean_temp AS mean_temp_c, days AS days_observed,
      anomaly AS anomaly_c, z_score AS zscore FROM matrix WHERE month = 3""",
    "mean_temp_c anomaly_c zscore",
)
def _(spark, path):
    return MS.month_slice_from_matrix(climate.matrix(spark, path), 3, "city")


@query(
    "month_slice_summary", "A19 T-3",
    with_sql(SLICES) + """, agg AS (SELECT city, month, CAST(min(year) AS INTEGER) AS start_year,
        CAST(max(year) AS INTEGER) AS end_year, count(*) AS years_included, max(cutoff_day) AS cut,
        avg(mean_temp_c) AS baseline_mean, coalesce(stddev_samp(mean_temp_c), 0.0) AS baseline_std,
        arg_max(mean_temp_c, year) AS latest_mean_temp, arg_max(anomaly_c, year) AS latest_anomaly,
        arg_max(zscore, year) AS latest_zscore, arg_max(year, anomaly_c) AS warmest_year, max(anomaly_c) AS warmest_anomaly,
        arg_min(year, anomaly_c) AS coldest_year, min(anomaly_c) AS coldest_anomaly FROM slices GROUP BY city, month)
      SELECT * EXCLUDE (cut), monthname(make_date(2000, month, 1)) AS month_name,
        CAST(greatest(1, least(cut, day(last_day(make_date(end_year, month, 1))))) AS INTEGER) AS cutoff_day,
        make_date(end_year, month, CAST(greatest(1, least(cut, day(last_day(make_date(end_year, month, 1))))) AS INTEGER))
          AS execution_date FROM agg""",
    "baseline_mean baseline_std latest_mean_temp latest_anomaly latest_zscore warmest_anomaly coldest_anomaly",
)
def _(spark, path):
    return MS.slice_summary(slices(spark, path), ["city", "month"])


@query(
    "month_slice_stored_or_derived", "A21",
    with_sql(SLICES, MATRIX.replace(CITY, "").lstrip(",\n")) + """,
      stored AS (SELECT city, month, year, mean_temp AS mean_temp_c, days AS days_observed, anomaly AS anomaly_c,
        z_score AS zscore FROM matrix WHERE month BETWEEN 3 AND 5)
      SELECT * FROM stored UNION ALL SELECT city, month, year, mean_temp_c, days_observed, anomaly_c, zscore
      FROM slices WHERE (city, month) NOT IN (SELECT (city, month) FROM stored)""",
    "mean_temp_c anomaly_c zscore",
)
def _(spark, path):
    stored = climate.matrix(spark, path).filter(F.col("month").between(3, 5)).select(
        "city", "month", "year", F.col("mean_temp").alias("mean_temp_c"), F.col("days").alias("days_observed"),
        F.col("anomaly").alias("anomaly_c"), F.col("z_score").alias("zscore"))
    return MS.stored_or_derived(stored, slices(spark, path), ["city", "month"])


@query(
    "execution_cutoff", "P3",
    with_sql(CITY) + """, last AS (SELECT city, max(time) AS d FROM city_cal GROUP BY city),
      months AS (SELECT DISTINCT city, month FROM city_cal)
      SELECT m.city, m.month, CAST(CASE WHEN month(d) = m.month THEN day(d)
        ELSE day(last_day(make_date(CAST(year(d) AS INTEGER), m.month, 1))) END AS INTEGER) AS cutoff_day
      FROM months m JOIN last USING (city)""",
)
def _(spark, path):
    months = cal.with_calendar(star.city_daily(spark, path)).groupBy("city", "month").agg(F.max("time").alias("d"))
    last = months.groupBy("city").agg(F.max("d").alias("execution_date"))
    return months.join(last, "city").select(
        "city", "month", cal.execution_cutoff_day(F.col("execution_date"), F.col("month")).alias("cutoff_day"))


# degree days ------------------------------------------------------------------------------------

DD = CITY + """,
hdd AS (SELECT city, strftime(time, '%Y-%m') AS month, sum(greatest(0.0, 18.0 - temperature_2m_mean)) AS hdd
  FROM city_cal WHERE temperature_2m_mean IS NOT NULL GROUP BY ALL),
hp AS (SELECT *, CAST(left(month, 4) AS INTEGER) AS year, CAST(right(month, 2) AS INTEGER) AS mo,
  max(month) OVER (PARTITION BY city) AS last FROM hdd),
hq AS (SELECT *, CAST(left(last, 4) AS INTEGER) AS ly, CAST(right(last, 2) AS INTEGER) AS lm,
  CASE WHEN mo >= 10 THEN year WHEN mo <= 4 THEN year - 1 END AS season FROM hp)"""


def hdd_series(spark, path):
    return D.monthly_degree_days(star.city_daily(spark, path), "city", "time", SPEC.temp)


@query("monthly_degree_days", "I6", with_sql(DD) + " SELECT city, month, hdd FROM hdd", "hdd")
def _(spark, path):
    return hdd_series(spark, path)


@query(
    "degree_day_ytd", "A22",
    with_sql(DD) + f""", cur AS (SELECT DISTINCT city, mo FROM hq WHERE year = ly),
      py AS (SELECT q.city, q.year, ly, lm, sum(hdd) AS total, count(*) AS n FROM hq q
        JOIN cur c ON q.city = c.city AND q.mo = c.mo GROUP BY ALL),
      o AS (SELECT city, ly, lm, CAST(sum(n) FILTER (WHERE year = ly) AS BIGINT) AS months,
        sum(total) FILTER (WHERE year = ly) AS total_hdd,
        coalesce(avg(total) FILTER (WHERE year BETWEEN {B0} AND {B1}), 0.0) AS baseline_mean FROM py GROUP BY city, ly, lm)
      SELECT city, CASE WHEN lm = 12 THEN 'Full year ' || ly
        ELSE 'Jan–' || left(monthname(make_date(2000, lm, 1)), 3) || ' ' || ly END AS label,
        months, total_hdd, baseline_mean, total_hdd - baseline_mean AS anomaly FROM o""",
    "total_hdd baseline_mean anomaly",
)
def _(spark, path):
    return D.ytd_degree_days(hdd_series(spark, path), "city", SPEC.baseline)


@query(
    "degree_day_season", "A23",
    with_sql(DD) + f""", refs AS (SELECT city, CASE WHEN bool_or(season = ly - CASE WHEN lm < 10 THEN 1 ELSE 0 END)
        THEN max(ly - CASE WHEN lm < 10 THEN 1 ELSE 0 END)
        WHEN bool_or(season = ly - CASE WHEN lm < 10 THEN 2 ELSE 1 END) THEN max(ly - CASE WHEN lm < 10 THEN 2 ELSE 1 END)
        ELSE max(ly) - 1 END AS ref FROM hq GROUP BY city),
      cur AS (SELECT q.city, mo, ref, hdd FROM hq q JOIN refs r ON q.city = r.city AND season = ref),
      bs AS (SELECT q.city, season, sum(q.hdd) AS total FROM hq q JOIN cur c ON q.city = c.city AND q.mo = c.mo
        WHERE q.year BETWEEN {B0} AND {B1} AND season BETWEEN {B0} AND {B1} GROUP BY q.city, season),
      bm AS (SELECT city, avg(total) AS baseline_mean FROM bs GROUP BY city),
      tot AS (SELECT city, ref, count(*) AS months_included, sum(hdd) AS total_hdd FROM cur GROUP BY city, ref)
      SELECT city, ref || '/' || lpad(CAST((ref + 1) % 100 AS VARCHAR), 2, '0') AS label, months_included, total_hdd,
        coalesce(baseline_mean, 0.0) AS baseline_mean, total_hdd - coalesce(baseline_mean, 0.0) AS anomaly
      FROM tot LEFT JOIN bm USING (city)""",
    "total_hdd baseline_mean anomaly",
)
def _(spark, path):
    return D.season_degree_days(hdd_series(spark, path), "city", SPEC.baseline)


@query(
    "degree_day_recent_months", "A24",
    with_sql(DD) + """ SELECT city, month, hdd FROM hdd
      QUALIFY row_number() OVER (PARTITION BY city ORDER BY month DESC) <= 12""",
    "hdd",
)
def _(spark, path):
    return D.recent_months(hdd_series(spark, path), "city")


@query(
    "degree_day_lag", "A24",
    with_sql(DD) + """ SELECT city, max(month) AS data_through, count(*) AS observations,
      CAST(2002 * 12 + 6 - (CAST(left(max(month), 4) AS INTEGER) * 12 + CAST(right(max(month), 2) AS INTEGER)) AS INTEGER)
        AS data_lag_months FROM hdd GROUP BY city""",
)
def _(spark, path):
    return D.publication_lag(hdd_series(spark, path), "city", date(2002, 6, 1))
