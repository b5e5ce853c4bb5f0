"""Climatology, anomalies, summaries, thresholds and month slices on small frames."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tempora.functions.calendar import with_year_month_day
from tempora.operators import climatology as C
from tempora.operators import month_slice as MS
from tempora.operators import summary as S
from tempora.spec import ObservationSpec

SPEC = ObservationSpec(cutoff="03-14", current_year=2026)


def daily(spark, years, cities=("A",), temp=5.0, precip=2.0, lo=None, hi=None, days=28):
    rows = []
    for y in years:
        for m in (1, 2, 3):
            for d in range(1, days + 1):
                step = y - min(years)
                for c in cities:
                    r = [c, date(y, m, d), temp + step * 0.1, precip]
                    if lo is not None:
                        r += [lo + step * 0.5, hi + step * 0.3]
                    rows.append(tuple(r))
    cols = "city string, time date, temperature_2m_mean double, precipitation_sum double"
    if lo is not None:
        cols += ", temperature_2m_min double, temperature_2m_max double"
    return spark.createDataFrame(rows, cols)


def series(spark, values, start=date(2026, 1, 1), city="A"):
    rows = [(city, start + timedelta(days=i), v, p) for i, (v, p) in enumerate(values)]
    return spark.createDataFrame(rows, "city string, time date, temperature_2m_mean double, precipitation_sum double")


def test_region_daily_cuts_and_averages(spark):
    d = daily(spark, range(2020, 2023), ("A", "B"))
    out = C.region_daily(d, SPEC, "02-15")
    assert out.agg(F.max("month_day")).first()[0] == "02-15"
    assert out.groupBy("time").count().filter("count > 1").isEmpty()
    assert out.filter("year = 2021").first()["temperature_2m_mean"] == pytest.approx(5.1)


def test_annual_summary(spark):
    rows = [(date(2020, 1, 1), 2020, 1.0, 0.5), (date(2020, 1, 2), 2020, 3.0, 0.5), (date(2021, 1, 1), 2021, 5.0, 1.0)]
    d = spark.createDataFrame(rows, "time date, year int, temperature_2m_mean double, precipitation_sum double")
    got = {r["year"]: r for r in S.annual_summary(d, SPEC).collect()}
    assert set(got) == {2020, 2021}
    assert got[2020]["ytd_mean_temp"] == pytest.approx(2.0) and got[2020]["days"] == 2
    assert "ytd_total_snowfall" not in got[2020].asDict()


def test_climatology_uses_baseline_years_only(spark):
    rows = [(date(y, 1, 15), float(y), 1.0) for y in range(1985, 2025)]
    d = with_year_month_day(spark.createDataFrame(rows, "time date, temperature_2m_mean double, precipitation_sum double"))
    r = C.daily_climatology(d, SPEC).first()
    assert r["climatology_temp_mean"] == pytest.approx(sum(range(1991, 2021)) / 30)


def annual(spark, last):
    rows = [(y, last if y == 2026 else 5.0, 100.0, 90) for y in range(1991, 2027)]
    return spark.createDataFrame(rows, "year int, ytd_mean_temp double, ytd_total_precip double, days long")


def test_summary_deviation(spark):
    up = S.weather_summary(annual(spark, 8.0), SPEC).first()
    assert up["temp_deviation"] == pytest.approx(3.0) and up["temp_percent_deviation"] == pytest.approx(60.0)
    flat = S.weather_summary(annual(spark, 5.0), SPEC).first()
    assert flat["temp_deviation"] == pytest.approx(0.0)
    assert flat["temp_zscore"] is None
    assert S.weather_summary(annual(spark, 5.0).filter("year < 2026"), SPEC).isEmpty()


def test_rankings_order_and_null_last(spark):
    s = spark.createDataFrame(
        [("A", 1.0, 0.5, -10.0, -0.3), ("B", 3.0, 2.0, -5.0, -0.1), ("C", 1.0, None, 0.0, 0.2), ("D", -3.0, -2.0, 0.0, 0.0)],
        "city string, temp_deviation double, temp_zscore double, precip_deviation double, precip_zscore double")
    r = S.city_rankings(s, "city")
    assert [x["city"] for x in r["temperature"].collect()] == ["B", "D", "A", "C"]
    assert [x["city"] for x in r["combined"].collect()] == ["B", "D", "A", "C"]
    assert set(r) == {"temperature", "precipitation", "combined"}


def test_threshold_days(spark):
    years = range(1991, 2027)
    assert S.threshold_days(daily(spark, years), SPEC) is None
    warm = {r["metric"]: r for r in S.threshold_days(daily(spark, years, lo=10.0, hi=20.0, days=14), SPEC).collect()}
    assert set(warm) == {"frost_days", "hot_days", "tropical_nights", "cold_nights"}
    assert warm["frost_days"]["current"] == 0
    cold = {r["metric"]: r for r in S.threshold_days(daily(spark, years, lo=-30.0, hi=5.0, days=14), SPEC).collect()}
    assert cold["frost_days"]["current"] == 42 and cold["frost_days"]["baseline_mean"] > 0
    mixed = {r["metric"]: r for r in S.threshold_days(daily(spark, years, lo=-5.0, hi=5.0, days=14), SPEC).collect()}
    f = mixed["frost_days"]
    assert f["anomaly"] == pytest.approx(f["current"] - f["baseline_mean"], abs=0.2)


def test_rolling_and_cumulative_skip_missing(spark):
    d = with_year_month_day(series(spark, [(1.0, 1.0), (None, None), (3.0, 2.0)]))
    d = d.withColumns({"temp_anomaly": F.col("temperature_2m_mean"), "precip_anomaly": F.col("precipitation_sum")})
    rows = C.with_rolling_anomalies(d, SPEC, ("city",)).orderBy("time").collect()
    assert [r["cumulative_precip_anomaly"] for r in rows] == [1.0, None, 3.0]
    assert [r["rolling_7d_temp_anomaly"] for r in rows] == [1.0, 1.0, 2.0]
    assert [r["rolling_7d_precip_anomaly"] for r in rows] == [1.0, 1.0, 3.0]


def test_windows_restart_each_year(spark):
    a = series(spark, [(10.0, 1.0)] * 3, date(2025, 12, 29))
    b = series(spark, [(2.0, 1.0)] * 3, date(2026, 1, 1))
    d = with_year_month_day(a.union(b)).withColumns({"temp_anomaly": F.col("temperature_2m_mean"), "precip_anomaly": F.lit(1.0)})
    rows = C.with_rolling_anomalies(d, SPEC, ("city",)).filter("year = 2026").orderBy("time").collect()
    assert [r["cumulative_precip_anomaly"] for r in rows] == [1.0, 2.0, 3.0]
    assert rows[0]["rolling_30d_temp_anomaly"] == 2.0


def matrix_input(spark):
    rows = []
    for c in ("A", "B", "C"):
        for y in (2019, 2020, 2021):
            if c == "C" and y < 2021:
                continue
            if c == "B" and y == 2019:
                continue
            for d in range(1, 4):
                rows.append((c, date(y, 1, d), float(y - 2018 + d), 0.0))
    rows += [(None, date(2020, 1, 1), 1.0, 0.0), ("A", date(2020, 2, 1), None, 0.0)]
    return spark.createDataFrame(rows, "city string, time date, temperature_2m_mean double, precipitation_sum double")


def test_matrix_edge_cases(spark):
    spec = ObservationSpec(baseline=(2019, 2020))
    m = C.monthly_means(matrix_input(spark), spec)
    got = {(r["city"], r["year"], r["month"]): r for r in C.monthly_anomaly_matrix(m, spec).collect()}
    assert len(got) == 3 + 2 + 1  # no NULL entity, no month without a temperature
    a = got["A", 2021, 1]
    assert a["baseline_mean"] == pytest.approx(3.5) and a["baseline_std"] == pytest.approx(0.5**0.5)
    assert a["z_score"] == pytest.approx(1.5 / 0.5**0.5)
    b = got["B", 2021, 1]
    assert b["baseline_std"] == 0.0 and b["anomaly"] == pytest.approx(1.0) and b["z_score"] is None
    c = got["C", 2021, 1]
    assert c["baseline_mean"] is None and c["anomaly"] is None and c["z_score"] is None
    joined = C.join_baseline(m, C.baseline_stats(m, spec), spec)
    assert {(r["city"], r["year"]): r["z_score"] for r in joined.collect()} == pytest.approx(
        {k[:2]: r["z_score"] for k, r in got.items()})


def slice_input(spark, temps, late=None):
    rows = [("Vilnius", date(y, 3, d), late if late is not None and d > 10 and y < max(temps) else t, 0.0)
            for y, t in temps.items() for d in range(1, 17) if not (late is not None and y == max(temps) and d > 10)]
    return spark.createDataFrame(rows, "city string, time date, temperature_2m_mean double, precipitation_sum double")


TEMPS = {2020: 1.0, 2021: 3.0, 2022: 5.0, 2023: 7.0, 2024: 9.0}


def test_month_slice_invariants(spark):
    out = MS.month_slice(slice_input(spark, TEMPS), SPEC, "VILNIUS", 3).orderBy("year").collect()
    assert len(out) == 5
    assert sum(r["zscore"] for r in out) == pytest.approx(0.0, abs=1e-9)
    assert out[0]["baseline_mean"] == pytest.approx(5.0) and out[-1]["anomaly_c"] == pytest.approx(4.0)


def test_month_slice_cutoff_excludes_later_days(spark):
    out = MS.month_slice(slice_input(spark, TEMPS, late=100.0), SPEC, "Vilnius", 3).collect()
    assert max(r["mean_temp_c"] for r in out) == pytest.approx(9.0)
    assert {r["days_observed"] for r in out} == {10}


def test_month_slice_window_and_zero_variance(spark):
    ten = {y: float(y - 2014) for y in range(2015, 2025)}
    out = MS.month_slice(slice_input(spark, ten), SPEC, "Vilnius", 3, window_years=5).collect()
    assert min(r["year"] for r in out) == 2020 and len(out) == 5
    flat = MS.month_slice(slice_input(spark, dict.fromkeys(TEMPS, 5.0)), SPEC, "Vilnius", 3).collect()
    assert {r["zscore"] for r in flat} == {0.0}


def test_slice_summary_and_stored_fallback(spark):
    hist = MS.month_histories(slice_input(spark, TEMPS), SPEC)
    s = MS.slice_summary(hist, ["city", "month"]).first()
    assert (s["start_year"], s["end_year"], s["years_included"], s["cutoff_day"]) == (2020, 2024, 5, 16)
    assert (s["warmest_year"], s["coldest_year"], s["month_name"]) == (2024, 2020, "March")
    assert s["execution_date"] == date(2024, 3, 16)
    stored = spark.createDataFrame([("Vilnius", 4, 2020, 1.0)], "city string, month int, year int, mean_temp_c double")
    both = MS.stored_or_derived(stored, hist, ["city", "month"])
    assert both.count() == 6
    again = MS.stored_or_derived(hist, hist, ["city", "month"])
    assert again.count() == 5


def test_stored_rows_are_completed(spark):
    rows = [("V", 3, "2020", "1.0", None, None), ("V", 3, "2021", "3.0", "1.5", None), ("V", 3, "bad", "9", None, None)]
    df = spark.createDataFrame(rows, "city string, month int, year string, mean_temp_c string, anomaly_c string, zscore string")
    out = {r["year"]: r for r in MS.fill_own_baseline(df, ["city", "month"]).collect()}
    assert set(out) == {2020, 2021}
    assert out[2020]["anomaly_c"] == pytest.approx(-1.0) and out[2021]["anomaly_c"] == 1.5
    assert out[2021]["zscore"] == pytest.approx(1.5 / 2**0.5)


def test_trend_direction(spark):
    df = spark.createDataFrame([(2.0, 1.0), (1.2, 1.0), (0.0, 1.0)], "latest_7d_temp_anomaly double, temp_deviation double")
    assert [r["trend_direction"] for r in S.trend_direction(df).collect()] == [1, 0, -1]
