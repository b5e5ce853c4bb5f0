"""Corpus, report, nested-map and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog import climate, models, summaries, wording
from tempora.catalog.base import B0, B1, MATRIX, REGISTRY, SPEC, query, with_sql
from tempora.operators import degree_days as DG
from tempora.operators import documents as D
from tempora.operators import modeling as MD
from tempora.operators import month_slice as MS
from tempora.operators import summary as SM
from tempora.sources import star

BASE = f"{B0}-{B1}"
PERIOD = f"01-01 to {SPEC.cutoff}"


def _corpus(spark, path):
    slices = summaries.slices(spark, path)
    hdd = summaries.hdd_series(spark, path)
    region_sum = summaries.region_summary(spark, path)
    latest = SM.latest_metrics(climate.region_current(spark, path), SPEC)
    full = summaries.city_full_summary(spark, path)
    report = D.region_report(region_sum, latest, SM.extreme_entities(full, "city"), "Region", PERIOD)
    slice_sum = MS.slice_summary(slices, ["city", "month"])
    return D.corpus([
        D.overview_document(region_sum, latest, "Region", PERIOD),
        D.ranking_document(summaries.city_summary(spark, path), "city"),
        D.slice_documents(slice_sum, "city"),
        D.model_document(MD.regression_metrics(models.city_pred(spark, path))),
        D.threshold_document(SM.threshold_days(star.city_daily(spark, path), SPEC, summaries.THRESHOLDS), "Region", PERIOD, SPEC.current_year, BASE),
        D.degree_day_documents(DG.ytd_degree_days(hdd, "city", SPEC.baseline), DG.season_degree_days(hdd, "city", SPEC.baseline), "city", BASE),
        D.report_documents(report.unionByName(D.slice_report(slice_sum, "city").select("name", "text"))),
    ])


@query(
    "corpus_documents", "R1 F17 F14",
    wording.corpus_sql(*[REGISTRY[n].sql for n in ("threshold_days", "degree_day_ytd", "degree_day_season")]),
)
@star.one_daily_pass
def _(spark, path):
    return _corpus(spark, path)


@query(
    "slice_corpus", "R1 F17",
    with_sql(summaries.SLICES) + """, s AS (SELECT city, monthname(make_date(2000, month, 1)) AS m, arg_max(year, anomaly_c) AS wy, max(anomaly_c) AS wa,
        arg_min(year, anomaly_c) AS cy, min(anomaly_c) AS ca FROM slices GROUP BY city, month)
      SELECT replace(lower(city), ' ', '-') || '-' || lower(m) || '-extremes' AS id, city || ' ' || m || ' historical extremes' AS title,
        'month_slices' AS source, 'The warmest ' || m || ' slice in the window was ' || wy || ' with anomaly ' || printf('%.2f', round(wa, 2) + 0.0)
        || ' C. The coldest was ' || cy || ' with anomaly ' || printf('%.2f', round(ca, 2) + 0.0) || ' C.' AS text FROM s""",
)
def _(spark, path):
    docs = D.slice_documents(MS.slice_summary(summaries.slices(spark, path), ["city", "month"]), "city")
    return docs.filter(F.col("id").endswith("-extremes"))


@query(
    "summary_report", "F17",
    with_sql(summaries.CITY_FULL) + """, p AS (SELECT *, chr(10) AS n FROM full_summary)
      SELECT city, '### ' || city || n || '- Mean temperature: ' || coalesce(printf('%.2f', round(ytd_mean_temp, 2) + 0.0), 'n/a') || ' C' || n
        || '- Temperature anomaly: ' || coalesce(printf('%.2f', round(temp_deviation, 2) + 0.0), 'n/a') || ' C' || n
        || '- Latest 7-day temperature anomaly: ' || coalesce(printf('%.2f', round(latest_7d_temp_anomaly, 2) + 0.0), 'n/a') || ' C' || n
        || '- Precipitation: ' || coalesce(printf('%.2f', round(ytd_total_precip, 2) + 0.0), 'n/a') || ' mm' || n
        || '- Precipitation anomaly: ' || coalesce(printf('%.2f', round(precip_deviation, 2) + 0.0), 'n/a') || ' mm' || n
        || '- Latest cumulative precipitation anomaly: ' || coalesce(printf('%.2f', round(latest_cumulative_precip_anomaly, 2) + 0.0), 'n/a') || ' mm' || n AS text FROM p""",
)
def _(spark, path):
    return D.summary_report(summaries.city_full_summary(spark, path), "city")


def _two(c: str) -> str:
    return f"printf('%.2f', round({c}, 2) + 0.0)"


@query(
    "slice_reports", "F17",
    with_sql(summaries.SLICES) + f""", s AS (SELECT city, month, monthname(make_date(2000, month, 1)) AS m, min(year) AS y0, max(year) AS y1,
        count(*) AS n, max(cutoff_day) AS cut, avg(mean_temp_c) AS bm, coalesce(stddev_samp(mean_temp_c), 0.0) AS bs,
        arg_max(mean_temp_c, year) AS t, arg_max(anomaly_c, year) AS a, arg_max(zscore, year) AS z, arg_max(year, anomaly_c) AS wy,
        max(anomaly_c) AS wa, arg_min(year, anomaly_c) AS cy, min(anomaly_c) AS ca FROM slices GROUP BY city, month)
      SELECT city, month, replace(lower(city), ' ', '-') || '-' || lower(m) AS name, array_to_string([
        '# ' || city || ' ' || m || ' Temperature Anomalies', '', 'Window: ' || y0 || ' to ' || y1,
        m || ' day cutoff used for every year: ' || lpad(CAST(month AS VARCHAR), 2, '0') || '-' || lpad(CAST(cut AS VARCHAR), 2, '0'),
        'Years analyzed: ' || n, '', '## Baseline', '', '- Baseline mean ' || m || ' temperature: ' || {_two('bm')} || ' C',
        '- Baseline standard deviation: ' || {_two('bs')} || ' C', '', '## Latest Year', '', '- Year: ' || y1,
        '- Mean temperature: ' || {_two('t')} || ' C', '- Anomaly: ' || {_two('a')} || ' C', '- Z-score: ' || {_two('z')}, '', '## Extremes', '',
        '- Warmest ' || m || ' slice: ' || wy || ' (' || {_two('wa')} || ' C anomaly)',
        '- Coldest ' || m || ' slice: ' || cy || ' (' || {_two('ca')} || ' C anomaly)'], chr(10)) AS text FROM s""",
)
def _(spark, path):
    return D.slice_report(MS.slice_summary(summaries.slices(spark, path), ["city", "month"]), "city")


@query(
    "matrix_pivot", "F18",
    with_sql(MATRIX) + " SELECT city, year, " + ", ".join(f"max(anomaly) FILTER (WHERE month = {i}) AS m{i}" for i in range(1, 13))
    + " FROM matrix GROUP BY city, year",
    " ".join(f"m{i}" for i in range(1, 13)),
)
def _(spark, path):
    return D.matrix_pivot(climate.matrix(spark, path), "city")


@query(
    "matrix_maps", "F18",
    with_sql(MATRIX) + """ SELECT city, year, month, mean_temp AS temp, anomaly, z_score AS z FROM matrix""",
    "temp anomaly z",
)
def _(spark, path):
    # nested map unfolded again, so that every cell is compared
    maps = D.matrix_maps(climate.matrix(spark, path), "city")
    years = maps.select("city", F.explode("data").alias("year", "m"))
    return years.select("city", F.col("year").cast("int").alias("year"), F.explode("m").alias("month", "c")).select(
        "city", "year", F.col("month").cast("int").alias("month"), "c.temp", "c.anomaly", "c.z")


@query("entity_documents", "F19 F18 I17")
@star.one_daily_pass
def _(spark, path):
    return D.entity_documents(
        climate.matrix(spark, path), summaries.slices(spark, path), summaries.city_full_summary(spark, path), "city")


@query("dashboard_document", "F19 W9 T-3")
@star.one_daily_pass
def _(spark, path):
    # the ranking has a row per entity and is a table of its own (city_ranking_combined)
    pred = models.city_pred(spark, path)
    m = climate.matrix(spark, path)
    sample = MD.even_sample(pred, "time", ["city"]).select(
        "position", F.round("y_true", 2).alias("actual"), F.round("y_pred", 2).alias("predicted"))
    return D.dashboard({
        "summary": summaries.region_summary(spark, path),
        "latest": SM.latest_metrics(climate.region_current(spark, path), SPEC),
        "model": MD.regression_metrics(pred),
        "predictions": sample,
        "threshold_days": SM.threshold_days(star.city_daily(spark, path), SPEC, summaries.THRESHOLDS),
        "region_years": m.groupBy("year").agg(F.round(F.avg("anomaly"), 2).alias("mean_anomaly")),
    })


def _entity_documents(spark, path):
    return REGISTRY["entity_documents"].run(spark, path)


@query(
    "entity_document_regional", "F19 F18",
    with_sql(MATRIX) + " SELECT city, year, month, mean_temp AS temp, anomaly, z_score AS z FROM matrix",
    "temp anomaly z",
)
def _(spark, path):
    # the documents' own cells, read back from their JSON
    kind = "struct<regional: struct<data: map<string, map<string, struct<temp: double, anomaly: double, z: double>>>>>"
    d = _entity_documents(spark, path).select("city", F.from_json("document", kind).alias("d"))
    years = d.select("city", F.explode("d.regional.data").alias("year", "m"))
    return years.select("city", F.col("year").cast("int").alias("year"), F.explode("m").alias("month", "c")).select(
        "city", "year", F.col("month").cast("int").alias("month"), "c.*")


@query(
    "entity_document_months", "F19",
    with_sql(summaries.SLICES) + """ SELECT city, CAST(month AS INTEGER) AS month, CAST(year AS INTEGER) AS year,
      round(mean_temp_c, 3) AS mean_temp_c, round(anomaly_c, 3) AS anomaly_c, round(zscore, 3) AS zscore FROM slices""",
    "mean_temp_c anomaly_c zscore",
)
def _(spark, path):
    kind = "struct<months: map<string, struct<annual: array<struct<year: int, mean_temp_c: double, anomaly_c: double, zscore: double>>>>>"
    d = _entity_documents(spark, path).select("city", F.from_json("document", kind).alias("d"))
    months = d.select("city", F.explode("d.months").alias("month", "m"))
    return months.select("city", F.col("month").cast("int").alias("month"), F.explode("m.annual").alias("a")).select("city", "month", "a.*")


@query(
    "entity_document_summary", "F19",
    with_sql(summaries.CITY_SUMMARY) + " SELECT city, ytd_mean_temp, ytd_total_precip, temp_deviation, temp_zscore, precip_zscore FROM summary",
    "ytd_mean_temp ytd_total_precip temp_deviation temp_zscore precip_zscore",
)
def _(spark, path):
    kind = ("struct<summary: struct<ytd_mean_temp: double, ytd_total_precip: double, temp_deviation: double, "
            "temp_zscore: double, precip_zscore: double>>")
    return _entity_documents(spark, path).select("city", F.from_json("document", kind)["summary"].alias("s")).select("city", "s.*")


@query(
    "dashboard_region_years", "F19",
    with_sql(MATRIX) + " SELECT CAST(year AS INTEGER) AS year, round(avg(anomaly), 2) AS mean_anomaly FROM matrix GROUP BY year",
    "mean_anomaly",
)
def _(spark, path):
    kind = "struct<region_years: array<struct<year: int, mean_anomaly: double>>>"
    d = REGISTRY["dashboard_document"].run(spark, path)
    return d.select(F.explode(F.from_json("document", kind)["region_years"]).alias("r")).select("r.*")
