"""Templated documents from result tables: retrieval corpus, reports, nested maps and the dashboard.

The wording of the documents is a fixed value: it is the output format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.calendar import month_name
from tempora.functions.json_safe import json_safe_table
from tempora.functions.numeric import fixed
from tempora.functions.text import normalize_text, paragraphs
from tempora.operators.sft import union

DOC_COLUMNS = ("id", "title", "source", "text")


def _t(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _n(c: str, digits: int = 2, plus: bool = False) -> Column:
    return F.coalesce(fixed(F.col(c), digits, plus), F.lit("n/a"))


def _doc(df: DataFrame, doc_id, title, source: str, text: Column) -> DataFrame:
    """One document per row; texts are normalised and empty ones dropped."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(as_col(doc_id).alias("id"), as_col(title).alias("title"), F.lit(source).alias("source"),
                     normalize_text(text).alias("text")).filter(F.col("text") != "")


def overview_document(summary: DataFrame, latest: DataFrame, place: str, period: str, source: str = "ytd_summary") -> DataFrame:
    """Region headline. Summary and latest figures are single rows and meet as scalar sub-queries."""
    week = latest.agg(F.max("latest_7d_temp_anomaly")).scalar()
    s = summary.withColumn("week", week)
    return _doc(s, "weather-overview", f"{place} YTD weather overview", source, _t(
        f"{place} year-to-date weather for {period} shows a temperature anomaly of ", _n("temp_deviation"), " C with z-score ",
        _n("temp_zscore"), ". Precipitation anomaly is ", _n("precip_deviation", 1), " mm with z-score ", _n("precip_zscore"),
        ". The latest 7-day temperature anomaly is ", _n("week"), " C."))


def ranking_document(summary: DataFrame, entity: str, source: str = "entity_rankings") -> DataFrame:
    name = F.col(entity).alias("e")

    def top(dev: str, z: str) -> Column:
        order = F.struct((-F.abs(z)).alias("v"), name)
        return F.min_by(F.struct(name, F.col(dev).alias("a"), F.col(z).alias("z")), F.when(F.col(z).isNotNull(), order))

    score = F.greatest(F.abs("temp_zscore"), F.abs("precip_zscore"))
    f = summary.agg(
        top("temp_deviation", "temp_zscore").alias("t"), top("precip_deviation", "precip_zscore").alias("p"),
        F.min_by(F.struct(name, score.alias("s")), F.struct((-score).alias("v"), name)).alias("c"))

    def line(kind: str, c: str) -> Column:
        return _t(f"The strongest {kind} signal is ", F.col(f"{c}.e"), " with anomaly ", _n(f"{c}.a"), " and z-score ", _n(f"{c}.z"), ".")

    combined = _t("The highest combined anomaly ranking is ", F.col("c.e"), " with combined score ", _n("c.s"), ".")
    return _doc(f, "weather-city-rankings", "City anomaly rankings", source,
                F.concat_ws(" ", line("temperature", "t"), line("precipitation", "p"), combined))


def slice_documents(summary: DataFrame, entity: str, source: str = "month_slices") -> DataFrame:
    """Overview and extremes of every (entity, month) slice."""
    month = month_name(F.col("month"))
    who = _t(F.col(entity), " ", month)
    slug = _t(F.lower(F.replace(entity, F.lit(" "), F.lit("-"))), "-", F.lower(month))
    year = lambda c: F.col(c).cast("string")
    overview = _doc(summary, _t(slug, "-overview"), _t(who, " anomaly overview"), source, _t(
        who, " through day ", year("cutoff_day"), " in ", year("end_year"), " has mean temperature ", _n("latest_mean_temp"),
        " C, an anomaly of ", _n("latest_anomaly"), " C, and z-score ", _n("latest_zscore"), ". The baseline mean is ",
        _n("baseline_mean"), " C with standard deviation ", _n("baseline_std"), " C."))
    extremes = _doc(summary, _t(slug, "-extremes"), _t(who, " historical extremes"), source, _t(
        "The warmest ", month, " slice in the window was ", year("warmest_year"), " with anomaly ", _n("warmest_anomaly"),
        " C. The coldest was ", year("coldest_year"), " with anomaly ", _n("coldest_anomaly"), " C."))
    return overview.unionByName(extremes)


def model_document(metrics: DataFrame, source: str = "model_evaluation", usable_r2: float = 0.65) -> DataFrame:
    quality = F.when(F.col("r2") >= usable_r2, "usable").otherwise("weak")
    return _doc(metrics, "ml-evaluation", "Climate model evaluation", source, _t(
        "The climate model reports R2 ", _n("r2", 4), ", RMSE ", _n("rmse", 4), ", and MAE ", _n("mae", 4),
        " on held-out data. That indicates ", quality,
        " predictive skill for climate anomaly briefing rather than exact deterministic weather forecasting."))


def threshold_document(threshold_days: DataFrame, place: str, period: str, year: int, baseline: str, source: str = "threshold_days") -> DataFrame:
    """Counts of all thresholds in one text; one row per metric is gathered."""
    line = _t(F.initcap(F.replace("metric", F.lit("_"), F.lit(" "))), ": ", F.col("current").cast("string"), " (baseline ",
              _n("baseline_mean", 1), ", anomaly ", _n("anomaly", 1, True), ").")
    f = threshold_days.agg(F.sort_array(F.collect_list(line)).alias("lines"))
    head = f"{place} {period} {year} heat and frost day counts versus the {baseline} baseline: "
    return _doc(f.filter(F.size("lines") > 0), "heat-stress", f"{place} {year} heat and frost stress", source,
                _t(head, F.array_join("lines", " ")))


def degree_day_documents(ytd: DataFrame, season: DataFrame, geo: str, baseline: str, source: str = "degree_days") -> DataFrame:
    """Year-to-date and heating-season degree days of every series."""
    y = ytd.select(geo, _t(
        F.col(geo), " Heating Degree Days ", F.col("label"), ": ", _n("total_hdd", 1), f" HDD total, versus a {baseline} baseline of ",
        _n("baseline_mean", 1), " HDD (anomaly ", _n("anomaly", 1, True),
        " HDD). A negative anomaly indicates lower heating demand than the historical average, consistent with a warmer-than-normal winter.").alias("y"))
    s = season.filter(F.col("months_included") > 0).select(geo, _t(
        "Heating season ", F.col("label"), ": ", _n("total_hdd", 1), " HDD so far (baseline ", _n("baseline_mean", 1), ", anomaly ",
        _n("anomaly", 1, True), " HDD).").alias("s"))
    j = y.join(s, geo, "left")
    return _doc(j, _t("heating-degree-days-", F.lower(geo)), _t(F.col(geo), " Heating Degree Days"), source, F.concat_ws(" ", "y", "s"))


def report_documents(reports: DataFrame, limit: int = 3) -> DataFrame:
    """First paragraphs of reports (columns name, text) as documents of their own."""
    p = reports.select("name", F.posexplode(paragraphs(F.col("text"), limit)).alias("i", "p"))
    n = (F.col("i") + 1).cast("string")
    return _doc(p, _t("report-", F.col("name"), "-", n), _t(F.col("name"), " narrative ", n), "report", F.col("p"))


def corpus(parts: list[DataFrame]) -> DataFrame:
    return union(parts)


# reports ---------------------------------------------------------------------------------------------

def summary_report(full_summary: DataFrame, entity: str) -> DataFrame:
    """Markdown section per entity: (entity, text)."""
    body = _t(
        "### ", F.col(entity), "\n- Mean temperature: ", _n("ytd_mean_temp"), " C\n- Temperature anomaly: ", _n("temp_deviation"),
        " C\n- Latest 7-day temperature anomaly: ", _n("latest_7d_temp_anomaly"), " C\n- Precipitation: ", _n("ytd_total_precip"),
        " mm\n- Precipitation anomaly: ", _n("precip_deviation"), " mm\n- Latest cumulative precipitation anomaly: ",
        _n("latest_cumulative_precip_anomaly"), " mm\n")
    return full_summary.select(entity, body.alias("text"))


def region_report(region_summary: DataFrame, region_latest: DataFrame, extremes: DataFrame, place: str, period: str) -> DataFrame:
    """Head of the markdown report, one row. Every input is a single row and is read as a scalar."""
    last = region_latest.agg(F.max(F.struct("latest_7d_temp_anomaly", "latest_cumulative_precip_anomaly"))).scalar()
    ext = extremes.agg(F.max(F.struct("warmest_entity", "warmest_7d_anomaly", "driest_entity", "driest_deviation"))).scalar()
    s = region_summary.withColumns({"l": last, "x": ext})
    return s.select(F.lit("weather-summary").alias("name"), _t(
        f"# {place} Weather Summary\n\nCoverage: {period}\nDays observed: ", F.col("days_observed").cast("string"),
        "\n\n## Country-level anomaly\n\n- YTD mean temperature: ", _n("ytd_mean_temp"), " C\n- Temperature deviation vs baseline mean: ",
        _n("temp_deviation"), " C\n- Temperature z-score: ", _n("temp_zscore"), "\n- Latest 7-day temperature anomaly: ",
        _n("l.latest_7d_temp_anomaly"), " C\n- YTD precipitation: ", _n("ytd_total_precip"), " mm\n- Precipitation deviation vs baseline mean: ",
        _n("precip_deviation"), " mm\n- Precipitation z-score: ", _n("precip_zscore"), "\n- Latest cumulative precipitation anomaly: ",
        _n("l.latest_cumulative_precip_anomaly"), " mm\n\n## Highlights\n\n- Strongest recent warm-up: ", F.col("x.warmest_entity"), " (",
        _n("x.warmest_7d_anomaly"), " C over the latest 7 days)\n- Largest precipitation deficit: ", F.col("x.driest_entity"), " (",
        _n("x.driest_deviation"), " mm)\n\n## City-level anomaly\n").alias("text"))


def slice_report(summary: DataFrame, entity: str) -> DataFrame:
    """Markdown report of every (entity, month) slice."""
    m = month_name(F.col("month"))
    n = lambda c: F.col(c).cast("string")
    body = _t(
        "# ", F.col(entity), " ", m, " Temperature Anomalies\n\nWindow: ", n("start_year"), " to ", n("end_year"), "\n", m,
        " day cutoff used for every year: ", F.lpad(n("month"), 2, "0"), "-", F.lpad(n("cutoff_day"), 2, "0"), "\nYears analyzed: ",
        n("years_included"), "\n\n## Baseline\n\n- Baseline mean ", m, " temperature: ", _n("baseline_mean"), " C\n- Baseline standard deviation: ",
        _n("baseline_std"), " C\n\n## Latest Year\n\n- Year: ", n("end_year"), "\n- Mean temperature: ", _n("latest_mean_temp"),
        " C\n- Anomaly: ", _n("latest_anomaly"), " C\n- Z-score: ", _n("latest_zscore"), "\n\n## Extremes\n\n- Warmest ", m, " slice: ",
        n("warmest_year"), " (", _n("warmest_anomaly"), " C anomaly)\n- Coldest ", m, " slice: ", n("coldest_year"), " (",
        _n("coldest_anomaly"), " C anomaly)")
    name = _t(F.lower(F.replace(entity, F.lit(" "), F.lit("-"))), "-", F.lower(m))
    return summary.select(entity, "month", name.alias("name"), body.alias("text"))


# nested forms ----------------------------------------------------------------------------------------

def matrix_pivot(matrix: DataFrame, entity: str, value: str = "anomaly") -> DataFrame:
    """One row per (entity, year) with the columns m1..m12; the months are listed, so no extra pass finds them."""
    wide = matrix.groupBy(entity, "year").pivot("month", list(range(1, 13))).agg(F.first(value))
    return wide.withColumnsRenamed({str(i): f"m{i}" for i in range(1, 13)})


def matrix_maps(matrix: DataFrame, entity: str) -> DataFrame:
    """Per entity: years, months and a year -> month -> {temp, anomaly, z} map with text keys.

    An entity has at most 12 entries per year, first folded per year and then per entity.
    """
    cell = F.struct(F.col("mean_temp").alias("temp"), "anomaly", F.col("z_score").alias("z"))
    per_year = matrix.groupBy(entity, "year").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("month"), cell.alias("c"))))).alias("by_month"),
        F.collect_set("month").alias("ms"))
    text_keys = F.transform_keys("by_month", lambda k, _: k.cast("string"))
    return per_year.groupBy(entity).agg(
        F.sort_array(F.collect_set("year")).alias("years"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("ms")))).alias("months"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("year").cast("string").alias("y"), F.map_entries(text_keys).alias("m"))))).alias("entries"),
    ).select(entity, "years", "months", F.transform_values("entries", lambda _, v: F.map_from_entries(v)).alias("data"))


def slice_documents_nested(histories: DataFrame, entity: str) -> DataFrame:
    """Per (entity, month): window, baseline, latest year, extremes and the annual list as one struct."""
    r = lambda c, d: F.round(c, d)
    annual = F.sort_array(F.collect_list(F.struct("year", r("mean_temp_c", 3).alias("mean_temp_c"), r("anomaly_c", 3).alias("anomaly_c"), r("zscore", 3).alias("zscore"))))
    out = histories.groupBy(entity, "month").agg(
        F.struct(F.min("year").alias("start_year"), F.max("year").alias("end_year"), F.count("*").alias("years_included"),
                 F.max("cutoff_day").alias("cutoff_day"), F.max("last_observation").cast("string").alias("execution_date")).alias("window"),
        F.struct(r(F.avg("mean_temp_c"), 3).alias("mean_temp_c"), r(F.coalesce(F.stddev_samp("mean_temp_c"), F.lit(0.0)), 3).alias("std_temp_c")).alias("baseline"),
        F.max(F.struct("year", r("mean_temp_c", 2).alias("mean_temp_c"), r("anomaly_c", 2).alias("anomaly_c"), r("zscore", 2).alias("zscore"))).alias("latest_year"),
        F.struct(F.max(F.struct(r("anomaly_c", 2).alias("anomaly_c"), "year")).alias("warmest"),
                 F.min(F.struct(r("anomaly_c", 2).alias("anomaly_c"), "year")).alias("coldest")).alias("extremes"),
        annual.alias("annual"),
    )
    return out.withColumn("month_name", month_name(F.col("month")))


def entity_documents(matrix: DataFrame, histories: DataFrame, summary: DataFrame, entity: str) -> DataFrame:
    """One JSON document per entity; the number of documents grows with the entities, their size does not."""
    maps = matrix_maps(matrix, entity).select(entity, F.struct("years", "months", "data").alias("regional"))
    months = slice_documents_nested(histories, entity)
    doc = F.struct("month_name", "window", "baseline", "latest_year", "extremes", "annual")
    by_month = months.groupBy(entity).agg(F.map_from_entries(
        F.sort_array(F.collect_list(F.struct(F.lpad(F.col("month").cast("string"), 2, "0").alias("m"), doc.alias("d"))))).alias("months"))
    head = summary.select(entity, F.struct(*[c for c in summary.columns if c != entity]).alias("summary"))
    joined = head.join(maps, entity, "full").join(by_month, entity, "full")
    safe = json_safe_table(joined)
    return safe.select(entity, F.to_json(F.struct(entity, "summary", "regional", "months")).alias("document"))


def dashboard(sections: dict[str, DataFrame]) -> DataFrame:
    """One JSON document from single-row sections.

    A section with several rows becomes a list, so callers pass only tables of bounded size
    (a top list, one row per metric or year). Sections enter as scalar sub-queries: no joins.
    """
    spark = next(iter(sections.values())).sparkSession
    parts = []
    for name, df in sections.items():
        safe = json_safe_table(df)
        row = F.struct(*safe.columns)
        parts.append(safe.agg(F.sort_array(F.collect_list(row)).alias("s")).scalar().alias(name))
    one = spark.range(1).select(*parts)
    return one.select(F.to_json(F.struct(*sections)).alias("document"))
