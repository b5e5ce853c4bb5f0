"""Shape of the physical plans and the two end-to-end jobs."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tempora.catalog import load, text
from tempora.operators import documents as D
from tempora.operators import retrieval as R
from tempora.plans import analysis, regional
from tempora.session import shared_table
from tempora.sources import star
from tempora.spec import ObservationSpec

PATH = "/root/testdata/sf0.001"
LAZY = [
    "monthly_anomaly_matrix", "daily_anomaly_rolling", "monthly_anomalies", "ytd_summary_by_entity", "city_rankings",
    "month_slices_all_entities", "degree_day_season", "source_priority", "feature_table", "typical_range_every_day",
    "even_sample", "weather_gate", "weather_gate_region", "question_slots", "year_month_answers", "dense_topk", "sft_split",
    "sft_tokens", "dashboard_document", "corpus_documents", "share_of_latest_year",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops_and_no_python(spark, name):
    p = plan(load()[name].run(spark, PATH))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in p, bad


def test_year_bounds_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    p = plan(star.city_daily(spark, PATH, 1995, 1999))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(l_shipdate" in p and "LessThan(l_shipdate" in p
    line = next(x for x in p.splitlines() if "lineitem" in x)
    assert "l_returnflag" not in line.split("ReadSchema")[1] and "l_tax" in line.split("ReadSchema")[1]


def test_matrix_scans_the_source_once(spark):
    p = plan(load()["monthly_anomaly_matrix"].run(spark, PATH))
    assert p.count("lineitem.parquet") == 1


def test_climatology_and_current_year_scan_their_own_years(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    p = plan(load()["daily_anomaly_rolling"].run(spark, PATH))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [x for x in p.splitlines() if "lineitem.parquet" in x]
    assert len(scans) == 2 and all("GreaterThanOrEqual(l_shipdate" in x and "LessThan(l_shipdate" in x for x in scans)


def test_line_items_are_not_broadcast_when_suppliers_are_small(spark):
    p = plan(star.raw_observations(spark, PATH))
    build = p[p.index("BroadcastExchange"):]
    assert "lineitem" not in build.split("FileScan")[1]


def test_regional_job(spark, tmp_path):
    spec = ObservationSpec(baseline=(1995, 1999))
    out = regional.run(star.city_daily(spark, PATH), spec, str(tmp_path), ["ASIA", "EUROPE"])
    assert {r["city"] for r in out.select("city").distinct().collect()} == {"ASIA", "EUROPE"}
    docs = [json.loads(x) for f in (tmp_path / "entities_json").glob("part-*") for x in f.read_text().splitlines()]
    asia = next(d for d in docs if d["city"] == "ASIA")
    assert asia["baseline"] == "1995-1999" and set(asia["data"]["1996"]["3"]) == {"temp", "anomaly", "z"}


def test_analysis_job(spark, tmp_path):
    spec = ObservationSpec(baseline=(1995, 1999), summary_baseline=(1995, 1999), current_year=2001, cutoff="11-04")
    paths = analysis.run(star.city_daily(spark, PATH), spec, str(tmp_path))
    assert {"entity_daily", "region_summary", "ranking_combined", "gate", "report", "threshold_days"} <= set(paths)
    for p in paths.values():
        assert not spark.read.parquet(p).isEmpty()
    report = spark.read.parquet(paths["report"]).first()["text"]
    assert report.startswith("# Region Weather Summary") and "Strongest recent warm-up" in report


def test_dashboard_is_strict_json(spark):
    bad = spark.range(1).select(F.lit(float("nan")).alias("x"), F.lit(date(2024, 1, 1)).alias("d"))
    doc = D.dashboard({"one": bad, "many": spark.range(3)}).first()["document"]
    got = json.loads(doc, parse_constant=lambda c: pytest.fail(c))
    assert got["many"] == [{"id": 0}, {"id": 1}, {"id": 2}] and got["one"][0].get("x") is None


@pytest.mark.parametrize("name", ["corpus_documents", "sft_examples", "dashboard_document", "entity_documents", "forecast_days", "question_router"])
def test_composed_results_read_the_stored_daily_table(spark, name):
    p = plan(load()[name].run(spark, PATH))
    assert "lineitem.parquet" not in p


def test_text_never_crosses_an_exchange(spark):
    p = plan(R.term_counts(star.table(spark, PATH, "documents"), "doc_id", "text"))
    above, below = p.split("Exchange", 1)
    assert p.count("Exchange") == 1 and "Generate explode" in below and "text" not in below.split("\n", 1)[0]


def test_questions_open_only_the_folders_of_their_terms(spark):
    index, vocabulary = text.stored_index(spark, PATH)
    assert text.stored_index(spark, PATH)[0] is index  # written once for one state of the documents
    q = shared_table(R.question_vectors(star.table(spark, PATH, "benchmark"), "item_id", "text", vocabulary), "questions")
    assert "dynamicpruning" in plan(R._dots(index, q.filter("df < 3"), "doc_id", "item_id"))
