"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tempora.catalog import load  # noqa: E402
from tempora.catalog.base import SPEC  # noqa: E402
from tempora.plans import analysis  # noqa: E402
from tempora.session import build_session, remove_shared, shared_dir  # noqa: E402
from tempora.sources import star  # noqa: E402

HEADLINE = (
    "monthly_anomaly_matrix", "matrix_rounded_ordered", "daily_climatology", "daily_anomaly_rolling",
    "daily_anomaly_rolling_region", "monthly_anomalies", "ytd_summary_by_entity", "latest_metrics_by_entity",
    "city_rankings", "threshold_days", "month_slices_all_entities", "degree_day_season", "merge_existing_wins",
    "source_priority", "feature_table", "regression_metrics", "typical_range_every_day", "even_sample", "weather_gate",
    "keyed_sum", "tokenize", "tfidf_topk", "dense_topk", "sft_tokens", "year_month_answers", "stream_monthly_means",
    "corpus_documents", "dashboard_document", "entity_documents", "sft_examples", "forecast_days", "question_router",
    "index_refresh", "combine_monthly_means", "dense_topk_cells", "moments_matrix", "matrix_published", "stream_merge_snapshot",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", max(int(cpus), 1) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    only = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    times = {}
    if not only or "analysis_job" in only:
        def job() -> float:
            t = time.perf_counter()
            analysis.run(star.daily_from_rows(star.clean_sentinel(star.raw_observations(spark, path))), SPEC, shared_dir(spark, "analysis"))
            return time.perf_counter() - t

        job()
        times["analysis_job"] = round(statistics.median(job() for _ in range(RUNS)), 3)
        print("analysis_job", times["analysis_job"], file=sys.stderr, flush=True)
    for name in [n for n in only if n != "analysis_job"] or ([] if only else HEADLINE):
        run = registry[name].run

        def once() -> float:
            t = time.perf_counter()
            run(spark, path).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t

        once()
        times[name] = round(statistics.median(once() for _ in range(RUNS)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(path.rstrip("/")),
    }))
    remove_shared(spark)
    spark.stop()


if __name__ == "__main__":
    main()
