"""The dashboard document from all its result tables, and its leaves read back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from tempora.catalog import answers, documents, models, streams, summaries  # noqa: F401  their queries are the sections
from tempora.catalog.base import REGISTRY, query
from tempora.operators import sections as SC
from tempora.sources import star


@dataclass(frozen=True)
class Section:
    """A registered result as a section: key columns, shown columns by kind, and which rows."""

    name: str
    source: str
    keys: tuple[str, ...]
    numbers: tuple[str, ...]
    texts: tuple[str, ...] = ()
    where: str = ""
    first: tuple[int, str] | None = None

    def rows(self, spark, path):
        df = REGISTRY[self.source].run(spark, path)
        if self.where:
            df = df.filter(self.where)
        if self.first:
            df = df.orderBy(*self.first[1].split(", ")).limit(self.first[0])
        dates = {c: F.col(c).cast("string") for c in self.texts if dict(df.dtypes)[c] == "date"}
        return SC.section(self.name, df.withColumns(dates), list(self.keys), [*self.numbers, *self.texts])

    def sql(self) -> str:
        leaf = "{{'field': '{0}', 'number': {1}, 'text': {2}}}".format
        leaves = [leaf(c, f'CAST("{c}" AS DOUBLE)', "CAST(NULL AS VARCHAR)") for c in self.numbers]
        leaves += [leaf(c, "CAST(NULL AS DOUBLE)", f'CAST("{c}" AS VARCHAR)') for c in self.texts]
        keys = ", ".join(f'CAST("{k}" AS VARCHAR)' for k in self.keys)
        key = f"concat_ws('|', {keys})" if keys else "''"
        rest = f" WHERE {self.where}" if self.where else ""
        rest += f" ORDER BY {self.first[1]} LIMIT {self.first[0]}" if self.first else ""
        return f"SELECT '{self.name}' AS section, {key} AS key, unnest([{', '.join(leaves)}], recursive := true) FROM (SELECT * FROM ({REGISTRY[self.source].sql}) AS q{rest}) AS s"


ONE_MONTH = "city = 'ASIA' AND month = 3"
SECTIONS = (
    Section("data", "dataset_profile", (), ("rows",), ("min_date", "max_date")),
    Section("month_anomaly", "month_slice_summary", (), (
        "start_year", "end_year", "years_included", "cutoff_day", "baseline_mean", "baseline_std", "latest_mean_temp", "latest_anomaly", "latest_zscore",
        "warmest_year", "warmest_anomaly", "coldest_year", "coldest_anomaly"), ("city", "month_name", "execution_date"), ONE_MONTH),
    Section("month_annual", "month_slice", ("year",), ("mean_temp_c", "anomaly_c", "zscore", "days_observed"), (), ONE_MONTH),
    Section("region", "ytd_summary", (), (
        "current_year", "days_observed", "ytd_mean_temp", "temp_deviation", "temp_zscore", "ytd_total_precip", "precip_deviation", "precip_zscore")),
    Section("region_latest", "latest_metrics", (), ("latest_7d_temp_anomaly", "latest_30d_temp_anomaly", "latest_cumulative_precip_anomaly"), ("latest_time",)),
    Section("rankings", "city_ranking_combined", ("city",), ("combined_score", "temperature_z", "precipitation_z")),
    Section("trend", "trend_direction", ("city",), ("temp_deviation", "latest_7d_temp_anomaly", "trend_direction")),
    Section("model", "regression_metrics", (), ("n", "r2", "rmse", "mae", "mse", "residual_mean", "residual_std")),
    Section("predictions", "even_sample", ("position",), ("y_true", "y_pred"), ("city", "time")),
    Section("runs", "run_history", ("run_id",), ("r2", "rmse"), ("date",), first=(200, "date, run_id")),
    Section("latest_run", "newest_run", ("name",), ("run_id", "rmse"), ("date",)),
    Section("weather_gate", "weather_gate_region", ("check",), ("value", "threshold"), ("passed", "first_failure")),
    Section("model_gate", "model_gate", ("city", "check"), ("value", "threshold"), ("passed", "first_failure")),
    Section("threshold_days", "threshold_days", ("metric",), ("current", "baseline_mean", "anomaly")),
    Section("degree_days", "degree_day_ytd", ("city",), ("months", "total_hdd", "baseline_mean", "anomaly"), ("label",)),
    Section("degree_day_season", "degree_day_season", ("city",), ("months_included", "total_hdd", "baseline_mean", "anomaly"), ("label",)),
    Section("degree_day_lag", "degree_day_lag", ("city",), ("observations", "data_lag_months"), ("data_through",)),
    Section("questions", "month_extreme_answers", ("question",), (), ("answer", "interpretation", "source_title"), "question LIKE 'What was the hottest %'"),
)


def sections(spark, path):
    return SC.union_sections([s.rows(spark, path) for s in SECTIONS])


@query("dashboard_complete", "F19")
@star.one_daily_pass
def _(spark, path):
    return SC.document(sections(spark, path))


@query("dashboard_sections", "F19 I17 T-10 W9 T-3", " UNION ALL ".join(s.sql() for s in SECTIONS), "number")
@star.one_daily_pass
def _(spark, path):
    # every leaf of the finished document, read back from its JSON
    return SC.flat(SC.document(sections(spark, path)))
