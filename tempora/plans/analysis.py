"""Year-to-date analysis job: daily observations in, all anomaly tables, rankings and reports out."""

from __future__ import annotations

from collections.abc import Callable, Generator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions.calendar import with_year_month_day
from tempora.operators import climatology as C
from tempora.operators import documents as D
from tempora.operators import gates as G
from tempora.operators import summary as S
from tempora.sources.files import write_yearly_parquet
from tempora.spec import ObservationSpec


Tables = dict[str, DataFrame]


def _levels(entity_ytd: DataFrame, region_ytd: DataFrame, spec: ObservationSpec, place: str) -> Generator[Tables, Tables]:
    """The tables in levels: each level is yielded, and the next reads what is sent back for it."""
    e = (spec.entity,)
    period = f"01-01 to {spec.cutoff}"
    base = yield {
        "region_annual": S.annual_summary(region_ytd, spec),
        "entity_annual": S.annual_summary(entity_ytd, spec, e),
        "region_daily_anomalies": C.current_daily_anomalies(region_ytd, spec),
        "entity_daily_anomalies": C.current_daily_anomalies(entity_ytd, spec, e),
        "region_monthly": C.monthly_anomalies(region_ytd, spec),
    }
    entity_summary = S.weather_summary(base["entity_annual"], spec, e).join(S.latest_metrics(base["entity_daily_anomalies"], spec, e), spec.entity)
    facts = yield {
        "region_latest": S.latest_metrics(base["region_daily_anomalies"], spec),
        "region_summary": S.weather_summary(base["region_annual"], spec),
        "entity_summary": S.trend_direction(entity_summary),
    }
    ranks = S.city_rankings(facts["entity_summary"], spec.entity)
    thresholds = S.threshold_days(entity_ytd, spec)
    yield {
        "entity_monthly": C.monthly_anomalies(entity_ytd, spec, e),
        "ranking_temperature": ranks["temperature"],
        "ranking_precipitation": ranks["precipitation"],
        "ranking_combined": ranks["combined"],
        "gate": G.weather_gate(facts["region_summary"], base["region_monthly"], []),
        "report": D.region_report(facts["region_summary"], facts["region_latest"], S.extreme_entities(facts["entity_summary"], spec.entity), place, period),
        "entity_reports": D.summary_report(facts["entity_summary"], spec.entity),
    } | ({} if thresholds is None else {"threshold_days": thresholds})


def _through(levels: Generator[Tables, Tables], store: Callable[[Tables], Tables]) -> Tables:
    out, level = {}, next(levels)
    while True:
        stored = store(level)
        out |= stored
        try:
            level = levels.send(stored)
        except StopIteration:
            return out


def analysis_tables(entity_ytd: DataFrame, region_ytd: DataFrame, spec: ObservationSpec, place: str = "Region") -> Tables:
    """Every table of the analysis from the two year-to-date daily tables."""
    return _through(_levels(entity_ytd, region_ytd, spec, place), lambda level: level)


def run(observations: DataFrame, spec: ObservationSpec, out: str, place: str = "Region") -> dict[str, str]:
    """Store the daily tables partitioned by year, then write every result from the stored copies.

    The raw observations are read once. The stored daily tables cut the lineage: losing an
    executor later re-reads them instead of the raw data, and year filters prune partitions.
    Results that others need are written before them and read back; the tables of one level are
    written at the same time, so small jobs share the executors.
    """
    spark = observations.sparkSession
    known = observations.filter(F.col(spec.entity).isNotNull())
    daily = known.groupBy(spec.entity, spec.time).agg(*[F.avg(c).alias(c) for c in spec.present(observations)])
    write_yearly_parquet(with_year_month_day(daily, spec.time), f"{out}/entity_daily")
    stored = spark.read.parquet(f"{out}/entity_daily")
    region = C.region_daily(stored, spec, spec.cutoff)
    write_yearly_parquet(region, f"{out}/region_daily")
    entity_ytd = C.entity_daily(stored, spec, spec.cutoff)

    def write(table: tuple[str, DataFrame]) -> tuple[str, DataFrame]:
        name, df = table
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return name, spark.read.schema(df.schema).parquet(f"{out}/{name}")

    with ThreadPoolExecutor(8) as pool:
        written = _through(_levels(entity_ytd, spark.read.parquet(f"{out}/region_daily"), spec, place), lambda level: dict(pool.map(write, level.items())))
    return {name: f"{out}/{name}" for name in ("entity_daily", "region_daily", *written)}
