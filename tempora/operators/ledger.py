"""Views over a table of model runs: name, run_id, start_time and a map of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_history(runs: DataFrame, name: str, required: list[str], limit: int | None = None) -> DataFrame:
    """Runs of a name with the required metrics, oldest first; with ``limit`` among the first runs only."""
    first = runs.filter(F.col("name") == name).orderBy("start_time", "run_id")
    if limit is not None:
        first = first.limit(limit)
    have = [F.try_element_at("metrics", F.lit(m)).isNotNull() for m in required]
    for h in have:
        first = first.filter(h)
    return first


def newest_run(runs: DataFrame) -> DataFrame:
    """Latest run of every name."""
    order = F.struct("start_time", "run_id")
    return runs.groupBy("name").agg(
        F.max_by("run_id", order).alias("run_id"), F.max("start_time").alias("start_time"),
        F.max_by("metrics", order).alias("metrics"))


def champion(versions: DataFrame) -> DataFrame:
    """Newest version of every model that passed its gate; among equal versions the largest run id."""
    return versions.filter("passed").groupBy("model").agg(
        F.max("version").alias("version"), F.max_by("run_id", F.struct("version", "run_id")).alias("run_id"))


def version_for_run(versions: DataFrame) -> DataFrame:
    """Highest version registered for each run of a model."""
    return versions.groupBy("model", "run_id").agg(F.max("version").alias("version"))


def promotions(versions: DataFrame, alias: str = "champion") -> DataFrame:
    """A row per promotion: the version that took the alias, the one it took it from, and its tags.

    Versions that passed their gate take the alias in the order of their numbers; of several runs
    of a version the largest id counts. ``current`` marks the one that has the alias now.
    """
    passed = versions.filter("passed").groupBy("model", "version").agg(F.max("run_id").alias("run_id"))
    w = Window.partitionBy("model").orderBy("version")
    return passed.select(
        "model", F.lit(alias).alias("alias"), "version", "run_id", F.lag("version").over(w).alias("previous_version"),
        F.lead("version").over(w).isNull().alias("current"),
        F.create_map(F.lit("quality_gate"), F.lit("passed"), F.lit("promoted_alias"), F.lit(alias)).alias("tags"))
