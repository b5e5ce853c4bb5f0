"""Monthly anomaly matrix job: observations in, ordered CSV and per-entity summary documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators import climatology as C
from tempora.operators.documents import matrix_maps
from tempora.operators.ingest import allow_list, in_dimension, missing_entities, require_rows
from tempora.sources.files import write_json_lines, write_ordered_csv
from tempora.spec import ObservationSpec


def regional_matrix(observations: DataFrame, spec: ObservationSpec, entities: DataFrame | list[str] | None = None) -> DataFrame:
    """Two-digit matrix of the allowed entities (a literal list or a dimension table)."""
    if isinstance(entities, list):
        observations = allow_list(observations, spec.entity, entities)
    elif entities is not None:
        observations = in_dimension(observations, entities, spec.entity)
    return C.rounded_matrix(C.monthly_anomaly_matrix(C.monthly_means(observations, spec), spec))


def run(observations: DataFrame, spec: ObservationSpec, out: str, entities=None) -> DataFrame:
    """Write the matrix once as Parquet, derive the CSV and the documents from the stored copy."""
    spark = observations.sparkSession
    regional_matrix(observations, spec, entities).write.mode("overwrite").parquet(f"{out}/matrix")
    stored = require_rows(spark.read.parquet(f"{out}/matrix"))
    write_ordered_csv(stored, f"{out}/matrix_csv", [spec.entity, "year", "month"])
    baseline = f"{spec.baseline[0]}-{spec.baseline[1]}"
    write_json_lines(matrix_maps(stored, spec.entity).withColumn("baseline", F.lit(baseline)), f"{out}/entities_json")
    return stored


def entities_without_data(observations: DataFrame, dimension: DataFrame, spec: ObservationSpec) -> DataFrame:
    return missing_entities(dimension, observations, spec.entity)
