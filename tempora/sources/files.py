"""File readers and sinks."""

from __future__ import annotations

import csv
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions.numeric import clean_sentinel
from tempora.spec import ObservationSpec


def observation_schema(spec: ObservationSpec, measures: list[str] | None = None) -> T.StructType:
    cols = measures if measures is not None else spec.measures
    return T.StructType(
        [T.StructField(spec.time, T.DateType())]
        + [T.StructField(c, T.DoubleType()) for c in cols]
        + [T.StructField(spec.entity, T.StringType())]
    )


def read_observations_csv(spark: SparkSession, path: str, spec: ObservationSpec) -> DataFrame:
    """Observation CSV with a header and any subset of the known measures, fill values cleaned.

    The header alone decides which columns exist; types come from the specification, so no
    pass over the data is spent on inference. Files may differ in the order and choice of their
    columns: files of one header are read together and the groups are united by name. A cell
    that does not parse becomes NULL.
    """
    known = {f.name: f for f in observation_schema(spec).fields}
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for file in spark.read.text(path).inputFiles():
        groups[tuple(first_line(spark, file))].append(file)
    parts = []
    for header, files in sorted(groups.items()):
        schema = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
        parts.append(spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(files))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return clean_sentinel(df, spec.sentinel)


def first_line(spark: SparkSession, file: str) -> list[str]:
    """The cells of a CSV file's first line; only that line is read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    raw = at.getFileSystem(conf).open(at)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(raw) if codec else raw, "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    return next(csv.reader([line.lstrip("\ufeff")])) if line else []


def write_ordered_csv(df: DataFrame, path: str, order: list[str | Column]) -> None:
    """CSV part files with a header whose concatenation in file order is the total order."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str, keep_nulls: bool = True) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", not keep_nulls).json(path)


def write_yearly_parquet(df: DataFrame, path: str, year: str = "year") -> None:
    """Parquet partitioned by year, so later runs prune to the years they need.

    AQE sizes the files: the rebalance hint splits a year that is far larger than the others.
    """
    df.hint("rebalance", F.col(year)).write.mode("overwrite").partitionBy(year).parquet(path)
