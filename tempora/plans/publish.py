"""Gated writes: a result is checked in the pass that writes it and becomes visible only if it passes.

The gate's facts are observed metrics of the write itself, so nothing is scanned for them. The
data goes to a folder of its own; a pass publishes the folder by renaming a small manifest into
place, a failure leaves readers with the version they had.
"""

from __future__ import annotations

import operator
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from tempora.streaming.snapshot import Manifests

OPERATORS = {"<=": operator.le, ">=": operator.ge, "==": operator.eq, "<": operator.lt, ">": operator.gt}


@dataclass(frozen=True)
class Check:
    """``value`` names an observed metric; a missing value passes unless ``required``."""

    name: str
    value: str
    test: str
    threshold: float
    required: bool = False
    absolute: bool = False

    def passed(self, facts: Mapping[str, object]) -> bool:
        v = facts[self.value]
        if v is None or v != v:
            return not self.required
        return OPERATORS[self.test](abs(v) if self.absolute else v, self.threshold)


@dataclass(frozen=True)
class Outcome:
    version: int | None
    facts: dict
    checks: list[tuple[str, float | None, float, bool]]

    @property
    def passed(self) -> bool:
        return self.version is not None

    def rows(self, spark: SparkSession) -> DataFrame:
        """(check, value, threshold, passed, first_failure, published), one row per check."""
        failed = next((c[0] for c in self.checks if not c[3]), None)
        return spark.createDataFrame(
            [(n, None if v is None else float(v), float(t), ok, failed, self.passed) for n, v, t, ok in self.checks],
            "check string, value double, threshold double, passed boolean, first_failure string, published boolean")


class Published:
    """Versions of a table in a folder, of which readers see the newest that passed its gate."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.manifests = spark, Manifests(spark, folder)

    def write(self, df: DataFrame, facts: Mapping[str, Column], checks: list[Check], partition_by: list[str] = ()) -> Outcome:
        """Write ``df``, judge it by ``checks`` over ``facts`` (aggregates of its rows), publish it if all pass."""
        seen = Observation(f"gate-{uuid.uuid4().hex}")
        at = f"data/{uuid.uuid4().hex}"
        writer = df.observe(seen, *[c.alias(n) for n, c in facts.items()]).write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.manifests.folder}/{at}")
        got = dict(seen.get)
        judged = [(c.name, got[c.value], c.threshold, c.passed(got)) for c in checks]
        if not all(ok for *_, ok in judged):
            self.manifests.delete(at)
            return Outcome(None, got, judged)
        old = self.manifests.read()
        version = self.manifests.commit(lambda m: {**m, "data": at, "schema": df.schema.json(), "before": old.get("data")})
        return Outcome(version, got, judged)

    def read(self) -> DataFrame:
        m = self.manifests.read()
        if "data" not in m:
            raise FileNotFoundError(self.manifests.folder)
        return self.spark.read.parquet(f"{self.manifests.folder}/{m['data']}")
