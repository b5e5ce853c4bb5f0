"""Results that are kept and updated, and writes that are published only if their gate passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog import climate, models
from tempora.catalog.base import MATRIX, SPEC, query, with_sql
from tempora.operators import climatology as C
from tempora.operators.moments import StoredMoments
from tempora.plans.publish import Check, Published
from tempora.session import shared_dir, shared_table
from tempora.sources import star

MATRIX_DOUBLES = "mean_temp baseline_mean baseline_std anomaly z_score"


def month_rows(spark, path):
    """Daily temperatures with their month; some days have a wrong first version, the second half of 2001 comes later."""
    d = star.city_daily(spark, path).select("city", "time", F.trunc("time", "month").alias("month"), F.col(SPEC.temp).alias("temp"))
    wrong = F.pmod(F.hash("city", "time"), F.lit(50)) == 0
    late = F.col("time") >= F.lit("2001-07-01").cast("date")
    return shared_table(d.withColumns({"wrong": wrong & ~late, "late": late, "first": F.when(wrong, F.col("temp") + 5).otherwise(F.col("temp"))}), "days")


def from_moments(kept):
    return kept.select("city", F.year("month").alias("year"), F.month("month").alias("month"), F.col("mean").alias("mean_temp"), F.col("n").alias("days"))


@query("moments_matrix", "A2 A8 A10 I8 I9 I10", with_sql(MATRIX) + " SELECT * FROM matrix", MATRIX_DOUBLES)
def _(spark, path):
    d = month_rows(spark, path)
    kept = StoredMoments(spark, shared_dir(spark, "moments"), ["city", "month"], "month", "temp")
    kept.update(d.filter("not late").withColumn("temp", F.col("first")), None, 0)
    kept.update(d.filter("late"), None, 1)
    # corrections: the new versions come in, the old ones are taken out again
    kept.update(d.filter("wrong"), d.filter("wrong").withColumn("temp", F.col("first")), 2)
    return C.monthly_anomaly_matrix(from_moments(kept.read()), SPEC)


MODEL_CHECKS = [Check("mse", "mse", "<=", 50.0, required=True), Check("r2", "r2", ">=", 0.65, required=True)]


@query(
    "model_gate_in_write", "Q2 A25",
    with_sql(models.PRED) + ", m AS (" + models.METRICS.format(k="", g="") + "), g AS ("
    + models._gate_sql("m", "", [("mse", "mse", 50, "mse <= 50"), ("r2", "r2", 0.65, "r2 >= 0.65")])
    + ") SELECT *, (SELECT bool_and(passed) FROM g) AS published FROM g",
    "value threshold",
)
def _(spark, path):
    out = Published(spark, shared_dir(spark, "predictions"))
    residual = F.col("y_true") - F.col("y_pred")
    mse = F.avg(residual * residual)
    return out.write(models.region_pred(spark, path), {"mse": mse, "r2": 1 - mse / F.var_pop("y_true")}, MODEL_CHECKS).rows(spark)


@query("matrix_published", "Q1 Q3 A10", with_sql(MATRIX) + " SELECT * FROM matrix", MATRIX_DOUBLES)
def _(spark, path):
    """The matrix is published; a later write with a sentinel left in fails its gate and changes nothing for readers."""
    facts = {"cells": F.count("*"), "max_z": F.max(F.abs("z_score")), "coldest": F.min("mean_temp"), "unknown": F.count_if(F.col("mean_temp").isNull())}
    checks = [Check("cells", "cells", ">=", 1), Check("max_z", "max_z", "<=", 50.0), Check("coldest", "coldest", ">=", -90.0), Check("unknown", "unknown", "==", 0)]
    out = Published(spark, shared_dir(spark, "matrix"))
    good = climate.matrix(spark, path)
    out.write(good, facts, checks, ["year"])
    spoiled = good.withColumn("mean_temp", F.when(F.col("month") == 3, F.lit(SPEC.sentinel)).otherwise(F.col("mean_temp")))
    out.write(spoiled, facts, checks, ["year"])
    return out.read().select(good.columns)
