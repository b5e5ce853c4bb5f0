"""Fitting, scoring, evaluation, histograms, bias and forecasts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.calendar import circular_days
from tempora.functions.numeric import ratio
from tempora.functions.position import with_global_position
from tempora.operators.features import TARGETS, FeatureContract
from tempora.spec import ObservationSpec

# Upper edges of the prediction histogram.
PREDICTION_EDGES = (-20, -15, -10, -5, 0, 5, 10, 15, 20, 25, 30, 35)


@dataclass(frozen=True)
class LinearModel:
    intercept: float
    coefficients: tuple[float, ...]

    def value(self, columns: tuple[str, ...]) -> Column:
        out = F.lit(self.intercept)
        for c, n in zip(self.coefficients, columns, strict=True):
            out = out + F.lit(c) * F.col(n)
        return out


def fit_regressors(train: DataFrame, contract: FeatureContract) -> dict[str, LinearModel]:
    """A linear model per target present, by the normal equations.

    All moments of all targets are sums of one aggregate over the training rows; the system of
    one equation per input is solved on the driver. Inputs are measured from their training
    means and scaled to the same length, so the squares in the system lose no digits to a large
    common value. An input that does not vary has coefficient 0.
    """
    targets = [t for t in TARGETS if t in train.columns]
    data = contract.apply(train, tuple(targets))
    at = np.array([0.0, *(contract.default(c) for c in contract.columns)])
    x = [F.lit(1.0), *(F.col(c) - F.lit(float(m)) for c, m in zip(contract.columns, at[1:], strict=True))]
    n = len(x)
    cells = []
    for t in targets:
        own = F.col(t).isNotNull()
        cells += [F.sum(F.when(own, x[i] * x[j])) for i in range(n) for j in range(i, n)]
        cells += [F.sum(x[i] * F.col(t)) for i in range(n)]
    row = [v or 0.0 for v in data.agg(*(c.alias(f"m{k}") for k, c in enumerate(cells))).first()]
    models, each = {}, n * (n + 1) // 2 + n
    for k, t in enumerate(targets):
        sums = row[k * each : (k + 1) * each]
        gram = np.zeros((n, n))
        gram[np.triu_indices(n)] = sums[:-n]
        gram = gram + np.triu(gram, 1).T
        length = np.sqrt(gram.diagonal())
        # what is left of a constant input is the rounding of its mean
        varies = length > 1e-12 * np.abs(at) * np.sqrt(gram[0, 0])
        scale = np.divide(1.0, length, out=np.zeros(n), where=varies & (length > 0))
        w = scale * np.linalg.lstsq(gram * np.outer(scale, scale), np.array(sums[-n:]) * scale, rcond=1e-13)[0]
        models[t] = LinearModel(float(w[0] - w[1:] @ at[1:]), tuple(map(float, w[1:])))
    return models


def coefficients(spark, models: dict[str, LinearModel], contract: FeatureContract) -> DataFrame:
    rows = [
        (t, n, float(v)) for t, m in models.items()
        for n, v in [("intercept", m.intercept), *zip(contract.columns, m.coefficients)]
    ]
    return spark.createDataFrame(rows, "target string, feature string, coefficient double")


def score(
    df: DataFrame, models: dict[str, LinearModel], contract: FeatureContract, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``y_pred`` (and ``y_min_pred``/``y_max_pred``) from the fitted models."""
    names = {"y": "y_pred", "y_min": "y_min_pred", "y_max": "y_max_pred"}
    columns = tuple(contract.columns)
    return contract.apply(df, keep).withColumns({names[t]: m.value(columns) for t, m in models.items()})


def predictions(test: DataFrame, models, contract: FeatureContract, keep: tuple[str, ...] = ()) -> DataFrame:
    """Test rows with ``y_true``, predictions and residual."""
    scored = score(test, models, contract, (*keep, "y")).withColumnRenamed("y", "y_true")
    cols = [c for c in ("y_min_pred", "y_max_pred") if c in scored.columns]
    return scored.select(*keep, "y_true", "y_pred", (F.col("y_true") - F.col("y_pred")).alias("residual"), *cols)


def regression_metrics(pred: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """mse, rmse, mae, r2 (0 for a constant truth), residual mean and population deviation."""
    res = F.col("y_true") - F.col("y_pred")
    stats = pred.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(res * res).alias("mse"), F.avg(F.abs(res)).alias("mae"),
        F.avg(res).alias("residual_mean"), F.stddev_pop(res).alias("residual_std"), F.var_pop("y_true").alias("_var"),
    )
    r2 = F.coalesce(F.lit(1.0) - ratio(F.col("mse"), F.col("_var")), F.lit(0.0))
    return stats.select(*keys, "n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), "residual_mean", "residual_std")


def residual_histogram(pred: DataFrame) -> DataFrame:
    """Unit-width bins from floor(min) to ceil(max) of the two-digit residuals, empty bins included."""
    r = F.round(F.col("y_true") - F.col("y_pred") + F.lit(1e-9), 2)
    counts = pred.groupBy(F.floor(r).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.min(r).alias("lo"), F.max(r).alias("hi"))
    # bins are as many as the value range is wide, whatever the number of rows
    span = counts.agg(F.floor(F.min("lo")).cast("int").alias("a"), F.ceil(F.max("hi")).cast("int").alias("b"))
    bins = span.select(F.explode(F.sequence("a", "b")).alias("bin"))
    return bins.join(counts.select("bin", "n"), "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).cast("long").alias("residuals"))


def prediction_histogram(pred: DataFrame, column: str = "y_pred", edges=PREDICTION_EDGES) -> DataFrame:
    """Cumulative counts of values at or below each edge, the last row counting all values."""
    cells = [F.struct(F.lit(str(e)).alias("le"), F.count_if(F.col(column) <= e).alias("count")) for e in edges]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.count(column).alias("count")))
    one = pred.agg(*[c.alias(f"b{i}") for i, c in enumerate(cells)])
    return one.select(F.explode(F.array(*one.columns)).alias("b")).select("b.le", "b.count")


def even_sample(pred: DataFrame, time: str, tie: list[str], points: int = 200) -> DataFrame:
    """Rows at the positions round(linspace(0, n-1, points)) of the chronological order; all when n is smaller.

    Rows of one day are ordered by a two-digit hash of the first tie column and then by the tie
    columns, so that a day holding a large share of all rows is numbered in 256 parts.
    """
    part = F.substring(F.md5(F.col(tie[0]).cast("string")), 1, 2)
    placed = with_global_position(pred, [("_day", F.col(time)), ("_part", part)], [F.col(c) for c in tie])
    if points == 1:
        return placed.filter("position = 0").drop("total")
    step = (F.col("total") - 1) / F.lit(float(points - 1))
    near = F.floor(F.col("position") / step)

    def lands(i: Column) -> Column:
        return (i >= 0) & (i < points) & (F.bround(i * step, 0) == F.col("position"))

    keep = (F.col("total") <= points) | lands(near) | lands(near + 1)
    return placed.filter(keep).drop("total")


def circular_range(daily: DataFrame, targets: DataFrame, spec: ObservationSpec, key: str = "target_date") -> DataFrame:
    """Typical low and high per target date: means over all rows within 7 circular days of its day of year.

    The daily table is first reduced to 366 sums; targets are reduced to their distinct days of
    year, each expanded to its at most 16 matching days, so the band becomes an equi-join.
    """
    by_doy = (
        daily.dropna(subset=[spec.temp_min, spec.temp_max])
        .groupBy(F.dayofyear(spec.time).alias("doy")).agg(
            F.sum(spec.temp_min).alias("lo"), F.sum(spec.temp_max).alias("hi"), F.count("*").alias("n"))
    )
    wanted = targets.select(F.dayofyear(key).alias("target_doy")).distinct()
    expanded = wanted.select("target_doy", F.explode(circular_days(F.col("target_doy"))).alias("doy"))
    bands = expanded.join(by_doy, "doy").groupBy("target_doy").agg(
        (F.sum("lo") / F.sum("n")).alias("typical_low"), (F.sum("hi") / F.sum("n")).alias("typical_high"))
    return targets.withColumn("target_doy", F.dayofyear(key)).join(bands, "target_doy", "left").drop("target_doy")


def year_bias(observed: DataFrame, keys: list[str], time: str, recent_rows: int = 30) -> DataFrame:
    """Mean of observed minus predicted over the year so far and over the last rows.

    ``observed`` has ``y_true`` and ``y_pred`` for one year, so a window holds at most 366 rows.
    """
    rows = observed.filter(F.col("y_true").isNotNull()).withColumn("bias", F.col("y_true") - F.col("y_pred"))
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    recent = F.col("rn") <= recent_rows
    return rows.withColumn("rn", F.row_number().over(w)).groupBy(*keys).agg(
        F.avg("bias").alias("ytd_bias"), F.count("*").alias("n_ytd"),
        F.avg(F.when(recent, F.col("bias"))).alias("recent_bias"), F.count_if(recent).alias("n_recent"),
        F.avg(F.when(recent, F.col("y_true"))).alias("recent_observed_mean"),
    )


def recent_mean(daily: DataFrame, keys: list[str], time: str, value: str, rows: int = 7) -> DataFrame:
    """Mean of the last observed rows per key; Spark limits each map task to ``rows`` rows per key."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    last = daily.filter(F.col(value).isNotNull()).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= rows)
    return last.groupBy(*keys).agg(F.avg(value).alias("recent_mean"), F.count("*").alias("observed_days"))


def bias_adjusted(forecast: DataFrame, bias: DataFrame, keys: list[str], min_days: int = 7) -> DataFrame:
    """Baseline plus the recent bias when the year has enough observations, otherwise the baseline."""
    enough = F.col("n_ytd") >= min_days
    return forecast.join(bias, keys, "left").withColumn(
        "adjusted", F.when(enough, F.col("y_pred") + F.col("recent_bias")).otherwise(F.col("y_pred"))
    ).withColumn("is_adjusted", F.coalesce(enough, F.lit(False)))


def forecast_table(
    targets: DataFrame, ranges: DataFrame, key: str = "target_date"
) -> DataFrame:
    """Forecast per target from an optional model figure, else the recent mean, with a typical range.

    ``targets`` has ``model_temp`` (may be NULL), ``recent_mean`` and optional model bounds
    ``model_low``/``model_high``.
    """
    r = ranges.select(key, "typical_low", "typical_high").distinct()
    bound = lambda m, t: F.coalesce(*( [F.col(m)] if m in targets.columns else []), F.col(t))
    return targets.join(r, key, "left").withColumns({
        "temperature": F.coalesce("model_temp", "recent_mean"),
        "temp_low": bound("model_low", "typical_low"),
        "temp_high": bound("model_high", "typical_high"),
        "mode": F.when(F.col("model_temp").isNotNull(), "model").otherwise("recent-observations"),
    }).drop("typical_low", "typical_high")
