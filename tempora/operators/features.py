"""Regression features, the ordered feature contract and the chronological split."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.spec import ObservationSpec

TARGETS = ("y", "y_min", "y_max")
SEASONAL = ("sin_doy", "cos_doy", "year_norm")


def seasonal_columns(time: str, year_ref: int = 1991, year_scale: float = 30.0) -> dict[str, Column]:
    """Annual cycle on a 365-day circle, leap years included, and the long-term trend."""
    angle = F.lit(2 * pi) * F.dayofyear(time) / F.lit(365.0)
    return {
        "sin_doy": F.sin(angle),
        "cos_doy": F.cos(angle),
        "year_norm": (F.year(time) - F.lit(year_ref)) / F.lit(float(year_scale)),
    }


def _log1p(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c), F.lit(0.0))))


def measure_columns(df: DataFrame, spec: ObservationSpec) -> dict[str, Column]:
    """Scaled measures, only for the columns this table has."""
    rules = (
        (spec.precip, "precip_log1p", _log1p),
        (spec.snow, "snow_log1p", _log1p),
        (spec.sun, "sunshine_frac_day", lambda c: F.col(c) / 86400.0),
        (spec.wind, "wind_norm", lambda c: F.col(c) / 30.0),
        (spec.et0, "et0_norm", lambda c: F.col(c) / 10.0),
    )
    return {name: fn(c) for c, name, fn in rules if c in df.columns}


def build_features(df: DataFrame, spec: ObservationSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    """Feature table with targets ``y``/``y_min``/``y_max``; rows without a target are dropped."""
    targets = {
        name: F.col(c) for name, c in zip(TARGETS, (spec.temp, spec.temp_min, spec.temp_max)) if c in df.columns
    }
    cols = {**seasonal_columns(spec.time), **measure_columns(df, spec), **targets}
    return df.select(*keep, F.year(spec.time).alias("year"), *[c.alias(n) for n, c in cols.items()]).dropna(subset=["y"])


def chronological_split(features: DataFrame, test_from_year: int) -> tuple[DataFrame, DataFrame]:
    year = F.col("year")
    return features.filter(year < test_from_year), features.filter(year >= test_from_year)


def feature_names(features: DataFrame) -> list[str]:
    """Inputs in table order: numeric columns that are neither the year nor a target."""
    return [n for n, t in features.dtypes if t == "double" and n not in (*TARGETS, "year")]


def feature_defaults(features: DataFrame, names: list[str]) -> DataFrame:
    """Mean of every feature as (feature, default_value) rows; computed on the training part."""
    means = features.agg(*[F.avg(n).alias(n) for n in names])
    return means.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("feature", "default_value"))


@dataclass(frozen=True)
class FeatureContract:
    """Ordered model inputs with a default for each; the order never depends on the table."""

    columns: tuple[str, ...] = SEASONAL
    defaults: Mapping[str, float] = field(default_factory=dict)

    def default(self, name: str) -> float:
        return float(self.defaults.get(name, 0.0))

    def apply(
        self, df: DataFrame, keep: tuple[str, ...] = (), overrides: Mapping[str, float | None] | None = None
    ) -> DataFrame:
        """The contract's columns in its order. Overrides win, then the table, then the default."""
        given = {k: v for k, v in (overrides or {}).items() if v is not None}
        out = []
        for n in self.columns:
            if n in given:
                c = F.lit(float(given[n]))
            elif n in df.columns:
                c = F.coalesce(F.col(n), F.lit(self.default(n)))
            else:
                c = F.lit(self.default(n))
            out.append(c.alias(n))
        return df.select(*keep, *out)


def fit_contract(train: DataFrame, columns: list[str] | None = None) -> FeatureContract:
    """Contract from a training table. One row with a mean per feature comes to the driver."""
    names = list(columns) if columns else feature_names(train)
    row = train.agg(*[F.avg(n).alias(n) for n in names]).first()
    return FeatureContract(tuple(names), {n: row[n] for n in names if row[n] is not None})


def resolve_contract(stored: FeatureContract, frame: DataFrame) -> FeatureContract:
    """The stored order when the table has all its columns, otherwise the table's own inputs."""
    if stored.columns and all(c in frame.columns for c in stored.columns):
        return fit_contract(frame, list(stored.columns))
    own = fit_contract(frame)
    return FeatureContract(own.columns, {**{c: stored.default(c) for c in own.columns}, **own.defaults})


def contract_check(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per contract column: present in the table or not, and how many values it has."""
    checks = [
        F.struct(
            F.lit(i).alias("position"), F.lit(n).alias("feature"), F.lit(n in df.columns).alias("present"),
            (F.count(n) if n in df.columns else F.lit(0).cast("long")).alias("values"),
        ) for i, n in enumerate(columns)
    ]
    # a further count keeps the row scan in place when no contract column exists
    one = df.agg(F.count("*").alias("_n"), *[c.alias(f"c{i}") for i, c in enumerate(checks)])
    return one.select(F.explode(F.array(*[f"c{i}" for i in range(len(checks))])).alias("c")).select("c.*")


def future_dates(last: DataFrame, last_date: str, days: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``days`` days after ``last_date`` of every row, as column ``time``."""
    first = F.date_add(last_date, 1)
    return last.select(*keep, F.explode(F.sequence(first, F.date_add(last_date, days))).alias("time"))


def future_features(dates: DataFrame, contract: FeatureContract, keep: tuple[str, ...] = ("time",), overrides=None) -> DataFrame:
    """Model inputs for future days: the seasonal columns computed, everything else by default."""
    return contract.apply(dates.withColumns(seasonal_columns("time")), keep, overrides)
