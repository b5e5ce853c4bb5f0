"""Plausibility predicates and display bounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.functions.numeric import finite, fixed

# Largest believable magnitudes.
MAX_TEMP_ANOMALY, MAX_TEMP_Z = 15.0, 6.0
MAX_PRECIP_ANOMALY, MAX_PRECIP_Z = 600.0, 8.0
MAX_MEAN_TEMP = 25.0


def _within(c: Column, limit: float) -> Column:
    return F.coalesce(F.abs(finite(c)) <= limit, F.lit(False))


def reasonable_temperature_signal(anomaly: Column, z: Column) -> Column:
    """True when both numbers are finite and within bounds; NULL and NaN count as false."""
    return _within(anomaly, MAX_TEMP_ANOMALY) & _within(z, MAX_TEMP_Z)


def reasonable_precip_signal(anomaly: Column, z: Column) -> Column:
    return _within(anomaly, MAX_PRECIP_ANOMALY) & _within(z, MAX_PRECIP_Z)


def reasonable_mean_temperature(temp: Column) -> Column:
    return _within(temp, MAX_MEAN_TEMP)


@dataclass(frozen=True)
class Bounds:
    low: float
    high: float
    digits: int
    unit: str
    signed: bool


# Bounds, decimals and units of the headline figures.
KPI_BOUNDS = {
    "anomaly": Bounds(-20, 20, 1, "°C", True),
    "zscore": Bounds(-8, 8, 2, "", True),
    "mean": Bounds(-30, 40, 2, "°C", True),
    "std": Bounds(0, 15, 2, "°C", False),
    "precip": Bounds(-1000, 1500, 0, "mm", True),
}


def within_or_na(c: Column, kind: str) -> Column:
    """Formatted figure, or ``N/A`` when it is missing or outside its sanity bounds."""
    b = KPI_BOUNDS[kind]
    text = fixed(c, b.digits, plus=b.signed)
    if b.unit:
        text = F.concat(text, F.lit(f" {b.unit}"))
    return F.when(finite(c).between(b.low, b.high), text).otherwise(F.lit("N/A"))
