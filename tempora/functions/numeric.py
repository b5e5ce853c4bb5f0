"""NULL-safe arithmetic and cleaning of numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRACTIONAL = (T.DoubleType, T.FloatType)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """The value, or NULL for NaN and both infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def without_sentinel(c: Column, sentinel: float = -999.0) -> Column:
    return F.when(~F.isnan(c) & (c != F.lit(sentinel)), c)


def clean_sentinel(df: DataFrame, sentinel: float = -999.0) -> DataFrame:
    """Replace the fill value and NaN by NULL in every numeric column of ``df``."""
    fixed = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, FRACTIONAL):
            fixed[f.name] = without_sentinel(F.col(f.name), sentinel)
        elif isinstance(f.dataType, (T.IntegralType, T.DecimalType)):
            fixed[f.name] = F.when(F.col(f.name) != F.lit(int(sentinel)), F.col(f.name))
    return df.withColumns(fixed) if fixed else df


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when the denominator is zero or missing."""
    return F.try_divide(num, den)


def mean_std(c: Column) -> tuple[Column, Column]:
    return F.avg(c), F.stddev_samp(c)


def between_years(year: Column, span: tuple[int, int]) -> Column:
    return year.between(span[0], span[1])


def fixed(c: Column, digits: int, plus: bool = False) -> Column:
    """Text with a fixed number of decimals, half-up, without a negative zero; NULL stays NULL."""
    sign = "+" if plus else ""
    return F.when(c.isNotNull(), F.format_string(f"%{sign}.{digits}f", F.round(c, digits) + F.lit(0.0)))
