"""Make nested values safe for strict JSON: NaN and infinities become NULL at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions.numeric import finite


def _has_fraction(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(_has_fraction(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return _has_fraction(t.elementType)
    if isinstance(t, T.MapType):
        return _has_fraction(t.valueType)
    return isinstance(t, (T.DoubleType, T.FloatType))


def json_safe(c: Column, t: T.DataType) -> Column:
    """The column with every non-finite number replaced, following its type."""
    if not _has_fraction(t):
        return c
    if isinstance(t, T.StructType):
        fields = [json_safe(c[f.name], f.dataType).alias(f.name) for f in t.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: json_safe(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda _, v: json_safe(v, t.valueType))
    return finite(c)


def json_safe_table(df: DataFrame) -> DataFrame:
    return df.select(*[json_safe(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
