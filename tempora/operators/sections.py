"""Documents of mixed sections, kept as (section, key, VARIANT) rows until the end.

A section is any table: its rows become objects under their key, a table of one row without a
key becomes the section's object itself. Rows of different shapes stand in one table, can be
stored, filtered and replaced section by section, and are folded into one document in two
levels: rows to a section, sections to the document. A section is one value of the document, so
callers pass tables whose size the document is meant to have.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions.json_safe import json_safe_table


def section(name: str, df: DataFrame, keys: list[str] = (), columns: list[str] | None = None) -> DataFrame:
    """Rows (section, key, value) of a table; non-finite numbers become NULL, keys are joined by ``|``."""
    shown = [c for c in df.columns if c not in keys] if columns is None else list(columns)
    safe = json_safe_table(df)
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
    return safe.select(F.lit(name).alias("section"), key.alias("key"), F.to_variant_object(F.struct(*shown)).alias("value"))


def union_sections(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _object(key: str):
    """Map of key to value in order of the keys; a VARIANT itself cannot be ordered."""
    rows = F.collect_list(F.struct(F.col(key).alias("key"), "value"))
    return F.map_from_entries(F.array_sort(rows, lambda a, b: F.when(a.key < b.key, -1).when(a.key > b.key, 1).otherwise(0)))


def fold(rows: DataFrame) -> DataFrame:
    """(section, value): every section as one VARIANT."""
    by_section = rows.groupBy("section").agg(_object("key").alias("m"))
    alone = F.try_element_at("m", F.lit(""))
    return by_section.select("section", F.when((F.size("m") == 1) & alone.isNotNull(), alone).otherwise(F.to_variant_object("m")).alias("value"))


def document(rows: DataFrame) -> DataFrame:
    """One row with the JSON document of all sections; an empty object where there are none."""
    whole = fold(rows).agg(F.to_variant_object(_object("section")).alias("d"))
    return whole.select(F.to_json("d").alias("document"))


def flat(documents: DataFrame, column: str = "document") -> DataFrame:
    """(section, key, field, number, text) of a document's leaves, read back from its JSON.

    Numbers stand in ``number``, texts and booleans in ``text``, a JSON null in neither. Sections
    of one object have the key ''.
    """
    view = documents.select(F.parse_json(column).alias("d"))
    top = view.lateralJoin(view.sparkSession.tvf.variant_explode(F.col("d").outer())).select(F.col("key").alias("section"), F.col("value").alias("v"))
    mid = top.lateralJoin(top.sparkSession.tvf.variant_explode(F.col("v").outer())).select("section", F.col("key").alias("k1"), F.col("value").alias("v1"))
    nested = F.schema_of_variant("v1").startswith("OBJECT")
    low = mid.filter(nested)
    low = low.lateralJoin(low.sparkSession.tvf.variant_explode(F.col("v1").outer())).select("section", F.col("k1").alias("key"), F.col("key").alias("field"), F.col("value").alias("x"))
    rows = low.unionByName(mid.filter(~nested).select("section", F.lit("").alias("key"), F.col("k1").alias("field"), F.col("v1").alias("x")))
    kind = F.schema_of_variant("x")
    worded = kind.isin("STRING", "BOOLEAN")
    return rows.select(
        "section", "key", "field", F.when(~worded, F.try_variant_get("x", "$", "double")).alias("number"),
        F.when(worded, F.try_variant_get("x", "$", "string")).alias("text"))
