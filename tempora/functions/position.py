"""Exact global row positions without sorting a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.session import shared_table


def with_global_position(
    df: DataFrame, buckets: list[tuple[str, Column]], order_within: list[Column], out: str = "position"
) -> DataFrame:
    """Number the rows 0..n-1 in the order (buckets, order_within) and add the row count ``total``.

    ``buckets`` names leading sort keys; the first has a bounded number of values (calendar days,
    hash prefixes). Rows are counted per bucket. Running offsets are taken over the first key's
    values, and within each of these over the other keys' values; only rows of one bucket are
    sorted together. The keyed rows are stored, so they are computed once for both uses.
    """
    names = [n for n, _ in buckets]
    keyed = shared_table(df.withColumns(dict(buckets)), "positions")
    counts = keyed.groupBy(*names).agg(F.count("*").alias("_n"))
    until = (Window.unboundedPreceding, Window.currentRow)
    inner = Window.partitionBy(names[0])
    if names[1:]:
        before = F.sum("_n").over(inner.orderBy(*names[1:]).rowsBetween(*until)) - F.col("_n")
    else:
        before = F.lit(0)
    lead = counts.groupBy(F.col(names[0]).alias("_lead")).agg(F.sum("_n").alias("_m")).withColumns({
        "_before": F.sum("_m").over(Window.orderBy("_lead").rowsBetween(*until)) - F.col("_m"),
        "total": F.sum("_m").over(Window.partitionBy()),
    })
    offsets = (
        counts.withColumn("_inner", before)
        .join(lead, F.col(names[0]).eqNullSafe(F.col("_lead")))
        .select(*[F.col(n).alias(f"_b_{n}") for n in names], (F.col("_before") + F.col("_inner")).alias("_offset"), "total")
    )
    local = keyed.withColumn("_local", F.row_number().over(Window.partitionBy(*names).orderBy(*order_within)))
    cond = [F.col(n).eqNullSafe(F.col(f"_b_{n}")) for n in names]
    return (
        local.join(offsets, cond)
        .withColumn(out, (F.col("_offset") + F.col("_local") - 1).cast("long"))
        .drop("_offset", "_local", *names, *[f"_b_{n}" for n in names])
    )
