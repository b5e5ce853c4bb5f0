"""Coercion, incremental ranges, merges, coverage guards and table facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coerce(df: DataFrame, numeric: list[str] = (), dates: list[str] = (), required: list[str] = ()) -> DataFrame:
    """Lenient casts: a value that does not parse becomes NULL; rows lacking a required one go."""
    out = df.withColumns({
        **{c: F.col(c).try_cast("double") for c in numeric},
        **{c: F.col(c).try_cast("date") for c in dates},
    })
    return out.dropna(subset=list(required)) if required else out


def allow_list(df: DataFrame, entity: str, names: list[str], ignore_case: bool = False) -> DataFrame:
    """Rows of the listed entities; the list is a literal of the query, so the filter reaches the scan."""
    if ignore_case:
        return df.filter(F.lower(entity).isin([n.lower() for n in names]))
    return df.filter(F.col(entity).isin(list(names)))


def in_dimension(df: DataFrame, dimension: DataFrame, entity: str) -> DataFrame:
    """Rows whose entity occurs in a dimension table."""
    return df.join(dimension.select(entity), entity, "left_semi")


def missing_entities(dimension: DataFrame, table: DataFrame, entity: str) -> DataFrame:
    """Entities of the dimension without any row in the table."""
    return dimension.join(table.select(entity).distinct(), entity, "left_anti")


def append(frames: list[DataFrame]) -> DataFrame:
    """Concatenate tables whose optional columns differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _picked(df: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """Per key the row with the lowest rank; equal ranks are decided by the row's content.

    ``min_by`` aggregates on the map side, so a key with many copies never meets in one sort.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(rank.alias("r"), row.alias("v"))).alias("_row"))
    return best.select(*keys, "_row.*")


def merge_by_priority(sources: list[DataFrame], keys: list[str], label: str | None = None) -> DataFrame:
    """One row per key from the first source in the list that has it.

    ``label`` adds the position (0-based) of the source that supplied the row.
    """
    tagged = append([s.withColumn("_priority", F.lit(i)) for i, s in enumerate(sources)])
    out = _picked(tagged, keys, F.col("_priority"))
    return out.withColumnRenamed("_priority", label) if label else out.drop("_priority")


def merge_tagged(rows: DataFrame, keys: list[str], tag: str, order: list[str], label: str | None = None) -> DataFrame:
    """Like :func:`merge_by_priority` for sources that stand in one table, told apart by ``tag``: one scan for all."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(tag)) - 1
    tagged = rows.withColumn("_priority", rank.cast("int")).filter("_priority >= 0").drop(tag)
    out = _picked(tagged, keys, F.col("_priority"))
    return out.withColumnRenamed("_priority", label) if label else out.drop("_priority")


def merge_existing_wins(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return merge_by_priority([existing, new], keys)


def merge_newest_wins(existing: DataFrame, new: DataFrame, keys: list[str], time: str, start: Column) -> DataFrame:
    """New rows replace existing ones; rows before the window start are dropped first."""
    keep = F.col(time) >= start
    return merge_by_priority([new.filter(keep), existing.filter(keep)], keys)


def incremental_range(existing: DataFrame, entity: str, time: str, end: str) -> DataFrame:
    """Next day to load per entity up to ``end``, and whether nothing is left to load."""
    last = existing.groupBy(entity).agg(F.max(time).alias("last_date"))
    start = F.date_add("last_date", 1)
    return last.withColumns({
        "fetch_start": start,
        "fetch_end": F.lit(end).cast("date"),
        "up_to_date": start > F.lit(end).cast("date"),
    })


def delta_rows(landed: DataFrame, existing: DataFrame, entity: str, time: str, end: str) -> DataFrame:
    """Landed rows after the last stored day of their entity; unknown entities load in full."""
    ranges = incremental_range(existing, entity, time, end).select(entity, "fetch_start")
    return (
        landed.filter(F.col(time) <= F.lit(end).cast("date"))
        .join(ranges, entity, "left")
        .filter(F.col("fetch_start").isNull() | (F.col(time) >= F.col("fetch_start")))
        .drop("fetch_start")
    )


def coverage_guard(existing: DataFrame, new: DataFrame, time: str, min_years: int, short_days: int = 180) -> DataFrame:
    """Decide whether a merged result may replace the stored table; always one row.

    ``write`` when the merge spans enough years, ``keep_existing`` when only the stored table
    does, ``fail`` otherwise. A short delta is flagged, not rejected.
    """
    tagged = existing.select(F.lit(0).alias("src"), time).unionByName(new.select(F.lit(1).alias("src"), time))
    # one row per day and source first, so the distinct counts below are over calendar days
    days = tagged.groupBy("src", time).agg(F.count("*").alias("n"))
    year, old = F.year(time), F.col("src") == 0
    facts = days.agg(
        F.count_distinct(F.when(old, year)).alias("existing_years"),
        F.count_distinct(F.when(~old, F.col(time))).alias("new_days"),
        F.count_distinct(year).alias("merged_years"),
    )
    return facts.withColumns({
        "short_delta": F.col("new_days") < short_days,
        "decision": F.when(F.col("merged_years") >= min_years, "write")
        .when(F.col("existing_years") >= min_years, "keep_existing").otherwise("fail"),
    })


def profile(df: DataFrame, time: str) -> DataFrame:
    """Row count and first and last date of a table."""
    return df.agg(F.count("*").alias("rows"), F.min(time).alias("min_date"), F.max(time).alias("max_date"))


def distinct_counts(df: DataFrame, entity: str, time: str) -> DataFrame:
    """Distinct years and days per entity."""
    return df.groupBy(entity).agg(
        F.count_distinct(F.year(time)).alias("years"), F.count_distinct(time).alias("days"))


def non_empty_gate(df: DataFrame) -> DataFrame:
    """One row stating whether a result has rows; callers that must fail raise on it."""
    n = F.count("*")
    return df.agg(
        n.alias("rows"), (n > 0).alias("passed"),
        F.when(n == 0, F.lit("result is empty")).alias("reason"),
    )


def require_rows(df: DataFrame) -> DataFrame:
    """Job-level form of the gate."""
    if df.isEmpty():
        raise RuntimeError("result is empty")
    return df


def word_sums(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sum per key."""
    return df.groupBy(key).agg(F.sum(value).alias("total"))
