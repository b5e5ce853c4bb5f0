"""Exact cosine top-k of dense vectors: one scan for few queries, cells for many.

Few queries are one matrix that every task multiplies its vectors with. For many, vectors are
stored in cells around sampled centroids, with each cell's largest angle to its centroid. The
angle of a query to anything in a cell is at least its angle to the centroid less that radius,
so once a query has k scores, cells that cannot beat the k-th are skipped and the result stays
exact. Cells are dealt in groups of some MB to the tasks. A query goes once to each group in which
it has cells to visit, and a group returns at most k rows for it, so what travels does not grow
with the number of cells. Where nothing can be skipped every pair is multiplied: the work then
grows with the square of the table, the rows between tasks with groups times queries.

Vectors of zeros have no direction and no score, nor has a vector of another length than the
first query's or centroid's. Scores are compared at six decimals, ties by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from tempora.operators.retrieval import top_per_question
from tempora.session import shared_table

#: Queries that one scan takes; beyond it, cells. Their matrix is at most so many vectors on the driver and in each task.
ONE_SCAN = 2048
#: Centroids at most, and vectors or queries of one block.
MOST_CELLS, BLOCK = 4096, 256
SALTS = 16
#: Bytes of vectors in one group of cells, and queries that meet it in one task.
GROUP, TOGETHER = 16 << 20, 65536
#: Scores are compared at six decimals.
MARGIN = 2e-6


def matrix(column, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of an array column and the rows they belong to; other rows have no direction."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(pc.list_value_length(column).fill_null(0))
    width = int(size[np.flatnonzero(size)[0]]) if width is None and (size > 0).any() else (width or 0)
    rows = np.flatnonzero((size == width) & (size > 0))
    values = column.take(pa.array(rows)).flatten().cast(pa.float64())
    x = np.nan_to_num(values.to_numpy(zero_copy_only=False)).reshape(len(rows), width) if len(rows) else np.zeros((0, width))
    length = np.sqrt((x * x).sum(1))
    good = length > 0
    return x[good] / length[good, None], rows[good]


def best(scores: np.ndarray, keys: np.ndarray, k: int) -> list[np.ndarray]:
    """Rows of the ``k`` best of each column of ``scores``: by score at six decimals, then key."""
    r = np.round(scores, 6)
    if len(r) <= k:
        return [np.arange(len(r))] * r.shape[1]
    least = np.partition(r, len(r) - k, axis=0)[len(r) - k]
    out = []
    for c in range(r.shape[1]):
        near = np.flatnonzero(r[:, c] >= least[c])
        out.append(near[np.lexsort((keys[near], -r[near, c]))[:k]])
    return out


def _found(questions: list, keys: np.ndarray, scores: np.ndarray, k: int, schema: pa.Schema) -> pa.RecordBatch:
    rows = best(scores, keys, k)
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    column = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    return pa.RecordBatch.from_arrays(
        [pa.array([questions[c] for c in column.tolist()], schema.field(0).type), pa.array(keys[at], schema.field(1).type), pa.array(scores[at, column])], schema=schema)


def _result(vectors: DataFrame, queries: DataFrame, key: str, question: str) -> StructType:
    return StructType([StructField(question, queries.schema[question].dataType), StructField(key, vectors.schema[key].dataType), StructField("score", DoubleType())])


def one_scan(vectors: DataFrame, queries: DataFrame, key: str, embedding: str, question: str, k: int) -> DataFrame:
    """Top-k of at most :data:`ONE_SCAN` queries."""
    rows = queries.select(question, "query").filter("query is not null").limit(ONE_SCAN + 1).collect()
    if len(rows) > ONE_SCAN:
        raise ValueError(f"more than {ONE_SCAN} queries")
    names = [r[0] for r in rows]
    q, kept = matrix(pa.array([r[1] for r in rows], pa.list_(pa.float64())))
    names = [names[i] for i in kept.tolist()]
    result = _result(vectors, queries, key, question)
    schema = to_arrow_schema(result)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, at = matrix(b.column(embedding), q.shape[1])
            if len(v) and len(q):
                yield _found(names, b.column(key).to_numpy(zero_copy_only=False)[at], v @ q.T, k, schema)

    return top_per_question(vectors.select(key, embedding).mapInArrow(scan, result), question, key, k)


@dataclass(frozen=True)
class Cells:
    """Stored blocks of vectors by cell, and for each cell its centroid, radius (an angle) and size."""

    blocks: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    key: str


def _angles(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ centroids.T, -1.0, 1.0))


def build_cells(vectors: DataFrame, key: str, embedding: str, cells: int | None = None) -> Cells:
    """Cells of a vector table. Centroids are the first vectors in hash order, the square root of their number but at most ``MOST_CELLS``; every vector is stored."""
    n = vectors.count()
    wanted = min(MOST_CELLS, cells or max(1, int(np.sqrt(n))))
    sample = vectors.select(F.col(embedding)).filter(F.exists(embedding, lambda x: x != 0)).orderBy(F.xxhash64(key)).limit(wanted).collect()
    centroids, _ = matrix(pa.array([r[0] for r in sample], pa.list_(pa.float64())))
    kind = vectors.schema[key].dataType

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, at = matrix(b.column(embedding), centroids.shape[1])
            if len(v):
                a = _angles(v, centroids)
                cell = a.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), b.column(key).take(pa.array(at)), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(a[np.arange(len(v)), cell])],
                    ["cell", "key", "v", "angle"])

    rows = StructType([StructField("key", kind)])
    named = to_arrow_schema(rows).field(0).type

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column("cell").to_numpy()
            begin = np.flatnonzero(np.diff(cell, prepend=-1))
            cuts = [s for x, y in zip(begin, np.append(begin[1:], len(cell)), strict=True) for s in range(x, y, BLOCK)]
            for s, e in zip(cuts, [*cuts[1:], len(cell)], strict=True):
                part = b.slice(s, e - s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cell[s]], pa.int32()), pa.array([e - s], pa.int64()), pa.array([float(np.max(part.column("angle").to_numpy()))]),
                     pa.array([part.column("key").to_pylist()], pa.list_(named)), pa.array([b"".join(x.as_py() for x in part.column("v"))], pa.binary())],
                    ["cell", "n", "angle", "keys", "vectors"])

    if not len(centroids):
        return Cells(vectors.sparkSession.createDataFrame([], f"cell int, n long, angle double, keys array<{kind.simpleString()}>, vectors binary"), centroids, np.zeros(0), np.zeros(0, np.int64), key)
    assigned = vectors.select(key, embedding).mapInArrow(assign, f"cell int, key {kind.simpleString()}, v binary, angle double")
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS))
    dealt = assigned.repartition("cell", salt).sortWithinPartitions("cell")
    blocks = shared_table(dealt.mapInArrow(pack, f"cell int, n long, angle double, keys array<{kind.simpleString()}>, vectors binary"), "cells")
    radius, size = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in blocks.groupBy("cell").agg(F.max("angle").alias("angle"), F.sum("n").alias("n")).collect():  # a row per cell
        radius[r.cell], size[r.cell] = r.angle, r.n
    return Cells(blocks, centroids, radius, size, key)


def _groups(cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of every cell; a cell larger than a group is spread over several."""
    per = max(1, GROUP // max(8 * cells.centroids.shape[1], 1))
    start = (np.cumsum(cells.size) - cells.size) // per
    return start, np.maximum(-(-cells.size // per), 1)


def _leading(row: np.ndarray, score: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each row: by score at six decimals, then name."""
    order = np.lexsort((names, -np.round(score, 6), row))
    ordered = row[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    return order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < k]


def _meet(cells: Cells, probes: DataFrame, result: StructType, question: str, k: int, parts: int) -> DataFrame:
    """The ``k`` best of each probe in its group, among those not below its ``kth``."""
    schema, width, (start, span) = to_arrow_schema(result), cells.centroids.shape[1], _groups(cells)
    spark = cells.blocks.sparkSession
    at = spark.createDataFrame(list(zip(range(len(start)), start.tolist(), span.tolist(), strict=True)), "cell int, start long, span long")
    group = F.col("start") + F.pmod(F.xxhash64(F.get("keys", F.lit(0))), F.col("span"))
    dealt = cells.blocks.join(F.broadcast(at), "cell").select(
        "cell", "keys", "vectors", group.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def score(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        if not blocks.num_rows or not asked.num_rows:
            return schema.empty_table()
        blocks, asked = blocks.combine_chunks(), asked.combine_chunks()
        q = np.frombuffer(b"".join(x.as_py() for x in asked.column("u"))).reshape(-1, width)
        visited = [np.frombuffer(x.as_py(), np.int32) for x in asked.column("cells")]
        visits = np.concatenate(visited)
        order = np.argsort(visits, kind="stable")
        visits, who = visits[order], np.repeat(np.arange(len(q)), [len(x) for x in visited])[order]
        names = blocks.column("keys").combine_chunks().values
        ranks = np.empty(len(names), np.int64)
        ranks[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        least = np.round(asked.column("kth").fill_null(-np.inf).to_numpy(), 6) - MARGIN
        row, place, found, waiting, begin = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], 0, 0
        for cell, raw in zip(blocks.column("cell").to_pylist(), blocks.column("vectors"), strict=True):
            v = np.frombuffer(raw.as_buffer()).reshape(-1, width)
            those = who[np.searchsorted(visits, cell) : np.searchsorted(visits, cell, "right")]
            for i in range(0, len(those), 4096):
                some = those[i : i + 4096]
                scores = q[some] @ v.T
                x, y = np.nonzero(scores >= least[some, None])
                row.append(some[x])
                place.append(begin + y)
                found.append(scores[x, y])
                waiting += len(x)
                if waiting > 1 << 20:
                    row, place, found = ([np.concatenate(c)] for c in (row, place, found))
                    best_ = _leading(row[0], found[0], ranks[place[0]], k)
                    row, place, found = ([c[0][best_]] for c in (row, place, found))
                    held = np.bincount(row[0], minlength=len(q)) >= k
                    last = np.full(len(q), np.inf)
                    np.minimum.at(last, row[0], found[0])
                    least[held] = np.maximum(least[held], last[held] - MARGIN)
                    waiting = 0
            begin += len(v)
        row, place, found = (np.concatenate(c) for c in (row, place, found))
        best_ = _leading(row, found, ranks[place], k)
        return pa.Table.from_arrays(
            [asked.column(question).take(pa.array(row[best_])), names.take(pa.array(place[best_])), pa.array(found[best_])], schema=schema)

    by = probes.withColumn("part", F.pmod(F.xxhash64(question), F.lit(parts)).cast("int"))
    return dealt.groupBy("group", "part").cogroup(by.groupBy("group", "part")).applyInArrow(score, result)


def search_cells(cells: Cells, vectors: DataFrame, queries: DataFrame, question: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Top-k of any number of queries, and (question, scored) with the vectors each was compared with."""
    key, centroids, radius, size = cells.key, cells.centroids, cells.radius, cells.size
    result = _result(vectors, queries, key, question)
    kind = queries.schema[question].dataType.simpleString()
    probe = f"{question} {kind}, u binary, group long, cells binary, scored long, kth double"
    start, span = _groups(cells)

    def plan(likeliest: bool):
        """For each query and group the cells to visit: the likeliest that hold k vectors, or all others that could hold a better score than the k-th."""
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q, at = matrix(b.column("query"), centroids.shape[1])
                names, kth = b.column(question).take(pa.array(at)), b.column("kth").fill_null(-np.inf).to_numpy(zero_copy_only=False)[at]
                for i in range(0, len(q), 64):
                    limit = np.cos(np.maximum(_angles(q[i : i + 64], centroids) - radius - 1e-9, 0.0))
                    limit[:, size == 0] = -np.inf
                    order = np.argsort(-limit, axis=1, kind="stable")
                    first = np.zeros(limit.shape, bool)
                    np.put_along_axis(first, order, np.cumsum(size[order], axis=1) - size[order] < k, 1)
                    wanted = (first if likeliest else ~first & (limit >= kth[i : i + 64, None] - MARGIN)) & (size > 0)
                    r, cell = np.nonzero(wanted)
                    if not len(r):
                        continue
                    times = span[cell]
                    # a cell of several groups is visited in each, and counted in its first
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    r, cell = np.repeat(r, times), np.repeat(cell, times)
                    group, n = start[cell] + nth, np.where(nth == 0, size[cell], 0)
                    order = np.lexsort((cell, group, r))
                    r, cell, group, n = r[order], cell[order].astype(np.int32), group[order], n[order]
                    head = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
                    ends = np.append(head[1:], len(r))
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(i + r[head])), pa.array([q[i + x].tobytes() for x in r[head].tolist()], pa.binary()), pa.array(group[head], pa.int64()),
                         pa.array([cell[x:y].tobytes() for x, y in zip(head.tolist(), ends.tolist(), strict=True)], pa.binary()),
                         pa.array(np.add.reduceat(n, head), pa.int64()), pa.array(kth[i + r[head]], pa.float64())],
                        [question, "u", "group", "cells", "scored", "kth"])

        return rows

    if not len(centroids):
        none = vectors.sparkSession.createDataFrame([], result)
        return top_per_question(none, question, key, k), none.select(question, F.lit(0).cast("long").alias("scored"))
    asked = queries.select(question, "query")
    parts = max(1, -(-asked.count() // TOGETHER))
    first = asked.withColumn("kth", F.lit(None).cast("double")).mapInArrow(plan(True), probe)
    some = shared_table(_meet(cells, first, result, question, k, parts), "first-scores")
    best_ = top_per_question(some, question, key, k)
    kth = best_.groupBy(question).agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    rest = asked.join(kth, question, "left").mapInArrow(plan(False), probe)
    more = _meet(cells, rest, result, question, k, parts)
    scored = first.select(question, "scored").unionByName(rest.select(question, "scored")).groupBy(question).agg(F.sum("scored").alias("scored"))
    return top_per_question(best_.select(question, key, "score").unionByName(more), question, key, k), scored


def dense_top_k(vectors: DataFrame, queries: DataFrame, key: str, embedding: str, question: str, k: int = 3) -> DataFrame:
    """(question, key, score, rank): cosine top-k for any number of rows (question, query)."""
    if queries.limit(ONE_SCAN + 1).count() <= ONE_SCAN:
        return one_scan(vectors, queries, key, embedding, question, k)
    return search_cells(build_cells(vectors, key, embedding), vectors, queries, question, k)[0]
