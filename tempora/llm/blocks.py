"""Exact repeats over blocks of documents.

Documents are dealt by hash into blocks of a few megabytes. A block tells hash buckets which
keys it has, each key once however often it occurs, so the rows of a hot key are at most as many
as there are blocks. A bucket answers each block with the keys that matter to it, and the block,
joined with its answer, continues on its own text. Keys travel packed: a row holds all keys of
one block for one bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import common as C

BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 5 << 20
LEAST_BLOCKS = 32
KEY_BITS = np.uint64(46)
KEY_MASK = np.uint64((1 << 46) - 1)


class Dealt:
    """Distinct (doc_id, text) rows in blocks.

    ``rows`` is (block, doc_id, text_id, text), ``buckets`` the number of hash buckets; both
    counts follow the bytes of text. A row that is there more than once is dealt once, so its
    copies do not meet in a block, and :meth:`for_all` gives its result to each of them.
    """

    def __init__(self, docs: DataFrame):
        total = C.text_bytes(docs)
        self.buckets = C.count_for(total, BUCKET_BYTES, LEAST_BLOCKS)
        self.docs = docs.select(C.doc_id(), C.text()).withColumn("text_id", F.xxhash64("text"))
        key = ["doc_id", "text_id"]
        repeated = C.store(self.docs.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1"), "repeated-rows")
        self.repeated = None if repeated.isEmpty() else repeated
        once = self.docs
        if self.repeated is not None:
            one = self.docs.join(repeated.select(*key), key).groupBy(*key).agg(F.min("text").alias("text"))
            once = self.docs.join(repeated, key, "left_anti").select("doc_id", "text", "text_id").unionByName(one)
        block = F.pmod(F.xxhash64(*key, F.lit(5)), F.lit(C.count_for(total, BLOCK_BYTES, LEAST_BLOCKS))).cast("int")
        self.rows = once.select(block.alias("block"), "doc_id", "text_id", "text")

    def for_all(self, results: DataFrame) -> DataFrame:
        """``results`` by (doc_id, text_id), a row for every row of the documents."""
        if self.repeated is None:
            return results.drop("text_id")
        copies = results.join(self.repeated, ["doc_id", "text_id"], "left")
        single = copies.filter("n is null").drop("n", "text_id")
        # the extra rows of a copy are made where the documents' rows are, not in one task
        several = C.store(copies.filter("n is not null").drop("n"), "results-of-repeated")
        return single.unionByName(self.docs.select("doc_id", "text_id").join(several, ["doc_id", "text_id"]).drop("text_id"))


class Block:
    """The distinct (doc_id, text) rows of a block, smallest id first."""

    def __init__(self, table: pa.Table):
        C.trim()
        ids = table.column("doc_id").to_numpy()
        tids = table.column("text_id").to_numpy()
        order = np.lexsort((tids, ids))
        new = np.ones(len(order), bool)
        new[1:] = (ids[order][1:] != ids[order][:-1]) | (tids[order][1:] != tids[order][:-1])
        rows = order[new]
        #: Place among the distinct rows of every row of the table.
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.all_ids, self.all_texts = ids, tids
        self.ids = ids[rows]
        self.data, self.offsets = C.string_bytes(table.column("text").combine_chunks().take(pa.array(rows)))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def combined(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and key of a hash in one number."""
    return ((bucket_of(h, buckets) & np.uint64(0x3FFFF)) << KEY_BITS) | (h & KEY_MASK)


def six_bytes(v: np.ndarray) -> bytes:
    return np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(raw) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :6] = x
    return out.view("<u8").ravel()


def cut(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that groups rows by bucket, and each bucket with its first row."""
    turn = np.argsort(bucket, kind="stable")
    of = bucket[turn]
    begin = np.flatnonzero(np.diff(of.astype(np.int64), prepend=-1))
    return turn, of[begin].astype(np.int64), np.append(begin, len(of))


def joined(column, kind) -> np.ndarray:
    """The packed arrays of a column end to end."""
    parts = [np.frombuffer(v.as_buffer(), kind) for c in column.chunks for v in c if v.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def sizes(column, width: int) -> np.ndarray:
    return np.array([len(v.as_buffer()) // width for c in column.chunks for v in c], np.int64)


def runs(mask_starts: np.ndarray, length: int) -> np.ndarray:
    """Merged [start, end) ranges of spans of one length at sorted starts."""
    if not len(mask_starts):
        return np.zeros((0, 2), np.uint32)
    new = np.ones(len(mask_starts), bool)
    new[1:] = mask_starts[1:] > mask_starts[:-1] + length
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(mask_starts)) - 1
    return np.stack([mask_starts[first], mask_starts[last] + length], 1).astype(np.uint32)


def covered(ranges: np.ndarray, n: int) -> np.ndarray:
    """Mask of the places within any [start, end) range."""
    d = np.zeros(n + 1, np.int32)
    if len(ranges):
        np.add.at(d, ranges[:, 0].astype(np.int64), 1)
        np.add.at(d, ranges[:, 1].astype(np.int64), -1)
    return np.cumsum(d[:n]) > 0


MINIMA = "bucket int, block int, ranges binary, twins binary, h1 binary, h2 binary, doc binary, at binary"


def minima_rows(block: int, buckets: int, ranges: np.ndarray, h1, h2, doc, at, twins=()) -> pa.Table:
    """A block's settled ranges (bucket -1) and its smallest place of every open class, by bucket.

    ``twins`` are pairs of such a place and another of the same class and document; they share
    its fate and stay with the block.
    """
    out = {c: [] for c in ("bucket", "ranges", "twins", "h1", "h2", "doc", "at")}

    def row(*values):
        for c, v in zip(out, values, strict=True):
            out[c].append(v)

    row(-1, ranges.astype(np.uint32).tobytes(), np.asarray(twins, np.uint32).tobytes(), None, None, None, None)
    if len(h1):
        turn, names, begin = cut(bucket_of(h1, buckets))
        for k, b in enumerate(names.tolist()):
            own = turn[begin[k] : begin[k + 1]]
            row(b, None, None, h1[own].tobytes(), h2[own].astype(np.uint32).tobytes(), doc[own].tobytes(), at[own].astype(np.uint32).tobytes())
    n = len(out["bucket"])
    return pa.table({
        "bucket": pa.array(out["bucket"], pa.int32()), "block": pa.array([block] * n, pa.int32()),
        **{c: pa.array(out[c], pa.binary()) for c in ("ranges", "twins", "h1", "h2", "doc", "at")}})


def losing_minima(table: pa.Table, by_place: bool) -> pa.Table:
    """Places of a bucket that some block has earlier: a smaller id, or with ``by_place`` the same id before."""
    C.trim()
    h1, h2 = joined(table.column("h1"), np.uint64), joined(table.column("h2"), np.uint32)
    doc, at = joined(table.column("doc"), np.int64), joined(table.column("at"), np.uint32)
    block = np.repeat(table.column("block").to_numpy(), sizes(table.column("at"), 4))
    turn = np.lexsort((at, doc, h2, h1))
    h1, h2, doc, at, block = h1[turn], h2[turn], doc[turn], at[turn], block[turn]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    lost = doc > doc[head]
    if by_place:
        lost |= (doc == doc[head]) & (block == block[head]) & (at > at[head])
    turn, names, begin = cut(block[lost])
    place = at[lost][turn]
    return pa.table({
        "block": pa.array(names.astype(np.int32)), "ranges": pa.array([None] * len(names), pa.binary()),
        "twins": pa.array([None] * len(names), pa.binary()),
        "lost": pa.array([place[begin[k] : begin[k + 1]].tobytes() for k in range(len(names))], pa.binary())})


def settle(minima: DataFrame, by_place: bool) -> DataFrame:
    """(block, ranges, twins, lost): what each block has to remove."""

    def lose(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return losing_minima(table, by_place)

    lost = minima.filter("bucket >= 0").groupBy("bucket").applyInArrow(lose, "block int, ranges binary, twins binary, lost binary")
    sure = minima.filter("bucket < 0").select("block", "ranges", "twins", F.lit(None).cast("binary").alias("lost"))
    return sure.unionByName(lost)


def removed(table: pa.Table, length: int, n: int) -> np.ndarray:
    """Mask of the places a block removes, from its rows of :func:`settle`."""
    ranges = joined(table.column("ranges"), np.uint32).reshape(-1, 2)
    lost = joined(table.column("lost"), np.uint32).astype(np.int64)
    twins = joined(table.column("twins"), np.uint32).astype(np.int64).reshape(-1, 2)
    lost = np.concatenate([lost, twins[np.isin(twins[:, 0], lost), 1]])
    return covered(np.concatenate([ranges.astype(np.int64), np.stack([lost, lost + length], 1)]), n)
