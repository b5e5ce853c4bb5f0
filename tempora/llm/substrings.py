"""Substring dedup by fixed-block anchors over words.

Every document is cut into non-overlapping reference blocks of ``WINDOW // 2`` words. The hash
index of the reference blocks is probed with every rolling window of that size; a repeated run
of ``WINDOW`` words always holds a whole reference block of its earlier place, so each repeat
is hit. Around the hits every ``WINDOW``-word span that holds a hit, that is every extension of
it to the left and right, is compared by a 96-bit digest; overlapping spans form the maximal
exact repeats. The first place of a span in (doc_id, word) order stays.

Null and empty texts have no words. A null ``doc_id`` counts as the smallest id. Rows with the
same id and text are one document and get the same result; rows with the same id and another
text count as neither earlier nor later than each other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import blocks as B
from tempora.llm import common as C


class _Words:
    def __init__(self, block: B.Block):
        self.hashes, _, _, self.first = C.word_hashes(block.data, block.offsets)
        self.left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hashes))
        self.row = np.repeat(np.arange(len(block.ids)), np.diff(self.first))

    def windows(self, size: int) -> np.ndarray:
        """First words of the windows of ``size`` words of one document."""
        return np.flatnonzero(self.left >= size)


def _probes(table: pa.Table, half: int, buckets: int) -> pa.Table:
    """Rolling windows of a block: key, whether one is a reference block, whether it occurs again."""
    block = B.Block(table)
    w = _Words(block)
    at = w.windows(half)
    h = C.Spans(w.hashes)(at, at + half)
    aligned = (at - w.first[w.row[at]]) % half == 0
    turn = np.argsort(h, kind="stable")
    h, aligned = h[turn], aligned[turn]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    flags = np.zeros(len(begin), np.uint64)
    if len(h):
        flags |= np.logical_or.reduceat(aligned, begin).astype(np.uint64)
        flags |= (np.diff(np.append(begin, len(h))) > 1).astype(np.uint64) << np.uint64(1)
    keys = h[begin]
    _, names, edge = B.cut(B.bucket_of(keys, buckets))
    packed = ((keys & B.KEY_MASK) << np.uint64(2)) | flags
    return pa.table({
        "bucket": pa.array(names.astype(np.int32)),
        "block": pa.array(np.full(len(names), table.column("block")[0].as_py(), np.int32)),
        "keys": pa.array([B.six_bytes(packed[edge[k] : edge[k + 1]]) for k in range(len(names))], pa.binary())})


def _hits(table: pa.Table) -> pa.Table:
    """Of each block's keys those that hit a reference block at another place."""
    C.trim()
    v = B.from_six(b"".join(x.as_buffer() for c in table.column("keys").chunks for x in c))
    size = B.sizes(table.column("keys"), 6)
    source = np.repeat(np.arange(len(size)), size)
    turn = np.argsort(v >> np.uint64(2), kind="stable")
    v, source = v[turn], source[turn]
    key = v >> np.uint64(2)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(begin, len(key)))
    flags = np.bitwise_or.reduceat(v & np.uint64(3), begin)
    live = ((flags & np.uint64(1)) > 0) & ((n > 1) | (flags > 1))
    keep = np.repeat(live, n)
    turn, names, edge = B.cut(source[keep])
    key = key[keep][turn]
    rows = table.select(["bucket", "block"]).take(pa.array(names))
    return rows.append_column("keys", pa.array([B.six_bytes(key[edge[k] : edge[k + 1]]) for k in range(len(names))], pa.binary()))


def _extend(table: pa.Table, hits: pa.Table, window: int, buckets: int) -> pa.Table:
    half = window // 2
    block = B.Block(table)
    w = _Words(block)
    at = w.windows(half)
    own = B.combined(C.Spans(w.hashes)(at, at + half), buckets)
    known = np.sort(np.concatenate([
        ((np.uint64(b.as_py()) & np.uint64(0x3FFFF)) << B.KEY_BITS) | B.from_six(k.as_buffer())
        for b, k in zip(hits.column("bucket"), hits.column("keys"), strict=True)] or [np.zeros(0, np.uint64)]))
    number = table.column("block")[0].as_py()
    none = np.zeros(0, np.uint64)
    if not len(known):
        return B.minima_rows(number, buckets, np.zeros((0, 2)), none, none, none, none)
    hit = np.zeros(len(w.hashes) + 1, np.int64)
    hit[at + 1] = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
    seen = np.cumsum(hit)
    s = w.windows(window)
    s = s[seen[s + window - half + 1] > seen[s]]
    h1, h2 = C.Spans(w.hashes)(s, s + window), C.Spans(w.hashes, 1)(s, s + window) & np.uint64(0xFFFFFFFF)
    # places are in (doc_id, word) order, and so are the members of a class
    turn = np.lexsort((h2, h1))
    a, b = h1[turn], h2[turn]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = turn[np.flatnonzero(new)][np.cumsum(new) - 1] if len(a) else turn
    row = w.row[s]
    later = (block.ids[row[turn]] > block.ids[row[head]]) | ((row[turn] == row[head]) & (s[turn] > s[head]))
    ranges = B.runs(np.sort(s[turn[later]]), window)
    first = np.sort(turn[~later])
    return B.minima_rows(number, buckets, ranges, h1[first], h2[first], block.ids[row[first]], s[first])


def _digests(table: pa.Table, gone: pa.Table, window: int) -> pa.Table:
    block = B.Block(table)
    _, _, first = C.words(block.data, block.offsets)
    out = B.removed(gone, window, int(first[-1]))
    n, lost, sha = np.diff(first), np.zeros(len(block.ids), np.int64), []
    for k in range(len(block.ids)):
        words = block.data[block.offsets[k] : block.offsets[k + 1]].tobytes().split()
        mask = out[first[k] : first[k + 1]]
        lost[k] = mask.sum()
        sha.append(hashlib.sha256(b" ".join(compress(words, ~mask) if lost[k] else words)).hexdigest())
    return pa.table({
        "doc_id": pa.array(block.all_ids), "text_id": pa.array(block.all_texts), "n_words": pa.array(n[block.place]), "n_removed": pa.array(lost[block.place]),
        "kept_sha256": pa.array(sha, pa.string()).take(pa.array(block.place))})


KEYS = "bucket int, block int, keys binary"


def repeated_words(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the remaining words of every row."""
    dealt = B.Dealt(docs)
    buckets = dealt.buckets

    def probes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _probes(table, window // 2, buckets)

    def hit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _hits(table)

    def extend(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        return _extend(table, found, window, buckets)

    def digest(key: tuple[pa.Scalar, ...], table: pa.Table, gone: pa.Table) -> pa.Table:
        return _digests(table, gone, window)

    by_block = dealt.rows.groupBy("block")
    hits = C.store(by_block.applyInArrow(probes, KEYS).groupBy("bucket").applyInArrow(hit, KEYS), "anchor-hits")
    minima = C.store(by_block.cogroup(hits.groupBy("block")).applyInArrow(extend, B.MINIMA), "span-minima")
    C.discard(hits)
    gone = C.store(B.settle(minima, by_place=True), "span-removed")
    C.discard(minima)
    out = by_block.cogroup(gone.groupBy("block")).applyInArrow(
        digest, "doc_id long, text_id long, n_words long, n_removed long, kept_sha256 string")
    return dealt.for_all(out).withColumn("doc_id", C.null_id())
