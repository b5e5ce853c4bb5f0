"""Suffix-array dedup of byte strings.

Anchors are chosen by content: in each window of ``least`` bytes the ``GRAM``-byte gram of the
smallest hash, so equal windows have equal anchors. The windows of one anchor make up its
context. Anchors and context digests are compared across blocks; a context that a smaller
document has too is settled at once for every later document. Only where an anchor has several
contexts does the first document of each context send its windows on: each block builds an
enhanced suffix array of them, scans the common-prefix intervals of at least ``least`` bytes
with a stack, and the intervals' members are compared across blocks by a 96-bit digest.

:func:`maximal_repeats` reports the left-diverse intervals with all occurrences.

Null and empty texts have no bytes. A null ``doc_id`` counts as the smallest id. Rows with the
same id and text get the same result; rows with the same id and another text do not remove each
other. Extra columns are ignored. Spans are judged on the input, and spans that touch or
overlap are one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import blocks as B
from tempora.llm import common as C

GRAM = 24
CONTEXTS = "bucket int, block int, keys binary, contexts binary, docs binary"


class Anchors:
    """Anchor windows of a block: each entry is a maximal run of windows with one anchor."""

    def __init__(self, block: B.Block, least: int, buckets: int):
        parts = [_anchors(block.data, block.offsets[i : j + 1], i, least) for i, j in C.slices(block.offsets, C.PASS)]
        parts = parts or [tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))]
        self.key, self.context, self.first, self.last, self.row = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.both = C.mix(B.combined(self.key, buckets)) ^ self.context


def _anchors(data: np.ndarray, offsets: np.ndarray, row: int, least: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, context digest, first and last window, row) of a few texts, numbered from ``row``."""
    base = offsets[0]
    data, offsets = data[base : offsets[-1]], offsets - base
    n, span = len(data), least - GRAM + 1
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    if n < least or not (left >= least).any():
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    sums = C.Spans(data)
    grams = np.arange(n - GRAM + 1)
    h = sums(grams, grams + GRAM)
    # smallest hash of each window by doubling, the leftmost where hashes are equal
    best = grams
    size = 1
    while size < span:
        step = min(size, span - size)
        x, y = best[:-step], best[step:]
        best = np.where(h[y] < h[x], y, x)
        size += step
    start = np.flatnonzero(left[: n - least + 1] >= least)
    anchor = best[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(new)
    first, last = start[begin], start[np.append(begin[1:], len(start)) - 1]
    at = anchor[begin]
    # a context is its bytes and the anchor's place in them
    context = C.mix(sums(first, last + least) + (at - first).astype(np.uint64))
    # the smallest hash of a window is small: mixed again, it deals anchors evenly over buckets
    return C.mix(h[at]), context, first + base, last + base, np.searchsorted(offsets, first, "right") - 1 + row


def _contexts(table: pa.Table, least: int, buckets: int) -> pa.Table:
    block = B.Block(table)
    a = Anchors(block, least, buckets)
    turn = np.lexsort((a.context, a.key))
    key, context = a.key[turn], a.context[turn]
    begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (context[1:] != context[:-1])])) if len(key) else turn
    ids = block.ids[a.row[turn]]
    lead = turn[begin]
    # entries are in id order, so the last of a run tells whether the run has several ids
    tail = np.append(begin[1:], len(key))[: len(begin)] - 1
    several = (ids[tail] > ids[begin]).astype(np.uint64)
    order = np.argsort(lead, kind="stable")  # back to document order: equal ids stand together
    lead, several = lead[order], several[order]
    packed = ((a.key[lead] & B.KEY_MASK) << np.uint64(2)) | several
    turn, names, edge = B.cut(B.bucket_of(a.key[lead], buckets))
    docs = block.ids[a.row[lead]]
    own = [turn[edge[k] : edge[k + 1]] for k in range(len(names))]
    return pa.table({
        "bucket": pa.array(names.astype(np.int32)),
        "block": pa.array(np.full(len(names), table.column("block")[0].as_py(), np.int32)),
        "keys": pa.array([B.six_bytes(packed[x]) for x in own], pa.binary()),
        "contexts": pa.array([a.context[lead[x]].tobytes() for x in own], pa.binary()),
        "docs": pa.array([docs[x].tobytes() for x in own], pa.binary())})


def _judge(table: pa.Table) -> pa.Table:
    """Keys that several documents have: for each context its first document and whether the key has others."""
    C.trim()
    v = B.from_six(b"".join(x.as_buffer() for c in table.column("keys").chunks for x in c))
    context, doc = B.joined(table.column("contexts"), np.uint64), B.joined(table.column("docs"), np.int64)
    size = B.sizes(table.column("keys"), 6)
    source = np.repeat(np.arange(len(size)), size)
    turn = np.lexsort((doc, context, v >> np.uint64(2)))
    v, context, doc, source = v[turn], context[turn], doc[turn], source[turn]
    key = v >> np.uint64(2)
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new = new_key.copy()
    new[1:] |= context[1:] != context[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    begin = np.flatnonzero(new_key)
    n = np.diff(np.append(begin, len(key)))
    low, high = np.minimum.reduceat(doc, begin), np.maximum.reduceat(doc, begin)
    some = np.bitwise_or.reduceat(v & np.uint64(1), begin) > 0
    live = np.repeat((low < high) | some, n)
    mixed = np.repeat(np.add.reduceat(new.astype(np.int64), begin) > 1, n)
    packed = (key << np.uint64(2)) | mixed.astype(np.uint64)
    turn, names, edge = B.cut(source[live])
    packed, context, first = packed[live][turn], context[live][turn], doc[head][live][turn]
    rows = table.select(["bucket", "block"]).take(pa.array(names))
    own = [slice(edge[k], edge[k + 1]) for k in range(len(names))]
    for name, values in (("keys", [B.six_bytes(packed[x]) for x in own]), ("contexts", [context[x].tobytes() for x in own]),
                         ("docs", [first[x].tobytes() for x in own])):
        rows = rows.append_column(name, pa.array(values, pa.binary()))
    return rows


def _prefix_words(data: np.ndarray, starts: np.ndarray, depth: int) -> list[np.ndarray]:
    """The first ``depth`` bytes of the suffixes at ``starts`` as 64-bit words that sort like them."""
    eight = np.lib.stride_tricks.sliding_window_view(data, 8) if len(starts) else np.zeros((0, 8), np.uint8)
    at = sorted({*range(0, depth - 7, 8), depth - 8})
    return [eight[starts + k].view(">u8").ravel().astype(np.uint64) for k in at]


def suffix_array(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` to ``depth`` bytes (ties by place), and whether each shares them with the one before."""
    words = _prefix_words(data, starts, depth)
    order = np.lexsort(words[::-1])
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = True
        for w in words:
            same[1:] &= w[order[1:]] == w[order[:-1]]
    return order, same


def _prefix_digest(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits that tell prefixes of ``depth`` bytes apart."""
    a, b = np.zeros(len(starts), np.uint64), np.full(len(starts), 0x9E3779B97F4A7C15, np.uint64)
    for w in _prefix_words(data, starts, depth):
        a = C.mix(a * np.uint64(0xD1342543DE82EF95) + w)
        b = C.mix(b ^ w) * np.uint64(0xA24BAED4963EE407)
    return a, C.mix(b) & np.uint64(0xFFFFFFFF)


def _resolve(table: pa.Table, judged: pa.Table, least: int, buckets: int) -> pa.Table:
    block = B.Block(table)
    a = Anchors(block, least, buckets)
    number = table.column("block")[0].as_py()
    none = np.zeros(0, np.uint64)
    v = B.from_six(b"".join(x.as_buffer() for c in judged.column("keys").chunks for x in c))
    if not len(v) or not len(a.key):
        return B.minima_rows(number, buckets, np.zeros((0, 2)), none, none, none, none)
    of = np.repeat(judged.column("bucket").to_numpy().astype(np.uint64), B.sizes(judged.column("keys"), 6))
    context = B.joined(judged.column("contexts"), np.uint64)
    known = C.mix(((of & np.uint64(0x3FFFF)) << B.KEY_BITS) | (v >> np.uint64(2))) ^ context
    first, mixed = B.joined(judged.column("docs"), np.int64), (v & np.uint64(1)) > 0
    turn = np.argsort(known)
    known, context, first, mixed = known[turn], context[turn], first[turn], mixed[turn]
    k = np.minimum(np.searchsorted(known, a.both), len(known) - 1)
    found = (known[k] == a.both) & (context[k] == a.context)  # the key and 64 bits of the context
    ids = block.ids[a.row]
    settled = found & (ids > first[k])
    ranges = np.stack([a.first[settled], a.last[settled] + least], 1)
    open_ = np.flatnonzero(found & (ids == first[k]) & mixed[k])
    size = a.last[open_] - a.first[open_] + 1
    starts = np.repeat(a.first[open_] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    order, same = suffix_array(block.data, starts, least)
    # intervals of the array with common prefixes of ``least`` bytes; their members are in id order
    head = np.flatnonzero(~same)[np.cumsum(~same) - 1] if len(order) else order
    s = starts[order]
    doc = block.ids[np.searchsorted(block.offsets, s, "right") - 1]
    later = doc > doc[head]
    ranges = np.concatenate([ranges, np.stack([s[later], s[later] + least], 1)])
    # one place speaks for a class; the others of its document are its twins
    s, doc, head = s[~later], doc[~later], head[~later]
    new = np.ones(len(s), bool)
    new[1:] = head[1:] != head[:-1]
    lead = s[new][np.cumsum(new) - 1] if len(s) else s
    twins = np.stack([lead[~new], s[~new]], 1)
    s, doc = s[new], doc[new]
    turn = np.argsort(s)
    s, doc = s[turn], doc[turn]
    h1, h2 = _prefix_digest(block.data, s, least)
    return B.minima_rows(number, buckets, _merged(ranges), h1, h2, doc, s, twins)


def _merged(ranges: np.ndarray) -> np.ndarray:
    """Overlapping or touching ranges as one."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.concatenate([[True], ranges[1:, 0] > reach[:-1]])
    begin = np.flatnonzero(new)
    return np.stack([ranges[begin, 0], reach[np.append(begin[1:], len(ranges)) - 1]], 1)


def _digests(table: pa.Table, gone: pa.Table, least: int) -> pa.Table:
    block = B.Block(table)
    out = B.removed(gone, least, len(block.data))
    # documents stand end to end, so a run ends with its document
    edge = np.zeros(len(out) + 1, bool)
    edge[block.offsets] = True
    begins = out & np.concatenate([[True], ~out[:-1]]) | (out & edge[:-1])
    count = np.concatenate([[0], np.cumsum(out)])[block.offsets]
    spans = np.concatenate([[0], np.cumsum(begins)])[block.offsets]
    sha = []
    for k in range(len(block.ids)):
        a, b = block.offsets[k], block.offsets[k + 1]
        kept = block.data[a:b] if count[k] == count[k + 1] else block.data[a:b][~out[a:b]]
        sha.append(hashlib.sha256(kept.tobytes()).hexdigest())
    return pa.table({
        "doc_id": pa.array(block.all_ids), "text_id": pa.array(block.all_texts), "n_bytes": pa.array(np.diff(block.offsets)[block.place]),
        "n_removed": pa.array(np.diff(count)[block.place]), "n_spans": pa.array(np.diff(spans)[block.place]),
        "kept_sha256": pa.array(sha, pa.string()).take(pa.array(block.place))})


def repeated_bytes(docs: DataFrame, least: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes of every row."""
    dealt = B.Dealt(docs)
    buckets = dealt.buckets

    def contexts(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _contexts(table, least, buckets)

    def judge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _judge(table)

    def resolve(key: tuple[pa.Scalar, ...], table: pa.Table, judged: pa.Table) -> pa.Table:
        return _resolve(table, judged, least, buckets)

    def digest(key: tuple[pa.Scalar, ...], table: pa.Table, gone: pa.Table) -> pa.Table:
        return _digests(table, gone, least)

    by_block = dealt.rows.groupBy("block")
    judged = C.store(by_block.applyInArrow(contexts, CONTEXTS).groupBy("bucket").applyInArrow(judge, CONTEXTS), "anchor-contexts")
    minima = C.store(by_block.cogroup(judged.groupBy("block")).applyInArrow(resolve, B.MINIMA), "suffix-minima")
    C.discard(judged)
    gone = C.store(B.settle(minima, by_place=False), "suffix-removed")
    C.discard(minima)
    out = by_block.cogroup(gone.groupBy("block")).applyInArrow(
        digest, "doc_id long, text_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return dealt.for_all(out).withColumn("doc_id", C.null_id())


def interval_tree(data: bytes, bounds: np.ndarray, starts: np.ndarray, least: int) -> Iterator[tuple[int, list[int]]]:
    """(length, places) of every maximal repeat of at least ``least`` bytes among suffixes at ``starts``.

    ``bounds`` are the text boundaries that no repeat crosses. The suffixes are sorted, the
    common prefixes of neighbours scanned with a stack; an interval is reported when its
    members differ in the byte before them, that is when it cannot be extended to the left.
    """
    end = bounds[np.searchsorted(bounds, starts, "right")].tolist()
    begin = set(bounds.tolist())
    order = sorted(range(len(starts)), key=lambda k: data[starts[k] : end[k]])
    at = [int(starts[k]) for k in order]
    stop = [end[k] for k in order]
    before = [-1 if p in begin else data[p - 1] for p in at]

    def common(i: int) -> int:
        a, b, n = at[i - 1], at[i], min(stop[i - 1] - at[i - 1], stop[i] - at[i])
        low = 0
        while low < n:
            step = min(64, n - low)
            if data[a + low : a + low + step] != data[b + low : b + low + step]:
                while data[a + low] == data[b + low]:
                    low += 1
                return low
            low += step
        return n

    stack: list[tuple[int, int]] = []  # (common prefix, first member)
    for i in range(1, len(at) + 1):
        lcp = common(i) if i < len(at) else 0
        first = i - 1
        while stack and stack[-1][0] > lcp:
            length, first = stack.pop()
            if length >= least:
                members = range(first, i)
                lefts = {before[m] for m in members}
                if len(lefts) > 1 or -1 in lefts:
                    yield length, sorted(at[m] for m in members)
        if lcp and (not stack or stack[-1][0] < lcp):
            stack.append((lcp, first))


GROUPS = "repeat string, n_bytes long, doc_id long, start long"


def _pieces(table: pa.Table, judged: pa.Table, least: int, buckets: int, around: int) -> pa.Table:
    """The surroundings of a block's repeated anchors, with the shard that the anchor belongs to."""
    block = B.Block(table)
    a = Anchors(block, least, buckets)
    v = B.from_six(b"".join(x.as_buffer() for c in judged.column("keys").chunks for x in c))
    rows = np.zeros(0, np.int64)
    if len(v) and len(a.key):
        of = np.repeat(judged.column("bucket").to_numpy().astype(np.uint64), B.sizes(judged.column("keys"), 6))
        known = np.unique(((of & np.uint64(0x3FFFF)) << B.KEY_BITS) | (v >> np.uint64(2)))
        rows = np.flatnonzero(np.isin(B.combined(a.key, buckets), known))
    begin = np.maximum(a.first[rows] - around, block.offsets[a.row[rows]])
    end = np.minimum(a.last[rows] + least + around, block.offsets[a.row[rows] + 1])
    return pa.table({
        "anchor": pa.array(a.key[rows].view(np.int64)), "doc_id": pa.array(block.ids[a.row[rows]]),
        "start": pa.array(begin - block.offsets[a.row[rows]]),
        "piece": pa.array([block.data[x:y].tobytes() for x, y in zip(begin, end, strict=True)], pa.binary())})


def _groups(table: pa.Table, least: int) -> pa.Table:
    """Maximal repeats among the pieces of a shard; equal pieces are one suffix with several places."""
    rows = {c: [] for c in ("repeat", "n_bytes", "doc_id", "start")}
    table = table.sort_by("anchor")
    anchor = table.column("anchor").to_numpy()
    edge = np.append(np.flatnonzero(np.diff(anchor, prepend=anchor[:1] - 1)), len(anchor))
    ids, begins = table.column("doc_id"), table.column("start")
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        data, bounds = C.string_bytes(table.column("piece").slice(a, b - a).combine_chunks())
        starts = np.concatenate([np.arange(x, y - least + 1) for x, y in zip(bounds[:-1], bounds[1:], strict=True)])
        raw = data.tobytes()
        for length, members in interval_tree(raw, bounds, starts, least):
            name = hashlib.sha256(raw[members[0] : members[0] + length]).hexdigest()
            of = np.searchsorted(bounds, members, "right") - 1
            for k, m in zip(of.tolist(), members, strict=True):
                for d, s in zip(ids[a + k].as_py(), begins[a + k].as_py(), strict=True):
                    rows["repeat"].append(name)
                    rows["n_bytes"].append(length)
                    rows["doc_id"].append(d)
                    rows["start"].append(s + m - int(bounds[k]))
    return pa.table({"repeat": pa.array(rows["repeat"], pa.string()), **{
        c: pa.array(rows[c], pa.int64()) for c in ("n_bytes", "doc_id", "start")}})


def maximal_repeats(docs: DataFrame, least: int = 50, around: int = 256) -> DataFrame:
    """(repeat, n_bytes, doc_id, start) of every occurrence of each left-diverse common-prefix interval.

    Shards are made by anchor, so the occurrences of an anchor meet whatever documents they are
    in; equal surroundings are one suffix with a list of places. A repeat is followed ``around``
    bytes beyond its anchor's windows on either side; a longer one shows as several overlapping
    groups, one for each anchor. ``repeat`` is the SHA-256 of the repeated bytes.
    """
    dealt = B.Dealt(docs)
    buckets = dealt.buckets

    def contexts(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _contexts(table, least, buckets)

    def judge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _judge(table)

    def pieces(key: tuple[pa.Scalar, ...], table: pa.Table, judged: pa.Table) -> pa.Table:
        return _pieces(table, judged, least, buckets, around)

    def groups(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _groups(table, least)

    by_block = dealt.rows.groupBy("block")
    judged = by_block.applyInArrow(contexts, CONTEXTS).groupBy("bucket").applyInArrow(judge, CONTEXTS)
    found = by_block.cogroup(judged.groupBy("block")).applyInArrow(pieces, "anchor long, doc_id long, start long, piece binary")
    same = found.groupBy("anchor", "piece").agg(F.collect_list(F.struct("doc_id", "start")).alias("at"))
    same = same.select("anchor", "piece", F.col("at.doc_id").alias("doc_id"), F.col("at.start").alias("start"))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(8 * buckets))
    out = same.withColumn("shard", shard).groupBy("shard").applyInArrow(groups, GROUPS).distinct()
    return out.withColumn("doc_id", C.null_id())
