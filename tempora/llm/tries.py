"""Prefix trie of conversations as balanced parentheses, a shard at a time.

A conversation travels as one row with 24 bytes a turn (digest and size), never as text; equal
rebuilt conversations are one class with a weight. Classes are range-partitioned by their paths,
so the classes under any node are neighbours, and a task cuts its sorted stream into shards of
some 65,000 nodes. Each shard is encoded as balanced parentheses. A tree of block minima and
maxima of the excess answers ``find_close`` for all nodes at once, which delimits subtrees;
ranks of "()" pairs count leaves, and sums over the preorder give members and savings.

A node that goes on in the next shard lies on the path to the last class of the one and to the
first class of the other. Such spine nodes leave a shard as partial rows, and each border between
neighbouring shards adds one correction row per shared node: the savings below it that both
shards left out, a child and perhaps a leaf that both counted. Sums by node merge them.

A null ``conv_id`` is one conversation that is not rebuilt; its members are written as an empty
string and it counts as the smallest. Ties in ``turn`` go by the SHA-256 of role and text. Texts
of any length count by their digest. Remainders of negative ids have their sign, as in SQL. An
empty table has no nodes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm import common as C

SHARD_NODES = 1 << 16
PART_BYTES = 4 << 20
TURN_BYTES = 24
#: Every (id % STEP)-th conversation lends its head; heads are shorter than HEAD turns.
STEP, HEAD = 5, 9
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """Balanced parentheses with a tree of block minima and maxima of the excess."""

    BLOCK = 64

    def __init__(self, is_open: np.ndarray):
        n = len(is_open)
        self.excess = np.cumsum(np.where(is_open, 1, -1)).astype(np.int32)
        blocks = max(1, -(-n // self.BLOCK))
        padded = np.zeros(blocks * self.BLOCK, np.int32)
        padded[:n] = self.excess
        padded[n:] = self.excess[-1] if n else 0
        self.rows = padded.reshape(blocks, self.BLOCK)
        self.low, self.high = [self.rows.min(1)], [self.rows.max(1)]
        while len(self.low[-1]) > 1:
            for levels, pick in ((self.low, np.minimum), (self.high, np.maximum)):
                level = levels[-1]
                level = np.append(level, level[-1:]) if len(level) % 2 else level
                levels[-1] = level
                levels.append(pick(level[::2], level[1::2]))
        pairs = np.zeros(n + 1, np.int64)
        pairs[1:n] = np.cumsum(is_open[:-1] & ~is_open[1:])
        pairs[n:] = pairs[max(n - 1, 0)]
        self.pairs = pairs

    def _has(self, level: int, node: np.ndarray, value: np.ndarray) -> np.ndarray:
        inside = node < len(self.low[level])
        at = np.where(inside, node, 0)
        return inside & (self.low[level][at] <= value) & (value <= self.high[level][at])

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """Place of the parenthesis that closes each open one: the next place with an excess of one less."""
        target = self.excess[opens] - 1
        block, inside = opens // self.BLOCK, opens % self.BLOCK
        hit = (self.rows[block] == target[:, None]) & (np.arange(self.BLOCK) > inside[:, None])
        found = hit.any(1)
        out = np.where(found, block * self.BLOCK + hit.argmax(1), -1)
        rest = np.flatnonzero(~found)
        node, value, level_of = block[rest], target[rest], np.full(len(rest), -1)
        for level in range(len(self.low)):
            climbing = level_of < 0
            right = np.where(node % 2 == 0, node + 1, len(self.low[level]))
            there = climbing & self._has(level, right, value)
            node = np.where(there, right, np.where(climbing, node // 2, node))
            level_of[there] = level
        for level in range(len(self.low) - 1, 0, -1):
            down = level_of >= level
            left = 2 * node
            node = np.where(down, np.where(self._has(level - 1, left, value), left, left + 1), node)
        out[rest] = node * self.BLOCK + (self.rows[node] == value[:, None]).argmax(1)
        return out

    def leaves(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Leaf pairs within each [open, close]."""
        return self.pairs[closes] - self.pairs[opens]


def shared(a: list, b: list) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def prefix_keys(path: list[bytes]) -> list[str]:
    """A key for every prefix of a path, the empty one first."""
    h, out = hashlib.sha256(), []
    out.append(h.hexdigest()[:32])
    for x in path:
        h.update(x)
        out.append(h.hexdigest()[:32])
    return out


NODE = ("key string, parent_key string, parent_conv_id long, conv_id long, depth long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string")
EDGE = "part int, side int, path array<binary>, sizes array<long>"
_NODE_TYPES = [("key", pa.string()), ("parent_key", pa.string()), *((c, pa.int64()) for c in (
    "parent_conv_id", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string())]
_EDGE_TYPES = [("part", pa.int32()), ("side", pa.int32()), ("path", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64()))]
SCHEMA = pa.schema(_NODE_TYPES + _EDGE_TYPES)


def _rows(columns: dict[str, list]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in SCHEMA], schema=SCHEMA)


def border(path: list[bytes], sizes: list[int], following: list[bytes]) -> dict[str, list]:
    """Corrections of the nodes that a shard ending with ``path`` shares with one starting with ``following``."""
    n = shared(path, following)
    keys = prefix_keys(path[:n])
    own = np.array([0, *sizes[:n]], np.int64)
    return {
        "key": keys, "depth": list(range(n + 1)), "n_convs": [0] * (n + 1), "n_children": [-1] * n + [0],
        # the shard's last class is a leaf there, but not where the next class goes on from it
        "n_leaves": [-1 if n == len(path) else 0] * (n + 1), "saved_tokens": np.cumsum(own[::-1])[::-1].tolist()}


class Shard:
    """Nodes of consecutive classes, in preorder."""

    def __init__(self) -> None:
        self.is_open, self.at, self.depth, self.parent, self.size = [True], [0], [0], [-1], [0]
        self.stack, self.path, self.path_sizes = [0], [], []
        self.first, self.ending = None, []

    def add(self, path: list[bytes], sizes: list[int], n: int, conv_id: int, ends: str) -> None:
        keep = shared(path, self.path)
        self.is_open += [False] * (len(self.stack) - 1 - keep)
        del self.stack[keep + 1 :]
        for d in range(keep, len(path)):
            self.parent.append(self.stack[-1])
            self.stack.append(len(self.at))
            self.at.append(len(self.is_open))
            self.is_open.append(True)
            self.depth.append(d + 1)
            self.size.append(sizes[d])
        self.path, self.path_sizes = path, sizes
        if self.first is None:
            self.first = (path, list(self.stack))
        self.ending.append((self.stack[-1], n, conv_id, ends))

    def rows(self) -> Iterator[pa.RecordBatch]:
        is_open = np.array(self.is_open + [False] * len(self.stack))
        tree, at = Parentheses(is_open), np.array(self.at)
        close = tree.find_close(at)
        m = len(at)
        after = np.arange(m) + (close - at + 1) // 2
        node = np.array([e[0] for e in self.ending])
        weight, least = np.zeros(m, np.int64), np.full(m, np.iinfo(np.int64).max)
        weight[node], least[node] = [e[1] for e in self.ending], [e[2] for e in self.ending]
        depth, parent, size = np.array(self.depth), np.array(self.parent), np.array(self.size, np.int64)

        def below(x: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(x)])
            return total[after] - total[:m]

        members = below(weight)
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(1, depth.max() + 2))
        for d in range(depth.max(), 0, -1):
            level = by_depth[cuts[d - 1] : cuts[d]]
            np.minimum.at(least, parent[level], least[level])
        ends = [None] * m
        for v, _, _, x in self.ending:
            ends[v] = x
        keys: list[str | None] = [None] * m
        for path, nodes in (self.first, (self.path, self.stack)):
            for v, k in zip(nodes, prefix_keys(path), strict=True):
                keys[v] = k
        up = parent.tolist()
        parent_keys = [keys[p] if p >= 0 else None for p in up]
        yield _rows({
            "key": keys, "parent_key": parent_keys,
            "parent_conv_id": [None if p < 0 or k is not None else x for p, k, x in zip(up, parent_keys, least[parent].tolist(), strict=True)],
            "conv_id": least.tolist(), "depth": depth.tolist(), "n_convs": members.tolist(),
            "n_children": np.bincount(parent[1:], minlength=m).tolist(), "n_leaves": tree.leaves(at, close).tolist(),
            "saved_tokens": below((members - 1) * size).tolist(), "ends_sha256": ends})


def _shards(batches: Iterator[pa.RecordBatch], most_nodes: int) -> Iterator[pa.RecordBatch]:
    """Nodes, spine nodes (with a key), border corrections, and the first and last path of the task."""
    from pyspark import TaskContext

    part, shard, first, last = TaskContext.get().partitionId(), None, None, None
    for b in batches:
        for path, sizes, n, conv_id, ends in zip(*(b.column(c).to_pylist() for c in ("path", "sizes", "n", "conv_id", "ends")), strict=True):
            if shard is None:
                shard = Shard()
                if last is None:
                    first = (path, sizes)
                else:
                    yield _rows(border(*last, path))
            shard.add(path, sizes, n, conv_id, ends)
            last = (path, sizes)
            if len(shard.at) >= most_nodes:
                yield from shard.rows()
                shard = None
    if shard is not None:
        yield from shard.rows()
    if first is not None:
        yield _rows({"part": [part] * 2, "side": [0, 1], "path": [first[0], last[0]], "sizes": [first[1], last[1]]})


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, sizes, following in zip(*(b.column(c).to_pylist() for c in ("path", "sizes", "following")), strict=True):
            yield _rows(border(path, sizes, following)).select([n for n, _ in _NODE_TYPES])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sequence, n, conv_id, ends) of each run of one sequence in a sorted stream; only a hash state is held."""
    key, n, least, sha = None, 0, None, None
    out: list[tuple] = []
    for b in batches:
        ids = b.column("conv_id").to_pylist()
        keys = b.column("sequence").to_pylist()
        i = 0
        while i < len(ids):
            j = i
            while j < len(ids) and keys[j] == keys[i]:
                j += 1
            text = ",".join("" if x == C.NULL_ID else str(x) for x in ids[i:j])
            if keys[i] == key:
                sha.update(b"," + text.encode())
                n += j - i
            else:
                if key is not None:
                    out.append((key, n, least, sha.hexdigest()))
                key, n, least, sha = keys[i], j - i, ids[i], hashlib.sha256(text.encode())
            i = j
        if out:
            yield _member_rows(out)
            out = []
    if key is not None:
        yield _member_rows([(key, n, least, sha.hexdigest())])


def _member_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())],
        ["sequence", "n", "conv_id", "ends"])


def half_sha(c: Column) -> Column:
    return F.unhex(F.substring(F.sha2(c, 256), 1, 32))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with the (digest, size) of every turn in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    d = half_sha(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"), d.alias("d"), F.octet_length(text).cast("long").alias("n"))
    keyed = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(C.NULL_ID)).alias("conv_id"), turn.alias("x"))
    return keyed.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x.d.alias("d"), x.n.alias("n"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``sequences`` after every conversation has taken the head of the one that its id leads to."""
    own = C.store(sequences(conversations), "turns")
    heads = own.filter(F.col("conv_id") % STEP == 0).filter(F.col("conv_id") != C.NULL_ID).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD - 1).alias("head"))
    c = own.withColumns({
        "base": F.when(F.col("conv_id") != C.NULL_ID, F.col("conv_id") - F.col("conv_id") % STEP),
        "h": F.when(F.col("conv_id") != C.NULL_ID, F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).otherwise(0).cast("int")})
    none = F.array().cast("array<struct<d:binary,n:bigint>>")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), none)
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return c.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def prefix_trie(paths: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``paths`` is (conv_id, turns: array of (d, n)), with one row per conversation.
    """
    key = half_sha(F.array_join(F.transform("turns", lambda x: F.hex(x.d)), ""))
    keyed = C.store(paths.select("conv_id", key.alias("sequence"), F.transform("turns", lambda x: x.d).alias("path"), F.transform("turns", lambda x: x.n).alias("sizes")), "paths")
    dealt = keyed.select("sequence", "conv_id").repartition("sequence").sortWithinPartitions("sequence", "conv_id")
    members = dealt.mapInArrow(_members, "sequence binary, n long, conv_id long, ends string")
    classes = keyed.join(members, ["sequence", "conv_id"]).drop("sequence")
    parts = C.count_for(TURN_BYTES * (keyed.agg(F.sum(F.size("path") + 1)).first()[0] or 0), PART_BYTES, 8)
    cut = classes.repartitionByRange(parts, "path").sortWithinPartitions("path")
    most = SHARD_NODES
    out = C.store(cut.mapInArrow(lambda it: _shards(it, most), f"{NODE}, {EDGE}"), "trie")
    names = [n for n, _ in _NODE_TYPES]
    # two rows per task at most
    ordered = Window.orderBy("part", "side")
    edges = out.filter("part is not null").select("side", "path", "sizes", F.lead("path").over(ordered).alias("following"))
    borders = edges.filter("side = 1 and following is not null").select("path", "sizes", "following").mapInArrow(_borders, NODE)
    nodes = out.filter("part is null").select(*names)
    spine = nodes.filter("key is not null").unionByName(borders).groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends_sha256").alias("ends_sha256"))
    spine = C.store(spine, "spine")
    inner = nodes.filter("key is null").drop("key")
    both = inner.unionByName(spine.drop("key").withColumn("parent_conv_id", F.lit(None).cast("long")))
    above = spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("spine_conv_id"))
    joined = both.join(above, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("spine_conv_id", "parent_conv_id"))
    return joined.select(
        C.null_id("conv_id"), "depth", C.null_id("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """:func:`prefix_trie` of the rebuilt conversations."""
    return prefix_trie(rebuilt(conversations))
