"""SimHash near-dedup with Golay-code fuzzy keys.

A fingerprint is cut into segments of at most 23 bits. In the perfect binary Golay code every
23-bit word lies within 3 bits of exactly one codeword; a word at distance 3 has five more
codewords at distance 4. Two words that differ in at most two bits always share one of these
one or six codewords, so a segment's codeword indices are keys that survive two bit errors.

A fingerprint with few errors has a segment without any (pigeonhole). A key joins such an exact
segment with one codeword index of the next segment: 33 bits or more, 16 keys per 64-bit
fingerprint, and no link at 2 or fewer bits is missed. Links are verified in the join itself.

Null and empty texts have no words: fingerprint zero, linked like any other. A null ``doc_id``
counts as the smallest id and gives its component a null id. Rows that repeat a ``doc_id`` get
a row each. Extra columns are ignored. Equal fingerprints are combined before any key is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import common as C
from tempora.llm.components import components

SEED = 42
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Byte to eight byte counters, so that up to 255 hashes add up without carries.
SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)
#: Generator polynomial of the [23, 12, 7] Golay code, a fixed value.
GENERATOR = 0xC75


def _syndrome(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64, copy=True)
    for bit in range(22, 10, -1):
        v ^= np.where((v >> bit) & 1, GENERATOR << (bit - 11), 0)
    return v


def _near_table() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of weight up to 3, or 3 and 4, and how many they are."""
    from itertools import combinations

    table, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], np.int64)
        for s, p in zip(_syndrome(patterns), patterns, strict=True):
            # weight 4 serves the syndromes whose leader weighs 3
            if weight < 4 or int(table[s, 0]).bit_count() == 3:
                table[s, count[s]] = p
                count[s] += 1
    return table, count


_NEAR: list = []


def codewords(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of every codeword within 3 bits of ``v``, or 4 where the nearest is at 3."""
    if not _NEAR:
        _NEAR.extend(_near_table())
    table, count = _NEAR
    s = _syndrome(v)
    n = count[s]
    row = np.repeat(np.arange(len(v)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, (v[row] ^ table[s[row], k]) >> 11


def word_list(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of every run of ``k`` words, repeats included; of all words where there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    return np.array([h(line[a:b], SEED) for a, b in zip(starts[: 1 - k or None].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as a 64-bit number."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    eight = SPREAD[hashes.view(np.uint8).reshape(n, 8)]
    for i in range(0, n, 255):
        counts += eight[i : i + 255].sum(0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = C.string_bytes(b.column("text"))
        fp = [majority(shingle_hashes(word_list(data[offsets[i] : offsets[i + 1]].tobytes()), shingle)) for i in range(b.num_rows)]
        C.trim()
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column("fp").to_numpy().view(np.uint64)
        parts = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
        for j in range(len(SEGMENTS)):
            row, index = codewords(parts[(j + 1) % len(SEGMENTS)])
            key = (np.int64(j) << 40) | (parts[j][row] << 12) | index
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64))], ["key", "fp"])


def links(fingerprints: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints that differ in at most two bits, from distinct ``fp``."""
    keys = C.store(fingerprints.select("fp").mapInArrow(_keys, "key long, fp long"), "simhash-keys")
    x, y = keys.select("key", F.col("fp").alias("a")), keys.select("key", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    return x.join(y.hint("merge"), (x["key"] == y["key"]) & (F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def simhash_components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    d = docs.select(C.doc_id(), C.text())
    fps = C.store(d.mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, fp long"), "fingerprints")
    first = C.store(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    labels = components(links(first))
    named = labels.join(first, labels["node"] == first["fp"]).select("component", "node", "first")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    joined = C.store(named.join(least, "component").select(F.col("node").alias("fp"), "component_id"), "fingerprint-components")
    all_ = C.store(first.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "component-of")
    out = fps.join(all_, "fp")
    return out.select(
        C.null_id(), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), C.null_id("component_id"))


# Near duplicates by similarity: SimHash links first, then an exact prefix filter for what the keys cannot cover.

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Shingle hashes below this come first in the common order; 5 of 16 on average, more than a prefix at 0.8 needs.
LOW = np.uint64(5 << 60)
#: A shingle in so many texts counts as frequent; frequent ones come last among the low hashes.
FREQUENT = 64
#: Heads of a group in the first round; each round takes eight times as many as the one before.
HEADS, MORE_HEADS = 1, 8


def prefix_size(n: int | np.ndarray, similarity: float):
    """Two sets with this Jaccard similarity share one of the first so many members in any common order."""
    return n - np.ceil(n * similarity - 1e-9).astype(np.int64) + 1


def _shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of every text; of all its words where there are fewer."""
    h, _, _, first = C.word_hashes(FOLD[data], offsets)
    span, out = C.Spans(h), []
    for a, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        starts = np.arange(a, max(e - k + 1, a + 1)) if e > a else np.zeros(0, np.int64)
        out.append(np.unique(span(starts, np.minimum(starts + k, e))))
    return out


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, offsets = C.string_bytes(batch.column("text"))
    for i, j in C.slices(offsets, C.PASS):
        yield i, j, _shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)


PROFILE = "doc_id long, same string, node long, n int, fp long, shingles binary"


def _profiles(batches: Iterator[pa.RecordBatch], k: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Number of shingles, SimHash, and the shingles that a prefix may be taken from."""
    for b in batches:
        for i, j, sets in _sets(b, k):
            n = np.array([len(s) for s in sets], np.int64)
            first = [s[: max(int(np.searchsorted(s, LOW)), int(p))].tobytes() if len(s) else b"" for s, p in zip(sets, prefix_size(n, similarity), strict=True)]
            fp = np.array([majority(C.mix(s)) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).slice(i, j - i) for c in ("doc_id", "same", "node")), pa.array(n.astype(np.int32)), pa.array(fp), pa.array(first, pa.binary())],
                ["doc_id", "same", "node", "n", "fp", "shingles"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in part.column("shingles")]
            size = [len(s) for s in sets]
            low = [int(np.searchsorted(s, LOW)) for s in sets]
            row = np.repeat(np.arange(len(sets)), size)
            values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values.view(np.int64)), part.column("node").take(pa.array(row)), part.column("n").take(pa.array(row)), pa.array(np.array(low, np.int32)[row])],
                ["token", "node", "n", "low"])


def _shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shingles that several texts have, from a stream sorted by (token, node), with the number of texts up to FREQUENT.

    At most FREQUENT rows of an open run are held.
    """
    names = ("token", "node", "n", "low")
    held, hot, last = [np.zeros(0, np.int64) for _ in names], None, None

    def rows(columns: list[np.ndarray], texts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32)), pa.array(columns[3].astype(np.int32)), pa.array(texts.astype(np.int32))], [*names, "texts"])

    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(c).to_numpy().astype(np.int64) for c in names]
        keep = np.ones(b.num_rows, bool)  # copies of a text are one
        keep[1:] = (new[0][1:] != new[0][:-1]) | (new[1][1:] != new[1][:-1])
        keep[0] = (new[0][0], new[1][0]) != last
        last = (new[0][-1], new[1][-1])
        both = [np.concatenate([h, x[keep]]) for h, x in zip(held, new, strict=True)]
        if not len(both[0]):
            continue
        begin = np.flatnonzero(np.concatenate([[True], both[0][1:] != both[0][:-1]]))
        size = np.diff(np.append(begin, len(both[0])))
        if hot is not None and both[0][0] == hot:
            size[0] = FREQUENT
        of = np.minimum(np.repeat(size, np.diff(np.append(begin, len(both[0])))), FREQUENT)
        hot = both[0][-1] if size[-1] >= FREQUENT else None
        done = len(both[0]) if hot is not None else begin[-1]
        out = np.flatnonzero(of[:done] > 1)
        if len(out):
            yield rows([c[out] for c in both], of[out])
        held = [c[done:] for c in both]
    if len(held[0]) > 1:
        yield rows(held, np.full(len(held[0]), len(held[0])))


def _set_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, sets in _sets(b, k):
            yield pa.RecordBatch.from_arrays([b.column("node").slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = []
        for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(both >= least * max(len(x) + len(y) - both, 1) - 1e-9)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _in_prefix(tokens: DataFrame, similarity: float) -> DataFrame:
    """(token, node, n, left) of the shared shingles in each text's prefix, as far as another text has them in its own.

    ``left`` is the number of the text's shingles from this one on, in the common order.

    ``tokens`` is (token, node, n, low) with ``low`` the number of the text's shingles under LOW,
    or n where the order is by number of texts alone. A prefix begins with the shingles that the
    text has alone, which need no row.
    """
    dealt = tokens.repartition("token").sortWithinPartitions("token", "node")
    shared = dealt.mapInArrow(_shared_tokens, "token long, node long, n int, low int, texts int")
    # unsigned order, as in the profiles
    early = F.col("token").between(0, int(LOW) - 1) | (F.col("low") == F.col("n"))
    own = shared.groupBy("node").agg(
        F.any_value("n").alias("n"), F.any_value("low").alias("low"),
        F.sort_array(F.collect_list(F.when(early, F.struct("texts", "token")))).alias("near"),
        F.collect_list(F.when(~early, F.struct("texts", "token"))).alias("beyond"))
    prefix = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    take = F.greatest(F.lit(0), F.least(F.size("near"), (prefix - (F.col("low") - F.size("near"))).cast("int")))
    shared = F.size("near") + F.size("beyond")
    taken = own.select("node", "n", shared.alias("shared"), F.posexplode(F.concat(F.slice("near", F.lit(1), take), "beyond")).alias("place", "x"))
    postings = C.store(taken.select("x.token", "node", "n", (F.col("shared") - F.col("place")).alias("left")), "postings")
    several = postings.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").select("token")
    return postings.join(several, "token")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(lambda it: _similar(it, similarity), "a long, b long")


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Texts of one fingerprint with the first of them, and the first ones of linked fingerprints."""
    first = C.store(nodes.groupBy("fp").agg(F.min("node").alias("first")), "first-of-fp")
    same = nodes.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    a, b = (first.select(F.col("fp").alias(c), F.col("first").alias(f"n{c}")) for c in "ab")
    linked = links(first).join(a, "a").join(b, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    return same.unionByName(linked)


def _set_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, node, n, low) of whole sets, with ``low`` as n: the order does not look at LOW."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in part.column("shingles")]
            size = np.array([len(s) for s in sets], np.int64)
            row = np.repeat(np.arange(len(sets)), size)
            n = pa.array(size[row].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), part.column("node").take(pa.array(row)), n, n], ["token", "node", "n", "low"])


def similar_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Stored (doc_id, same, node) of every row, and (node, component) of the texts that have a similar one.

    ``node`` stands for a text. Its neighbours have a Jaccard similarity of ``similarity`` or
    more over sets of ``shingle``-word shingles, and no pair is missed: two such sets share a
    shingle of their prefixes in any common order. The first order takes a sample of the hashes
    first, rare shingles before frequent ones, and only tells which texts can have a neighbour.
    These texts are compared in the order of all their shingles by number of texts, so a shared
    one comes up only where four fifths of the text are shared.

    Links that SimHash keys give are verified with the first comparisons and join most of each
    group. Every prefix shingle compares its smallest text with its others, as far as these are
    not in one component yet and their shingles from this one on allow the similarity; texts that have been compared
    with all others of their shingle leave it, and the rest goes on with more heads until each
    shingle has one component left.
    """
    d = docs.select(C.doc_id(), C.text()).withColumn("same", F.md5("text")).withColumn("node", F.conv(F.substring("same", 1, 15), 16, 10).cast("long"))
    profiles = C.store(d.mapInArrow(lambda it: _profiles(it, shingle, similarity), PROFILE), "profiles")
    nodes = C.store(profiles.filter("n > 0").groupBy("node").agg(
        F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.min(F.struct("doc_id", "same")).alias("head")), "nodes")
    tokens = profiles.filter("n > 0").mapInArrow(_tokens, "token long, node long, n int, low int")
    some = C.store(_in_prefix(tokens, similarity).select("node").distinct(), "with-candidates")
    rows = C.store(profiles.select("doc_id", "same", "node"), "rows")
    C.discard(profiles)
    by_fp = C.store(_simhash_pairs(nodes), "fp-pairs")
    wanted = some.unionByName(by_fp.select(F.col("a").alias("node"))).unionByName(by_fp.select(F.col("b").alias("node"))).distinct()
    heads = C.store(nodes.join(wanted, "node").select("node", "head.*"), "wanted")
    sets = C.store(
        d.select("doc_id", "same", "text").join(heads.hint("shuffle_hash"), ["doc_id", "same"]).select("node", "text").mapInArrow(
            lambda it: _set_rows(it, shingle), "node long, shingles binary").dropDuplicates(["node"]), "shingle-sets")
    again = sets.join(some, "node", "left_semi").mapInArrow(_set_tokens, "token long, node long, n int, low int")
    open_ = C.store(_in_prefix(again, similarity), "open-postings")
    labels, found, pairs, heads_a_round = None, None, by_fp, HEADS
    while True:
        component = F.col("node") if labels is None else F.coalesce("component", "node")
        named = (open_ if labels is None else open_.join(labels, "node", "left")).select("token", "node", "n", "left", component.alias("component"))
        several = named.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("token")
        named = C.store(named.join(several, "token"), "named")
        if named.isEmpty() and labels is not None:
            break
        part = F.pmod(F.xxhash64("node", F.lit(heads_a_round)), F.lit(heads_a_round))
        first = C.store(named.groupBy("token", part.alias("part")).agg(F.min(F.struct("node", "n", "left", "component")).alias("h")).select(
            "token", F.col("h.node").alias("a"), F.col("h.n").alias("an"), F.col("h.left").alias("aleft"), F.col("h.component").alias("ac")), "heads")
        # at its first shared shingle a pair has at most the rest of either set in common; for the similarity it needs this
        needed = F.ceil((F.col("n") + F.col("an")) * (similarity / (1 + similarity)) - 1e-9)
        fits = needed <= F.least("left", "aleft")
        met = named.join(first, "token").filter((F.col("component") != F.col("ac")) & fits).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        pairs = C.store((met if labels is not None else met.unionByName(pairs)).distinct(), "pairs")
        more = C.store(_verified(pairs, sets, similarity), "found")
        rest = named.select("token", "node", "n", "left").join(first.select("token", F.col("a").alias("node")), ["token", "node"], "left_anti")
        open_ = C.store(rest, "open-postings")
        if labels is None or not more.isEmpty():
            found = more if found is None else found.unionByName(more)
            labels = components(found)
        heads_a_round *= MORE_HEADS
    C.discard(sets)
    return rows, labels


def duplicate_ids(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, same) of the rows that go: all but the row with the smallest id of each group of near duplicates.

    ``same`` is the MD5 of the row's text. Copies of a text are in one group; wordless texts only
    with their copies. Among null or equal ids the text with the smallest MD5 stays.
    """
    rows, labels = similar_texts(docs, shingle, similarity)
    grouped = rows.join(labels, "node", "left").select("doc_id", "same", F.coalesce("component", "node").alias("component"))
    kept = C.store(grouped.groupBy("component").agg(F.min(F.struct("doc_id", "same")).alias("kept")), "kept")
    gone = grouped.join(kept, "component").filter((F.col("doc_id") != F.col("kept.doc_id")) | (F.col("same") != F.col("kept.same")))
    return C.store(gone.select("doc_id", "same").distinct(), "duplicates")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest id.

    Rows that repeat a ``doc_id`` and text stay or go together. Null texts are empty, null ids the
    smallest. Columns of any name pass through.
    """
    gone_id, gone_text = C.unused(docs, "gone_id"), C.unused(docs, "gone_text")
    gone = duplicate_ids(docs, shingle, similarity).select(F.col("doc_id").alias(gone_id), F.col("same").alias(gone_text))
    on = (F.coalesce(docs["doc_id"].cast("long"), F.lit(C.NULL_ID)) == F.col(gone_id)) & (
        F.md5(F.coalesce(docs["text"], F.lit(""))) == F.col(gone_text))
    return docs.join(gone.hint("shuffle_hash"), on, "left_anti")
