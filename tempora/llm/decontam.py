"""Benchmark decontamination by latent semantic retrieval.

One scan turns every document into the positions of the benchmark's words. Passages are runs of
``PASSAGE`` words, half overlapping. Document frequencies over all passages give TF-IDF weights;
a distributed randomised SVD (one sketch of A'A over all passages, the items folded in) gives
the latent space. Passages with a high latent cosine to an item are candidates, and so are the
places where enough pairs of an item's neighbouring words stand together, however frequent the
words and however many the copies of the leak. A candidate is a leak when the longest common subsequence with the item covers ``MIN_LCS`` of its words and
the item's closing words (its answer) are there too. Words that no item has can neither match
nor change a subsequence, so nothing is lost by leaving them out.

The benchmark is the stated query set; it is taken in blocks of ``BLOCK`` items, so what is sent
to executors is bounded by the block. Items of fewer than ``MIN_WORDS`` words are leaks where all
their words stand in a row. A long item has a small cosine to any passage; its pairs find it.
Null and empty texts have no leak. A null ``doc_id`` stays null; repeated rows give the same
rows again. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import common as C
from tempora.llm.toxicity import FOLD

PASSAGE, HALF, BLOCK, MIN_WORDS = 48, 24, 256, 6
RANK, OVERSAMPLE = 256, 16
#: Words in a larger share of the passages carry no weight.
COMMON = 0.002
MIN_COSINE, MIN_LCS, MIN_ANSWER = 0.22, 0.6, 0.5
SLOTS = 18
#: Neighbouring item words may have so many other benchmark words between them, less one, and still are a pair.
GAPS = (1, 2, 3)
#: Weighted words whose vectors are in memory at a time, in whole documents.
AT_ONCE = 8_000


def _slot_of(pairs: np.ndarray) -> np.ndarray:
    return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)


@dataclass
class Items:
    """A block of benchmark items as sequences of word numbers."""

    ids: list[int]
    words: list[np.ndarray]
    hashes: np.ndarray  # sorted; a word's number is its place
    slot: np.ndarray = field(init=False)
    pairs: np.ndarray = field(init=False)  # sorted pairs of neighbouring words in items
    owners: np.ndarray = field(init=False)  # items that have each pair, from ``begin`` on
    begin: np.ndarray = field(init=False)
    least: np.ndarray = field(init=False)  # distinct pairs that a leak of the item has
    maybe: np.ndarray = field(init=False)

    def __post_init__(self):
        # hashes spread over 2**SLOTS slots; each slot tells where its hashes begin
        at = (self.hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        self.slot = np.searchsorted(at, np.arange((1 << SLOTS) + 1)).astype(np.int32)
        own = [np.unique(w[:-1] * len(self.hashes) + w[1:]) for w in self.words]
        codes, owners = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
        turn = np.argsort(codes, kind="stable")
        self.owners = owners[turn]
        self.pairs, begin = np.unique(codes[turn], return_index=True)
        self.begin = np.append(begin, len(codes))
        # of n words k stay, in at most n - k + 1 runs: 2k - n - 1 pairs, less the item's repeated ones
        n = np.array([len(w) for w in self.words])
        k = np.ceil(MIN_LCS * n - 1e-9).astype(np.int64)
        self.least = np.maximum(2 * k - n - 1 - (n - 1 - np.array([len(x) for x in own])), 1)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[_slot_of(self.pairs)] = True

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Number of each hashed word, -1 for words of no item."""
        out = np.full(len(h), -1, np.int32)
        at = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
        low, high = self.slot[at], self.slot[at + 1]
        some = np.flatnonzero(low < high)
        k = low[some]
        for _ in range(int((high[some] - k).max(initial=0))):
            ok = k < high[some]
            hit = ok & (self.hashes[np.minimum(k, len(self.hashes) - 1)] == h[some])
            out[some[hit]] = k[hit]
            k = k + 1
        return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, _, _, first = C.word_hashes(FOLD[data], offsets)
    return h, first


def item_blocks(benchmark: DataFrame, block: int = BLOCK) -> Iterator[Items]:
    rows: list = []

    def made() -> Items:
        texts = pa.array([r.text for r in rows], pa.string())
        h, first = _words(*C.string_bytes(texts))
        known = np.unique(h)
        number = np.searchsorted(known, h)
        return Items([r.item_id for r in rows], [number[first[i] : first[i + 1]] for i in range(len(rows))], known)

    b = benchmark.select("item_id", C.text()).filter(F.col("text") != "").orderBy("item_id", "text")
    for r in b.toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            yield made()
            rows = []
    if rows:
        yield made()


def judged_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Blocks that have any word."""
    return (items for items in item_blocks(benchmark) if len(items.hashes))


def _numbered(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    items = shared.value
    for b in batches:
        data, offsets = C.string_bytes(b.column("text"))
        for i, j in C.slices(offsets, C.PASS):
            pos, ids, count = [], [], []
            h, first = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n = items.numbers(h)
            at = np.flatnonzero(n >= 0)
            cut = np.searchsorted(at, first)
            for k in range(j - i):
                own = at[cut[k] : cut[k + 1]]
                pos.append((own - first[k]).astype(np.uint32).tobytes())
                ids.append(n[own].astype(np.uint32).tobytes())
            count = np.diff(first)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(i, j - i), pa.array(count), pa.array(pos, pa.binary()), pa.array(ids, pa.binary())],
                ["doc_id", "n_words", "pos", "ids"])


NUMBERED = "doc_id long, n_words long, pos binary, ids binary"


@dataclass
class Chunk:
    """The benchmark words of a few documents: row of the document, place in it, word number."""

    row: np.ndarray
    pos: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, b: pa.RecordBatch) -> Chunk:
        pos, offsets = C.string_bytes(b.column("pos"))
        ids, _ = C.string_bytes(b.column("ids"))
        row = np.repeat(np.arange(b.num_rows), np.diff(offsets) // 4)
        return cls(row, pos.view(np.uint32).astype(np.int64), ids.view(np.uint32).astype(np.int64))

    def only(self, keep: np.ndarray) -> Chunk:
        return Chunk(self.row[keep], self.pos[keep], self.ids[keep])

    def parts(self) -> Iterator[Chunk]:
        """Runs of whole documents of about ``AT_ONCE`` words."""
        i, n = 0, len(self.row)
        while i < n:
            j = min(i + AT_ONCE, n)
            if j < n:
                j = int(np.searchsorted(self.row, self.row[j], "left"))
                j = j if j > i else int(np.searchsorted(self.row, self.row[i], "right"))
            yield Chunk(self.row[i:j], self.pos[i:j], self.ids[i:j])
            i = j

    def halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Half passages that hold words: where each begins among the words, its document and its number there."""
        half = self.pos // HALF
        new = np.ones(len(half), bool)
        new[1:] = (half[1:] != half[:-1]) | (self.row[1:] != self.row[:-1])
        begin = np.flatnonzero(new)
        return begin, self.row[begin], half[begin]


def _frequencies(batches: Iterator[pa.RecordBatch], n_words: int) -> Iterator[pa.RecordBatch]:
    """Half passages that hold each word, and all half passages as word -1."""
    df, halves = np.zeros(n_words, np.int64), 0
    for b in batches:
        halves += int((-(-b.column("n_words").to_numpy() // HALF)).sum())
        c = Chunk.of(b)
        begin, _, _ = c.halves()
        of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(c.ids))))
        df += np.bincount(np.unique(of * n_words + c.ids) % n_words, minlength=n_words)
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(some, -1)), pa.array(np.append(df[some], halves))], ["word", "n"])


def _half_sums(c: Chunk, weight: np.ndarray, vectors: np.ndarray):
    """Halves of a chunk, their weighted sums of word vectors, and which follow on the half before."""
    begin, row, half = c.halves()
    sums = np.add.reduceat(weight[c.ids][:, None] * vectors[c.ids], begin) if len(begin) else np.zeros((0, vectors.shape[1]), np.float32)
    follows = np.zeros(len(begin), bool)
    follows[1:] = (row[1:] == row[:-1]) & (half[1:] == half[:-1] + 1)
    return begin, row, half, sums, follows


def _sketch(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Sum over passages a of a (a' omega), one row per word.

    A passage is two halves, so a word of half h meets the passages (h - 1, h) and (h, h + 1).
    """
    weight, omega = shared.value
    total = np.zeros_like(omega)
    for b in batches:
        whole = Chunk.of(b)
        for c in whole.only(weight[whole.ids] > 0).parts():
            begin, _, _, sums, follows = _half_sums(c, weight, omega)
            seen = 2 * sums
            seen[1:][follows[1:]] += sums[:-1][follows[1:]]
            seen[:-1][follows[1:]] += sums[1:][follows[1:]]
            of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(c.ids))))
            turn = np.argsort(c.ids, kind="stable")
            words = c.ids[turn]
            first = np.flatnonzero(np.diff(words, prepend=-1))
            total[words[first]] += weight[words[first]][:, None] * np.add.reduceat(seen[of[turn]], first)
    some = np.flatnonzero(np.abs(total).sum(1))
    if len(some):
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array([v.tobytes() for v in total[some]], pa.binary())], ["word", "v"])


def _add_up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(v.as_buffer(), np.float32) for v in table.column("v").combine_chunks()], axis=0, dtype=np.float64)
    return pa.table({"word": [key[0].as_py()], "v": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


@dataclass
class Latent:
    """Everything a task needs to judge documents against one block of items."""

    items: Items
    weight: np.ndarray
    basis: np.ndarray  # words x rank
    points: np.ndarray  # items x rank, unit length
    places: dict = field(default_factory=dict)  # places of each word in an item and in its tail, as needed

    def candidates(self, c: Chunk) -> Iterator[tuple[int, int, int, float]]:
        """(document, item, first word of the passage, cosine) above the threshold."""
        for part in c.only(self.weight[c.ids] > 0).parts():
            yield from self._candidates(part)

    def _candidates(self, c: Chunk) -> Iterator[tuple[int, int, int, float]]:
        begin, row, half, sums, follows = _half_sums(c, self.weight, self.basis)
        x = self.weight[c.ids]
        norm = np.add.reduceat(x * x, begin)
        count = np.diff(np.append(begin, len(x)))
        # a passage is a half and the next one; where there is no next one, the half alone
        sums[:-1][follows[1:]] += sums[1:][follows[1:]]
        norm[:-1] += np.where(follows[1:], norm[1:], 0)
        count[:-1] += np.where(follows[1:], count[1:], 0)
        some = np.flatnonzero(count >= 3)
        cos = (sums[some] @ self.points.T) / np.sqrt(norm[some])[:, None]
        for r, i in zip(*np.nonzero(cos >= MIN_COSINE), strict=True):
            k = some[r]
            yield int(row[k]), int(i), int(half[k]) * HALF, float(cos[r, i])

    def leaks(self, c: Chunk) -> dict[tuple[int, int], tuple[float, float, int]]:
        """(document, item) -> (share of the item in its longest common subsequence, cosine, first word)."""
        found: dict[tuple[int, int], tuple[float, float, int]] = {}
        if not len(c.row):
            return found
        edge = np.searchsorted(c.row, np.arange(c.row[-1] + 2))
        for row, i, start, cos in self.candidates(c):
            n = len(self.items.words[i])
            if n < MIN_WORDS or found.get((row, i), (0.0,))[0] >= 1:
                continue
            share = self.share(c, edge, row, i, start)
            if share:
                found[row, i] = max(found.get((row, i), (0.0, 0.0, 0)), (share, cos, start))
        by_cosine = set(found)
        for row, i, start in self.paired(c):
            if (row, i) in by_cosine or found.get((row, i), (0.0,))[0] >= 1:
                continue
            # the window that begins with the pairs, and the one that has them in its middle
            for at in (start, start + len(self.items.words[i]) // HALF * HALF):
                share = self.share(c, edge, row, i, at, self.items.least[i])
                if share > found.get((row, i), (0.0,))[0]:
                    found[row, i] = share, self.cosine(c, edge, row, i, start), start
        for row, i, start in self.verbatim(c):
            if (row, i) not in found:
                found[row, i] = 1.0, self.cosine(c, edge, row, i, start), start
        return found

    def verbatim(self, c: Chunk) -> Iterator[tuple[int, int, int]]:
        """(document, item, first word of a half) where all words of an item under ``MIN_WORDS`` stand in a row."""
        for i, item in enumerate(self.items.words):
            n = len(item)
            if not 0 < n < MIN_WORDS:
                continue
            at = np.flatnonzero(c.ids[: max(len(c.ids) - n + 1, 0)] == item[0])
            for k in range(1, n):
                at = at[(c.ids[at + k] == item[k]) & (c.row[at + k] == c.row[at]) & (c.pos[at + k] == c.pos[at] + k)]
            for x in at.tolist():
                yield int(c.row[x]), i, int(c.pos[x]) // HALF * HALF

    def share(self, c: Chunk, edge: np.ndarray, row: int, i: int, start: int, pairs: int = 0) -> float:
        """Share of the item in its longest common subsequence with the words around a passage, 0 if it is no leak."""
        item = self.items.words[i]
        n = len(item)
        low, high = edge[row], edge[row + 1]
        a, b = low + np.searchsorted(c.pos[low:high], [start - n, start + PASSAGE + n])
        near = c.ids[a:b].tolist()
        if i not in self.places:
            self.places[i] = word_places(item), word_places(item[-max(3, n // 4):])
        whole, tail = self.places[i]
        if pairs and sum(map(whole.__contains__, near)) < MIN_LCS * n:
            return 0.0
        share = _common(whole, n, near) / n
        size = len(item[-max(3, n // 4):])
        return share if share >= MIN_LCS and _common(tail, size, near) / size >= MIN_ANSWER else 0.0

    def cosine(self, c: Chunk, edge: np.ndarray, row: int, i: int, start: int) -> float:
        """Latent cosine of a passage to an item; 0 where no word has weight."""
        low, high = edge[row], edge[row + 1]
        a, b = low + np.searchsorted(c.pos[low:high], [start, start + PASSAGE])
        ids = c.ids[a:b]
        x = self.weight[ids]
        return float((x @ self.basis[ids]) @ self.points[i] / max(np.sqrt((x * x).sum()), 1e-9))

    def paired(self, c: Chunk) -> Iterator[tuple[int, int, int]]:
        """(document, item, first word of a half) from where as many pairs of the item stand together as a leak has."""
        items = self.items
        n_words, n_items = len(items.hashes), len(items.words)
        places, pairs = [], []
        for gap in GAPS:
            code = c.ids[:-gap] * n_words + c.ids[gap:]
            at = np.flatnonzero(items.maybe[_slot_of(code)] & (c.row[gap:] == c.row[:-gap]))
            k = np.searchsorted(items.pairs, code[at])
            some = items.pairs[np.minimum(k, len(items.pairs) - 1)] == code[at] if len(items.pairs) else np.zeros(len(at), bool)
            places.append(at[some])
            pairs.append(k[some])
        at, k = np.concatenate(places), np.concatenate(pairs)
        size = items.begin[k + 1] - items.begin[k]
        of = np.repeat(np.arange(len(k)), size)
        item = items.owners[np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + items.begin[k[of]]]
        at, k = at[of], k[of]
        long_ = np.array([len(w) for w in items.words])
        key = c.row[at] * n_items + item
        # most documents have too few of an item's pairs, wherever they stand
        many = (np.bincount(key, minlength=1)[key] >= items.least[item]) & (long_[item] >= MIN_WORDS)
        at, k, key, item = at[many], k[many], key[many], item[many]
        # a window lies in two neighbouring tiles of its length
        tile = c.pos[at] // (PASSAGE + 2 * long_[item])
        tile += key * (int(tile.max(initial=0)) + 2)
        distinct = np.sort(tile * len(items.pairs) + k)
        distinct = distinct[np.diff(distinct, prepend=-1) > 0] // max(len(items.pairs), 1)
        tiles, n = np.unique(distinct, return_counts=True)
        beside = np.zeros(len(n), np.int64)
        follows = np.flatnonzero(np.diff(tiles) == 1)
        beside[follows] = n[follows + 1]
        beside[follows + 1] = np.maximum(beside[follows + 1], n[follows])
        of = np.searchsorted(tiles, tile)
        some = (n + beside)[of] >= items.least[item]
        at, k, key, item = at[some], k[some], key[some], item[some]
        turn = np.lexsort((at, key))
        at, k, key, item = at[turn], k[turn], key[turn], item[turn]
        pos, near = c.pos[at].tolist(), {}
        first, before, group = 0, None, -1
        for y, (pair, own, i) in enumerate(zip(k.tolist(), key.tolist(), item.tolist(), strict=True)):
            if own != group:
                first, near, group, least, span = y, {}, own, int(items.least[i]), PASSAGE + 2 * int(long_[i])
            near[pair] = near.get(pair, 0) + 1
            while pos[y] - pos[first] > span:
                left = int(k[first])
                near[left] -= 1
                if not near[left]:
                    del near[left]
                first += 1
            if len(near) >= least:
                start = pos[first] // HALF * HALF
                if (own, start) != before:
                    before = own, start
                    yield own // n_items, i, start


def word_places(item: np.ndarray) -> dict[int, int]:
    """The places of each word in an item as the bits of a number."""
    place: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        place[w] = place.get(w, 0) | (1 << k)
    return place


def _common(place: dict[int, int], n: int, words: list[int]) -> int:
    full = (1 << n) - 1
    v = full
    for w in words:
        if m := place.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def common_subsequence(item: np.ndarray, words: list[int]) -> int:
    """Length of the longest common subsequence, a machine word of the item at a time."""
    return _common(word_places(item), len(item), words)


def latent_space(numbered: DataFrame, items: Items, rank: int = RANK) -> Latent:
    """Document frequencies and the sketch over all passages; the small algebra on the driver.

    What reaches the driver is one vector per benchmark word, whatever the corpus.
    """
    sc = numbered.sparkSession.sparkContext
    n_words = len(items.hashes)
    counts = numbered.mapInArrow(lambda it: _frequencies(it, n_words), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df, passages = np.zeros(n_words), 1
    for w, n in counts.collect():
        if w < 0:
            passages = max(n, 1)
        else:
            df[w] = n
    # an item counts as a passage, so that no word has frequency zero
    passages += len(items.ids)
    for words in items.words:
        df[np.unique(words)] += 1
    idf = np.log(passages / np.maximum(df, 1))
    weight = np.where(df <= max(COMMON * passages, 20), idf, 0).astype(np.float32)
    size = min(rank + OVERSAMPLE, n_words)
    omega = np.random.default_rng(11).normal(size=(n_words, size)).astype(np.float32)
    shared = sc.broadcast((weight, omega))
    rows = numbered.mapInArrow(lambda it: _sketch(it, shared), "word long, v binary")
    salted = rows.withColumn("part", F.spark_partition_id() % 64)
    once = salted.groupBy("word", "part").applyInArrow(_add_up, "word long, v binary")
    y = np.zeros((n_words, size))
    for w, v in once.groupBy("word").applyInArrow(_add_up, "word long, v binary").collect():
        y[w] = np.frombuffer(v, np.float32)
    # the items themselves, as heavy as the passages together, so that the space holds each of them
    x = np.zeros((len(items.ids), n_words))
    for i, words in enumerate(items.words):
        np.add.at(x[i], words, weight[words])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    lift = max(np.linalg.norm(y) / max(np.linalg.norm(x.T @ (x @ omega)), 1e-9), 1.0)
    y += lift * (x.T @ (x @ omega))
    q, _ = np.linalg.qr(y)
    # one-pass eigenvalues: q'y = (q'A'Aq)(q'omega)
    core = np.linalg.lstsq((q.T @ omega).T, (q.T @ y).T, rcond=None)[0].T
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    basis = (q @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)
    points = (x @ basis).astype(np.float32)
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    return Latent(items, weight, basis, points)


def _leaks(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    latent = shared.value
    for b in batches:
        ids = b.column("doc_id").to_pylist()
        rows = [(ids[k], latent.items.ids[i], cos, share, start) for (k, i), (share, cos, start) in latent.leaks(Chunk.of(b)).items()]
        if rows:
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2]), pa.array(c[3]), pa.array(c[4], pa.int64())],
                ["doc_id", "item_id", "cosine", "lcs_share", "first_word"])


LEAKS = "doc_id long, item_id long, cosine double, lcs_share double, first_word long"


def fitted(docs: DataFrame, items: Items) -> tuple[DataFrame, Latent]:
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(items)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text())
    numbered = C.store(d.mapInArrow(lambda it: _numbered(it, shared), NUMBERED), "benchmark-words")
    return numbered, latent_space(numbered, items)


def leaked_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, first_word of every leak."""
    out = docs.sparkSession.createDataFrame([], LEAKS)
    for items in judged_blocks(benchmark):
        numbered, latent = fitted(docs, items)
        shared = docs.sparkSession.sparkContext.broadcast(latent)
        out = out.unionByName(numbered.mapInArrow(lambda it, s=shared: _leaks(it, s), LEAKS))
    return out


def _clean(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    latent = shared.value
    for b in batches:
        data, offsets = C.string_bytes(b.column("text"))
        good = np.ones(b.num_rows, bool)
        for i, j in C.slices(offsets, C.PASS):
            h, first = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n = latent.items.numbers(h)
            at = np.flatnonzero(n >= 0)
            row = np.searchsorted(first, at, "right") - 1
            for k, _ in latent.leaks(Chunk(row, at - first[row], n[at].astype(np.int64))):
                good[i + k] = False
        yield b.filter(pa.array(good))


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, with the same columns."""
    out = docs
    for items in judged_blocks(benchmark):
        numbered, latent = fitted(docs, items)
        C.discard(numbered)
        shared = docs.sparkSession.sparkContext.broadcast(latent)
        out = out.mapInArrow(lambda it, s=shared: _clean(it, s), docs.schema)
    return out
