"""Toxicity by subword-bag embeddings and a linear softmax, trained in numpy.

A document's vector is the mean embedding of its words and of their character n-grams (4 to 6
bytes, word boundaries included), so an unseen spelling shares most of its vectors with known
ones. Embeddings and softmax weights are fitted jointly by full-batch Adam on a bounded sample
of the labelled rows: at most ``SAMPLE_ROWS`` rows of each label, the first in hash order,
leaving out texts over ``SAMPLE_TEXT`` bytes. The log odds are shifted from the sample's
balance to the share of label 1 among all learnable labels. Scoring needs one number per
bucket (embedding times weights) and reads every text whole in one scan without a shuffle.

Null and empty texts score the prior alone. Labels that are null are not learned from; without
any learnable row of both labels every score is 0. Rows that repeat an id are scored one by one;
of an id's texts the smallest is learned, once per different label that the id has. Very long
texts are scored whole, one at a time. Extra columns are ignored, and pass through the stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm import common as C

BITS, DIM, SCALE = 18, 16, 200.0
SAMPLE_ROWS, SAMPLE_TEXT, MIN_TEXTS = 2500, 8_000, 5
GRAMS = (4, 5, 6)
#: Neutral features added to each text, so that a few words alone do not decide.
SMOOTH = 400
THRESHOLD = 0.3
#: Lower-cased letters and digits and all bytes beyond ASCII; everything else separates words.
FOLD = np.full(256, 0x20, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        FOLD[_c] = _c + 32 if 65 <= _c <= 90 else _c


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, place) of the words, then of the n-grams of each length, of all texts."""
    # one separator before every text and two at the end, so that no gram crosses texts
    n = len(offsets) - 1
    flat = np.full(len(data) + n + max(GRAMS), 0x20, np.uint8)
    row = np.repeat(np.arange(n), np.diff(offsets))
    flat[np.arange(len(data)) + row + 1] = FOLD[data]
    starts, ends, first = C.words(flat, np.append(places(offsets), len(flat)))
    word = C.Spans(flat)(starts, ends)
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] == word[:-1]
    again[first[:-1][first[:-1] < len(word)]] = False
    if again.any():  # a word said twice running counts once
        gone = np.zeros(len(flat) + 1, np.int8)
        gone[starts[again]] += 1
        gone[ends[again]] -= 1
        flat[np.cumsum(gone[:-1], dtype=np.int8) > 0] = 0x20
        starts, word = starts[~again], word[~again]
    yield (word >> np.uint64(64 - BITS)).astype(np.int64), starts
    space = flat == 0x20
    size = len(flat) - max(GRAMS) + 1
    value = flat[:size].astype(np.uint64)
    inner = np.zeros(size, bool)  # a separator strictly inside
    for k in range(1, max(GRAMS)):
        if k >= 2:
            inner |= space[k - 1 : k - 1 + size]
        value |= flat[k : k + size].astype(np.uint64) << np.uint64(8 * k)
        if k + 1 in GRAMS:
            at = np.flatnonzero(~inner)
            yield _bucket(value[at] + (np.uint64(k + 1) << np.uint64(56))), at


def _bucket(v: np.ndarray) -> np.ndarray:
    return (C.mix(v) >> np.uint64(64 - BITS)).astype(np.int64)


def places(offsets: np.ndarray) -> np.ndarray:
    """Where each text begins in the separated sequence of :func:`features`."""
    return offsets + np.arange(len(offsets))


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and weights (share of the text's features) of a few texts."""
    out = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        got = np.concatenate([b for b, _ in features(raw, np.array([0, len(raw)]))])
        b, n = np.unique(got, return_counts=True)
        out.append((b.astype(np.int32), (n * (SCALE / (len(got) + SMOOTH))).astype(np.float32)))
    return out


def fit(texts: list[str], labels: np.ndarray, steps: int = 60, rate: float = 0.05, decay: float = 1e-4, seed: int = 7):
    """Softmax weights and embeddings fitted jointly; returns (number per bucket, intercept).

    Forward and backward passes go through ``embedding @ (w1 - w0)``, one number per bucket, so
    a step costs two passes over the non-zero entries.
    """
    bagged = bags(texts)
    y = labels.astype(np.float32)
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    # buckets of a few texts only could do nothing but learn these texts by heart
    held = np.zeros(1 << BITS, np.int32)
    for c, _ in bagged:
        held[c] += 1
    used = np.flatnonzero(held >= min(MIN_TEXTS, len(texts)))
    if not len(used):
        return np.zeros(1 << BITS, np.float32), 0.0
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    for i, (c, v) in enumerate(bagged):
        k = place[c]
        bagged[i] = (k[k >= 0], v[k >= 0])
    rows = np.repeat(np.arange(len(bagged), dtype=np.int32), [len(c) for c, _ in bagged])
    cols, weights = np.concatenate([c for c, _ in bagged]), np.concatenate([v for _, v in bagged])
    del bagged
    turn = np.argsort(cols, kind="stable")
    cols_at = np.searchsorted(cols, np.arange(len(used)), sorter=turn)
    rows_turned, weights_turned = rows[turn], weights[turn]
    del turn
    rows_at = np.flatnonzero(np.diff(rows, prepend=-1))
    some = rows[rows_at]
    del rows
    part = e[used]
    del e
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (part, w, b)]
    n = len(texts)
    for t in range(1, steps + 1):
        s = part @ (w[:, 1] - w[:, 0])
        z = np.full(n, b[1] - b[0])
        z[some] += np.add.reduceat(s[cols] * weights, rows_at)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        err = ((p - y) / n).astype(np.float32)
        back = np.add.reduceat(err[rows_turned] * weights_turned, cols_at)
        gw = part.T @ back
        grads = (np.outer(back, w[:, 1] - w[:, 0]) + decay * part, np.stack([-gw, gw], 1), np.array([-err.sum(), err.sum()]))
        for x, g, (m, v) in zip((part, w, b), grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    table = np.zeros(1 << BITS, np.float32)
    table[used] = part @ (w[:, 1] - w[:, 0])
    return table, float(b[1] - b[0])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    known = labels.filter(~held_out() & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") == 1).alias("toxic")).distinct()
    n, ones = known.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    if not n or not ones or ones == n:
        return None
    sample = None
    for value in (True, False):
        # SAMPLE_ROWS rows at most, so this side may be broadcast
        one = known.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
        sample = one if sample is None else sample.unionByName(one)
    texts = docs.select("doc_id", C.text()).filter(F.octet_length("text") <= SAMPLE_TEXT)
    # one text per id and label, so that rows that repeat an id do not raise the bound
    one_each = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = sorted((r.doc_id, r.text, r.toxic) for r in one_each.collect())
    y = np.array([r[2] for r in got], bool)
    if not len(got) or y.all() or not y.any():
        return None
    table, intercept = fit([r[1] for r in got], y)
    share, sampled = ones / n, y.mean()
    return table, intercept + float(np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)))


def log_odds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean of the buckets' numbers over each text's features, scaled as in training."""
    at = places(offsets)
    total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for bucket, place in features(data, offsets):
        cut = np.searchsorted(place, at)
        sums = np.concatenate([[0.0], np.cumsum(table[bucket], dtype=np.float64)])
        total += np.diff(sums[cut])
        count += np.diff(cut)
    return total * SCALE / (count + SMOOTH)


def _scores(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = C.string_bytes(b.column("text"))
        score = np.zeros(b.num_rows)
        if shared is not None:
            table, intercept = shared.value
            for i, j in C.slices(offsets, C.PASS):
                z = log_odds(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table) + intercept
                score[i:j] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        keep = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(score)], [*keep, "score"])


def scored(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model) if model is not None else None  # 1 MB whatever the input
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text())
    out = d.mapInArrow(lambda it: _scores(it, shared), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, train(docs, labels))


def _clean(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = C.string_bytes(b.column("text"))
        table, intercept = shared.value
        good = np.ones(b.num_rows, bool)
        for i, j in C.slices(offsets, C.PASS):
            z = log_odds(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table) + intercept
            good[i:j] = 1 / (1 + np.exp(-np.clip(z, -500, 500))) < THRESHOLD
        yield b.filter(pa.array(good))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with the same columns."""
    model = train(docs, labels)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda it: _clean(it, shared), docs.schema)
