"""Quality rules with risk-controlled cutoffs.

Every document gets counts over its whole text and, from them, one badness between 0 and 1000
per rule (:data:`RULES`). Cutoffs are learned per stratum from labelled documents that pass the
base filter: a rule may reject a value above ``t`` only if the exact binomial test on the good
holdouts shows that less than its share of ``risk`` of the good documents lie above ``t``. The
cutoffs of a rule are tested from the most lenient one on and the first failure ends the
sequence, which needs no correction; rules and strata are corrected by Bonferroni. So with
probability ``1 - delta`` no stratum loses more than ``risk`` of its good documents. Among the
cutoffs that passed, the one that parts bad from good best is taken (largest difference of the
rejected shares, then the more lenient one).

Null and empty texts have no words and fail the base filter. A null stratum is one with the
empty string. Strata with too few labels get no cutoffs and lose nothing beyond the base filter.
A document with several labels is good only if all say so; each row of a repeated ``doc_id``
counts and is judged on its own text. Very long texts are one pass of the arithmetic each. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm import common as C

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
#: Share of good documents a stratum may lose, and the probability that any stratum loses more.
RISK, DELTA = 0.05, 0.05
MIN_WORDS, MAX_REPEATED = 50, 50
TOP = 1000


def _per_mille(part: str, of: str) -> Column:
    return F.least(F.expr(f"{part} * {TOP} div greatest({of}, 1)"), F.lit(TOP))


def rules() -> dict[str, Column]:
    """Badness of a document by each rule; whole numbers from 0 to 1000."""
    return {
        "symbols": _per_mille("n_symbols", "word_chars"),
        "dup_lines": _per_mille("n_dup_lines", "n_lines"),
        "repeat_words": _per_mille("n_repeat_words", "n_words"),
        "upper": _per_mille("n_upper", "word_chars"),
        "word_length": F.least(F.expr("word_chars * 10 div greatest(n_words, 1)"), F.lit(TOP)),
    }


RULES = ("symbols", "dup_lines", "repeat_words", "upper", "word_length")


def _ids(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number per value of the byte strings that lie end to end in ``data``; equal bytes, equal number."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    values = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return values.dictionary_encode().indices.to_numpy().astype(np.int64)


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def _lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal to an earlier one, of every text."""
    cuts = np.flatnonzero(data == 0x0A)
    ends, newline = np.concatenate([offsets[1:], cuts]), np.repeat([0, 1], [len(offsets) - 1, len(cuts)])
    order = np.lexsort((newline, ends))  # a text that ends where a newline begins ends before it
    ends, newline = ends[order], newline[order]
    starts = np.concatenate([[0], ends[:-1] + newline[:-1]])
    text = np.concatenate([[0], np.cumsum(1 - newline)[:-1]])
    full = np.searchsorted(word_starts, starts) < np.searchsorted(word_starts, ends)
    of = text[full]
    line = _ids(data[data != 0x0A], ends - starts)[full]
    n = np.bincount(of, minlength=len(offsets) - 1)
    distinct = np.unique(of * (line.max(initial=0) + 1) + line)
    return n, n - np.bincount(distinct // (line.max(initial=0) + 1), minlength=len(offsets) - 1)


def _repeated(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of every text that lie in a 3-word window found twice or more in it."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[2:] == text[:-2])
    kinds = word.max(initial=0) + 1
    pair = pd.factorize(word[at] * kinds + word[at + 1])[0]
    triple = pd.factorize(pair * kinds + word[at + 2])[0]
    own = pd.factorize(text[at] * (triple.max(initial=0) + 1) + triple)[0]
    at = at[np.bincount(own)[own] > 1] if len(own) else at
    covered = np.zeros(len(word), bool)
    for k in range(3):
        covered[at + k] = True
    return _sums(covered, first)


def counted(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """:data:`COUNTS` of every text; ``offsets`` start at 0."""
    starts, ends, first = C.words(data, offsets)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    n_lines, n_dup = _lines(data, offsets, starts)
    return {
        "n_words": np.diff(first), "word_chars": _sums(points[ends] - points[starts], first),
        "n_symbols": _sums(SYMBOLS[data], offsets), "n_dup_lines": n_dup,
        "n_repeat_words": _repeated(_ids(data[~C.WHITESPACE[data]], ends - starts), first),
        "n_lines": n_lines, "n_upper": _sums((data >= 65) & (data <= 90), offsets)}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = C.string_bytes(b.column("text"))
        for i, j in C.slices(offsets, C.PASS):
            n = counted(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(i, j - i), b.column("stratum").slice(i, j - i), *(pa.array(n[c].astype(np.int64)) for c in COUNTS)],
                ["doc_id", "stratum", *COUNTS])


def measured(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and :data:`COUNTS` of every row."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), C.text())
    return d.mapInArrow(_measure, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h, m = d, 0
    while True:
        m += 1
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-13:
            return h


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most ``k`` of ``n``) at probability ``p``: the incomplete beta function of 1 - p at (n - k, k + 1)."""
    if k >= n:
        return 1.0
    a, b, x = float(n - k), float(k + 1), 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def allowed(n: int, risk: float, delta: float) -> int:
    """Most of ``n`` good holdouts that may be rejected so that the risk is under ``risk`` at level ``delta``; -1: none proves it."""
    low, high = -1, n  # the tail grows with k
    while high - low > 1:
        k = (low + high) // 2
        low, high = (k, high) if binomial_tail(k, n, risk) <= delta else (low, k)
    return low


def _allowances(frames: Iterator[pd.DataFrame], risk: float, delta: float) -> Iterator[pd.DataFrame]:
    for f in frames:
        rules_risk, level = risk / len(RULES), delta / len(RULES)
        f["allowed"] = [allowed(int(n), rules_risk, level / s) for n, s in zip(f["n_good"], f["strata"], strict=True)]
        yield f[["stratum", "n_good", "n_bad", "allowed"]]


def cutoffs(measures: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff, n_good, n_bad, allowed, good_rejected, bad_rejected: the rules that got a cutoff.

    Labelled rows are reduced to counts per (stratum, rule, value), at most 1001 of a rule, before
    anything is ordered.
    """
    quality = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(F.col("quality").cast("int")).alias("quality"))
    held = measures.filter(~base_failed()).join(quality, "doc_id")
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), c.cast("int").alias("value")) for r, c in rules().items()]))
    per_value = held.select("stratum", "quality", pairs.alias("x")).groupBy("stratum", "x.rule", "x.value").agg(
        F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("bad"))
    per_value = C.store(per_value, "holdouts")
    n = per_value.filter(F.col("rule") == RULES[0]).groupBy("stratum").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
    n = n.filter("n_good > 0")
    sized = n.withColumn("strata", F.lit(n.count()))
    limits = sized.mapInPandas(lambda it: _allowances(it, risk, delta), "stratum string, n_good long, n_bad long, allowed long")
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    tested = per_value.withColumns({f"{x}_rejected": F.coalesce(F.sum(x).over(above), F.lit(0)) for x in ("good", "bad")}).join(limits, "stratum")
    gain = F.coalesce(F.try_divide("bad_rejected", "n_bad"), F.lit(0.0)) - F.col("good_rejected") / F.col("n_good")
    return tested.filter((F.col("good_rejected") <= F.col("allowed")) & (gain > 0)).groupBy("stratum", "rule").agg(
        F.max_by(F.struct(F.col("value").alias("cutoff"), "n_good", "n_bad", "allowed", "good_rejected", "bad_rejected"),
                 F.struct(gain, "value")).alias("x")).select("stratum", "rule", "x.*")


def judged(measures: DataFrame, cuts: DataFrame) -> DataFrame:
    """``measures`` with base_failed, the rejecting ``rule`` (first in order of :data:`RULES`, else null) and kept.

    ``cuts`` has one row per stratum and rule; Spark broadcasts it where its stored size allows.
    """
    wide = C.store(cuts.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES]), "cutoffs")
    joined = measures.join(wide, "stratum", "left")
    hit = F.coalesce(*[F.when(c > F.col(f"cut_{r}"), F.lit(r)) for r, c in rules().items()])
    return joined.withColumns({"base_failed": base_failed(), "rule": hit}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()).drop(*[f"cut_{r}" for r in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, stratum, the counts, base_failed, rule and kept of every row of ``docs``."""
    m = C.store(measured(docs, stratum), "measures")
    return judged(m, cutoffs(m, labels, risk, delta))

