"""Op 12: counts and cutoffs against brute force."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tempora.llm import quality

NAMES = quality.COUNTS


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams, covered = {}, set()
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(lines), len(re.findall("[A-Z]", text)))


def badness(n):
    words, chars, symbols, dup, rep, lines, upper = n
    return {k: min(v, 1000) for k, v in {
        "symbols": symbols * 1000 // max(chars, 1), "dup_lines": dup * 1000 // max(lines, 1), "repeat_words": rep * 1000 // max(words, 1),
        "upper": upper * 1000 // max(chars, 1), "word_length": chars * 10 // max(words, 1)}.items()}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("stratum", "rule", "value", "quality", "n_words", "cutoff")})


def text_of(r, words, junk):
    out = [r.choice(["alpha", "Beta", "gamma", "delta", "eins", "zwei", "ünï"]) + str(r.randint(0, 400)) for _ in range(words)]
    if junk:
        out = [w + "***" for w in out]
    return " ".join(w + ("\n" if r.random() < 0.1 else "") for w in out)


def test_counts(spark):
    r = random.Random(5)
    texts = [None, "", " ", "\n", "\n\n", "a", "a\n", "\na", "a\na\n a\n", "a b c a b c", "a b c d a b c", "x x x x", "A#b*$ %&|<>\n<>", "ä ö ü ß x", "same line\nsame line\nother\nsame line ",
             "w " * 60_000, "\n".join(f"line {i % 7} of some {i % 5}" for i in range(900))]
    texts += ["".join(r.choice("ab \n\t#É") for _ in range(r.randint(0, 120))) for _ in range(300)]
    got = {x.doc_id: tuple(x[c] for c in NAMES) for x in quality.measured(table(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_binomial_tail():
    for n, p in ((1, 0.3), (10, 0.01), (200, 0.05), (3000, 0.01)):
        total = 0.0
        for k in range(min(n, 80)):
            total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            assert quality.binomial_tail(k, n, p) == pytest.approx(min(total, 1.0), rel=1e-8)
    assert quality.allowed(100, 0.01, 0.05) == -1 and quality.allowed(300, 0.01, 0.05) == 0
    assert quality.binomial_tail(9_900_000, 10**9, 0.01) < 1e-20 < 0.4 < quality.binomial_tail(10_000_000, 10**9, 0.01) < 0.6


def brute_cutoffs(rows, labels, risk, delta):
    marks = {}
    for i, q in labels:
        if i is not None and q is not None:
            marks[i] = min(marks.get(i, q), q)
    held = {}
    for i, t, lang in rows:
        n = brute(t)
        if i in marks and not (n[0] < 50 or 100 * n[4] > 50 * n[0]):
            held.setdefault(lang or "", []).append((badness(n), marks[i]))
    held = {s: v for s, v in held.items() if any(q for _, q in v)}
    out = {}
    for s, v in held.items():
        good, bad = [b for b, q in v if q], [b for b, q in v if not q]
        for rule in quality.RULES:
            best = None
            for cut in {b[rule] for b, _ in v}:
                g, d = sum(b[rule] > cut for b in good), sum(b[rule] > cut for b in bad)
                tail = sum(math.comb(len(good), k) * (risk / 5) ** k * (1 - risk / 5) ** (len(good) - k) for k in range(g + 1))
                gain = (d / len(bad) if bad else 0) - g / len(good)
                if tail <= delta / 5 / len(held) and gain > 0 and (best is None or (gain, cut) > best):
                    best = (gain, cut)
            if best:
                out[s, rule] = best[1]
    return out


def test_cutoffs_and_verdicts(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        lang = ["en", "en", "de", None, "xx"][i % 5] if i > 30 else "rare"
        bad = r.random() < 0.2
        rows.append((i, text_of(r, r.randint(20, 120), bad and r.random() < 0.8), lang))
        labels.append((i, int(not bad)))
    rows += [(None, text_of(r, 90, True), "en"), (None, None, None), (3, text_of(r, 90, True), "en"), (5000, "", "en")] + rows[40:60]
    labels += [(None, 1), (17, 0), (17, 1), (18, None), (9999, 1)]
    lab = spark.createDataFrame([(i, q, "x") for i, q in labels], "doc_id long, quality long, stratum string")
    for risk, delta in ((0.3, 0.1), (0.05, 0.05)):
        want = brute_cutoffs(rows, labels, risk, delta)
        assert bool(want) == (risk > 0.2)
        m = quality.measured(table(spark, rows))
        got = {(x.stratum, x.rule): x.cutoff for x in quality.cutoffs(m, lab, risk, delta).collect()}
        assert got == want
        verdicts = sorted((tuple(x) for x in quality.quality_rules(table(spark, rows), lab, risk=risk, delta=delta).select("doc_id", "base_failed", "kept", "rule").collect()), key=str)
        expected = []
        for i, t, lang in rows:
            n = brute(t)
            base = n[0] < 50 or 100 * n[4] > 50 * n[0]
            rule = next((k for k in quality.RULES if badness(n)[k] > want.get((lang or "", k), 1000)), None)
            expected.append((i, base, not base and rule is None, rule))
        assert verdicts == sorted(expected, key=str)


def test_no_documents(spark):
    lab = spark.createDataFrame([], "doc_id long, quality long")
    assert quality.quality_rules(table(spark, []), lab).collect() == []
    assert quality.quality_rules(table(spark, [(1, "w " * 10, "en")]), lab).collect()[0].base_failed
