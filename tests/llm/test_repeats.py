"""Ops 1, 5 and 6 against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import common, lines, repeats, substrings
from tests.llm import brute

SF = "/root/testdata/sf0.001/documents.parquet"
SCHEMA = "doc_id long, text string"


def table(spark, rows):
    """Documents with columns that bear the operators' own names."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("block", "bucket", "text_id", "keep", "hash", "pos", "keys", "n_bytes")})


def by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def planted():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage, line = text(300), text(40), "  " + text(4) + " \t"
    rows = []
    for i in range(40):
        kind = i % 5
        if kind == 0:  # near copies
            w = base.split()
            for _ in range(4):
                w[r.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind == 1:
            t = text(60) + "\n" + passage + "\n" + text(30)
        elif kind == 2:
            t = "\n".join([line.upper() if i % 2 else line, text(20), "", line])
        elif kind == 3:
            t = ("ab" * r.randint(20, 60)) + " " + "xyz " * r.randint(1, 40)  # periodic
        else:
            t = base if i % 10 == 4 else text(r.randint(0, 5))
        rows.append((i * 7 % 101, t))
    return rows + [(500, None), (501, ""), (502, " \n\t "), (503, text(8000)), (504, "\n"), (505, base)]


def test_bytes_against_brute_force(spark):
    rows = planted()
    assert by_id(repeats.repeated_bytes(table(spark, rows))) == brute.repeated_bytes(rows)


def test_words_against_brute_force(spark):
    rows = planted()
    assert by_id(substrings.repeated_words(table(spark, rows))) == brute.repeated_words(rows)


def test_lines_against_brute_force(spark):
    rows = planted() + [(600 + i, f"same Line\nown {i}\n SAME line") for i in range(12)]
    assert by_id(lines.line_digests(table(spark, rows))) == brute.lines(rows)


def test_generated_documents(spark):
    df = spark.read.parquet(SF)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert by_id(repeats.repeated_bytes(df)) == brute.repeated_bytes(rows)
    assert by_id(substrings.repeated_words(df)) == brute.repeated_words(rows)


def test_null_ids_and_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = table(spark, [(None, t), (3, t), (3, t), (4, t + " more")])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in repeats.repeated_bytes(df).collect())
    assert got == [(False, 3, len(t)), (False, 3, len(t)), (False, 4, len(t)), (True, 0, 0)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substrings.repeated_words(df).collect())
    assert got == [(False, 3, 30), (False, 3, 30), (False, 4, 30), (True, 0, 0)]
    assert lines.line_digests(df).count() == 4


@pytest.mark.parametrize("f", [repeats.repeated_bytes, substrings.repeated_words, lines.line_digests, lines.drop_repeated_lines])
def test_empty_table(spark, f):
    assert f(table(spark, [])).count() == 0


def test_first_occurrence_stays(spark):
    rows = [(i, f"head\nown {i}") for i in range(12)]
    df = lines.keep_bitmaps(table(spark, rows), min_docs=3, keep_first=True)
    assert {r.doc_id for r in df.collect()} == set(range(1, 12))


def test_hot_line_over_partitions(spark):
    """Every document has one line; its run crosses partition edges and is still counted whole."""
    rows = [(i, f"common\nline {i % 400}") for i in range(4000)]
    out = lines.line_digests(table(spark, rows), min_docs=3000).collect()
    assert {r.n_dropped for r in out} == {1}
    out = lines.line_digests(table(spark, rows), min_docs=4001).collect()
    assert {r.n_dropped for r in out} == {0}


def test_dropping_lines_keeps_columns(spark):
    rows = [(i, f"common\nline {i}") for i in range(10)] + [(50, None), (51, "")]
    df = table(spark, rows)
    out = lines.drop_repeated_lines(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {**{i: f"line {i}" for i in range(10)}, 50: None, 51: ""}


def thue_morse(n, a="a", b="b"):
    x = a
    while len(x) < n:
        x += x.translate(str.maketrans({a: b, b: a}))
    return x, x.translate(str.maketrans({a: b, b: a}))


def test_long_lines_and_words_that_polynomials_confuse(spark):
    """A long Thue-Morse string and its complement have one polynomial hash mod 2**64 whatever the multiplier."""
    one, two = thue_morse(4096)
    rows = [(i, f"{(one, two)[i % 2]}\nown {i}") for i in range(12)]
    assert by_id(lines.line_digests(table(spark, rows))) == brute.lines(rows)
    assert {r.n_dropped for r in lines.line_digests(table(spark, rows)).collect()} == {0}
    assert {r.text for r in lines.drop_repeated_lines(table(spark, rows)).collect()} == {t for _, t in rows}
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, f"{two} {tail} x")]
    assert by_id(substrings.repeated_words(table(spark, rows))) == brute.repeated_words(rows)


def test_columns_of_any_name_pass_the_line_stage(spark):
    rows = [(i, f"common\nline {i}") for i in range(10)]
    df = table(spark, rows).withColumns({c: F.lit(1) for c in ("__keep", "__id", "__tid", "line_keep", "LINE_ID", "line_text", "hash", "more")})
    out = lines.drop_repeated_lines(df)
    assert out.columns == df.columns and {r.text for r in out.collect()} == {f"line {i}" for i in range(10)}


def test_maximal_repeats(spark):
    r = random.Random(3)
    letters = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    x, y = letters(70), letters(55)
    rows = [(1, letters(40) + x + letters(30)), (2, x + letters(20)), (3, letters(9) + x + y + letters(9)), (4, y), (5, None)]
    got = {}
    for g in repeats.maximal_repeats(table(spark, rows)).collect():
        got.setdefault((g.repeat, g.n_bytes), set()).add((g.doc_id, g.start))
    text = dict(rows)
    places = {frozenset(v) for v in got.values()}
    assert frozenset((i, text[i].find(x)) for i in (1, 2, 3)) in places
    assert frozenset((i, text[i].find(y)) for i in (3, 4)) in places
    for (_, n), at in got.items():
        assert len({text[i][s : s + n] for i, s in at}) == 1 and len(at) > 1


def test_interval_tree_is_every_maximal_repeat():
    import numpy as np

    r = random.Random(1)
    texts = ["".join(r.choice("ab") for _ in range(30)) for _ in range(4)]
    raw = "".join(texts).encode()
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = {(n, tuple(m)) for n, m in repeats.interval_tree(raw, bounds, np.arange(len(raw)), 4)}
    want, place = set(), [(t, o, b) for t, b in zip(texts, bounds) for o in range(len(t))]
    for n in range(4, 31):
        occ = {}
        for t, o, b in place:
            if o + n <= len(t):
                occ.setdefault(t[o : o + n], []).append((t, o, int(b)))
        for at in occ.values():
            left = {t[o - 1] if o else None for t, o, _ in at}
            right = {t[o + n] if o + n < len(t) else None for t, o, _ in at}
            if len(at) > 1 and (len(left) > 1 or None in left) and (len(right) > 1 or None in right):
                want.add((n, tuple(sorted(b + o for _, o, b in at))))
    assert got == want


def test_contexts_that_agree_in_32_bits():
    """300,000 surroundings of one anchor have as many digests."""
    r = np.random.default_rng(3)
    grams = r.integers(97, 123, 24 * 20000).astype(np.uint8)
    at = np.arange(20000) * 24
    best = at[np.argmin(common.Spans(grams)(at, at + 24))]
    texts = r.integers(97, 123, (300_000, 76)).astype(np.uint8)
    texts[:, 26:50] = grams[best : best + 24]
    digests = []
    for i in range(0, len(texts), 10_000):
        key, context, *_ = repeats._anchors(texts[i : i + 10_000].ravel(), np.arange(10_001) * 76, 0, 50)
        digests.append(np.stack([key, context], 1))
    digests = np.concatenate(digests)
    top = np.unique(digests[:, 0], return_counts=True)
    own = digests[digests[:, 0] == top[0][top[1].argmax()], 1]
    assert len(own) > 250_000 and len(np.unique(own)) == len(own)
