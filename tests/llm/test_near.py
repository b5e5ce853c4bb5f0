"""Op 2, its links and the near-duplicate stage."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import simhash
from tempora.llm.components import components
from tests.llm import brute


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("fp", "key", "a", "b", "node", "component", "same", "first")})


def test_golay_neighbours():
    """Two words within two bits always share a codeword, and every word has one or six."""
    r = np.random.default_rng(0)
    v = r.integers(0, 1 << 23, 20000)
    row, index = simhash.codewords(v)
    assert set(np.bincount(row)) == {1, 6}
    sets = {}
    for k, i in zip(row.tolist(), index.tolist()):
        sets.setdefault(k, set()).add(i)
    w = v.copy()
    for _ in range(2):
        w ^= np.where(r.random(len(v)) < 0.8, 1 << r.integers(0, 23, len(v)), 0)
    row, index = simhash.codewords(w)
    other = {}
    for k, i in zip(row.tolist(), index.tolist()):
        other.setdefault(k, set()).add(i)
    assert all(sets[k] & other[k] for k in range(len(v)))


def test_links_are_all_pairs_within_two_bits(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = set(base) | {0, (1 << 64) - 1}
    for b in base:
        for _ in range(12):
            x = b
            for bit in r.sample(range(64), r.randint(1, 3)):
                x ^= 1 << bit
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {tuple(sorted(p)) for p in simhash.links(df).collect()}
    want = {tuple(sorted((signed(x), signed(y)))) for x in fps for y in fps if x < y and (x ^ y).bit_count() <= 2}
    assert got == want


@pytest.mark.parametrize("links,want", [
    ([(i, i + 1) for i in range(60)], {i: 0 for i in range(61)}),  # a chain
    ([(500, i) for i in range(400)], {i: 0 for i in [*range(400), 500]}),  # a hub
    ([(1, 2), (4, 3), (3, 5), (2, 2)], {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}),
    ([], {}),
])
def test_components(spark, links, want):
    assert dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect())) == want


def test_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "One  two"), (905, "one two"), (906, "É two THREE four"), (907, "x " * 5000)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(table(spark, rows)).collect()}
    assert got == brute.simhash_components(rows)
    assert got[900] == got[902] == ("0" * 16, 900)


def test_null_ids_repeated_rows_and_empty(spark):
    out = simhash.simhash_components(table(spark, [(None, "a b c"), (5, "a b c"), (5, "a b c"), (6, "q r s t")])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in out if r.doc_id != 6) == [(False, None), (False, None), (True, None)]
    assert [r.component_id for r in out if r.doc_id == 6] == [6]
    assert simhash.simhash_components(table(spark, [])).count() == 0


def near_rows():
    r = random.Random(9)
    word = lambda: "".join(r.choice("bcdfgaeiou") for _ in range(r.randint(2, 8)))
    rows, groups = [], []
    for g in range(40):
        base = [word() for _ in range(r.randint(60, 200))]
        ids = []
        for k in range(r.randint(1, 4)):
            w = list(base)
            for _ in range(0 if k == 0 else max(1, len(w) // 60)):
                w[r.randrange(len(w))] = word()
            ids.append(g * 10 + k)
            rows.append((ids[-1], " ".join(w)))
        groups.append(ids)
    r.shuffle(rows)
    return rows, groups


def test_near_duplicates_against_all_pairs(spark):
    rows, groups = near_rows()
    rows += [(1000, rows[0][1]), (1001, None), (1002, ""), (1003, "two words"), (1004, "two words")]
    sets = {i: brute.shingles(t) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            same = dict(rows)[a] == dict(rows)[b] or not sets[a] | sets[b]
            if a < b and (same or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    df = table(spark, rows)
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {i for i in parent if root(i) == i}


def kept_by_all_pairs(rows, least=0.8):
    """rows: (doc_id or None, text). What stays, as (doc_id, text), by comparing all pairs of texts."""
    texts = sorted({t or "" for _, t in rows})
    sets = [brute.shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                group = [group[i] if g == group[j] else g for g in group]
    order = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())
    best = {}
    for r in rows:
        g = group[texts.index(r[1] or "")]
        best[g] = min(best.get(g, r), r, key=order)
    return {(r[0], r[1] or "") for r in best.values()}


def test_every_kind_of_pair_from_080_on(spark):
    """Appended, truncated, shifted and scattered edits of texts of 8 to 300 words, at 0.75 to 0.97; none is missed or made up."""
    r = random.Random(77)
    word = lambda: "".join(r.choice("bcdfgaeiou") for _ in range(r.randint(3, 8)))
    common = [word() for _ in range(120)]  # a passage that many texts begin with
    rows = []
    for k in range(220):
        n = r.choice([8, 9, 12, 20, 40, 100, 100, 300])
        base = [word() for _ in range(n)]
        if k % 3 == 0:
            base = common[: r.randint(5, 120)] + base
        n, share = len(base), r.uniform(0.02, 0.25)
        m = max(1, round(n * share))
        kind = r.choice(["append", "prepend", "cut", "scatter", "both"])
        other = {"append": base + [word() for _ in range(m)], "prepend": [word() for _ in range(m)] + base, "cut": base[:-m] or base,
                 "both": base[m // 2 :] + [word() for _ in range(m // 2)]}.get(kind, list(base))
        if kind == "scatter":
            for _ in range(max(1, m // 5)):
                other[r.randrange(len(other))] = word()
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other).upper() if r.random() < 0.2 else " ".join(other))]
    r.shuffle(rows)
    want = kept_by_all_pairs(rows)
    assert 40 < len(rows) - len(want) < 400
    got = {(x.doc_id, x.text) for x in simhash.drop_near_duplicates(table(spark, rows)).collect()}
    assert got == want


def test_null_and_repeated_ids_are_searched(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("bcdfgaeiou") for _ in range(6))
    rows = []
    for k in range(60):
        base = [word() for _ in range(80)]
        i = None if k < 20 else 7 if k < 40 else k
        rows += [(i, " ".join(base)), (i if k < 40 else k + 100, " ".join(base + [word()] * 4))]
    rows += rows[:5] + [(None, None), (7, ""), (None, " ")]
    df = table(spark, rows).withColumns({c: F.lit(1) for c in ("__gone", "__same", "gone_id", "GONE_TEXT", "component", "head")})
    got = simhash.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert {(x.doc_id, x.text or "") for x in got.collect()} == kept_by_all_pairs(rows)


def test_hot_shingle_of_unlike_texts(spark):
    """Texts that are mostly one passage share frequent shingles only; their links do not hang on one head."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("bcdfgaeiou") for _ in range(6))
    passage = [word() for _ in range(40)]
    rows = []
    for k in range(120):
        tail = [word() for _ in range(30)]
        rows += [(10 * k, " ".join(passage + tail)), (10 * k + 1, " ".join(passage + tail[:-1]))]
    got = {(x.doc_id, x.text) for x in simhash.drop_near_duplicates(table(spark, rows)).collect()}
    assert got == kept_by_all_pairs(rows) and len(got) == 120


def test_large_group_of_copies(spark):
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(i, text if i % 2 else f"{text} end{i}") for i in range(3000)]
    assert {r.doc_id for r in simhash.drop_near_duplicates(table(spark, rows)).collect()} == {0}


def test_near_duplicates_of_nothing(spark):
    assert simhash.drop_near_duplicates(table(spark, [])).count() == 0
    out = simhash.drop_near_duplicates(table(spark, [(None, "a b c"), (None, "a b c"), (4, "a b c")])).collect()
    assert [r.doc_id for r in out] == [None, None]  # rows of one id and text stay or go together
