"""Ops 3, 8 and 10: native sharding and fingerprints, URL verdicts."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tempora.llm import fingerprints, sharding, urls
from tests.llm import brute


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("h", "n", "bucket", "depth", "prefix", "part", "f", "e", "guest", "bytes")})


def shard_rows(spark, rows, limit, key="doc_id"):
    return sharding.shards(table(spark, rows), limit, key).collect()


def test_shards_hold_their_limit_and_are_as_large_as_they_can(spark):
    r = random.Random(4)
    rows = [(i, "x" * r.randint(0, 900)) for i in range(700)] + [(800, None), (801, "y" * 9000)]
    got = shard_rows(spark, rows, 5000)
    assert len(got) == len(rows)
    size, n = {}, {}
    for x in got:
        size[x.shard] = size.get(x.shard, 0) + x.n_bytes
        n[x.shard] = n.get(x.shard, 0) + 1
    for x in got:
        assert (x.shard_bytes, x.shard_rows) == (size[x.shard], n[x.shard])
        assert x.oversized == (size[x.shard] > 5000) and (not x.oversized or n[x.shard] == 1)
        bits = bin(int(hashlib.md5(str(x.doc_id).encode()).hexdigest()[:15], 16))[2:].zfill(60)
        assert bits.startswith(x.shard) and x.depth == len(x.shard)
    for s in size:  # a shard exists because its parent was over the limit
        if s:
            assert sum(v for k, v in size.items() if k.startswith(s[:-1])) > 5000


def test_hot_key_is_parted(spark):
    rows = [(1, f"text {i:04d}") for i in range(900)] + [(i, "small") for i in range(2, 300)] + [(7777, "same")] * 800 + [(None, "n" * 50)] * 30
    got = shard_rows(spark, rows, 1000)
    assert len(got) == len(rows)
    assert max(x.shard_bytes for x in got) <= 1000


def test_directory_covers_every_slot_once(spark):
    rows = [(i, "x" * 40) for i in range(500)]
    d = sharding.directory(sharding.shards(table(spark, rows), 600)).collect()
    slots = sorted(x.slot for x in d)
    assert len(slots) == len(set(slots)) <= 1 << (len(slots) - 1).bit_length()


def test_no_shards_of_nothing(spark):
    assert shard_rows(spark, [], 100) == []
    assert [(x.shard, x.depth) for x in shard_rows(spark, [(3, "a")], 100)] == [("", 0)]


def test_fingerprints(spark):
    r = random.Random(6)
    text = lambda n: " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7))) for _ in range(n))
    rows = [(r.randrange(10**6) * 2, text(r.choice([3, 40, 300, 900]))) for _ in range(150)]
    rows += [(1, None), (3, ""), (5, " \n"), (7, "é"), (9, rows[0][1]), (11, "word " * 4000)]
    rows = list(dict(rows).items())
    got = {x.doc_id: x for x in fingerprints.document_fingerprints(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    order = sorted((i, t or "") for i, t in rows)
    error = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert len(x.fingerprint) == len(x.edited_fingerprint) == 2 * fingerprints.BINS
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        for near, other in ((x.near_edited, edited), (x.near_next, following)):
            a, b = brute.shingles(t), brute.shingles(other)
            if a and b:
                error.append(near - len(a & b) / len(a | b))
    assert got[9].fingerprint == got[rows[0][0]].fingerprint
    assert got[1].fingerprint == got[3].fingerprint == got[5].fingerprint
    assert abs(sum(error)) / len(error) < 0.02 and sum(map(abs, error)) / len(error) < 0.05


def test_fingerprints_of_nulls_ties_and_nothing(spark):
    out = fingerprints.document_fingerprints(table(spark, [(None, "a b"), (4, "c d"), (4, "c d"), (4, "e")])).collect()
    assert sorted(x.doc_id is None for x in out) == [False, False, False, True]
    assert fingerprints.document_fingerprints(table(spark, [])).count() == 0


def test_fingerprints_run_without_python(spark):
    plan = fingerprints.document_fingerprints(table(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def pages(spark, urls_):
    df = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    return df.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "canonical", "html", "h")})


def test_url_rules_and_list(spark):
    cases = [
        ("http://a.example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://EXAMPLE.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("https://example.org", "example.org", "", None, "allow"),
        ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("x://shop.com/de/1?q=/fr/", "shop.com", "/de/1", "com/de/", "block"),
        ("http://shop.com/fr/", "shop.com", "/fr/", "com/fr/", "allow"),
        ("http://com.net/de/", "com.net", "/de/", None, "allow"),
        ("http://www.bad.net/page/#x", "www.bad.net", "/page/", None, "block"),
        ("ftp://bad.net/page", "bad.net", "/page", None, "block"),
        ("http://bad.net/Page", "bad.net", "/Page", None, "allow"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"), ("http://x.net/a\nb?c", "x.net", "/a\nb", None, "allow"),
    ]
    listed = spark.createDataFrame([("bad.net/page",), ("bad.net/page",), ("",)], "canonical string")
    got = {r.page_id: tuple(r[1:]) for r in urls.judge(pages(spark, [c[0] for c in cases]), listed).collect()}
    assert got == {k: c[1:] for k, c in enumerate(cases)}


def test_false_positives_of_the_filter_are_removed(spark):
    listed = spark.range(60000).select(F.concat(F.lit("l.net/"), "id").alias("canonical"))
    p = spark.range(20000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://l.net/"), F.col("id") + 50000).alias("url"))
    got = urls.judge(p, listed).groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in got} == {"block": 10000, "allow": 10000}


def test_filter_grows_with_the_list():
    assert [urls.blocks_for(n) for n in (0, 1, 32_768, 32_769, 10_000_000, 10**9)] == [1 << 10, 1 << 10, 1 << 10, 1 << 11, 1 << 19, 1 << 21]
    r = np.random.default_rng(1)
    listed, others = (r.integers(-(2**63), 2**63, n, dtype=np.int64) for n in (50_000, 200_000))
    blocks = urls.blocks_for(len(listed))
    words = np.zeros(blocks * 8, np.uint64)
    at, mask = urls._slots(listed, blocks)
    np.bitwise_or.at(words, at.ravel(), mask.ravel())
    passes = lambda h: ((words[(s := urls._slots(h, blocks))[0]] & s[1]) == s[1]).all(1)
    assert passes(listed).all() and passes(others).mean() < 0.01


def test_urls_of_nothing(spark):
    none = spark.createDataFrame([], "canonical string")
    assert urls.judge(pages(spark, []), none).count() == 0
    assert urls.judge(pages(spark, ["http://bad.net/x"] * 3), none).filter("verdict = 'allow'").count() == 3
