"""Copies of one row, rows of one id and repeated labels in great number: no group or result grows with them."""

import hashlib

import pandas as pd
from pyspark.sql import functions as F

from tempora.llm import blocks, fingerprints, lines, packing, repeats, simhash, substrings, toxicity
from tests.llm import brute

N = 20_000
TEXT = " ".join(f"word{i}" for i in range(30))


def copies(spark, *others):
    """N rows of one text under a null id, and others."""
    hot = spark.range(N).select(F.lit(None).cast("long").alias("doc_id"), F.lit(TEXT).alias("text"))
    return hot.unionByName(spark.createDataFrame(list(others), "doc_id long, text string"))


def test_copies_of_a_row_are_dealt_to_a_block_once(spark):
    df = copies(spark, (4, TEXT + " more"), (5, "something else altogether"))
    assert blocks.Dealt(df).rows.count() == 3
    for f, gone in ((repeats.repeated_bytes, len(TEXT)), (substrings.repeated_words, 30)):
        got = f(df).groupBy("doc_id", "n_removed").count().collect()
        assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["n_removed"], x["count"]) for x in got) == [
            (False, 4, gone, 1), (False, 5, 0, 1), (True, 0, 0, N)]


def test_lines_of_copies(spark):
    got = {(x.doc_id, x.n_dropped) for x in lines.line_digests(copies(spark, (4, TEXT)), min_docs=2).distinct().collect()}
    assert got == {(None, 1), (4, 1)}


def test_copies_are_packed_in_groups_of_their_size(spark, tmp_path):
    import public_tokenizers

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    df = copies(spark, (4, "x"))
    pieces = packing.C.store(packing.token_pieces(df, vocabulary).withColumn("row", F.monotonically_increasing_id()), "pieces")
    dealt, parts = packing._pack_groups(pieces, 2048, 2500, 0)
    sizes = dealt.groupBy(F.floor(F.col("sequence_id") / 2**24).alias("part")).count().toPandas()["count"]
    assert parts == 9 and sizes.sum() == N + 1 and sizes.max() < 2750
    got = packing.pack(df, vocabulary).toPandas()
    assert len(got) == N + 1
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    whole = int(got["length"].sum())
    assert got["sequence_id"].nunique() <= 1.05 * -(-whole // 2048)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *pd.Series(g["length"]).cumsum().tolist()[:-1]]


def test_rows_of_one_id_spread_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 1 << 14)
    rows = [(None, f"{i:05d} {TEXT}") for i in range(3000)] + [(9, "last one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    d = fingerprints.with_next(df)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") >= 1 and "CASE" not in plan.split("Window")[0]
    got = {(x.doc_id, x.text): x.next_text for x in d.select("doc_id", "text", "next_text").collect()}
    texts = [t for _, t in rows]
    assert [got[(fingerprints.C.NULL_ID if i is None else i, t)] for i, t in rows] == texts[1:] + texts[:1]


def test_bound_of_the_classifiers_sample(spark):
    """Two labelled ids with many rows bring two texts to the driver."""
    ids = [i for i in range(40) if not brute.held_out(i)][:2]
    rows = spark.range(30_000).select(F.when(F.col("id") % 2 == 0, ids[0]).otherwise(ids[1]).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(ids[0], 1), (ids[1], 0)] * 50, "doc_id long, toxic long")
    seen = []
    original = toxicity.fit
    try:
        toxicity.fit = lambda texts, y, **k: seen.append(len(texts)) or original(texts, y, **k)
        out = toxicity.toxicity(rows, labels)
    finally:
        toxicity.fit = original
    assert seen == [2] and out.count() == 30_000


def test_near_duplicates_of_copies(spark):
    got = simhash.drop_near_duplicates(copies(spark, (4, TEXT + " more"), (5, "something else altogether"))).groupBy("doc_id").count().collect()
    assert {(x["doc_id"], x["count"]) for x in got} == {(None, N), (5, 1)}
    assert hashlib.md5(TEXT.encode()).hexdigest() in {x.same for x in simhash.similar_texts(copies(spark), 5, 0.8)[0].distinct().collect()}
