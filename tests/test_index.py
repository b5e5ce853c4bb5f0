"""The stored index: packed postings, vocabulary in passes, scores made in the block of a text."""

import contextlib
import io
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import retrieval as R
from tests.test_models_text import brute_top
from tests.test_terms import DOCS, brute_vectors


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def corpus(spark, n=400, words=4000, parts=3):
    rng = np.random.default_rng(7)
    texts = {i: " ".join(f"w{x}" for x in rng.integers(0, words, 60)) for i in range(n)}
    return texts, spark.createDataFrame(list(texts.items()), "doc long, text string").repartition(parts, "doc")


def stored_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_index_stores_no_row_per_text_and_term(spark, tmp_path):
    _, d = corpus(spark)
    before = shuffle_files(spark)
    R.write_index(d, "doc", "text", str(tmp_path / "ix"), buckets=4)
    assert not shuffle_files(spark) - before
    assert spark.read.parquet(str(tmp_path / "ix/vectors")).count() <= 4 * 3
    assert stored_bytes(tmp_path / "ix/vectors") < 10 * R.build_index(d, "doc", "text").count()


def test_vocabulary_equals_a_brute_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "PART", 1)  # many parts of a folder
    d = spark.createDataFrame(DOCS, "doc long, text string").repartition(3, "doc")
    _, vocabulary = R.write_index(d, "doc", "text", str(tmp_path / "ix"), buckets=3)
    weights, df = brute_vectors(DOCS)
    most = {}
    for (_, t), w in weights.items():
        most[t] = max(w, most.get(t, 0))
    rows = {r["term"]: r for r in vocabulary.collect()}
    assert {t: r["df"] for t, r in rows.items()} == df
    assert {t: r["max_weight"] for t, r in rows.items()} == {t: pytest.approx(w, rel=1e-12) for t, w in most.items()}
    assert {t: r["idf"] for t, r in rows.items()} == {t: pytest.approx(math.log((1 + len(DOCS)) / (1 + n)) + 1) for t, n in df.items()}


def test_index_of_no_texts(spark, tmp_path):
    d = spark.createDataFrame([], "doc long, text string")
    index, vocabulary = R.write_index(d, "doc", "text", str(tmp_path / "ix"), buckets=4)
    q = spark.createDataFrame([(1, "rain")], "q long, text string")
    assert vocabulary.isEmpty() and R.retrieve(index, vocabulary, q, "doc", "q", "text").isEmpty()


@pytest.mark.parametrize("asked", [5, 1 << 18])
def test_questions_in_groups_get_the_same_hits(spark, tmp_path, monkeypatch, asked):
    monkeypatch.setattr(R, "ASKED", asked)
    monkeypatch.setattr(R, "TOGETHER", asked)
    texts, d = corpus(spark, 60, 30)
    texts = {f"d{k % 50:02d}{k}": t for k, t in texts.items()} | {"copy": texts[3]}
    d = spark.createDataFrame(list(texts.items()), "doc string, text string").repartition(3, "doc")
    qs = {i: " ".join(f"w{x}" for x in range(i, i + 7)) for i in range(12)} | {99: "nothing known"}
    q = spark.createDataFrame(list(qs.items()), "q long, text string")
    index, vocabulary = R.write_index(d, "doc", "text", str(tmp_path / "ix"), buckets=4)
    got = sorted((r["q"], r["doc"], r["rank"]) for r in R.retrieve(index, vocabulary, q, "doc", "q", "text", 3, 0.3).collect())
    assert got == brute_top(texts, qs, 3)


def test_a_block_returns_its_best_and_only_the_texts_asked_for(spark, tmp_path):
    _, d = corpus(spark, 200, 20)
    q = spark.createDataFrame([(1, "w1 w2"), (2, "w3")], "q long, text string")
    index, vocabulary = R.write_index(d, "doc", "text", str(tmp_path / "ix"), buckets=4)
    terms = R.shared_table(R.question_vectors(q, "q", "text", vocabulary), "terms")
    every = R._dots(index, terms, "doc", "q").collect()
    assert len(every) > 100 and R._dots(index, terms, "doc", "q", 3).count() <= 2 * 3 * 3
    one = next(r for r in every if r["q"] == 2)
    only = spark.createDataFrame([(2, one["block"], one["code"])], "q long, block string, code int")
    limited = R._dots(index, terms, "doc", "q", 3, only)
    assert limited.filter("q = 2").collect() == [one] and not limited.filter("q = 1").isEmpty()


@contextlib.contextmanager
def broadcast_up_to(spark, size):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def unsized_questions(spark):
    return spark.range(10**7).filter("id < 2").select("id", F.lit("w1 w2 w3").alias("text"))


def test_texts_of_hits_do_not_travel(spark, tmp_path):
    _, d = corpus(spark)
    d.selectExpr("doc", "text", "'t' AS title", "'s' AS source").write.parquet(str(tmp_path / "docs"))
    index, vocabulary = R.write_index(d, "doc", "text", str(tmp_path / "ix"), buckets=4)
    with broadcast_up_to(spark, "16k"):
        hits = R.retrieve(index, vocabulary, unsized_questions(spark), "doc", "id", "text")
        assert "SortMergeJoin" not in plan(R.with_documents(hits, spark.read.parquet(str(tmp_path / "docs")), "doc", "id"))


def test_vocabulary_does_not_travel_to_few_questions(spark, tmp_path):
    _, d = corpus(spark)
    _, vocabulary = R.write_index(d, "doc", "text", str(tmp_path / "ix"), buckets=4)
    with broadcast_up_to(spark, "16k"):
        assert "SortMergeJoin" not in plan(R.question_vectors(unsized_questions(spark), "id", "text", vocabulary))
