"""Ops 4, 7 and 9 and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tempora.llm import decontam, lines, packing, simhash, toxicity
from tempora.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.01"
tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("score", "held_out", "item_id", "piece", "length", "part", "fill", "pos", "ids")})


def words(r, n):
    return [("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))) for _ in range(n)]


def leak_rows():
    r = random.Random(8)
    items = [(i, words(r, r.randint(12, 50))) for i in range(30)]
    rows, want = [], set()
    for d in range(300):
        w = words(r, r.randint(20, 400))
        if d % 3 == 0:
            i, item = items[r.randrange(30)]
            copy = list(item)
            if d % 2:  # a paraphrase: some words changed, some added
                for _ in range(len(copy) // 6):
                    copy[r.randrange(len(copy))] = words(r, 1)[0]
                copy.insert(len(copy) // 2, "extra")
            at = r.randrange(len(w))
            w = [*w[:at], *copy, *w[at:]]
            if brute.lcs(item, copy) >= 0.6 * len(item):
                want.add((d, i))
        rows.append((d, " ".join(w)))
    return rows, [(i, " ".join(w)) for i, w in items], want


def test_leaks_against_longest_common_subsequence(spark):
    rows, items, want = leak_rows()
    rows += [(900, None), (901, ""), (902, "!!"), (903, " ".join(words(random.Random(1), 9000)))]
    items += [(900, None), (901, ""), (902, "only three words"), (903, "?!")]
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in decontam.leaked_documents(table(spark, rows), b).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    kept = decontam.drop_leaked(table(spark, rows), b)
    assert kept.columns == table(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {d for d, _ in got}


def test_leaks_by_blocks_of_items(spark, monkeypatch):
    rows, items, want = leak_rows()
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", (7,))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaked_documents(table(spark, rows), b).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_leaks_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert decontam.leaked_documents(table(spark, [(1, "a b c d e f g h")]), none).count() == 0
    assert decontam.leaked_documents(table(spark, []), one).count() == 0
    assert decontam.drop_leaked(table(spark, [(1, "x")]), none).count() == 1


def test_leaks_of_frequent_words(spark):
    """A leak that a third of the documents have, and an item of everyday words only."""
    r = random.Random(4)
    everyday = "the of and to in a is that it was for on are as with his they at be this".split()
    hidden, common = words(r, 30), [r.choice(everyday) for _ in range(25)]
    rows, want = [], set()
    for d in range(1500):
        w = [r.choice(everyday) if r.random() < 0.5 else words(r, 1)[0] for _ in range(100)]
        if d % 3 == 0:
            w[40:40] = hidden
            want.add((d, 1))
        if d % 50 == 1:
            w[60:60] = common
            want.add((d, 2))
        rows.append((d, " ".join(w)))
    b = spark.createDataFrame([(1, " ".join(hidden)), (2, " ".join(common))], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.leaked_documents(table(spark, rows), b).collect()}
    assert want <= got
    assert {d for d, i in got if i == 1} == {d for d, i in want if i == 1}
    kept = {x.doc_id for x in decontam.drop_leaked(table(spark, rows), b).collect()}
    assert kept == set(range(1500)) - {d for d, _ in got}


def test_leaks_of_short_and_long_items(spark):
    r = random.Random(6)
    long_ = words(r, 1500)
    items = [(1, "who wrote hamlet"), (2, "Why?"), (3, " ".join(long_)), (4, "name the capital of peru")]
    text = lambda n: " ".join(words(r, n))
    rows = [(0, f"{text(40)} Who wrote Hamlet {text(40)}"), (1, f"who {text(2)} wrote hamlet"), (2, f"{text(9)} why? {text(9)}"),
            (3, f"{text(60)} {' '.join(long_)} {text(60)}"), (4, " ".join(long_[:800])), (5, text(300)),
            (6, "name the capital"), (7, "of peru name the capital of peru"), (8, "who wrote")]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.leaked_documents(table(spark, rows), b).collect()}
    assert got == {(0, 1), (2, 2), (3, 3), (7, 4)}
    assert {x.doc_id for x in decontam.drop_leaked(table(spark, rows), b).collect()} == {1, 4, 5, 6, 8}


def test_common_subsequence():
    r = random.Random(0)
    for _ in range(200):
        a, b = [[r.randrange(6) for _ in range(r.randint(1, 90))] for _ in range(2)]
        assert decontam.common_subsequence(np.array(a), b) == brute.lcs(a, b)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(out) == docs.count()
    assert all(r.held_out == brute.held_out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in out.items())
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(toxic[i], r.score) for i, r in out.items() if r.held_out and i in toxic]
    ones, zeros = [s for t, s in held if t == 1], [s for t, s in held if t == 0]
    assert np.mean([a > b for a in ones for b in zeros]) > 0.9


def spelled():
    """Documents with one of a few bad words, spelled as learned or otherwise."""
    r = random.Random(3)
    bad = ["scoundrel", "blockhead", "numbskull"]
    learned, unseen = [], []
    for i in range(900):
        w = words(r, r.randint(20, 80))
        y = i % 3 == 0
        if y:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        learned.append((" ".join(w), y))
    for i in range(300):
        w = words(r, r.randint(20, 80))
        y = i % 3 == 0
        if y:
            for _ in range(3):
                x = r.choice(bad)
                w.insert(r.randrange(len(w)), x[:5] + x[5] * 2 + x[6:])
        unseen.append((" ".join(w), y))
    return learned, unseen


def test_unseen_spellings_share_subwords():
    learned, unseen = spelled()
    table_, bias = toxicity.fit([t for t, _ in learned], np.array([y for _, y in learned]))
    raw = [t.encode() for t, _ in unseen]
    z = toxicity.log_odds(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), table_) + bias
    y = np.array([y for _, y in unseen])
    assert ((z > 0) == y).mean() > 0.95


def test_score_depends_on_the_text_alone_and_batches_do_not_matter():
    r = np.random.default_rng(0)
    table_ = r.normal(size=1 << toxicity.BITS).astype(np.float32)
    texts = ["a bad bad word", "", "  ", "é Ünï", "x", "word word a", "bad a", "a" * 5000]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    z = toxicity.log_odds(np.frombuffer(b"".join(raw), np.uint8), at, table_)
    one = [toxicity.log_odds(np.frombuffer(x, np.uint8), np.array([0, len(x)]), table_)[0] for x in raw]
    assert np.allclose(z, one) and z[1] == z[2] == 0


def test_toxicity_without_labels_nulls_and_nothing(spark):
    kinds = "doc_id long, toxic int, quality int"
    rows = [(None, "a b"), (1, None), (2, ""), (2, ""), (3, "good text")]
    for labels in ([], [(3, None, 1)], [(3, 1, 1)]):
        out = toxicity.toxicity(table(spark, rows), spark.createDataFrame(labels, kinds)).collect()
        assert len(out) == 5 and {r.score for r in out} == {0.0} and {r.predicted for r in out} == {0}
    labels = spark.createDataFrame([(3, 0, 1), (1, 1, 0), (2, 1, 0), (5, 0, 0), (None, 1, 1)], kinds)
    assert toxicity.toxicity(table(spark, rows), labels).count() == 5
    assert toxicity.toxicity(table(spark, []), labels).count() == 0
    assert toxicity.drop_toxic(table(spark, rows), labels).columns == table(spark, rows).columns


def test_packing_is_whole(spark):
    r = random.Random(5)
    odd = ["don't I'm it's", "a\x0bb c\x1cd e\x85f", "<|endoftext|> x<|startoftext|>y", "İstanbul İ, שׁ. ﬁn", "a.b,c.. 1234 x1,", "漢字。 café."]
    rows = [(i, " ".join(words(r, r.choice([1, 5, 60, 300, 2500])))) for i in range(120)] + [(200 + i, t) for i, t in enumerate(odd)]
    rows += [(300, None), (301, ""), (302, "twice"), (302, "twice"), (None, "no id"), (303, "long " * 20000)]
    out = packing.pack(table(spark, rows), VOCABULARY).collect()
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want += [(i, p, p * 2048, len(c := ids[p * 2048 : (p + 1) * 2048]), zlib.crc32(np.array(c, "<u4").tobytes()))
                 for p in range(-(-len(ids) // 2048))]
    key = lambda x: (x[0] is None, *(v or 0 for v in x))
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(want, key=key)
    bins = {}
    for x in out:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(w[3] for w in want) // 2048) + 2
    assert packing.pack(table(spark, []), VOCABULARY).count() == 0


def test_local_search_lowers_the_number_of_bins():
    r = random.Random(1)
    fewer = 0
    for _ in range(60):
        lengths = [r.randint(250, 700) for _ in range(60)]
        bins = packing.best_fit(lengths, 1000)
        better = packing.improve([list(b) for b in bins], lengths, 1000)
        assert sorted(k for b in better for k in b) == list(range(60))
        assert all(sum(lengths[k] for k in b) <= 1000 for b in better)
        assert len(better) <= len(bins)
        fewer += len(bins) - len(better)
    assert fewer > 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what the one before kept and wrote, against plain versions where the method is exact."""
    assert QUERIES["pipeline"][1] is corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs)
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
            clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert len(toxic & ids) <= 0.3 * len(toxic) and len(clean & ids) >= 0.95 * len(clean)
        if k == 1:
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            want = brute.lines(rows)
            assert {r.doc_id: brute.sha((r.text or "").encode()) for r in docs.collect()} == {i: w[2] for i, w in want.items()}
        if k == 2:
            rows = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            sets = {i: brute.shingles(t) for i, t in rows.items()}
            gone = set(rows) - ids
            for i in gone:  # each has a similar document
                assert any(j != i and (rows[i] == rows[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for j in rows)
            left = sorted(ids)
            missed = sum(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0 for n, i in enumerate(left) for j in left[n + 1 :] if sets[i] & sets[j])
            assert missed <= 0.1 * max(len(gone), 10)
    packed = {r.doc_id for r in docs.collect()}
    assert packed == {r.doc_id for r in kept[3].select("doc_id").collect()}


@pytest.mark.parametrize("rows", [[], [(1, None), (None, ""), (1, "twice"), (1, "twice"), (2, "x " * 3000)]])
def test_pipeline_on_odd_tables(spark, tmp_path, rows):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], kinds)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some words of a benchmark item here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {i for i, _ in rows}


def test_stage_functions_do_not_need_the_columns_in_order(spark):
    df = spark.createDataFrame([("en", "a b", 3), ("en", "a b", 4)], "lang string, text string, doc_id long")
    assert simhash.drop_near_duplicates(df).count() == 1
    assert lines.drop_repeated_lines(df).columns == df.columns
