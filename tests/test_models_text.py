"""Features, models, retrieval, answers, fine-tuning data and streaming."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.functions import text as TX
from tempora.operators import answers as A
from tempora.operators import features as FT
from tempora.operators import modeling as MD
from tempora.operators import dense
from tempora.operators import retrieval as R
from tempora.operators import sft as S
from tempora.spec import ObservationSpec
from tempora.streaming import jobs

SPEC = ObservationSpec()


def test_contract_order_defaults_and_overrides(spark):
    c = FT.FeatureContract(("b", "a", "wind_norm"), {"wind_norm": 0.33})
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    out = c.apply(df)
    assert out.columns == ["b", "a", "wind_norm"] and tuple(out.first()) == (0.0, 1.0, 0.33)
    assert tuple(c.apply(df, overrides={"a": 5.0, "zzz": 1.0, "b": None}).first()) == (0.0, 5.0, 0.33)
    missing = [r["feature"] for r in FT.contract_check(df, ["a", "et0_norm"]).filter("not present").collect()]
    assert missing == ["et0_norm"]


def test_resolve_contract(spark):
    df = spark.createDataFrame([(1.0, 3.0, 2.0)], "a double, b double, y double")
    assert FT.resolve_contract(FT.FeatureContract(("b", "a")), df).columns == ("b", "a")
    assert FT.resolve_contract(FT.FeatureContract(("x",)), df).columns == ("a", "b")


def test_features_handle_leap_day_and_negative_precip(spark):
    df = spark.createDataFrame([(date(2020, 12, 31), 1.0, -4.0), (date(2021, 1, 1), None, 1.0)],
                               "time date, temperature_2m_mean double, precipitation_sum double")
    rows = FT.build_features(df, SPEC).collect()
    assert len(rows) == 1
    assert rows[0]["sin_doy"] == pytest.approx(math.sin(2 * math.pi * 366 / 365)) and rows[0]["precip_log1p"] == 0.0
    assert rows[0]["year_norm"] == pytest.approx(29 / 30)


def test_fit_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = 1.5 + x @ [2.0, -0.5] + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    contract = FT.fit_contract(df)
    models = MD.fit_regressors(df, contract)
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    got = {r["feature"]: r["coefficient"] for r in MD.coefficients(spark, models, contract).collect()}
    assert [got["intercept"], got["a"], got["b"]] == pytest.approx(list(want), abs=1e-6)
    pred = MD.predictions(df, models, contract)
    assert pred.columns == ["y_true", "y_pred", "residual"]
    m = MD.regression_metrics(pred).first()
    assert m["r2"] > 0.99 and m["residual_mean"] == pytest.approx(0.0, abs=1e-6)


def test_fit_keeps_its_digits_far_from_zero(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([11.2 + rng.normal(0, 0.07, 300), 1.65 + rng.normal(0, 0.001, 300), np.full(300, 0.1)])
    y = 25.0 + x[:, :2] @ [0.5, -0.9] + rng.normal(0, 0.5, 300)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    contract = FT.fit_contract(df)
    model = MD.fit_regressors(df, contract)["y"]
    want = np.linalg.lstsq(np.column_stack([x[:, :2] - x[:, :2].mean(0), np.ones(300)]), y, rcond=None)[0]
    assert model.coefficients == pytest.approx((want[0], want[1], 0.0), abs=1e-9)
    assert model.intercept == pytest.approx(want[2] - want[:2] @ x[:, :2].mean(0), abs=1e-9)


def test_metrics_of_constant_truth(spark):
    m = MD.regression_metrics(spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "y_true double, y_pred double")).first()
    assert (m["mse"], m["r2"], m["residual_std"]) == (1.0, 0.0, 1.0)


def test_one_day_holding_all_rows_is_numbered_in_parts(spark):
    df = spark.createDataFrame([(date(2020, 1, 1), i, float(i)) for i in range(500)], "time date, id int, y double")
    assert [r["position"] for r in MD.even_sample(df, "time", ["id"], points=1).collect()] == [0]
    got = MD.even_sample(df, "time", ["id"], points=1000)
    assert sorted(r["position"] for r in got.collect()) == list(range(500))


@pytest.mark.parametrize("n", [5, 37])
def test_even_sample_matches_linspace(spark, n):
    df = spark.createDataFrame([(date(2020, 1, 1 + i % 28), i, float(i)) for i in range(n)], "time date, id int, y double")
    got = sorted(r["position"] for r in MD.even_sample(df, "time", ["id"], points=10).collect())
    want = list(range(n)) if n <= 10 else [int(v) for v in np.round(np.linspace(0, n - 1, 10))]
    assert got == want


def test_circular_range_against_brute_force(spark):
    days = [(date(2020, 1, 1).fromordinal(date(2020, 1, 1).toordinal() + i), float(i % 13), float(i % 17)) for i in range(366)]
    df = spark.createDataFrame(days, "time date, temperature_2m_min double, temperature_2m_max double")
    targets = spark.createDataFrame([(date(2021, 1, 3),), (date(2020, 12, 31),), (date(2021, 7, 1),)], "target_date date")
    for r in MD.circular_range(df, targets, SPEC).collect():
        t = r["target_date"].timetuple().tm_yday
        near = [(lo, hi) for d, lo, hi in days if min(abs(d.timetuple().tm_yday - t), 365 - abs(d.timetuple().tm_yday - t)) <= 7]
        assert r["typical_low"] == pytest.approx(sum(a for a, _ in near) / len(near))
        assert r["typical_high"] == pytest.approx(sum(b for _, b in near) / len(near))


def test_bias_needs_seven_days(spark):
    fc = spark.createDataFrame([("A", 10.0), ("B", 10.0)], "city string, y_pred double")
    obs = spark.createDataFrame([(c, date(2024, 1, d), 12.0, 10.0) for c, n in (("A", 7), ("B", 6)) for d in range(1, n + 1)],
                                "city string, time date, y_true double, y_pred double")
    out = {r["city"]: r for r in MD.bias_adjusted(fc, MD.year_bias(obs, ["city"], "time"), ["city"]).collect()}
    assert out["A"]["adjusted"] == 12.0 and out["B"]["adjusted"] == 10.0 and not out["B"]["is_adjusted"]


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("v")).first()["v"]


def test_text_functions(spark):
    assert one(spark, "# Head\n\n## Two\n a  b ", TX.normalize_text) == "Head Two a b"
    assert one(spark, "One. Two! Three? Four", TX.first_sentences) == "One. Two!"
    assert one(spark, "The cat of Rome", TX.words) == ["cat", "rome"]
    assert one(spark, "The cat of Rome", lambda c: TX.bigrams(TX.words(c))) == ["cat_rome"]
    assert one(spark, "the", lambda c: TX.bigrams(TX.words(c))) == []
    assert one(spark, " a \n\n\n\n b\n\nc\n\nd", TX.paragraphs) == ["a", "b", "c"]
    got = one(spark, "shows a temperature anomaly of 2.50 C with z-score 1.70 and R2 = 0.81", TX.interpretation)
    assert got.startswith("This means it has been notably warmer than the 30-year average (+2.5 °C).")
    assert "A z-score of +1.70 is very anomalous" in got and "a good fit" in got
    assert one(spark, "nothing here", TX.interpretation) == ""


def test_answer_score(spark):
    def score(text, n):
        return one(spark, text, lambda c: TX.answer_score(c, F.lit(n)))

    assert score(TX.NO_ANSWER, 3) == 0.0
    assert score("short", 0) == 1.5
    assert score("x" * 300 + " about 1 2 3", 3) == 4.75
    assert score("I don't know", 1) == 1.0


def brute_top(docs, questions, k):
    import re
    from collections import Counter

    def toks(t):
        w = [x for x in re.findall(r"[a-z0-9_]+", t.lower()) if x not in TX.STOP_WORDS]
        return w + [f"{a}_{b}" for a, b in zip(w, w[1:])]

    df = Counter(t for d in docs.values() for t in set(toks(d)))
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}

    def vec(text):
        c = Counter(toks(text))
        v = {t: n / sum(c.values()) * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    dv = {i: vec(t) for i, t in docs.items()}
    out = []
    for q, text in questions.items():
        qv = vec(text)
        s = [(round(sum(w * dv[i].get(t, 0.0) for t, w in qv.items()), 6), i) for i in docs]
        ranked = sorted([x for x in s if x[0] > 0], key=lambda x: (-x[0], x[1]))[:k]
        out += [(q, i, r + 1) for r, (_, i) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("first", [0.01, 0.3, 0.5, 1.0])
def test_retrieval_is_exact_whatever_terms_come_first(spark, tmp_path, first):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(40)]
    p = 1 / np.arange(1, 41)
    docs = {i: " ".join(rng.choice(vocab, size=rng.integers(3, 30), p=p / p.sum())) for i in range(80)}
    qs = {100 + i: " ".join(rng.choice(vocab, size=6, p=p / p.sum())) + " unseen" for i in range(12)}
    d = spark.createDataFrame(list(docs.items()), "doc long, text string")
    q = spark.createDataFrame(list(qs.items()), "q long, text string")
    index, vocabulary = R.write_index(d, "doc", "text", str(tmp_path / "ix"), buckets=4)
    got = sorted((r["q"], r["doc"], r["rank"]) for r in R.retrieve(index, vocabulary, q, "doc", "q", "text", 3, first).collect())
    assert got == brute_top(docs, qs, 3)


def test_dense_queries_in_blocks(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id int, e array<float>")
    q = spark.createDataFrame([(i, [1.0, 0.1] if i % 2 else [0.0, 2.0]) for i in range(1001)], "q int, query array<double>")
    top = {r["q"]: r["id"] for r in dense.dense_top_k(v, q, "id", "e", "q", 1).collect()}
    assert top == {i: 1 if i % 2 else 2 for i in range(1001)}


def test_entity_lookup_finds_the_first_contained_name(spark):
    qs = spark.createDataFrame([("how warm is middle east or asia?",), ("nothing",), ("AFRICAN heat",)], "question string")
    names = spark.createDataFrame([("ASIA",), ("MIDDLE EAST",), ("AFRICA",)], "city string")
    s = A.with_entity(A.with_slots(qs, "question", date(2024, 1, 1)), names, "city", "question")
    got = {r["question"]: r["chosen"] for r in s.collect()}
    assert got == {"how warm is middle east or asia?": "ASIA", "nothing": None, "AFRICAN heat": "AFRICA"}


def test_forecast_slots(spark):
    qs = spark.createDataFrame([("What will the temperature be tomorrow?",), ("Forecast for next week",), ("predict 2024-07-05",),
                                ("predict 2024-13-45",), ("hello",)], "q string")
    got = [r["target_date"] for r in A.with_slots(qs, "q", date(2024, 1, 1)).collect()]
    assert got == [date(2024, 1, 2), date(2024, 1, 8), date(2024, 7, 5), date(2024, 1, 2), None]


def test_comparison_needs_this_or_latest_year(spark):
    h = spark.createDataFrame([("A", 3, 2003, 1.0, -1.0, 0.0), ("A", 3, 2024, 4.0, 2.0, 1.0)],
                              "city string, month int, year int, mean_temp_c double, anomaly_c double, zscore double")
    qs = spark.createDataFrame([("Is this March in A warmer than 2003?",), ("Was March in A warmer in 2003?",)], "q string")
    s = A.with_slots(qs, "q", date(2024, 3, 1)).withColumn("chosen", F.lit("A"))
    rows = A.comparison_answers(s, h, "city", "q").collect()
    assert len(rows) == 1
    assert rows[0]["answer"].startswith("Yes. A March 2024 is warmer than 2003. Mean temperature is 4.00 C versus 1.00 C, a difference of +3.00 C")


def test_sft_outliers_are_dropped(spark):
    cols = "city string, temp_deviation double, temp_zscore double"
    df = spark.createDataFrame([("A", 1.25, 0.5), ("B", -37.68, -14.68)], cols)
    rows = S.entity_ytd_examples(df, "city").collect()
    assert [r["output"] for r in rows] == ["A is warmer than the baseline by 1.25 C (z=+0.50) year-to-date."]


def test_sft_slice_builders(spark):
    rows = [("V", 3, 2020 + i, float(i), float(i - 2), (i - 2) / 2.0) for i in range(5)] + [("V", 3, 2019, -60.0, -99.89, -9.0)]
    h = spark.createDataFrame(rows, "city string, month int, year int, mean_temp_c double, anomaly_c double, zscore double")
    trend = S.slice_trend_examples(h, "city").collect()
    assert len(trend) == 2 and "warmest March was 2024 (+2.00 C)" in trend[0]["output"] and "2/10" in trend[0]["output"]
    assert all("-99.89" not in r["input"] for r in trend)
    assert S.slice_trend_examples(h.filter("year > 2020"), "city").isEmpty()
    comp = S.slice_comparison_examples(h, "city")
    assert comp.count() == 4 and comp.filter("output like 'Yes,%'").count() == 4


def test_split_never_leaves_eval_empty(spark):
    one_row = S.split_examples(spark.range(1), ["id"]).collect()
    assert sorted(r["part"] for r in one_row) == ["eval", "train"]
    parts = S.split_examples(spark.range(100), ["id"]).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"train": 80, "eval": 20}


def test_supervised_tokens(spark):
    df = spark.createDataFrame([("Do it", "ctx", "ok")], "instruction string, input string, output string")
    r = S.supervised_tokens(df, 160).first()
    p = "### Instruction:\nDo it\n\n### Input:\nctx\n\n### Response:\n"
    ids = [101, *[ord(c) + 3 for c in p], *[ord(c) + 3 for c in "ok"], 102]
    assert r["input_ids"] == ids + [0] * (160 - len(ids))
    assert r["attention_mask"] == [1] * len(ids) + [0] * (160 - len(ids))
    assert [x for x in r["labels"] if x != -100] == ids[-3:]
    long = spark.createDataFrame([("Do it", "ctx", "a long response")], "instruction string, input string, output string")
    t = S.supervised_tokens(long, 10).first()
    assert t["input_ids"] == [101, *[ord(c) + 3 for c in "a long r"], 102] and t["labels"][0] == -100
    with pytest.raises(ValueError):
        S.supervised_tokens(df, 1)


def test_pluggable_tokenizer(spark):
    encode = S.batch_tokenizer(lambda texts: [[len(w) for w in t.split()] for t in texts])
    df = spark.createDataFrame([("a", "bb", "ccc dddd")], "instruction string, input string, output string")
    r = S.supervised_tokens(df, 20, tokenize=encode).first()
    assert [x for x in r["labels"] if x != -100] == [3, 4, 102]


def test_stream_equals_batch_for_closed_months(spark, tmp_path):
    rows = [("k", f"2024-0{m}-1{d} 00:00:00", float(m * d)) for m in (1, 2, 3) for d in (1, 2)]
    df = spark.createDataFrame(rows, "k string, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = jobs.monthly_stream(jobs.as_stream(spark, str(tmp_path / "in"), "*.parquet"), ["k"], "t", "v")
    jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, jobs.monthly_stream(df, ["k"], "t", "v").filter("month < 3").collect()))
    assert got == want and len(got) == 2


def test_merge_stream_over_batches(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    cols = "city string, time date, v double"
    for rows in ([("A", date(2023, 1, 1), 1.0), ("A", date(2024, 1, 1), 1.0)], [("A", date(2024, 1, 1), 5.0), ("A", date(2024, 1, 2), 6.0)]):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(src)
        stream = jobs.as_stream(spark, src, "*.parquet")
        jobs.merge_stream(stream, ["city", "time"], "time", "2000-01-01", out, cp).awaitTermination()
    got = {r["time"]: r["v"] for r in jobs.read_snapshot(spark, out).collect()}
    assert got == {date(2023, 1, 1): 1.0, date(2024, 1, 1): 5.0, date(2024, 1, 2): 6.0}


def test_sliding_rates(spark):
    rows = [("a", f"2024-01-01 00:00:{s:02d}") for s in range(7)] + [("b", "2024-01-01 00:00:01")]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    out = jobs.sliding_rates(df, "k", "t", 5)
    assert {r["k"] for r in out.collect()} == {"a"} and out.agg(F.max("n")).first()[0] == 7
