"""Term counts and vectors made in blocks of texts."""

import contextlib
import io
import math
import re
from collections import Counter
from itertools import pairwise

import pyarrow as pa
import pytest

from tempora.functions import text as TX
from tempora.operators import retrieval as R
from tempora.operators import terms as T


def brute_vectors(docs):
    """{(doc, term): weight} with the texts of one key counted together."""
    counts, total = {}, {}
    for k, text in docs:
        w = [t for t in re.findall(TX.TOKEN_PATTERN, (text or "").lower()) if t not in TX.STOP_WORDS]
        terms = w + [f"{a}_{b}" for a, b in pairwise(w)]
        for t in terms:
            counts[k, t] = counts.get((k, t), 0) + 1
        total[k] = max(total.get(k, 0), len(terms))
    df = Counter(t for _, t in counts)
    raw = {(k, t): n / total[k] * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for (k, t), n in counts.items()}
    norm = {k: math.sqrt(sum(w * w for (i, _), w in raw.items() if i == k)) for k in total}
    return {at: w / norm[at[0]] for at, w in raw.items()}, df


DOCS = [(1, "Rain rain a_b, a b snow"), (2, None), (3, ""), (4, "the of"), (5, "rain"), (6, "snow É9 rain.a_b"), (6, "Rain again and again"), (7, "x" * 5000 + " rain")]


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_vectors_in_blocks_equal_a_brute_count(spark, monkeypatch, size):
    monkeypatch.setattr(T, "BUCKET", size)
    monkeypatch.setattr(T, "TASK", size)
    d = spark.createDataFrame(DOCS, "doc long, text string").repartition(3, "doc")
    want, df = brute_vectors(DOCS)
    got = {(r["doc"], r["term"]): r["weight"] for r in R.build_index(d, "doc", "text").collect()}
    assert got == {k: pytest.approx(w, rel=1e-12) for k, w in want.items()}
    assert {r["term"]: r["df"] for r in R.inverse_document_frequency(d, "doc", "text").collect()} == df


@pytest.mark.parametrize("size", [1, 30, 1 << 20])
def test_blocks_of_any_size_count_the_same(monkeypatch, size):
    monkeypatch.setattr(T, "BLOCK", size)
    texts = [[(t or "").lower()] if t is not None else [None] for _, t in DOCS]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(DOCS))), pa.array(texts, pa.list_(pa.string()))], ["doc", "texts"])
    df = Counter()
    for _, c in T._blocks(iter([batch])):
        df.update({t.as_py(): int((c.code == i).sum()) for i, t in enumerate(c.terms)})
    assert df == brute_vectors(list(enumerate(t for _, t in DOCS)))[1]


def test_numbers_and_strings_survive_packing():
    for x in ([], [0, 1, 2**31, 70000]):
        assert T._unpack(T._pack(pa.array(x, pa.int64()).to_numpy())).tolist() == x
        s = [str(v) * 3 for v in x]
        assert T._unpack_strings(T._pack_strings(pa.array(s, pa.string()))).to_pylist() == s


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_no_row_per_text_and_term_crosses_an_exchange(spark):
    d = spark.range(400, numPartitions=2).selectExpr("id AS doc", "'rain snow wind' AS text")
    assert plan(T.document_counts(d, "doc", "text")).count("Exchange") == 1
    p = plan(R.build_index(d, "doc", "text"))
    assert "Join" not in p and "Generate" not in p and "Window" not in p
