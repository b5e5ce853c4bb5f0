"""Exact dense search: one scan and cells against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import dense


def frame(spark, rows, name, column):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{name} long, {column} array<float>")


def brute(vectors, queries, k):
    unit = lambda v: np.asarray(v, np.float32).astype(float) / np.linalg.norm(np.asarray(v, np.float32).astype(float))
    known = [(i, unit(v)) for i, v in vectors if v is not None and len(v) == 12 and np.any(v)]
    out = {}
    for i, q in queries:
        if q is not None and np.any(q):
            s = sorted(((-round(float(v @ unit(q)), 6), j) for j, v in known))[:k]
            out[i] = [j for _, j in s]
    return out


def got(df, key):
    out = {}
    for r in df.orderBy("q", "rank").collect():
        out.setdefault(r.q, []).append(r[key])
    return out


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(5)
    centres = r.normal(size=(30, 12))
    vectors = [(i, centres[i % 30] + 0.05 * r.normal(size=12)) for i in range(3000)]
    vectors += [(5000 + i, centres[3]) for i in range(1500)]  # a third of all rows is one vector
    vectors += [(9000, np.zeros(12)), (9001, None), (9002, []), (9003, [1.0, 2.0])]
    queries = [(i, centres[i % 30] + 0.05 * r.normal(size=12)) for i in range(400)] + [(800, np.zeros(12)), (801, None), (802, -centres[0])]
    return vectors, queries


def test_one_scan(spark, data):
    vectors, queries = data
    v, q = frame(spark, vectors, "id", "e").repartition(7), frame(spark, queries, "q", "query")
    assert got(dense.dense_top_k(v, q, "id", "e", "q", 4), "id") == brute(vectors, queries, 4)


def test_cells_are_exact_and_skip_most_vectors(spark, data):
    vectors, queries = data
    v, q = frame(spark, vectors, "id", "e").repartition(7), frame(spark, queries, "q", "query")
    cells = dense.build_cells(v, "id", "e")
    assert cells.size.sum() == 4500 and cells.blocks.agg(F.max("n")).first()[0] <= dense.BLOCK
    found, scored = dense.search_cells(cells, v, q, "q", 4)
    want = brute(vectors, queries, 4)
    assert got(found, "id") == want
    share = {r.q: r.scored / 4500 for r in scored.collect()}
    assert set(share) == set(want) and 0 < np.median(list(share.values())) < 0.45
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_many_queries_go_through_cells(spark, data, monkeypatch):
    vectors, queries = data
    v, q = frame(spark, vectors[:900], "id", "e"), frame(spark, queries, "q", "query")
    monkeypatch.setattr(dense, "ONE_SCAN", 100)
    with pytest.raises(ValueError):
        dense.one_scan(v, q, "id", "e", "q", 2)
    assert got(dense.dense_top_k(v, q, "id", "e", "q", 2), "id") == brute(vectors[:900], queries, 2)


def test_fewer_vectors_than_k_and_none(spark, data):
    vectors, queries = data
    q = frame(spark, queries[:9], "q", "query")
    for few in (vectors[:3], [(1, np.zeros(12))], []):
        v = frame(spark, few, "id", "e")
        want = {k: x for k, x in brute(few, queries[:9], 5).items() if x}
        assert got(dense.one_scan(v, q, "id", "e", "q", 5), "id") == want
        assert got(dense.search_cells(dense.build_cells(v, "id", "e"), v, q, "q", 5)[0], "id") == want
    v = frame(spark, vectors[:50], "id", "e")
    assert dense.dense_top_k(v, q.limit(0), "id", "e", "q", 2).count() == 0
    assert dense.search_cells(dense.build_cells(v, "id", "e"), v, q.limit(0), "q", 2)[0].count() == 0
