"""Cells in groups: exact for any group size, and a query travels once per group."""

import numpy as np
import pytest

from tempora.operators import dense
from tests.test_dense import brute, data, frame, got  # noqa: F401


@pytest.mark.parametrize("group, together", [(1, 65536), (12 * 8 * 200, 50), (1 << 24, 7)])
def test_groups_of_any_size_are_exact(spark, data, monkeypatch, group, together):  # noqa: F811
    monkeypatch.setattr(dense, "GROUP", group)
    monkeypatch.setattr(dense, "TOGETHER", together)
    vectors, queries = data
    vectors, queries = vectors[::10] + vectors[3000:3400] + vectors[-4:], queries[::8] + queries[-3:]
    v, q = frame(spark, vectors, "id", "e").repartition(5), frame(spark, queries, "q", "query")
    cells = dense.build_cells(v, "id", "e", 9)
    found, scored = dense.search_cells(cells, v, q, "q", 4)
    assert got(found, "id") == brute(vectors, queries, 4)
    assert all(0 < r.scored <= cells.size.sum() for r in scored.collect())


def test_a_query_travels_once_per_group_not_once_per_cell(spark):
    r = np.random.default_rng(6)
    v = frame(spark, [(i, r.normal(size=12)) for i in range(900)], "id", "e")
    q = v.filter("id % 10 = 0").selectExpr("id AS q", "e AS query")
    found, scored = dense.search_cells(dense.build_cells(v, "id", "e"), v, q, "q", 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan
    assert {x.scored for x in scored.collect()} <= set(range(901))
