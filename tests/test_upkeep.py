"""Kept moments, gated writes, panes and documents of sections."""

import json
import math
import random
import statistics
from datetime import date

import pytest
from pyspark.sql import functions as F

from tempora.operators import moments as M
from tempora.operators import sections as SC
from tempora.plans.publish import Check, Published
from tempora.streaming import jobs, panes, rolling

# --- moments ----------------------------------------------------------------------------------------------------------


def rows(spark, data):
    return spark.createDataFrame([(k, date(2000 + y, 1, 1), v) for k, y, v in data], "k string, month date, v double")


def kept(s):
    return {(r.k, r.month.year - 2000): (r.n, r["mean"], r["sd"]) for r in s.read().withColumn("sd", M.std()).collect()}


def want(data):
    by = {}
    for k, y, v in data:
        if v is not None:
            by.setdefault((k, y), []).append(v)
    return {g: (len(v), statistics.fmean(v), statistics.stdev(v) if len(v) > 1 else None) for g, v in by.items()}


def same(a, b):
    assert set(a) == set(b)
    for k in a:
        assert a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1], abs=1e-9)
        assert (a[k][2] is None) == (b[k][2] is None) and (a[k][2] is None or a[k][2] == pytest.approx(b[k][2], abs=1e-6))


def test_moments_follow_increments_and_replacements(spark, tmp_path):
    r = random.Random(6)
    data = [(r.choice("abc"), r.randint(0, 3), r.choice([None, *[r.uniform(-50, 50) for _ in range(6)]])) for _ in range(200)]
    s = M.StoredMoments(spark, str(tmp_path), ["k", "month"], "month", "v")
    s.update(rows(spark, data), None, 0)
    same(kept(s), want(data))
    new = [("a", 1, 3.0), ("d", 9, 4.0), ("d", 9, 6.0)]
    s.update(rows(spark, new), None, 1)
    data += new
    same(kept(s), want(data))
    # two values are corrected, one is withdrawn, one key loses all its values
    old = [data[0], data[1], data[2], ("d", 9, 4.0), ("d", 9, 6.0)]
    put = [(old[0][0], old[0][1], 7.5), (old[1][0], old[1][1], None)]
    s.update(rows(spark, put), rows(spark, old), 2)
    for x in old:
        data.remove(x)
    data += put
    same(kept(s), want(data))
    before = s.snapshot.manifest()["version"]
    s.update(rows(spark, put), rows(spark, old), 2)  # a repeated batch
    assert s.snapshot.manifest()["version"] == before


def test_an_increment_reads_its_delta_and_the_moments_only(spark, tmp_path):
    s = M.StoredMoments(spark, str(tmp_path / "m"), ["k", "month"], "month", "v")
    rows(spark, [("a", 1, 1.0), ("a", 1, 2.0), ("b", 2, 5.0)]).write.parquet(str(tmp_path / "base"))
    rows(spark, [("a", 1, 3.0)]).write.parquet(str(tmp_path / "delta"))
    s.update(spark.read.parquet(str(tmp_path / "base")), None, 0)
    delta = M.moments(spark.read.parquet(str(tmp_path / "delta")), s.keys, "v")
    files = M.merged(s.snapshot.read(), delta, delta.limit(0), s.keys).inputFiles()
    assert {f.split(str(tmp_path.name))[1].split("/")[1] for f in files} == {"m", "delta"}
    s.update(spark.read.parquet(str(tmp_path / "delta")), None, 1)
    changed = [f.getPath().getName() for f in s.snapshot.manifests.entries(s.snapshot.manifest()["years"]["2001"][-1])]
    assert [n for n in changed if n.startswith("year=")] == ["year=2001"]  # the other year's moments were not written again
    same(kept(s), want([("a", 1, 1.0), ("a", 1, 2.0), ("a", 1, 3.0), ("b", 2, 5.0)]))


def test_first_increment_may_be_empty_and_keys_may_vanish(spark, tmp_path):
    s = M.StoredMoments(spark, str(tmp_path), ["k", "month"], "month", "v")
    s.update(rows(spark, []), None, 0)
    assert s.read().count() == 0
    s.update(rows(spark, [("a", 1, 2.0)]), None, 1)
    s.update(rows(spark, []), rows(spark, [("a", 1, 2.0)]), 2)
    assert s.read().count() == 0


# --- gated writes -----------------------------------------------------------------------------------------------------

def facts():
    return {"n": F.count("*"), "worst": F.max(F.abs("v")), "mean": F.avg("v")}


CHECKS = [Check("rows", "n", ">=", 2, required=True), Check("worst", "worst", "<=", 10.0), Check("mean", "mean", "<", 5.0, absolute=True)]


def test_a_failing_gate_leaves_the_old_version(spark, tmp_path):
    out = Published(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        out.read()
    good = rows(spark, [("a", 1, 1.0), ("b", 1, -2.0)])
    first = out.write(good, facts(), CHECKS)
    assert first.passed and first.version == 1 and first.facts == {"n": 2, "worst": 2.0, "mean": -0.5}
    bad = out.write(rows(spark, [("a", 1, 99.0), ("b", 1, 0.0)]), facts(), CHECKS)
    assert not bad.passed and [c[3] for c in bad.checks] == [True, False, False]
    shown = bad.rows(spark).collect()
    assert {r.first_failure for r in shown} == {"worst"} and not any(r.published for r in shown)
    assert sorted(r.v for r in out.read().collect()) == [-2.0, 1.0]
    few = out.write(rows(spark, [("a", 1, None)]), facts(), CHECKS)
    assert [c[3] for c in few.checks] == [False, True, True]  # a missing figure is skipped unless required
    assert out.write(rows(spark, [("c", 1, 4.0), ("c", 2, 4.5)]), facts(), CHECKS).version == 2
    assert {r.k for r in out.read().collect()} == {"c"}
    folders = [f.getPath().getName() for f in out.manifests.entries("data")]
    assert len(folders) == 2  # what failed is gone, the version before stays for its readers


def test_the_gate_costs_no_second_scan(spark, tmp_path):
    rows(spark, [("a", 1, 1.0), ("b", 1, -2.0)]).write.parquet(str(tmp_path / "in"))
    spark.sparkContext.setJobGroup("gated", "gated write")
    try:
        Published(spark, str(tmp_path / "t")).write(spark.read.schema("k string, month date, v double").parquet(str(tmp_path / "in")), facts(), CHECKS)
        jobs_run = spark.sparkContext.statusTracker().getJobIdsForGroup("gated")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs_run) == 1


# --- panes ------------------------------------------------------------------------------------------------------------


def test_panes_equal_windows_and_state_stays_small(spark, tmp_path):
    r = random.Random(9)
    at = sorted(r.uniform(0, 600) for _ in range(900))
    data = [(r.choice("ab"), t) for t in at]
    for part in range(3):  # three files, in order of time but for a few seconds
        own = data[part * 300 : part * 300 + 300]
        r.shuffle(own)
        spark.createDataFrame(own, "k string, s double").select("k", F.timestamp_millis((F.col("s") * 1000).cast("long") + 1_700_000_000_000).alias("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in"))
        with rolling.state_store(spark):
            jobs.run_available(panes.sliding_rates_by_panes(stream, "k", "t", 8, 1, 10, "300 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(x.k, x.window_start): (x.n, x.panes) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = jobs.sliding_rates(spark.read.parquet(str(tmp_path / "in")), "k", "t", 8).collect()
    closed = spark.read.parquet(str(tmp_path / "in")).agg(F.max("t")).first()[0].timestamp() - 300
    expected = {(x.k, x.window_start): x.n for x in batch if x.window_start.timestamp() + 10 <= math.floor(closed)}
    assert expected and {k: n for k, (n, _) in got.items() if k[1].timestamp() + 10 <= math.floor(closed)} == expected
    assert max(p for _, p in got.values()) <= 10 + 300 + 1


# --- sections ---------------------------------------------------------------------------------------------------------


def test_document_of_mixed_sections(spark):
    one = spark.createDataFrame([(1, 2.5, "x", True, None)], "n int, v double, t string, ok boolean, missing string")
    many = spark.createDataFrame([("b", 2, math.nan), ("a", 1, math.inf), ("a|c", 3, 0.1)], "k string, n long, v double")
    rows_ = SC.union_sections([SC.section("one", one), SC.section("many", many, ["k"]), SC.section("two keys", many, ["k", "n"], ["v"]), SC.section("none", many.limit(0), ["k"])])
    assert [f.dataType.simpleString() for f in rows_.schema] == ["string", "string", "variant"]
    doc = SC.document(rows_).first().document
    got = json.loads(doc)
    assert got == {
        "one": {"n": 1, "v": 2.5, "t": "x", "ok": True, "missing": None},
        "many": {"a": {"n": 1, "v": None}, "a|c": {"n": 3, "v": 0.1}, "b": {"n": 2, "v": None}},
        "two keys": {"a|1": {"v": None}, "a|c|3": {"v": 0.1}, "b|2": {"v": None}}}
    assert list(got["many"]) == ["a", "a|c", "b"]
    leaves = {(r.section, r.key, r.field): (r.number, r.text) for r in SC.flat(SC.document(rows_)).collect()}
    assert leaves["one", "", "t"] == (None, "x") and leaves["one", "", "ok"] == (None, "true") and leaves["one", "", "missing"] == (None, None)
    assert leaves["many", "a|c", "v"] == (0.1, None) and leaves["many", "b", "n"] == (2.0, None) and len(leaves) == 5 + 6 + 3


def test_document_of_nothing(spark):
    empty = SC.section("s", spark.createDataFrame([], "k string"), ["k"], [])
    assert SC.document(empty).first().document in ("{}", "null")


# --- promotions -------------------------------------------------------------------------------------------------------


def test_promotions(spark):
    from tempora.operators import ledger

    v = spark.createDataFrame(
        [("m", "run-1", 1, True), ("m", "run-2", 2, False), ("m", "run-3", 3, True), ("m", "run-9", 3, True), ("n", "run-5", 1, False)],
        "model string, run_id string, version int, passed boolean")
    got = {(r.version): (r.alias, r.run_id, r.previous_version, r.current, r.tags) for r in ledger.promotions(v).collect()}
    tags = {"quality_gate": "passed", "promoted_alias": "champion"}
    assert got == {1: ("champion", "run-1", None, False, tags), 3: ("champion", "run-9", 1, True, tags)}
    assert [r.run_id for r in ledger.champion(v).collect()] == ["run-9"]
