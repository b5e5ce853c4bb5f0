"""Mergeable aggregates, manifest snapshots and the stateful rolling stream."""

import math
import random
import statistics
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempora.operators import combine as K
from tempora.streaming import jobs, rolling
from tempora.streaming.snapshot import Conflict, Snapshot


class Longest(K.Combiner):
    """Longest text and how many rows have one: a state that no built-in aggregate has."""

    state, result = {"text": "string", "n": "long"}, {"longest": "string", "n": "long"}

    def create(self, n):
        return {"text": np.full(n, None, object), "n": np.zeros(n, np.int64)}

    def _fold(self, state, group, texts, counts):
        for g, x, k in zip(group.tolist(), texts, counts, strict=True):
            if x is not None:
                old = state["text"][g]
                state["text"][g] = x if old is None else min(x, old, key=lambda v: (-len(v), v))
            state["n"][g] += k

    def add(self, state, group, values):
        texts = values["text"].to_pylist()
        self._fold(state, group, texts, [int(x is not None) for x in texts])

    def merge(self, state, group, other):
        self._fold(state, group, other["text"], other["n"].tolist())

    def extract(self, state):
        return {"longest": state["text"], "n": state["n"]}


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(2)
    data = [(r.choice(["a", "a", "a", "b", None, f"k{r.randint(0, 60)}"]), r.choice([1, 2, None]), r.choice([None, math.nan, *[r.uniform(-5, 5) for _ in range(8)]]),
             r.choice([None, "x" * r.randint(0, 9), f"t{r.randint(0, 99)}"])) for _ in range(5000)]
    return data, spark.createDataFrame(data, "k string, j int, v double, text string").repartition(12).cache()


def groups(data):
    out = {}
    for k, j, v, t in data:
        out.setdefault((k, j), []).append((None if v is None or v != v else v, t))
    return out


def test_combiners_equal_plain_python(rows):
    data, df = rows
    want = groups(data)
    sums = {(x.k, x.j): x.total for x in K.combine_per_key(df, ["k", "j"], K.Sum(), ["v"]).collect()}
    stats = {(x.k, x.j): x for x in K.combine_per_key(df, ["k", "j"], K.MeanStd(), ["v"]).collect()}
    means = {(x.k, x.j): x for x in K.combine_per_key(df, ["k", "j"], K.MeanCount(), ["v"], fanout=3).collect()}
    texts = {(x.k, x.j): (x.longest, x.n) for x in K.combine_per_key(df, ["k", "j"], Longest(), ["text"]).collect()}
    assert set(sums) == set(stats) == set(means) == set(texts) == set(want)
    for key, own in want.items():
        v = [x for x, _ in own if x is not None]
        t = [x for _, x in own if x is not None]
        assert texts[key] == (min(t, key=lambda x: (-len(x), x)) if t else None, len(t))
        assert means[key]["count"] == stats[key].n == len(v)
        if not v:
            assert sums[key] is None and means[key]["mean"] is None and stats[key]["std"] is None
            continue
        assert sums[key] == pytest.approx(sum(v)) and means[key]["mean"] == pytest.approx(sum(v) / len(v))
        assert stats[key]["std"] == pytest.approx(statistics.stdev(v) if len(v) > 1 else 0.0)


def test_one_row_per_task_and_key_is_exchanged(rows):
    _, df = rows
    tasks = df.select(F.spark_partition_id().alias("p"), "k", "j").distinct().count()
    sent = K.partials(df, ["k", "j"], K.Sum(), ["v"])
    assert sent.count() == tasks
    plan = K.combine_per_key(df, ["k", "j"], K.Sum(), ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.index("hashpartitioning(k") < plan.rindex("_salt")
    assert len({x[K.SALT] for x in sent.collect()}) == df.rdd.getNumPartitions()


def test_many_keys_are_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr(K, "MAX_KEYS", 50)
    df = spark.range(20_000).select((F.col("id") % 700).alias("k"), F.col("id").cast("double").alias("v"))
    got = {x.k: x.total for x in K.combine_per_key(df, ["k"], K.Sum(), ["v"]).collect()}
    assert got == {k: float(sum(range(k, 20_000, 700))) for k in range(700)}


def test_global_and_empty(spark, rows):
    data, df = rows
    assert K.combine_globally(df, K.MeanCount(), ["v"]).first()["count"] == sum(v is not None and v == v for _, _, v, _ in data)
    assert K.combine_per_key(df.limit(0), ["k"], K.Sum(), ["v"]).collect() == []
    assert K.combine_globally(df.limit(0), K.Sum(), ["v"]).first().total is None


def test_merge_does_not_depend_on_order():
    r = random.Random(1)
    m = K.MeanStd()
    parts = []
    for _ in range(6):
        s = m.create(2)
        m.add(s, np.array([0, 1, 0, 1]), {"v": pa.array([r.uniform(0, 9) for _ in range(4)])})
        parts.append(s)
    a, b = m.create(2), m.create(2)
    for s in parts:
        m.merge(a, np.array([0, 1]), s)
    for s in reversed(parts):
        m.merge(b, np.array([0, 1]), s)
    for c in a:
        assert np.allclose(a[c], b[c])


# --- snapshots --------------------------------------------------------------------------------------------------------


def snap(spark, path, order=("at",), start=None):
    return Snapshot(spark, str(path), ["city", "day"], "day", order, start)


def batch(spark, *rows):
    return spark.createDataFrame([(c, date.fromisoformat(d), at, v) for c, d, at, v in rows], "city string, day date, at int, v int")


def state(s, version=None):
    return {(x.city, x.day.isoformat()): x.v for x in s.read(version).collect()}


def test_newest_event_wins_over_batches(spark, tmp_path):
    s = snap(spark, tmp_path, start="2000-01-01")
    s.append(batch(spark, ("a", "2001-05-01", 5, 1), ("a", "2001-05-01", 7, 2), ("b", "2002-01-01", 1, 3), ("c", "1999-12-31", 9, 9)), 0)
    assert state(s) == {("a", "2001-05-01"): 2, ("b", "2002-01-01"): 3}
    s.append(batch(spark, ("a", "2001-05-01", 6, 4), ("b", "2002-01-01", 1, 5)), 1)  # an older event, and an equal one that comes later
    assert state(s) == {("a", "2001-05-01"): 2, ("b", "2002-01-01"): 5}
    assert state(s, 1) == {("a", "2001-05-01"): 2, ("b", "2002-01-01"): 3}
    later = snap(spark, tmp_path / "arrival", order=())
    later.append(batch(spark, ("a", "2001-05-01", 9, 1)), 0)
    later.append(batch(spark, ("a", "2001-05-01", 2, 2)), 1)
    assert state(later) == {("a", "2001-05-01"): 2}


def test_repeated_and_half_written_batches(spark, tmp_path):
    s = snap(spark, tmp_path)
    one = batch(spark, ("a", "2001-05-01", 5, 1))
    assert (s.append(one, 0), s.append(one, 0)) == (1, 1)
    # a batch whose writer died before its commit
    s._write(batch(spark, ("a", "2001-05-01", 9, 99)).withColumn("_version", F.lit(2).cast("long")), "batch-1")
    assert state(s) == {("a", "2001-05-01"): 1}
    assert s.append(batch(spark, ("a", "2001-05-01", 6, 2)), 1) == 2
    assert state(s) == {("a", "2001-05-01"): 2}
    assert len(s.expire(keep=1, older_than_s=0)) == 1 and state(s) == {("a", "2001-05-01"): 2}


def test_two_writers(spark, tmp_path):
    s, other = snap(spark, tmp_path), snap(spark, tmp_path)
    s.append(batch(spark, ("a", "2001-05-01", 5, 1)), 0)
    stale = other.manifest()
    s.append(batch(spark, ("b", "2001-05-01", 5, 2)), 1)
    with pytest.raises(Conflict):
        other.manifests.publish({**stale, "version": 2})
    other.append(batch(spark, ("c", "2003-05-01", 5, 3)), 0, "other")
    assert len(state(s)) == 3 and s.manifest()["version"] == 3
    with pytest.raises(ValueError):
        s.append(batch(spark, ("a", "2001-05-01", 5, 1)).drop("v"), 2)


def test_compaction_keeps_rows_and_later_deltas(spark, tmp_path):
    s = snap(spark, tmp_path)
    for k in range(6):
        s.append(batch(spark, ("a", "2001-05-01", k % 4, k), (f"c{k}", "2002-02-02", 0, k)), k)
    before = state(s)
    assert before["a", "2001-05-01"] == 3
    assert s.compact(most_deltas=6) == 6
    s.compact(most_deltas=3)
    assert {len(v) for v in s.manifest()["years"].values()} == {1} and state(s) == before
    plan = s.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # years with one folder are read as they are
    s.append(batch(spark, ("a", "2001-05-01", 3, 77)), 6)
    assert state(s)["a", "2001-05-01"] == 77
    s.expire(keep=1, older_than_s=0)
    assert state(s)["a", "2001-05-01"] == 77 and len(s.versions()) == 1
    opened = s.read()._jdf.queryExecution().executedPlan().toString()
    assert opened.count("PartitionFilters") == 2


def test_merge_stream_restarts(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for k in range(3):
        batch(spark, ("a", "2001-05-01", [2, 9, 4][k], k), (f"n{k}", "2001-05-02", 0, k)).write.mode("append").parquet(src)
        for _ in range(2):  # the second run has nothing new
            stream = spark.readStream.schema("city string, day date, at int, v int").parquet(src)
            jobs.merge_stream(stream, ["city", "day"], "day", "2000-01-01", out, cp, "at").awaitTermination()
    got = {(x.city, x.day.isoformat()): x.v for x in jobs.read_snapshot(spark, out).collect()}
    assert got == {("a", "2001-05-01"): 1, **{(f"n{k}", "2001-05-02"): k for k in range(3)}}


# --- rolling ----------------------------------------------------------------------------------------------------------


def test_trailing_figures_equal_windows():
    r = random.Random(4)
    t, seen, year_of = rolling.Trailing(), [], None
    for k in range(500):
        d = date(2000, 11, 1) + timedelta(days=k)
        v = tuple(r.choice([None, r.uniform(-9, 9)]) for _ in range(3))
        if d.year != year_of:
            seen, year_of = [], d.year
        seen.append(v)
        got = t.push(d.year, v)
        some = lambda n, c: [x[c] for x in seen[-n:] if x[c] is not None]  # noqa: B023, E731
        mean = lambda x: sum(x) / len(x) if x else None
        total = lambda x: sum(x) if x else None
        want = (mean(some(7, 0)), mean(some(30, 0)), total(some(7, 1)), None if v[1] is None else sum(some(400, 1)), total(some(7, 2)))
        assert [x is None for x in got] == [x is None for x in want]
        assert [x for x in got if x is not None] == pytest.approx([x for x in want if x is not None])


def test_rolling_stream_over_restarts_and_late_rows(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "city string, time date, temp_anomaly double, precip_anomaly double, snow_anomaly double"
    first = date(2001, 1, 1)
    day = lambda c, k, v: (c, first + timedelta(days=k), float(v), 1.0, None)
    landings = [
        [day("a", k, k) for k in (3, 0, 1)] + [day("b", 2, 5), day("a", 1, 100)],  # a day is sent twice
        [day("a", 2, 2), day("a", 20, 20), day("b", 3, 7)],
        [day("a", 2, 999), day("a", 4, 999), day("b", 21, 1), (None, date(2001, 6, 1), None, None, None)],  # day 4 is behind the watermark by now, day 2 final
    ]
    for rows_ in landings:
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        with rolling.state_store(spark):
            jobs.run_available(rolling.rolling_stream(stream, ["city"], "time", "10 days"), out, cp)
    got = {(x.city, (x.time - first).days): (x.temp_anomaly, x.rolling_7d_temp_anomaly, x.cumulative_precip_anomaly, x.rolling_7d_snow_anomaly) for x in spark.read.parquet(out).collect()}
    a = {0: 0.0, 1: got["a", 1][0], 2: 2.0, 3: 3.0, 20: 20.0}
    assert a[1] in (1.0, 100.0)
    want, seen = {}, []
    for k, v in a.items():
        seen.append(v)
        want["a", k] = (v, sum(seen) / len(seen), float(len(seen)), None)
    want |= {("b", 2): (5.0, 5.0, 1.0, None), ("b", 3): (7.0, 6.0, 2.0, None), ("b", 21): (1.0, 13 / 3, 3.0, None)}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v)
