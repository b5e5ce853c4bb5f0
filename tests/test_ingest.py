"""Readers, payloads, merges, guards, degree days and gates."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from tempora.functions.json_safe import json_safe_table
from tempora.functions.position import with_global_position
from tempora.operators import degree_days as D
from tempora.operators import gates as G
from tempora.operators import ingest as I
from tempora.sources import files, payloads
from tempora.spec import ObservationSpec

SPEC = ObservationSpec()


def test_csv_scan_cleans_fill_values(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text("time,temperature_2m_mean,city,note\n2024-01-01,-999.0,A,x\n2024-01-02,NaN,A,y\n2024-01-03,oops,A,z\n2024-01-04,2.5,A,w\n")
    out = files.read_observations_csv(spark, str(p), SPEC).orderBy("time")
    assert dict(out.dtypes)["temperature_2m_mean"] == "double" and dict(out.dtypes)["time"] == "date"
    assert [r["temperature_2m_mean"] for r in out.collect()] == [None, None, None, 2.5]


def test_ordered_csv_and_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([("B", 1), ("A", 2), ("C", 0)], "city string, n int").repartition(3)
    files.write_ordered_csv(df, str(tmp_path / "csv"), ["city"])
    text = "".join(f.read_text().split("\n", 1)[1] for f in sorted((tmp_path / "csv").glob("part-*")))
    assert text.split() == ["A,2", "B,1", "C,0"]
    files.write_json_lines(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_columnar_payload(spark):
    df = spark.createDataFrame([('{"daily":{"time":["2024-01-01","2024-01-02"],"t":[1.5,null]}}',)], "p string")
    rows = payloads.columnar_daily(df, "p", ["t"]).collect()
    assert [(r["time"], r["t"]) for r in rows] == [(date(2024, 1, 1), 1.5), (date(2024, 1, 2), None)]


def test_parameter_maps_take_the_union_of_days(spark):
    doc = '{"properties":{"parameter":{"T2M":{"20240101":1.0},"PRECTOTCORR":{"20240102":2.0}}}}'
    rows = payloads.parameter_maps(spark.createDataFrame([(doc,)], "p string"), "p").orderBy("time").collect()
    assert [(r["time"].day, r["temperature_2m_mean"], r["precipitation_sum"], r["snowfall_sum"]) for r in rows] == [
        (1, 1.0, None, None), (2, None, 2.0, None)]


def test_statistics_cube(spark):
    doc = ('{"dimension":{"time":{"category":{"index":{"2024-02":1,"202401":0,"2024-03":2}}}},"value":{"0":500.0,"1":400.0}}')
    rows = payloads.statistics_cube(spark.createDataFrame([(doc,)], "p string"), "p").orderBy("month").collect()
    assert [(r["month"], r["hdd"]) for r in rows] == [("2024-01", 500.0), ("2024-02", 400.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "city string, time date, v double")


def test_merges(spark):
    old = frame(spark, [("A", date(2024, 1, 1), 1.0), ("A", date(2023, 1, 1), 0.0)])
    new = frame(spark, [("A", date(2024, 1, 1), 9.0), ("A", date(2024, 1, 2), 2.0), ("A", date(2024, 1, 2), 3.0)])
    keep = {r["time"]: r["v"] for r in I.merge_existing_wins(old, new, ["city", "time"]).collect()}
    assert keep[date(2024, 1, 1)] == 1.0 and len(keep) == 3
    newest = I.merge_newest_wins(old, new, ["city", "time"], "time", F.lit("2024-01-01").cast("date"))
    got = {r["time"]: r["v"] for r in newest.collect()}
    assert got == {date(2024, 1, 1): 9.0, date(2024, 1, 2): 2.0}
    again = I.merge_newest_wins(newest, new, ["city", "time"], "time", F.lit("2024-01-01").cast("date"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, newest.collect()))


def test_incremental_range_and_delta(spark):
    old = frame(spark, [("A", date(2024, 1, 5), 1.0), ("B", date(2024, 1, 9), 1.0)])
    r = {x["city"]: x for x in I.incremental_range(old, "city", "time", "2024-01-09").collect()}
    assert r["A"]["fetch_start"] == date(2024, 1, 6) and not r["A"]["up_to_date"] and r["B"]["up_to_date"]
    landed = frame(spark, [(c, date(2024, 1, d), 0.0) for c in "ABC" for d in (5, 6, 10)])
    got = sorted((x["city"], x["time"].day) for x in I.delta_rows(landed, old, "city", "time", "2024-01-09").collect())
    assert got == [("A", 6), ("C", 5), ("C", 6)]


@pytest.mark.parametrize("years,need,decision", [((2020, 2021, 2022), 3, "write"), ((2020,), 3, "fail")])
def test_coverage_guard(spark, years, need, decision):
    old = frame(spark, [("A", date(y, 1, 1), 1.0) for y in years])
    new = frame(spark, [("A", date(years[-1], 1, 2), 1.0)])
    r = I.coverage_guard(old, new, "time", need).first()
    assert r["decision"] == decision and r["short_delta"]


def test_missing_entities_and_gate(spark):
    dim = spark.createDataFrame([("A",), ("B",)], "city string")
    t = frame(spark, [("A", date(2024, 1, 1), 1.0)])
    assert [r["city"] for r in I.missing_entities(dim, t, "city").collect()] == ["B"]
    assert not I.non_empty_gate(t.filter("v > 5")).first()["passed"]
    with pytest.raises(RuntimeError):
        I.require_rows(t.filter("v > 5"))


def test_word_sums(spark):
    pairs = [("distributed", 3), ("beam", 5), ("flink", 2), ("computing", 4), ("distributed", 1), ("flink", 3), ("learning", 2)]
    got = {r["word"]: r["total"] for r in I.word_sums(spark.createDataFrame(pairs, "word string, n int"), "word", "n").collect()}
    assert got == {"distributed": 4, "beam": 5, "flink": 5, "computing": 4, "learning": 2}


def test_json_safe_nested(spark):
    df = spark.range(1).select(
        F.struct(F.lit(float("nan")).alias("a"), F.array(F.lit(float("inf")), F.lit(1.0)).alias("b"),
                 F.create_map(F.lit("k"), F.lit(float("-inf"))).alias("m"), F.lit("x").alias("s")).alias("d"))
    d = json_safe_table(df).first()["d"]
    assert (d["a"], d["b"], d["m"], d["s"]) == (None, [None, 1.0], {"k": None}, "x")


def hdd(spark, years, value=lambda y, m: 100.0, until=12):
    rows = [("LT", f"{y}-{m:02d}", value(y, m)) for y in years for m in range(1, 13) if y < max(years) or m <= until]
    return spark.createDataFrame(rows, "geo string, month string, hdd double")


def test_degree_days_ytd(spark):
    s = hdd(spark, range(1991, 2026), lambda y, m: 50.0 if y == 2025 else 100.0, until=3)
    r = D.ytd_degree_days(s, "geo", (1991, 2020)).first()
    assert (r["months"], r["total_hdd"], r["baseline_mean"], r["anomaly"]) == (3, 150.0, 300.0, -150.0)
    assert r["label"] == "Jan–Mar 2025"
    full = D.ytd_degree_days(hdd(spark, range(1991, 2025)), "geo", (1991, 2020)).first()
    assert full["label"] == "Full year 2024" and full["anomaly"] == 0.0


def test_degree_days_season(spark):
    s = hdd(spark, range(1991, 2026), until=2)
    r = D.season_degree_days(s, "geo", (1991, 2020)).first()
    assert (r["label"], r["months_included"], r["total_hdd"]) == ("2024/25", 5, 500.0)
    # season 2020 counts with its autumn months only
    assert r["baseline_mean"] == pytest.approx((29 * 500 + 300) / 30)
    strict = D.season_degree_days(s, "geo", (1991, 2020), complete_seasons_only=True).first()
    assert strict["baseline_mean"] == pytest.approx(500.0)


def test_degree_days_season_fallback(spark):
    only_summer = spark.createDataFrame([("LT", "2024-06", 1.0), ("LT", "2023-02", 7.0)], "geo string, month string, hdd double")
    r = D.season_degree_days(only_summer, "geo", (1991, 2020)).first()
    assert (r["label"], r["months_included"], r["total_hdd"]) == ("2022/23", 1, 7.0)
    bare = spark.createDataFrame([("LT", "2024-06", 1.0)], "geo string, month string, hdd double")
    r = D.season_degree_days(bare, "geo", (1991, 2020)).first()
    assert (r["label"], r["months_included"], r["total_hdd"]) == ("2023/24", 0, 0.0)


def test_degree_days_empty_and_lag(spark):
    empty = hdd(spark, [2024]).filter("hdd < 0")
    r = D.empty_as_zeros(D.ytd_degree_days(empty, "geo", (1991, 2020))).first()
    assert (r["label"], r["total_hdd"]) == ("n/a", 0.0)
    lag = D.publication_lag(hdd(spark, [2023, 2024], until=6), "geo", date(2025, 3, 1)).first()
    assert (lag["data_through"], lag["data_lag_months"]) == ("2024-06", 9)
    assert D.recent_months(hdd(spark, [2023, 2024]), "geo").count() == 12


def test_month_slice_gate(spark):
    def gate(n, days, z):
        rows = [("V", 3, 2000 + i, days, z if i == 0 else 0.1) for i in range(n)]
        df = spark.createDataFrame(rows, "city string, month int, year int, days_observed long, zscore double")
        return G.month_slice_gate(df, ["city", "month"], 30, 10, 3.5).collect()

    assert gate(25, 16, 0.0)[0]["first_failure"] == "years_included"
    assert gate(30, 3, 0.0)[0]["first_failure"] == "min_days"
    assert gate(30, 16, 4.5)[0]["first_failure"] == "max_abs_z"
    ok = gate(30, 16, 1.0)
    assert ok[0]["first_failure"] is None and all(r["passed"] for r in ok)


def test_weather_gate_skips_missing_z_and_running_month(spark):
    s = spark.createDataFrame([(60, None, 1.0)], "days_observed long, temp_zscore double, precip_zscore double")
    m = spark.createDataFrame([(1, 31, 1.0, 1.0), (2, 3, 0.5, 4.0)], "month int, days long, temp_zscore double, precip_zscore double")
    rows = {r["check"]: r for r in G.weather_gate(s, m, []).collect()}
    assert rows["temp_zscore"]["passed"] and rows["weak_months"]["passed"]
    assert rows["days_observed"]["first_failure"] == "extreme_precip_months"


def test_model_gate(spark):
    m = spark.createDataFrame([(60.0, 0.9)], "mse double, r2 double")
    assert G.model_gate(m).first()["first_failure"] == "mse"


def test_global_position_is_a_permutation_in_order(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    out = with_global_position(df, [("b", F.col("k"))], [F.col("id").desc()]).orderBy("position").collect()
    want = sorted(((i % 7, -i) for i in range(1000)))
    assert [(r["k"], -r["id"]) for r in out] == want
    assert [r["position"] for r in out] == list(range(1000)) and out[0]["total"] == 1000
    assert not math.isnan(out[0]["position"])


def test_csv_files_of_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,temperature_2m_mean,precipitation_sum,city\n2020-01-01,1.0,9.0,X\n")
    (tmp_path / "b.csv").write_text("city,precipitation_sum,time,temperature_2m_mean\nX,9.0,2020-01-02,1.0\n")
    (tmp_path / "c.csv").write_text("time,city\n2020-01-03,X\n")
    out = files.read_observations_csv(spark, str(tmp_path), SPEC).orderBy("time").collect()
    assert [(r["temperature_2m_mean"], r["precipitation_sum"], r["city"]) for r in out] == [(1.0, 9.0, "X")] * 2 + [(None, None, "X")]


def test_champion_of_equal_versions_does_not_depend_on_the_order(spark):
    from tempora.operators import ledger as L

    rows = [("m", 1, 3, True), ("m", 2, 3, True), ("m", 9, 2, True)]
    for r in (rows, rows[::-1]):
        df = spark.createDataFrame(r, "model string, run_id int, version int, passed boolean")
        assert [tuple(x) for x in L.champion(df).collect()] == [("m", 3, 2)]


def test_run_history_is_whole(spark):
    from tempora.operators import ledger as L

    df = spark.createDataFrame([("a", i, i, {"r": 1.0}) for i in range(300)], "name string, run_id int, start_time int, metrics map<string,double>")
    assert L.run_history(df, "a", ["r"]).count() == 300
    assert L.run_history(df, "a", ["r"], limit=200).count() == 200


def test_shared_folder_is_required_off_one_machine(spark, monkeypatch):
    from tempora import session

    class Elsewhere:
        class conf:
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:
            master = "spark://host"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_root(Elsewhere)
