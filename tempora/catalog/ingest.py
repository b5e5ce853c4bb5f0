"""Source, coercion, merge and predicate queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.catalog import climate, summaries
from tempora.catalog.base import B0, B1, CITY, MATRIX, MEASURES_SQL, RAW, SPEC, _DAILY_AGGS, query, with_sql
from tempora.functions import calendar as cal
from tempora.functions.json_safe import json_safe_table
from tempora.functions.numeric import clean_sentinel
from tempora.functions.plausibility import (
    KPI_BOUNDS, reasonable_mean_temperature, reasonable_precip_signal, reasonable_temperature_signal, within_or_na,
)
from tempora.operators import climatology as C
from tempora.operators import ingest as I
from tempora.session import shared_dir
from tempora.sources import files, payloads, star

M = " ".join(MEASURES_SQL)


def feed(spark, path, flag: str):
    """Daily table of one of three overlapping feeds (the return flags play that part)."""
    rows = clean_sentinel(star.raw_observations(spark, path))
    return star.daily_from_rows(rows.filter(F.col("l_returnflag") == flag))


FEEDS = RAW + "," + ",".join(
    f"\nfeed_{f} AS (SELECT city, time, {_DAILY_AGGS} FROM obs WHERE l_returnflag = '{f}' GROUP BY city, time)"
    for f in "ANR")


@query("clean_sentinel", "I1", with_sql(RAW) + """ SELECT city, time, temperature_2m_mean, precipitation_sum,
    snowfall_sum, sunshine_duration FROM obs""", "temperature_2m_mean snowfall_sum sunshine_duration")
def _(spark, path):
    return clean_sentinel(star.raw_observations(spark, path)).drop("l_returnflag", "l_linestatus")


@query(
    "lenient_coercion", "I2",
    """WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value,
        CASE WHEN event_type = 'click' AND value < 10 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events)
      SELECT event_id, TRY_CAST(value AS DOUBLE) AS value, TRY_CAST(day AS DATE) AS day FROM e
      WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL AND TRY_CAST(day AS DATE) IS NOT NULL""",
    "value",
)
def _(spark, path):
    ev = star.table(spark, path, "events")
    text = ev.select(
        "event_id",
        F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("value"),
        F.when((F.col("event_type") == "click") & (F.col("value") < 10), F.lit("not a date"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"))
    return I.coerce(text, numeric=["value"], dates=["day"], required=["value", "day"])


@query("allow_list", "I3", with_sql(CITY) + f" SELECT city, time, {', '.join(MEASURES_SQL)} FROM city_cal WHERE city IN ('ASIA', 'EUROPE')", M)
def _(spark, path):
    return I.allow_list(star.city_daily(spark, path), "city", ["asia", "Europe"], ignore_case=True)


@query(
    "allow_list_dimension", "I3 J8",
    with_sql(CITY) + """ SELECT city, time, precipitation_sum FROM city_cal
      WHERE city IN (SELECT r_name FROM region WHERE r_name LIKE 'A%')""",
    "precipitation_sum",
)
def _(spark, path):
    dim = star.table(spark, path, "region").filter(F.col("r_name").startswith("A")).select(F.col("r_name").alias("city"))
    return I.in_dimension(star.city_daily(spark, path).select("city", "time", "precipitation_sum"), dim, "city")


MONTHS_SQL = with_sql(CITY) + f" SELECT city, year AS part, time, {', '.join(MEASURES_SQL[:4])} FROM city_cal"


def _yearly_rows(spark, path):
    """Days of one entity and year as an array; at most 366 entries."""
    cols = MEASURES_SQL[:4]
    return (
        star.city_daily(spark, path).groupBy("city", F.year("time").alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("time", *cols))).alias("rows"))
    )


@query("columnar_json", "I4", MONTHS_SQL, " ".join(MEASURES_SQL[:4]))
def _(spark, path):
    cols = MEASURES_SQL[:4]
    arrays = [F.transform("rows.time", lambda t: t.cast("string")).alias("time")]
    arrays += [F.col(f"rows.{c}").alias(c) for c in cols]
    landed = _yearly_rows(spark, path).select(
        "city", "part", F.to_json(F.struct(F.struct(*arrays).alias("daily"))).alias("payload"))
    return payloads.columnar_daily(landed, "payload", list(cols), ["city", "part"])


@query(
    "parameter_map_json", "I5",
    with_sql(CITY) + """ SELECT city, year AS part, time, temperature_2m_mean, temperature_2m_min, temperature_2m_max,
      precipitation_sum, CAST(NULL AS DOUBLE) AS wind_speed_10m_max, CAST(NULL AS DOUBLE) AS snowfall_sum,
      CAST(NULL AS DOUBLE) AS sunshine_duration, CAST(NULL AS DOUBLE) AS et0_fao_evapotranspiration FROM city_cal""",
    " ".join(MEASURES_SQL[:4]),
)
def _(spark, path):
    def entries(c):
        known = F.filter("rows", lambda r: r[c].isNotNull())
        return F.map_from_entries(F.transform(known, lambda r: F.struct(F.date_format(r["time"], "yyyyMMdd"), r[c])))

    names = {n: c for n, c in payloads.POWER_PARAMETERS.items() if c in MEASURES_SQL[:4]}
    maps = F.create_map(*[x for n, c in names.items() for x in (F.lit(n), entries(c))])
    landed = _yearly_rows(spark, path).select(
        "city", "part", F.to_json(F.struct(F.struct(maps.alias("parameter")).alias("properties"))).alias("payload"))
    return payloads.parameter_maps(landed, "payload", ["city", "part"])


@query("statistics_cube_json", "I6", with_sql(summaries.DD) + " SELECT city, month, hdd FROM hdd WHERE hdd >= 500", "hdd")
def _(spark, path):
    # cells under 500 are withheld from the cube; one entity labels its months without a dash
    series = summaries.hdd_series(spark, path)
    pos = F.row_number().over(Window.partitionBy("city").orderBy("month")) - 1
    label = F.when(F.col("city") == "ASIA", F.replace("month", F.lit("-"), F.lit(""))).otherwise(F.col("month"))
    entry = F.struct(label.alias("label"), F.col("pos"), F.when(F.col("hdd") >= 500, F.col("hdd")).alias("hdd"))
    cube = series.withColumn("pos", pos).groupBy("city").agg(F.collect_list(entry).alias("m"))
    index = F.map_from_entries(F.transform("m", lambda e: F.struct(e["label"], e["pos"])))
    known = F.filter("m", lambda e: e["hdd"].isNotNull())
    value = F.map_from_entries(F.transform(known, lambda e: F.struct(e["pos"].cast("string"), e["hdd"])))
    payload = F.to_json(F.struct(
        F.struct(F.struct(F.struct(index.alias("index")).alias("category")).alias("time")).alias("dimension"),
        value.alias("value")))
    return payloads.statistics_cube(cube.select("city", payload.alias("payload")), "payload", ["city"])


@query(
    "source_priority", "I7",
    with_sql(FEEDS) + """, u AS (SELECT *, 0 AS source FROM feed_A UNION ALL SELECT *, 1 FROM feed_N
      UNION ALL SELECT *, 2 FROM feed_R)
      SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY city, time ORDER BY source) = 1""",
    M,
)
def _(spark, path):
    rows = clean_sentinel(star.raw_observations(spark, path))
    return I.merge_tagged(star.daily_from_rows(rows, ["l_returnflag"]), ["city", "time"], "l_returnflag", list("ANR"), "source")


@query(
    "incremental_range", "I8",
    with_sql(FEEDS) + """ SELECT city, max(time) AS last_date, CAST(max(time) + 1 AS DATE) AS fetch_start,
      DATE '2001-11-04' AS fetch_end, max(time) + 1 > DATE '2001-11-04' AS up_to_date FROM feed_A
      WHERE time < DATE '2001-10-01' GROUP BY city""",
)
def _(spark, path):
    existing = feed(spark, path, "A").filter(F.col("time") < F.lit("2001-10-01").cast("date"))
    return I.incremental_range(existing, "city", "time", "2001-11-04")


@query(
    "incremental_delta", "I8",
    with_sql(FEEDS) + """, last AS (SELECT city, max(time) AS d FROM feed_A WHERE time < DATE '2001-10-01' GROUP BY city)
      SELECT n.* FROM feed_N n LEFT JOIN last USING (city) WHERE n.time <= DATE '2001-11-04' AND (d IS NULL OR n.time > d)""",
    M,
)
def _(spark, path):
    existing = feed(spark, path, "A").filter(F.col("time") < F.lit("2001-10-01").cast("date"))
    return I.delta_rows(feed(spark, path, "N"), existing, "city", "time", "2001-11-04")


@query(
    "merge_existing_wins", "I9",
    with_sql(FEEDS) + """ SELECT * FROM feed_A UNION ALL
      SELECT * FROM feed_N WHERE (city, time) NOT IN (SELECT (city, time) FROM feed_A)""",
    M,
)
def _(spark, path):
    return I.merge_existing_wins(feed(spark, path, "A"), feed(spark, path, "N"), ["city", "time"])


@query(
    "merge_newest_wins", "I10",
    with_sql(FEEDS) + """ SELECT * FROM feed_N WHERE time >= DATE '1996-03-01' UNION ALL
      SELECT * FROM feed_A WHERE time >= DATE '1996-03-01' AND (city, time) NOT IN (SELECT (city, time) FROM feed_N)""",
    M,
)
def _(spark, path):
    start = F.lit("1996-03-01").cast("date")
    return I.merge_newest_wins(feed(spark, path, "A"), feed(spark, path, "N"), ["city", "time"], "time", start)


@query(
    "coverage_guard", "I11 A28",
    with_sql(FEEDS) + """, n AS (SELECT * FROM feed_N WHERE time >= DATE '2001-06-01'),
      f AS (SELECT (SELECT count(DISTINCT year(time)) FROM feed_A) AS existing_years,
        (SELECT count(DISTINCT time) FROM n) AS new_days,
        (SELECT count(DISTINCT year(time)) FROM (SELECT time FROM feed_A UNION ALL SELECT time FROM n)) AS merged_years)
      SELECT *, new_days < 180 AS short_delta, CASE WHEN merged_years >= 7 THEN 'write'
        WHEN existing_years >= 7 THEN 'keep_existing' ELSE 'fail' END AS decision FROM f""",
)
def _(spark, path):
    new = feed(spark, path, "N").filter(F.col("time") >= F.lit("2001-06-01").cast("date"))
    return I.coverage_guard(feed(spark, path, "A"), new, "time", 7)


@query(
    "missing_entities", "I12 J8",
    """SELECT n_name AS nation FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""",
)
def _(spark, path):
    names = star.table(spark, path, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    supplied = star.table(spark, path, "supplier").filter(F.col("s_acctbal") > 5000).select("s_nationkey")
    present = supplied.join(F.broadcast(names), F.col("s_nationkey") == F.col("n_nationkey")).select("nation")
    return I.missing_entities(names.select("nation"), present, "nation")


@query(
    "append_frames", "I13",
    with_sql(FEEDS) + """ SELECT * FROM feed_A UNION ALL
      SELECT city, time, temperature_2m_mean, temperature_2m_min, temperature_2m_max, precipitation_sum,
        NULL, NULL, NULL, NULL FROM feed_N""",
    M,
)
def _(spark, path):
    return I.append([feed(spark, path, "A"), feed(spark, path, "N").select("city", "time", *MEASURES_SQL[:4])])


@query("dataset_profile", "I14", with_sql(CITY) + " SELECT count(*) AS rows, min(time) AS min_date, max(time) AS max_date FROM city_cal")
def _(spark, path):
    return I.profile(star.city_daily(spark, path), "time")


@query(
    "distinct_years_days", "A28",
    with_sql(CITY) + " SELECT city, count(DISTINCT year) AS years, count(DISTINCT time) AS days FROM city_cal GROUP BY city",
)
def _(spark, path):
    return I.distinct_counts(star.city_daily(spark, path), "city", "time")


@query(
    "csv_sink_ordered", "I15 I1",
    with_sql(MATRIX) + " SELECT city, year, month, round(mean_temp + 1e-9, 4) + 0.0 AS mean_temp, days FROM matrix",
)
def _(spark, path):
    out = shared_dir(spark, "matrix-csv")
    m = climate.matrix(spark, path).select(
        "city", "year", "month", (F.round(F.col("mean_temp") + F.lit(1e-9), 4) + F.lit(0.0)).alias("mean_temp"), "days")
    files.write_ordered_csv(m, out, ["city", "year", "month"])
    return spark.read.option("header", True).schema("city string, year int, month int, mean_temp double, days long").csv(out)


@query("json_lines_sink", "I16", with_sql(MATRIX) + " SELECT city, year, month, anomaly, z_score FROM matrix", "anomaly z_score")
def _(spark, path):
    out = shared_dir(spark, "matrix-json")
    files.write_json_lines(climate.matrix(spark, path).select("city", "year", "month", "anomaly", "z_score"), out)
    return spark.read.schema("city string, year int, month int, anomaly double, z_score double").json(out)


@query(
    "json_safe_numbers", "I17",
    with_sql(CITY) + """ SELECT city, year, month, CASE WHEN max(time) > DATE '2001-06-01' THEN NULL ELSE avg(precipitation_sum) END AS mean_precip,
      CASE WHEN month = 2 THEN NULL ELSE sum(snowfall_sum) END AS snow FROM city_cal GROUP BY city, year, month""",
    "mean_precip snow",
)
def _(spark, path):
    # late months carry NaN and February carries an infinity, both nested
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    d = cal.with_calendar(star.city_daily(spark, path)).groupBy("city", "year", "month").agg(
        F.avg("precipitation_sum").alias("p"), F.sum("snowfall_sum").alias("s"), F.max("time").alias("t"))
    late = F.col("t") > F.lit("2001-06-01").cast("date")
    doc = F.struct(
        F.when(late, nan).otherwise(F.col("p")).alias("mean"),
        F.array(F.when(F.col("month") == 2, inf).otherwise(F.col("s"))).alias("series"),
        F.create_map(F.lit("s"), F.when(F.col("month") == 2, -inf).otherwise(F.col("s"))).alias("byname"))
    safe = json_safe_table(d.select("city", "year", "month", doc.alias("doc")))
    return safe.select("city", "year", "month", F.col("doc.mean").alias("mean_precip"),
                       F.coalesce(F.col("doc.series")[0], F.col("doc.byname")["s"]).alias("snow"))


@query(
    "empty_result_gate", "I18",
    with_sql(MATRIX) + """ SELECT count(*) AS rows, count(*) > 0 AS passed,
      CASE WHEN count(*) = 0 THEN 'result is empty' END AS reason FROM matrix WHERE year > 2001""",
)
def _(spark, path):
    return I.non_empty_gate(climate.matrix(spark, path).filter(F.col("year") > SPEC.current_year))


PLACES = (("ASIA", 34.0, 100.0), ("EUROPE", 54.5, 15.3), ("AFRICA", 8.8, 34.5))


@query(
    "in_memory_dimension", "I19",
    with_sql(CITY) + """, places(city, lat, lon) AS (VALUES ('ASIA', CAST(34.0 AS DOUBLE), CAST(100.0 AS DOUBLE)),
      ('EUROPE', CAST(54.5 AS DOUBLE), CAST(15.3 AS DOUBLE)), ('AFRICA', CAST(8.8 AS DOUBLE), CAST(34.5 AS DOUBLE)))
      SELECT city, lat, lon, count(*) AS days FROM city_cal JOIN places USING (city) GROUP BY city, lat, lon""",
)
def _(spark, path):
    places = spark.createDataFrame(list(PLACES), "city string, lat double, lon double")
    days = star.city_daily(spark, path).groupBy("city").agg(F.count("*").alias("days"))
    return days.join(places, "city")


@query(
    "calendar_fields", "P1",
    with_sql(CITY) + """ SELECT city, time, year, month, CAST(day(time) AS INTEGER) AS day,
      CAST(dayofyear(time) AS INTEGER) AS day_of_year, month_day FROM city_cal""",
)
def _(spark, path):
    return cal.with_calendar(star.city_daily(spark, path).select("city", "time"))


@query(
    "trailing_years", "P4",
    with_sql(MATRIX) + """ SELECT city, year, month, mean_temp, days FROM monthly
      QUALIFY year > max(year) OVER (PARTITION BY city) - 3""",
    "mean_temp",
)
def _(spark, path):
    return cal.trailing_years(C.monthly_means(star.city_daily(spark, path), SPEC), ["city"], 3)


@query(
    "baseline_years_pushed", "P5",
    with_sql(CITY) + f" SELECT city, count(*) AS days, min(time) AS first_day, max(time) AS last_day FROM city_cal WHERE year BETWEEN {B0} AND {B1} GROUP BY city",
)
def _(spark, path):
    return star.city_daily(spark, path, B0, B1).groupBy("city").agg(
        F.count("*").alias("days"), F.min("time").alias("first_day"), F.max("time").alias("last_day"))


@query(
    "plausibility", "P8",
    with_sql(climate.CITY_MONTHLY) + """ SELECT city, month,
      coalesce(abs(temp_anomaly) <= 15.0 AND abs(temp_zscore) <= 6.0, false) AS temp_ok,
      coalesce(abs(precip_anomaly) <= 600.0 AND abs(precip_zscore) <= 8.0, false) AS precip_ok,
      coalesce(abs(current_temp_mean) <= 25.0, false) AS mean_ok FROM monthly_anom""",
)
def _(spark, path):
    return climate.city_monthly(spark, path).select(
        "city", "month",
        reasonable_temperature_signal(F.col("temp_anomaly"), F.col("temp_zscore")).alias("temp_ok"),
        reasonable_precip_signal(F.col("precip_anomaly"), F.col("precip_zscore")).alias("precip_ok"),
        reasonable_mean_temperature(F.col("current_temp_mean")).alias("mean_ok"))


def _shown_sql(col: str, kind: str) -> str:
    b = KPI_BOUNDS[kind]
    fmt = f"%{'+' if b.signed else ''}.{b.digits}f"
    val = f"printf('{fmt}', round({col}, {b.digits}) + 0.0)" + (f" || ' {b.unit}'" if b.unit else "")
    return f"CASE WHEN {col} BETWEEN {b.low} AND {b.high} THEN {val} ELSE 'N/A' END"


@query(
    "display_bounds", "P9",
    with_sql(summaries.CITY_FULL) + f""" SELECT city, {_shown_sql('temp_deviation', 'anomaly')} AS temp_anomaly,
      {_shown_sql('temp_zscore', 'zscore')} AS temp_z, {_shown_sql('expected_temp_mean', 'mean')} AS baseline_mean,
      {_shown_sql('expected_temp_std', 'std')} AS baseline_std,
      {_shown_sql('precip_deviation', 'precip')} AS precip_anomaly FROM full_summary""",
)
def _(spark, path):
    s = summaries.city_summary(spark, path)
    return s.select(
        "city",
        within_or_na(F.col("temp_deviation"), "anomaly").alias("temp_anomaly"),
        within_or_na(F.col("temp_zscore"), "zscore").alias("temp_z"),
        within_or_na(F.col("expected_temp_mean"), "mean").alias("baseline_mean"),
        within_or_na(F.col("expected_temp_std"), "std").alias("baseline_std"),
        within_or_na(F.col("precip_deviation"), "precip").alias("precip_anomaly"))


@query("keyed_sum", "A27", "SELECT event_type, sum(value) AS total FROM events GROUP BY event_type", "total")
def _(spark, path):
    return I.word_sums(star.table(spark, path, "events"), "event_type", "value")
