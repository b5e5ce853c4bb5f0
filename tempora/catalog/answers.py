"""Question answering queries. Questions are written from the result tables and the benchmark texts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tempora.catalog import climate, models, summaries, text
from tempora.catalog.base import REGISTRY, B0, B1, CITY, MATRIX, SPEC, query, with_sql
from tempora.functions.calendar import month_name
from tempora.operators import answers as A
from tempora.operators import climatology as C
from tempora.operators import features as FT
from tempora.operators import modeling as MD
from tempora.operators import retrieval as R
from tempora.operators import sft as SFT
from tempora.session import ensure_checkpoint_dir
from tempora.sources import star

TODAY = date(2001, 11, 4)
BASE = f"{B0}–{B1}"
KEY = "question"


def _asked(m):
    """Question texts over a matrix-like frame with city, year and month."""
    y, mn, c = F.col("year").cast("string"), month_name(F.col("month")), F.col("city")
    forms = [
        F.concat(F.lit("Which month in "), y, F.lit(" was the warmest in "), c, F.lit("?")),
        F.concat(F.lit("Which month in "), y, F.lit(" was the coldest in "), F.initcap(c), F.lit("?")),
        F.concat(F.lit("Which month in "), (F.col("year") + 50).cast("string"), F.lit(" was the coldest in "), c, F.lit("?")),
        F.concat(F.lit("Which month of "), y, F.lit(" had the highest figure?")),
        F.concat(F.lit("Which year was the coldest "), mn, F.lit(" in "), c, F.lit("?")),
        F.concat(F.lit("What was the hottest "), mn, F.lit("?")),
        F.concat(F.lit("Is this "), mn, F.lit(" in "), c, F.lit(" warmer than "), y, F.lit("?")),
    ]
    return m.select(F.explode(F.array(*forms)).alias(KEY)).distinct()


QUESTIONS = """
qs AS (SELECT DISTINCT unnest([
    'Which month in ' || year || ' was the warmest in ' || city || '?',
    'Which month in ' || year || ' was the coldest in ' || array_to_string(list_transform(string_split(city, ' '),
        lambda w: upper(left(w, 1)) || lower(substring(w, 2))), ' ') || '?',
    'Which month in ' || (year + 50) || ' was the coldest in ' || city || '?',
    'Which month of ' || year || ' had the highest figure?',
    'Which year was the coldest ' || monthname(make_date(2000, month, 1)) || ' in ' || city || '?',
    'What was the hottest ' || monthname(make_date(2000, month, 1)) || '?',
    'Is this ' || monthname(make_date(2000, month, 1)) || ' in ' || city || ' warmer than ' || year || '?']) AS question
  FROM monthly)"""
MONTH_CASE = "CASE " + " ".join(
    f"WHEN contains(q, '{n.lower()}') THEN {i}" for i, n in enumerate(A.MONTH_NAMES, 1)) + " END"


def _has_sql(phrases):
    return "(" + " OR ".join(f"contains(q, '{p}')" for p in phrases) + ")"


SLOTS = MATRIX + "," + QUESTIONS + f""",
slots0 AS (SELECT question, lower(trim(question)) AS q FROM qs),
slots AS (SELECT question, q, TRY_CAST(regexp_extract(q, '{A.YEAR_PATTERN}', 1) AS INTEGER) AS year,
  TRY_CAST(regexp_extract(q, '{A.COMPARISON_YEAR_PATTERN}', 1) AS INTEGER) AS comparison_year,
  CAST({MONTH_CASE} AS INTEGER) AS month,
  CASE WHEN {_has_sql(A.COLD_WORDS)} THEN 'coldest' WHEN {_has_sql(A.WARM_WORDS)} THEN 'warmest' END AS month_extreme,
  CASE WHEN {_has_sql(A.COLD_WORDS_YEAR)} THEN 'coldest' WHEN {_has_sql(A.WARM_WORDS_YEAR)} THEN 'warmest' END AS year_extreme,
  {_has_sql(('warmer', 'colder'))} AS compares, contains(q, 'this') AS says_this,
  (SELECT min(r_name) FROM region WHERE contains(q, lower(r_name))) AS chosen FROM slots0)"""

ROUND2 = """
m2 AS (SELECT city, year, month, round(mean_temp + 1e-9, 2) + 0.0 AS mean_temp, days, round(anomaly + 1e-9, 2) + 0.0 AS anomaly,
  round(z_score + 1e-9, 2) + 0.0 AS z_score FROM matrix)"""


def matrix2(spark, path):
    cols = ["mean_temp", "anomaly", "z_score"]
    return climate.matrix(spark, path).withColumns(
        {c: F.round(F.col(c) + F.lit(1e-9), 2) + F.lit(0.0) for c in cols}).drop("baseline_mean", "baseline_std")


def questions(m):
    return _asked(m)


def slots(spark, m, qs):
    cities = m.select("city").distinct()
    return A.with_entity(A.with_slots(qs, KEY, TODAY), cities, "city", KEY)


@query(
    "question_slots", "F16",
    with_sql(SLOTS) + " SELECT question, year, comparison_year, month, month_extreme, year_extreme, compares, says_this, chosen FROM slots",
)
def _(spark, path):
    m = C.monthly_means(star.city_daily(spark, path), SPEC)
    return slots(spark, m, questions(m)).drop("normalized", "target_date")


_LABEL = "left(monthname(make_date(2000, {m}, 1)), 3)"


@query(
    "year_month_answers", "R7 T-4",
    with_sql(SLOTS, ROUND2) + f""", asked AS (SELECT question, coalesce(chosen, (SELECT min(city) FROM m2)) AS city, year, year_extreme AS extreme
        FROM slots WHERE year IS NOT NULL AND year_extreme IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY city, year ORDER BY anomaly DESC, month) AS wr,
        row_number() OVER (PARTITION BY city, year ORDER BY anomaly, month) AS cr FROM m2 WHERE anomaly IS NOT NULL),
      sp AS (SELECT city, min(year) AS y0, max(year) AS y1 FROM m2 GROUP BY city),
      j AS (SELECT a.*, y0, y1, b.month AS bm, b.mean_temp AS bt, b.anomaly AS ba, coalesce(b.z_score, 0.0) AS bz, n.month AS nm, n.anomaly AS na,
        EXISTS (SELECT 1 FROM m2 WHERE m2.city = a.city AND m2.year = a.year) AS known FROM asked a JOIN sp USING (city)
        LEFT JOIN r b ON b.city = a.city AND b.year = a.year AND CASE a.extreme WHEN 'warmest' THEN b.wr ELSE b.cr END = 1
        LEFT JOIN r n ON n.city = a.city AND n.year = a.year AND CASE a.extreme WHEN 'warmest' THEN n.wr ELSE n.cr END = 2)
      SELECT question, CASE WHEN NOT known THEN 'No data for ' || city || ' in ' || year || '. Available years: ' || y0 || '–' || y1 || '.'
        ELSE 'The ' || extreme || ' month in ' || city || ' ' || year || ' was ' || {_LABEL.format(m='bm')} || ', with mean temperature '
        || printf('%.1f', round(bt, 1) + 0.0) || ' °C and anomaly ' || printf('%+.2f', ba) || ' °C (z-score ' || printf('%+.2f', bz)
        || ' vs {BASE} baseline).' || coalesce(' Runner-up: ' || {_LABEL.format(m='nm')} || ' (anomaly ' || printf('%+.2f', na) || ' °C).', '') END AS answer,
        CASE WHEN NOT known THEN '' ELSE {_LABEL.format(m='bm')} || ' ' || year || ' was the ' || extreme || ' month in ' || city || ' that year.' END AS interpretation,
        CASE WHEN known THEN city || ' regional anomalies' END AS source_title FROM j WHERE NOT known OR bm IS NOT NULL""",
)
@star.one_daily_pass
def _(spark, path):
    m = matrix2(spark, path)
    return A.year_month_answers(slots(spark, m, questions(m)), m, "city", KEY, BASE)


def as_history(m):
    return m.withColumnsRenamed({"mean_temp": "mean_temp_c", "anomaly": "anomaly_c", "z_score": "zscore"})


@query(
    "month_extreme_answers", "R8 T-3",
    with_sql(SLOTS, ROUND2) + """, asked AS (SELECT question, coalesce(chosen, 'EUROPE') AS city, month, month_extreme AS extreme
        FROM slots WHERE month IS NOT NULL AND month_extreme IS NOT NULL),
      w AS (SELECT *, 'warmest' AS kind FROM m2 WHERE anomaly IS NOT NULL QUALIFY row_number() OVER (PARTITION BY city, month ORDER BY anomaly DESC, year) = 1
        UNION ALL SELECT *, 'coldest' FROM m2 WHERE anomaly IS NOT NULL QUALIFY row_number() OVER (PARTITION BY city, month ORDER BY anomaly, year) = 1)
      SELECT question, 'The ' || extreme || ' ' || monthname(make_date(2000, a.month, 1)) || ' in the ' || a.city || ' record was ' || h.year
        || ', with a mean temperature of ' || printf('%.1f', round(h.mean_temp, 1) + 0.0) || ' degC and anomaly ' || printf('%+.2f', h.anomaly)
        || ' degC (z-score ' || printf('%+.2f', coalesce(h.z_score, 0.0)) || '). For comparison, the ' || o.kind || ' was ' || o.year || ' with anomaly '
        || printf('%+.2f', o.anomaly) || ' degC.' AS answer,
        h.year || ' was the ' || extreme || ' ' || monthname(make_date(2000, a.month, 1)) || ' in ' || a.city || ' in the dataset.' AS interpretation,
        a.city || ' regional anomalies' AS source_title
      FROM asked a JOIN w h ON h.city = a.city AND h.month = a.month AND h.kind = a.extreme
      JOIN w o ON o.city = a.city AND o.month = a.month AND o.kind <> a.extreme""",
)
def _(spark, path):
    m = matrix2(spark, path)
    return A.month_extreme_answers(slots(spark, m, questions(m)), as_history(m), "city", KEY, "EUROPE")


@query(
    "comparison_answers", "R9 J5",
    with_sql(SLOTS, ROUND2) + """, l AS (SELECT city, month, arg_max(struct_pack(y := year, t := mean_temp, a := anomaly), year) AS now FROM m2 GROUP BY city, month),
      j AS (SELECT s.question, o.city, monthname(make_date(2000, o.month, 1)) AS label, o.year AS other, o.mean_temp AS ot, o.anomaly AS oa, now,
        now.t - o.mean_temp AS delta FROM slots s JOIN m2 o ON o.city = s.chosen AND o.month = s.month AND o.year = s.comparison_year
        JOIN l ON l.city = o.city AND l.month = o.month WHERE s.compares AND (says_this OR contains(q, CAST(now.y AS VARCHAR)))),
      k AS (SELECT *, 'Anomalies are ' || printf('%+.2f', now.a) || ' C and ' || printf('%+.2f', oa) || ' C respectively.' AS anoms,
        city || ' ' || label || ' ' || now.y AS head, printf('%+.2f', round(delta, 2) + 0.0) AS d FROM j)
      SELECT question, CASE WHEN delta = 0 THEN head || ' is the same as ' || other || ' at ' || printf('%.2f', now.t) || ' C over the same cutoff window. ' || anoms
        ELSE 'Yes. ' || head || CASE WHEN delta > 0 THEN ' is warmer than ' ELSE ' is colder than ' END || other || '. Mean temperature is '
        || printf('%.2f', now.t) || ' C versus ' || printf('%.2f', ot) || ' C, a difference of ' || d || ' C over the same cutoff window. ' || anoms END AS answer,
        head || ' is ' || CASE WHEN delta > 0 THEN 'warmer' WHEN delta < 0 THEN 'colder' ELSE 'the same temperature as' END || ' ' || other || ' by ' || d || ' C.' AS interpretation,
        city || ' ' || label || ' anomaly table' AS source_title FROM k WHERE delta IS NOT NULL AND anoms IS NOT NULL""",
)
def _(spark, path):
    m = matrix2(spark, path)
    return A.comparison_answers(slots(spark, m, questions(m)), as_history(m), "city", KEY)


def _nested(name: str) -> str:
    """The registered SQL of a table branch, without the blocks it shares with the others."""
    return "WITH " + REGISTRY[name].sql.removeprefix(with_sql(SLOTS, ROUND2)).lstrip().removeprefix(",")


_C1, _C1P = "printf('%.1f', round({0}, 1) + 0.0)", "printf('%+.1f', round({0}, 1) + 0.0)"
_ASKED = QUESTIONS.replace("qs AS", "table_qs AS", 1)
ROUTER = models.recursive_sql(
    models.MODEL, models.FUTURE.removeprefix(models.REGION), models.RANGE, models.AHEAD, MATRIX.removeprefix(CITY), _ASKED,
    """ qs AS (SELECT question FROM table_qs UNION SELECT 'What will the temperature be on ' || CAST(time AS VARCHAR) || '?' FROM future
      UNION SELECT text FROM benchmark)""",
    SLOTS.removeprefix(MATRIX + "," + QUESTIONS), ROUND2,
    f""" miss AS (SELECT y_true, y_true - y_pred AS b, row_number() OVER (ORDER BY time DESC) AS rn FROM modelled WHERE year = {SPEC.current_year}),
    bias AS (SELECT round(coalesce(avg(b), 0), 1) AS ytd, count(*) AS n, round(coalesce(avg(b) FILTER (rn <= 30), 0), 1) AS recent, count(*) FILTER (rn <= 30) AS n_recent FROM miss),
    fc AS (SELECT 'What will the temperature be on ' || CAST(time AS VARCHAR) || '?' AS question, CAST(time AS VARCHAR) AS day,
      CASE WHEN time = DATE '{TODAY.isoformat()}' + 1 THEN 'tomorrow' ELSE CAST(time AS VARCHAR) END AS label, round(y_pred, 1) AS base, y_pred, r.lo AS lo, r.hi AS hi,
      b.*, n >= 7 AS enough, CAST(year(time) AS VARCHAR) AS year FROM ahead JOIN tr ON target_date = time, bias b),
    fc2 AS (SELECT *, CASE WHEN enough THEN round(y_pred + recent, 1) ELSE base END AS adjusted,
      coalesce(' Typical daily range for this time of year: ' || {_C1.format('lo')} || '°C (low) to ' || {_C1.format('hi')} || '°C (high).', '') AS rng FROM fc),
    forecasts AS (SELECT question, 'For ' || label || ' (' || day || ') in the region, the ' || CASE WHEN enough THEN 'adjusted temperature estimate is ' || {_C1.format('adjusted')}
      || '°C.' || rng || ' The model''s seasonal baseline for that date is ' || {_C1.format('base')} || '°C. This year has been running ' || {_C1.format('abs(ytd)')}
      || '°C ' || CASE WHEN ytd >= 0 THEN 'warmer' ELSE 'colder' END || ' than the model baseline year-to-date, and the most recent ' || n_recent || '-day window is '
      || {_C1.format('abs(recent)')} || '°C ' || CASE WHEN recent >= 0 THEN 'warmer' ELSE 'colder' END
      || ' than expected. That recent bias is applied as a correction to produce the adjusted estimate. '
      ELSE 'current climatological baseline estimate is ' || {_C1.format('base')} || '°C.' || rng || ' There are not enough ' || year
      || ' observations yet to compute a reliable bias correction, so the answer is reported as the raw model baseline rather than an adjusted estimate. ' END
      || 'This is a climatological trend estimate, not a live synoptic weather forecast.' AS answer,
      'Baseline: ' || {_C1.format('base')} || '°C | YTD bias: ' || {_C1P.format('ytd')} || '°C | Recent ' || n_recent || 'd bias: ' || {_C1P.format('recent')}
      || '°C | Adjusted: ' || {_C1.format('adjusted')} || '°C' AS interpretation, 'Temperature model forecast' AS source_title FROM fc2)""",
    " tables AS (SELECT 0 AS ord, 'forecast' AS kind, * FROM forecasts " + " ".join(
        f"UNION ALL SELECT {i}, '{kind}', question, answer, interpretation, source_title FROM ({_nested(name)}) AS b{i}"
        for i, (kind, name) in enumerate((("year-month", "year_month_answers"), ("month-extreme", "month_extreme_answers"), ("comparison", "comparison_answers")), 1)) + ")",
    """ open_qs AS (SELECT question, question AS text FROM qs WHERE question NOT IN (SELECT question FROM tables))""",
    text.INDEX, text.QUESTIONS.replace("item_id", "question").replace("benchmark", "open_qs"),
    f""" found AS (SELECT question, string_agg('**Document ' || doc_id || '**: ' || array_to_string(({text.sentences_sql('d.text')})[1:2], ' '), chr(10) || chr(10) ORDER BY rank) AS answer,
      arg_min('Document ' || doc_id, rank) AS source_title FROM hits JOIN documents d USING (doc_id) WHERE trim(d.text) <> '' GROUP BY question),
    answers AS (SELECT * FROM tables UNION ALL SELECT 4, 'retrieval', question, answer, '', source_title FROM found),
    routed AS (SELECT qs.question, coalesce(kind, 'none') AS kind, coalesce(answer, '{A.NO_ANSWER}') AS answer, coalesce(interpretation, '') AS interpretation, source_title
      FROM qs LEFT JOIN (SELECT * FROM answers QUALIFY row_number() OVER (PARTITION BY question ORDER BY ord) = 1) USING (question))""",
)


@query("question_router", "R10 R7 R8 R9 R11 M5 J6", ROUTER + " SELECT question, kind, answer, interpretation, source_title FROM routed")
@star.one_daily_pass
def _(spark, path):
    # the matrix and the table answers are small results used by several branches: each is
    # computed once and cut off by a checkpoint in the shared folder
    ensure_checkpoint_dir(spark)
    daily = star.city_daily(spark, path)
    m = matrix2(spark, path).checkpoint()
    future = models.future(spark, path).withColumnRenamed("time", "target_date")
    ahead = future.select(F.concat(F.lit("What will the temperature be on "), F.col("target_date").cast("string"), F.lit("?")).alias(KEY))
    bench = star.table(spark, path, "benchmark").select(F.col("text").alias(KEY))
    qs = questions(m).unionByName(ahead).unionByName(bench).distinct()
    s = slots(spark, m, qs)

    fitted, contract, test = models._fitted(spark, path)
    ahead_pred = MD.score(FT.future_features(models.future(spark, path), contract), fitted, contract, ("time",)).select(
        F.col("time").alias("target_date"), "y_pred")
    past = MD.predictions(test, fitted, contract, ("time",)).withColumn("year", F.year("time"))
    bias = MD.year_bias(past.filter(F.col("year") == SPEC.current_year), ["year"], "time")
    fc = (
        MD.circular_range(daily, future, SPEC).join(ahead_pred, "target_date")
        .withColumn("year", F.year("target_date")).join(bias, "year", "left")
    )
    docs = text.corpus(spark, path)
    index, vocabulary = text.stored_index(spark, path)
    from_tables = A.stack_answers([
        ("forecast", A.forecast_answers(s, fc, KEY, TODAY, "the region")),
        ("year-month", A.year_month_answers(s, m, "city", KEY, BASE)),
        ("month-extreme", A.month_extreme_answers(s, as_history(m), "city", KEY, "EUROPE")),
        ("comparison", A.comparison_answers(s, as_history(m), "city", KEY)),
    ], KEY).checkpoint()
    open_qs = qs.join(from_tables.select(KEY), KEY, "left_anti")
    hits = R.retrieve(index, vocabulary, open_qs.withColumn("body", F.col(KEY)), "doc_id", KEY, "body")
    found = R.extractive_answers(R.with_documents(hits, docs, "doc_id", KEY), KEY)
    found = found.withColumn("source_title", F.element_at("sources", 1)["title"])
    return A.route(qs, KEY, from_tables.unionByName(A.stack_answers([("retrieval", found)], KEY, 4)))


@query(
    "table_answer_evaluation", "R12 F15",
    f"""WITH a AS ({REGISTRY['year_month_answers'].sql}), e AS (SELECT question, answer, CAST(source_title IS NOT NULL AS BIGINT) AS n FROM a)
      SELECT question, NOT contains(answer, 'No relevant pipeline artifacts') AS answered, n AS source_count,
        length(answer) AS answer_length, CAST({text.SCORE} AS DOUBLE) AS judge_score FROM e""",
    "judge_score",
)
def _(spark, path):
    a = REGISTRY["year_month_answers"].run(spark, path)
    a = a.select("question", "answer", F.col("source_title").isNotNull().cast("long").alias("n_sources"))
    return R.evaluation_rows(a).drop("answer", "n_sources")


@query(
    "router_evaluation", "R12 R10",
    ROUTER + f""" SELECT question, NOT contains(answer, '{A.NO_ANSWER[:30]}') AS answered, n AS source_count, length(answer) AS answer_length,
      CAST({text.SCORE} AS DOUBLE) AS judge_score FROM (SELECT *, CAST(source_title IS NOT NULL AS BIGINT) AS n FROM routed)""",
    "judge_score",
)
def _(spark, path):
    a = REGISTRY["question_router"].run(spark, path)
    n = F.size("sources").cast("long") if "sources" in a.columns else F.col("source_title").isNotNull().cast("long")
    return R.evaluation_rows(a.withColumn("n_sources", n)).select(KEY, "answered", "source_count", "answer_length", "judge_score")


@query(
    "sft_question_answers", "S1",
    f"""WITH a AS ({REGISTRY['year_month_answers'].sql})
      SELECT question AS instruction, '{{"question":' || CAST(to_json(question) AS VARCHAR) || ',"sources":' ||
        CASE WHEN source_title IS NULL THEN '[]' ELSE '[' || CAST(to_json(source_title) AS VARCHAR) || ']' END || '}}' AS input,
        answer || CASE WHEN interpretation = '' THEN '' ELSE ' ' || interpretation END AS output FROM a
      WHERE trim(question) <> '' AND trim(answer) <> ''""",
)
def _(spark, path):
    a = REGISTRY["year_month_answers"].run(spark, path)
    a = a.withColumn("sources", F.array_compact(F.array("source_title")))
    return SFT.question_answer_examples(a, KEY, "answer", "interpretation", "sources").select("instruction", "input", "output")
