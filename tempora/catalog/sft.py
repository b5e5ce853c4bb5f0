"""Fine-tuning data queries over the result tables and the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog import climate, models, summaries, wording
from tempora.catalog.base import MATRIX, SPEC, query, with_sql
from tempora.operators import modeling as MD
from tempora.operators import month_slice as MS
from tempora.operators import sft as S
from tempora.operators import summary as SM
from tempora.sources import star


def _latest(spark, path):
    return SM.latest_metrics(climate.city_current(spark, path), SPEC, ("city",))


def _slices(spark, path):
    return summaries.slices(spark, path)


BUILDERS = {
    "ytd": lambda s, p: S.ytd_examples(summaries.region_summary(s, p), "the region", f"01-01 to {SPEC.cutoff}"),
    "entity_ytd": lambda s, p: S.entity_ytd_examples(summaries.city_summary(s, p), "city"),
    "ranking": lambda s, p: S.ranking_examples(summaries.city_summary(s, p), "city"),
    "annual_trend": lambda s, p: S.annual_trend_examples(summaries.region_annual(s, p).withColumn("place", F.lit("region")), ["place"]),
    "entity_month": lambda s, p: S.entity_month_examples(climate.city_monthly(s, p), "city"),
    "latest_month": lambda s, p: S.latest_month_examples(climate.city_monthly(s, p), "city"),
    "region_month": lambda s, p: S.region_month_examples(climate.region_monthly(s, p), "the region"),
    "rolling": lambda s, p: S.rolling_examples(_latest(s, p), "city"),
    "slice": lambda s, p: S.slice_examples(_slices(s, p), MS.slice_summary(_slices(s, p), ["city", "month"]), "city"),
    "slice_trend": lambda s, p: S.slice_trend_examples(_slices(s, p), "city"),
    "slice_comparison": lambda s, p: S.slice_comparison_examples(_slices(s, p), "city"),
    "model": lambda s, p: S.model_examples(MD.regression_metrics(models.city_pred(s, p))),
    "residual": lambda s, p: S.residual_examples(models.city_pred(s, p), ["city", "time"]),
    "matrix": lambda s, p: S.matrix_examples(climate.matrix(s, p), "city"),
    "strongest": lambda s, p: S.strongest_examples(climate.matrix(s, p), "city"),
}


def table_examples(spark, path):
    """Examples of every builder over the result tables."""
    return S.union([build(spark, path) for build in BUILDERS.values()])


def _register(name, build):
    """The texts of one builder; its context column is the row itself and is compared as tables elsewhere."""
    @query(f"sft_text_{name}", "S1 F17", wording.SFT[name])
    @star.one_daily_pass
    def run(spark, path):
        return build(spark, path).select("instruction", "output")


for _name in wording.SFT:
    _register(_name, BUILDERS[_name])


@query("sft_examples", "S1 S2 F17")
@star.one_daily_pass
def _(spark, path):
    return table_examples(spark, path)


def _plausible(a, z):
    return f"abs(round({a}, 2)) <= 15 AND abs(round({z}, 2)) <= 6"


@query(
    "sft_counts_by_source", "A26 S1",
    with_sql(summaries.CITY_FULL, climate._monthly_sql("city_ytd", "city").strip(), summaries.SLICES.replace(climate.CITY, "").lstrip(",\n"),
             MATRIX.replace(climate.CITY, "").lstrip(",\n")) + f""",
      okslice AS (SELECT * FROM slices WHERE abs(mean_temp_c) <= 25 AND abs(anomaly_c) <= 15 AND abs(zscore) <= 6),
      n AS (SELECT city, month, count(*) AS n FROM okslice GROUP BY city, month)
      SELECT 'entity_ytd_summary' AS source, count(*) AS examples FROM summary WHERE abs(temp_deviation) <= 15 AND abs(temp_zscore) <= 6
      UNION ALL SELECT 'entity_monthly_anomalies', count(*) FROM monthly_anom WHERE {_plausible('temp_anomaly', 'temp_zscore')}
      UNION ALL SELECT 'month_slices', sum((n - 1) * CASE WHEN n >= 2 THEN 1 ELSE 0 END + CASE WHEN n >= 5 THEN 2 ELSE 0 END)::BIGINT FROM n
      UNION ALL SELECT 'month_slice_summary', count(DISTINCT (city, month)) FROM slices
      UNION ALL SELECT 'anomaly_matrix', (SELECT count(DISTINCT city) FROM (SELECT city, anomaly FROM matrix
        QUALIFY year = max(year) OVER (PARTITION BY city)) WHERE abs(anomaly) <= 15)
        + (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM matrix WHERE abs(anomaly) <= 15 AND abs(z_score) <= 6)""",
)
def _(spark, path):
    city_mon, slices, m = climate.city_monthly(spark, path), summaries.slices(spark, path), climate.matrix(spark, path)
    return S.counts_by_source(S.union([
        S.entity_ytd_examples(summaries.city_summary(spark, path), "city"),
        S.entity_month_examples(city_mon, "city"),
        S.slice_examples(slices, MS.slice_summary(slices, ["city", "month"]), "city"),
        S.slice_trend_examples(slices, "city"),
        S.slice_comparison_examples(slices, "city"),
        S.matrix_examples(m, "city"),
        S.strongest_examples(m, "city"),
    ]))


@query(
    "sft_entity_month_text", "S1 F17",
    with_sql(climate.CITY_MONTHLY) + f""" SELECT 'Describe the weather anomaly for ' || city || ' in month ' || month || ' of ' || year || '.' AS instruction,
      city || ' in month ' || month || '/' || year || ' was ' || CASE WHEN temp_anomaly > 0 THEN 'warmer' ELSE 'colder' END || ' than the climatology by '
      || printf('%.2f', abs(round(temp_anomaly, 2))) || ' C (z=' || printf('%+.2f', round(temp_zscore, 2) + 0.0) || ').'
      || CASE WHEN abs(round(precip_anomaly, 1)) <= 600 AND abs(round(precip_zscore, 2)) <= 8 THEN ' Precipitation anomaly: '
        || printf('%+.1f', round(precip_anomaly, 1) + 0.0) || ' mm (z=' || printf('%+.2f', round(precip_zscore, 2) + 0.0) || ').' ELSE '' END AS output
      FROM monthly_anom WHERE {_plausible('temp_anomaly', 'temp_zscore')}""",
)
def _(spark, path):
    return S.entity_month_examples(climate.city_monthly(spark, path), "city").select("instruction", "output")


PAIRS = """pairs AS (SELECT a.conv_id, a.turn, u.text AS asked, a.text AS reply FROM conversations u JOIN conversations a
  ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
ex AS (SELECT conv_id, turn, 'Reply to the user.' AS instruction, trim(asked, ' ') AS input, trim(reply, ' ') AS output FROM pairs
  WHERE trim(asked, ' ') <> '' AND trim(reply, ' ') <> '')"""


def chat_examples(spark, path):
    p = S.turn_pairs(star.table(spark, path, "conversations"))
    return p.select("conv_id", "turn", F.lit("Reply to the user.").alias("instruction"), F.trim("asked").alias("input"),
                    F.trim("reply").alias("output")).filter((F.col("input") != "") & (F.col("output") != ""))


@query("sft_chat_pairs", "S2", "WITH " + PAIRS + " SELECT conv_id, turn, input, output FROM ex")
def _(spark, path):
    return chat_examples(spark, path).drop("instruction")


@query(
    "sft_split", "S3",
    "WITH " + PAIRS + """, o AS (SELECT conv_id, turn, row_number() OVER (ORDER BY md5('42|' || conv_id || '|' || turn), conv_id, turn) - 1 AS position,
        count(*) OVER () AS total FROM ex)
      SELECT conv_id, turn, position, CASE WHEN position < greatest(1, CAST(floor(total * (1.0 - 0.2)) AS BIGINT)) THEN 'train' ELSE 'eval' END AS part FROM o""",
)
def _(spark, path):
    return S.split_examples(chat_examples(spark, path), ["conv_id", "turn"]).select("conv_id", "turn", "position", "part")


PROMPT = """'### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Input:' || chr(10) || input || chr(10) || chr(10) || '### Response:' || chr(10)"""


@query("sft_prompts", "S4", "WITH " + PAIRS + f" SELECT conv_id, turn, {PROMPT} AS prompt, {PROMPT} || output AS full_text FROM ex")
def _(spark, path):
    return S.with_prompt(chat_examples(spark, path)).select("conv_id", "turn", "prompt", "full_text")


MAX = 512


@query(
    "sft_tokens", "S5",
    "WITH " + PAIRS + f""", t AS (SELECT conv_id, turn, list_transform(string_split({PROMPT}, ''), lambda c: unicode(c) + 3) AS p,
        list_append(list_transform(string_split(output, ''), lambda c: unicode(c) + 3), 102) AS r FROM ex),
      u AS (SELECT conv_id, turn, CASE WHEN len(r) >= {MAX - 1} THEN CAST([] AS INTEGER[]) ELSE p[1:{MAX - 1} - len(r)] END AS p,
        CASE WHEN len(r) >= {MAX - 1} THEN list_append(r[1:{MAX - 2}], 102) ELSE r END AS r FROM t),
      v AS (SELECT *, 1 + len(p) + len(r) AS n FROM u)
      SELECT conv_id, turn, array_to_string(list_concat([101], p, r, list_resize(CAST([] AS INTEGER[]), {MAX} - n, 0)), ' ') AS input_ids,
        array_to_string(list_concat(list_resize(CAST([] AS INTEGER[]), n, 1), list_resize(CAST([] AS INTEGER[]), {MAX} - n, 0)), ' ') AS attention_mask,
        array_to_string(list_concat(list_resize(CAST([] AS INTEGER[]), 1 + len(p), -100), r, list_resize(CAST([] AS INTEGER[]), {MAX} - n, -100)), ' ') AS labels FROM v""",
)
def _(spark, path):
    t = S.supervised_tokens(chat_examples(spark, path), MAX)
    return t.select("conv_id", "turn", *[F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
                                          for c in ("input_ids", "attention_mask", "labels")])
