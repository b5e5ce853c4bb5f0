"""Fine-tuning examples from result tables, hash-ordered split, prompts and token arrays.

The wording of instructions and outputs is a fixed value: it is the output format.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.calendar import month_name
from tempora.functions.numeric import finite, fixed
from tempora.functions.plausibility import (
    MAX_TEMP_ANOMALY, reasonable_mean_temperature, reasonable_precip_signal, reasonable_temperature_signal,
)
from tempora.functions.position import with_global_position
from tempora.operators import selection as SEL

COLUMNS = ("instruction", "input", "output", "source")


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _num(c: str, digits: int = 2, plus: bool = False, absolute: bool = False) -> Column:
    v = F.coalesce(finite(F.col(c)), F.lit(0.0))
    return fixed(F.abs(v) if absolute else v, digits, plus)


def _tone(c: str, up: str, down: str) -> Column:
    return F.when(F.col(c) > 0, up).otherwise(down)


def examples(df: DataFrame, instruction: Column, context: Column, output: Column, source: str) -> DataFrame:
    """Four text columns; rows with an empty context or output are dropped."""
    out = df.select(
        instruction.alias("instruction"), F.trim(context).alias("input"), F.trim(output).alias("output"),
        F.lit(source).alias("source"))
    return out.filter((F.col("input") != "") & (F.col("output") != ""))


def _row(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def _precip(prefix: str, suffix: str, deviation: str, z: str) -> Column:
    ok = reasonable_precip_signal(F.round(deviation, 1), F.round(z, 2))
    return F.when(ok, _text(prefix, _num(deviation, 1, True), suffix.split("{z}")[0],
                            *([_num(z, 2, True), suffix.split("{z}")[1]] if "{z}" in suffix else []))).otherwise("")


def ytd_examples(summary: DataFrame, place: str, period: str) -> DataFrame:
    """Two phrasings of the region's year-to-date signal."""
    ok = summary.filter(reasonable_temperature_signal(F.col("temp_deviation"), F.col("temp_zscore")))
    strong = F.when(F.abs("temp_zscore") > 1.5, "significantly ").otherwise("")
    head = _text(strong, _tone("temp_deviation", "warmer", "colder"))
    first = _text(f"For {period}, {place} is ", head, " than the baseline by ", _num("temp_deviation", absolute=True), " C (z=",
                  _num("temp_zscore", plus=True), ").", _precip(" Precipitation deviation is ", " mm (z={z}).", "precip_deviation", "precip_zscore"))
    second = _text(f"{place} is ", head, f" than normal in {period}: temperature anomaly ", _num("temp_deviation", plus=True),
                   " C, z-score ", _num("temp_zscore", plus=True), ".")
    src = "ytd_summary"
    return examples(ok, F.lit(f"Summarize {place} year-to-date weather anomaly signal."), _row(summary), first, src).unionByName(
        examples(ok, F.lit(f"Is {place} currently warmer or colder than normal this year?"), _row(summary), second, src))


def entity_ytd_examples(summary: DataFrame, entity: str) -> DataFrame:
    ok = summary.filter(reasonable_temperature_signal(F.col("temp_deviation"), F.col("temp_zscore")))
    out = _text(F.col(entity), " is ", _tone("temp_deviation", "warmer", "colder"), " than the baseline by ",
                _num("temp_deviation", absolute=True), " C (z=", _num("temp_zscore", plus=True), ") year-to-date.")
    return examples(ok, _text("Summarize the year-to-date temperature anomaly for ", F.col(entity), "."), _row(summary), out, "entity_ytd_summary")


def ranking_examples(summary: DataFrame, entity: str) -> DataFrame:
    """Strongest and weakest combined signal and the most extreme temperature; one aggregate each."""
    score = F.greatest(F.abs("temp_zscore"), F.abs("precip_zscore"))
    s = summary.withColumn("combined_score", score)
    name = F.col(entity)
    facts = s.agg(
        F.min_by(entity, F.struct((-score).alias("v"), name.alias("e"))).alias("top"), F.max(score).alias("top_score"),
        F.max_by(entity, F.struct((-score).alias("v"), name.alias("e"))).alias("bottom"), F.min(score).alias("bottom_score"),
        F.min_by(F.struct(name.alias("e"), F.col("temp_deviation").alias("a"), F.col("temp_zscore").alias("z")),
                 F.struct((-F.abs("temp_zscore")).alias("v"), name.alias("e"))).alias("t"),
    ).filter(F.col("top").isNotNull())
    src = "entity_rankings"
    both = examples(
        facts.filter((F.col("top_score") <= 15.0) & (F.col("bottom_score") <= 15.0)),
        F.lit("Which city currently has the strongest combined anomaly signal?"), _row(facts),
        _text("The strongest combined anomaly is in ", F.col("top"), " (score ", _num("top_score", plus=True), "). The weakest is ",
              F.col("bottom"), " (score ", _num("bottom_score", plus=True), ")."), src)
    temp = examples(
        facts.filter(reasonable_temperature_signal(F.col("t.a"), F.col("t.z"))),
        F.lit("Which city has the most extreme temperature anomaly right now?"), _row(facts.select("t")),
        _text(F.col("t.e"), " has the most extreme temperature z-score at ", fixed(F.col("t.z"), 2, True), "."), src)
    return both.unionByName(temp)


def annual_trend_examples(annual: DataFrame, keys: list[str], min_rows: int = 5) -> DataFrame:
    """Latest year against the year before, and the extremes of the last ten years, per series."""
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.desc("year"))
    last = (
        annual.withColumns({"_n": F.count("*").over(w), "rn": F.row_number().over(order)})
        .filter((F.col("_n") >= min_rows) & (F.col("rn") <= 10))
    )
    point = F.struct("year", "ytd_mean_temp", "ytd_total_precip")
    t = F.round("ytd_mean_temp", 2)
    facts = last.groupBy(*keys).agg(
        F.sort_array(F.collect_list(point)).alias("rows"), F.max("year").alias("cur_year"),
        F.max(F.when(F.col("rn") == 1, t)).alias("cur"), F.max(F.when(F.col("rn") == 2, F.col("year"))).alias("prev_year"),
        F.max(F.when(F.col("rn") == 2, t)).alias("prev"),
        F.max_by("year", F.struct(t, (-F.col("year")).alias("y"))).alias("warm_year"), F.max(t).alias("warm"),
        F.min_by("year", F.struct(t, F.col("year").alias("y"))).alias("cold_year"), F.min(t).alias("cold"),
    ).withColumn("diff", F.round(F.col("cur") - F.col("prev"), 2))
    ctx, src = F.to_json("rows"), "annual_summary"
    y = _s("cur_year")
    compare = _text(y, " YTD mean temp is ", _num("cur"), " C vs ", _num("prev"), " C in ", _s("prev_year"), ", so ", y, " is ",
                    _num("diff", absolute=True), " C ", _tone("diff", "warmer", "colder"), " year-on-year.")
    decade = _text("In the last decade, ", _s("warm_year"), " was warmest (", _num("warm"), " C YTD) and ", _s("cold_year"),
                   " was coldest (", _num("cold"), " C YTD).")
    return examples(facts, _text("How does the ", y, " YTD temperature compare to ", _s("prev_year"), "?"), ctx, compare, src).unionByName(
        examples(facts, F.lit("Which year in the last decade had the warmest and coldest YTD temperature?"), ctx, decade, src))


def entity_month_examples(monthly: DataFrame, entity: str) -> DataFrame:
    """One example per plausible (entity, month) row."""
    ok = monthly.filter(reasonable_temperature_signal(F.round("temp_anomaly", 2), F.round("temp_zscore", 2)))
    out = _text(F.col(entity), " in month ", _s("month"), "/", _s("year"), " was ", _tone("temp_anomaly", "warmer", "colder"),
                " than the climatology by ", _num("temp_anomaly", absolute=True), " C (z=", _num("temp_zscore", plus=True), ").",
                _precip(" Precipitation anomaly: ", " mm (z={z}).", "precip_anomaly", "precip_zscore"))
    q = _text("Describe the weather anomaly for ", F.col(entity), " in month ", _s("month"), " of ", _s("year"), ".")
    return examples(ok, q, _row(monthly), out, "entity_monthly_anomalies")


def latest_month_examples(monthly: DataFrame, entity: str) -> DataFrame:
    """Most and least anomalous entity of the most recent month."""
    ok = monthly.filter(reasonable_temperature_signal(F.col("temp_anomaly"), F.col("temp_zscore")))
    e = SEL.latest_month_extremes(ok, entity, "temp_zscore")
    when = _text("month ", _s("month"))
    out = _text("In ", when, "/", _s("year"), ", ", F.col(f"warmest_{entity}"), " was most above normal (z=", _num("warmest_z", plus=True),
                ") and ", F.col(f"coldest_{entity}"), " was most below normal (z=", _num("coldest_z", plus=True), ").")
    q = _text("Which city was warmest and coldest relative to normal in ", when, " of ", _s("year"), "?")
    return examples(e, q, _row(e), out, "entity_monthly_anomalies")


def region_month_examples(monthly: DataFrame, place: str) -> DataFrame:
    ok = monthly.filter(reasonable_temperature_signal(F.round("temp_anomaly", 2), F.round("temp_zscore", 2)))
    out = _text(f"{place} month ", _s("month"), "/", _s("year"), ": temperature was ", _tone("temp_anomaly", "above", "below"),
                " normal by ", _num("temp_anomaly", absolute=True), " C (z=", _num("temp_zscore", plus=True), ");",
                _precip(" precipitation anomaly ", " mm.", "precip_anomaly", "precip_zscore"))
    q = _text(f"Describe the national weather anomaly for {place} in month ", _s("month"), " of ", _s("year"), ".")
    return examples(ok, q, _row(monthly), out, "region_monthly_anomalies")


def rolling_examples(latest: DataFrame, entity: str) -> DataFrame:
    """Recent trend of every entity from its latest enriched row."""
    r7, r30 = finite(F.col("latest_7d_temp_anomaly")), finite(F.col("latest_30d_temp_anomaly"))
    ok = latest.filter(F.coalesce((F.abs(r7) <= MAX_TEMP_ANOMALY) & (F.abs(r30) <= MAX_TEMP_ANOMALY), F.lit(False)))
    out = _text("As of ", _s("latest_time"), ", ", F.col(entity), " has a 7-day rolling temperature anomaly of ",
                _num("latest_7d_temp_anomaly", plus=True), " C and a 30-day rolling anomaly of ", _num("latest_30d_temp_anomaly", plus=True), " C.")
    return examples(ok, _text("What is the recent temperature trend for ", F.col(entity), "?"), _row(latest), out, "entity_daily_anomalies")


def plausible_years(histories: DataFrame) -> DataFrame:
    return histories.filter(
        reasonable_mean_temperature(F.col("mean_temp_c")) & reasonable_temperature_signal(F.col("anomaly_c"), F.col("zscore")))


def slice_examples(histories: DataFrame, summary: DataFrame, entity: str) -> DataFrame:
    """Latest plausible year of every (entity, month) slice, else its baseline figures."""
    last = plausible_years(histories).groupBy(entity, "month").agg(F.max(F.struct("year", "anomaly_c", "zscore")).alias("last"))
    j = summary.join(last, [entity, "month"], "left")
    where = _text(F.col(entity), " ", month_name(F.col("month")))
    known = _text(where, " ", F.col("last.year").cast("string"), " (through day ", _s("cutoff_day"), "): temperature anomaly ",
                  fixed(F.col("last.anomaly_c"), 2, True), " C (z=", fixed(F.col("last.zscore"), 2, True), ") ",
                  F.when(F.col("last.anomaly_c") > 0, "above").otherwise("below"), " the ", _num("baseline_mean"), " C baseline.")
    bare = _text(where, " latest year is ", _s("end_year"), ". Baseline mean: ", _num("baseline_mean"), " C (std ", _num("baseline_std"), " C).")
    out = F.when(F.col("last").isNotNull(), known).otherwise(bare)
    return examples(j, _text("Describe the ", where, " anomaly for the latest year."), _row(summary), out, "month_slice_summary")


def _slice_facts(histories: DataFrame, entity: str, min_rows: int) -> DataFrame:
    """Years of a slice in order, its latest year and extremes; one row per (entity, month)."""
    w = Window.partitionBy(entity, "month")
    rows = plausible_years(histories).withColumn("rn", F.row_number().over(w.orderBy(F.desc("year"))))
    a = F.round("anomaly_c", 2)
    return rows.groupBy(entity, "month").agg(
        F.sort_array(F.collect_list(F.struct("year", "mean_temp_c", "anomaly_c", "zscore"))).alias("rows"),
        F.max(F.struct(F.col("year"), F.round("mean_temp_c", 2).alias("t"), a.alias("a"), F.round("zscore", 2).alias("z"))).alias("last"),
        F.max(F.struct(a.alias("a"), (-F.col("year")).alias("y"))).alias("hot"), F.min(F.struct(a.alias("a"), F.col("year").alias("y"))).alias("cold"),
        F.count_if((F.col("rn") <= 10) & (a > 0)).alias("positive"), F.count("*").alias("n"),
    ).filter(F.col("n") >= min_rows)


def slice_trend_examples(histories: DataFrame, entity: str) -> DataFrame:
    """Rank of the latest year in its slice's history; slices under five plausible years give nothing."""
    f = _slice_facts(histories, entity, 5)
    m, y = month_name(F.col("month")), F.col("last.year").cast("string")
    a, z = fixed(F.col("last.a"), 2, True), fixed(F.col("last.z"), 2, True)
    ctx = F.to_json(F.transform("rows", lambda r: F.struct(r["year"].alias("year"), r["anomaly_c"].alias("anomaly_c"), r["zscore"].alias("zscore"))))
    src = "month_slices"
    history = _text(F.col(entity), " ", m, " ", y, " anomaly is ", a, " C (z=", z, "). Historically, the warmest ", m, " was ",
                    (-F.col("hot.y")).cast("string"), " (", fixed(F.col("hot.a"), 2, True), " C) and coldest was ", F.col("cold.y").cast("string"),
                    " (", fixed(F.col("cold.a"), 2, True), " C). In the last 10 years, ", _s("positive"), "/10 were above normal.")
    trend = _text("Over the recorded period, ", _s("positive"), " of the last 10 in ", F.col(entity), " were above the baseline. The most recent year (",
                  y, ") shows an anomaly of ", a, " C (z=", z, ").")
    return examples(f, _text("How unusual is this ", m, " in ", F.col(entity), " compared to history?"), ctx, history, src).unionByName(
        examples(f, _text("Is ", F.col(entity), " ", m, " showing a long-term warming trend?"), ctx, trend, src))


def slice_comparison_examples(histories: DataFrame, entity: str) -> DataFrame:
    """Latest year of a slice against each of its other years; a slice has one row per year."""
    f = _slice_facts(histories, entity, 2)
    pairs = f.select(entity, "month", "last", "rows", F.explode("rows").alias("o")).filter(F.col("o.year") != F.col("last.year"))
    diff = F.round(F.col("last.t") - F.round("o.mean_temp_c", 2), 2)
    m, y, o = month_name(F.col("month")), F.col("last.year").cast("string"), F.col("o.year").cast("string")
    out = _text(F.when(diff > 0, "Yes, ").otherwise("No, "), m, " ", y, " (", fixed(F.col("last.t"), 2), " C) is ",
                F.when(diff > 0, "warmer").otherwise("colder"), " than ", m, " ", o, " (", fixed(F.col("o.mean_temp_c"), 2), " C) by ",
                fixed(F.abs(diff), 2), " C.")
    q = _text("Is this ", m, " in ", F.col(entity), " warmer than ", o, "? Give a yes/no answer with the degree difference.")
    return examples(pairs, q, F.to_json("rows"), out, "month_slices")


def model_examples(metrics: DataFrame) -> DataFrame:
    grade = F.when(F.col("r2") > 0.7, "good").when(F.col("r2") > 0.5, "moderate").otherwise("poor")
    first = _text("The climate model has ", grade, " fit: R2=", _num("r2", 4), ", RMSE=", _num("rmse", 4), " C, MAE=", _num("mae", 4), " C on held-out data.")
    second = _text("The model achieves R2=", _num("r2", 4), " (", grade, " fit), meaning it explains ",
                   fixed(F.round("r2", 4) * 100, 1), "% of temperature variance. Typical error is ", _num("mae"), " C (MAE).")
    src = "model_evaluation"
    return examples(metrics, F.lit("Evaluate model quality from metrics."), _row(metrics), first, src).unionByName(
        examples(metrics, F.lit("Can you trust the climate model predictions?"), _row(metrics), second, src))


def residual_examples(predictions: DataFrame, ties: list[str], n: int = 5) -> DataFrame:
    """The largest residuals as one example; n rows are gathered."""
    top = SEL.top_by_abs(predictions, "residual", n, ties)
    order = F.struct((-F.abs(F.round("residual", 6))).alias("v"), *ties)
    row = F.struct("y_true", "y_pred", "residual")
    f = top.agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), row.alias("r"))))["r"].alias("rows"),
                F.avg(F.abs(F.round("residual", 2))).alias("avg")).filter(F.size("rows") > 0)
    worst = F.element_at("rows", 1)
    out = _text(f"The {n} largest prediction errors average ", _num("avg"), " C. The worst case has a residual of ",
                fixed(worst["residual"], 2, True), " C (predicted ", fixed(worst["y_pred"], 2), " C, actual ", fixed(worst["y_true"], 2), " C).")
    return examples(f, F.lit("Where does the climate model make its largest prediction errors?"), F.to_json("rows"), out, "model_predictions")


def matrix_examples(matrix: DataFrame, entity: str) -> DataFrame:
    """Monthly pattern of each entity's latest year; at most 12 months per entity are gathered."""
    w = Window.partitionBy(entity)
    latest = matrix.withColumn("_y", F.max("year").over(w)).filter(F.col("year") == F.col("_y")).drop("_y")
    ok = latest.filter(F.coalesce(F.abs(finite(F.col("anomaly"))) <= MAX_TEMP_ANOMALY, F.lit(False)))
    months = F.sort_array(F.collect_list(F.struct("month", "mean_temp", "anomaly", "z_score")))
    f = ok.groupBy(entity, "year").agg(months.alias("months"))
    pattern = F.array_join(F.transform("months", lambda m: _text("month ", m["month"].cast("string"), ": ", fixed(m["anomaly"], 2, True), " C")), "; ")
    out = _text("For ", F.col(entity), " in ", _s("year"), ", monthly anomaly pattern: ", pattern, ".")
    return examples(f, _text("Summarize ", F.col(entity), " regional monthly anomalies for ", _s("year"), "."), F.to_json("months"), out, "anomaly_matrix")


def strongest_examples(matrix: DataFrame, entity: str, n: int = 10) -> DataFrame:
    """The strongest plausible anomalies of the matrix as one example; n rows are gathered."""
    ok = matrix.filter(reasonable_temperature_signal(F.col("anomaly"), F.col("z_score")))
    top = SEL.top_by_abs(ok, "anomaly", n, [entity, "year", "month"])
    order = F.struct((-F.abs(F.round("anomaly", 6))).alias("v"), entity, "year", "month")
    f = top.agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.struct(entity, "year", "month", "anomaly", "z_score").alias("r"))))["r"].alias("rows"))
    f = f.filter(F.size("rows") > 0)
    listed = F.array_join(F.transform("rows", lambda r: _text(
        r[entity], " ", r["year"].cast("string"), "-", r["month"].cast("string"), ": ", fixed(r["anomaly"], 2, True), " C (z=", fixed(r["z_score"], 2, True), ")")), "; ")
    return examples(f, F.lit("Identify strongest regional monthly anomaly signals."), F.to_json("rows"), _text("Top anomaly signals: ", listed, "."), "anomaly_matrix")


def question_answer_examples(answers: DataFrame, question: str, answer: str, interpretation: str, sources: str) -> DataFrame:
    """Answered questions as examples: the question with its sources, and the answer with its interpretation."""
    q, a, i = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in (question, answer, interpretation))
    context = F.to_json(F.struct(q.alias("question"), F.col(sources).alias("sources")))
    full = F.when(i == "", a).otherwise(F.concat(a, F.lit(" "), i))
    return examples(answers.filter((q != "") & (a != "")), q, context, full, "question_answers")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def counts_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("examples"))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """A user turn followed by an assistant turn; an equi-join on (conversation, turn), so one
    very long conversation spreads over all partitions."""
    user = conversations.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    reply = conversations.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("reply"))
    return user.join(reply, ["conv_id", "turn"]).select("conv_id", "turn", "asked", "reply")


def hash_order(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def split_examples(df: DataFrame, ids: list[str], eval_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``part``: the first max(1, int(n * (1 - ratio))) rows in hash order are training rows.

    With nothing left for evaluation the last training row serves for both. Rows are placed by
    the first three hash digits, 4096 even buckets, so no task sees the whole table.
    """
    h = df.withColumn("_h", hash_order(seed, *ids))
    placed = with_global_position(h, [("_b", F.substring("_h", 1, 3))], [F.col("_h"), *[F.col(i) for i in ids]])
    cut = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(1.0 - eval_ratio)).cast("int"))
    both = F.array(F.lit("train"), F.lit("eval"))
    parts = (
        F.when((cut >= F.col("total")) & (F.col("position") == F.col("total") - 1), both)
        .when(F.col("position") < cut, F.array(F.lit("train"))).otherwise(F.array(F.lit("eval")))
    )
    return placed.withColumn("part", F.explode(parts)).drop("_h", "total")


def prompt(instruction: Column, context: Column) -> Column:
    return _text("### Instruction:\n", F.coalesce(instruction, F.lit("")), "\n\n### Input:\n", F.coalesce(context, F.lit("")), "\n\n### Response:\n")


def with_prompt(df: DataFrame) -> DataFrame:
    p = prompt(F.col("instruction"), F.col("input"))
    return df.withColumns({"prompt": p, "full_text": F.concat(p, F.coalesce("output", F.lit("")))})


def code_points(c: Column, shift: int = 3) -> Column:
    """One token per character: its code point plus ``shift``."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.transform(chars, lambda x: F.ascii(x) + shift)


def batch_tokenizer(encode: Callable[[list[str]], list[list[int]]]):
    """Wrap any tokenizer as an Arrow-batched function of a text column."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(encode(texts.fillna("").tolist()))

    return run


def supervised_tokens(
    df: DataFrame, max_length: int, bos: int | None = 101, eos: int | None = 102, pad: int = 0,
    tokenize: Callable[[Column], Column] = code_points,
) -> DataFrame:
    """input_ids, attention_mask and labels of fixed length.

    The response is kept before the prompt: a response that fills the budget is cut and ends in
    the end token, otherwise the prompt is cut to what remains. Prompt and padding carry the
    label -100.
    """
    lead = F.array(*([F.lit(bos)] if bos is not None else [])).cast("array<int>")
    budget = max_length - (1 if bos is not None else 0)
    if budget <= 0:
        raise ValueError("max_length must be at least 2")
    tail = F.array(*([F.lit(eos)] if eos is not None else [])).cast("array<int>")
    staged = df.withColumns({
        "_p": tokenize(prompt(F.col("instruction"), F.col("input"))),
        "_r": F.concat(tokenize(F.coalesce("output", F.lit(""))), tail),
    })
    full = F.size("_r") >= budget
    cut = F.concat(F.slice("_r", 1, budget - 1), tail) if eos is not None else F.slice("_r", 1, budget)
    staged = staged.withColumns({
        "_r": F.when(full, cut).otherwise(F.col("_r")),
        "_p": F.when(full, F.array().cast("array<int>")).otherwise(
            F.slice("_p", F.lit(1), F.greatest(F.lit(budget) - F.size("_r"), F.lit(0)))),
    })
    ids = F.concat(lead, "_p", "_r")
    used = F.size(lead) + F.size("_p") + F.size("_r")
    fill = F.lit(max_length) - used
    skip = F.lit(-100)
    return staged.withColumns({
        "input_ids": F.concat(ids, F.array_repeat(F.lit(pad), fill)),
        "attention_mask": F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), fill)),
        "labels": F.concat(F.array_repeat(skip, F.size(lead) + F.size("_p")), "_r", F.array_repeat(skip, fill)),
    }).drop("_p", "_r")
