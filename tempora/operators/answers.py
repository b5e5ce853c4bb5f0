"""Batch question answering: slots from the text, one relation of answers per question kind, a router.

The wording of the answers is a fixed value: it is the output format.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.calendar import MONTH_NAMES, month_label, month_name
from tempora.functions.numeric import fixed
from tempora.functions.text import NO_ANSWER
from tempora.operators import selection as SEL

# Phrases that reveal what a question asks for.
FORECAST_WORDS = ("tomorrow", "next week", "forecast", "predict", "will it be", "will the temp")
COLD_WORDS = ("coldest", "lowest", "least warm")
WARM_WORDS = ("warmest", "hottest", "highest")
COLD_WORDS_YEAR = (*COLD_WORDS, "most cold")
WARM_WORDS_YEAR = (*WARM_WORDS, "most warm")
YEAR_PATTERN = r"\b(1[89]\d{2}|20\d{2})\b"
COMPARISON_YEAR_PATTERN = r"\b((?:19|20)\d{2})\b"
DATE_PATTERN = r"(\d{4}-\d{2}-\d{2})"

ANSWER_COLUMNS = ("answer", "interpretation", "source_title")


def _has(c: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(c, F.lit(p))
    return out


def _number(c: Column, pattern: str) -> Column:
    return F.regexp_extract(c, pattern, 1).try_cast("int")


def with_slots(questions: DataFrame, text: str, today: date) -> DataFrame:
    """Year, month, extremes, comparison and forecast date found in the question text."""
    q = F.lower(F.trim(F.col(text)))
    month = F.coalesce(*[F.when(F.contains(q, F.lit(n.lower())), F.lit(i)) for i, n in enumerate(MONTH_NAMES, 1)])
    day0 = F.lit(today.isoformat()).cast("date")
    named = F.try_to_date(F.regexp_extract(F.col(text), DATE_PATTERN, 1), "yyyy-MM-dd")
    target = F.when(F.contains(q, F.lit("next week")), F.date_add(day0, 7)).otherwise(
        F.coalesce(named, F.date_add(day0, 1)))
    return questions.withColumns({
        "normalized": q,
        "year": _number(q, YEAR_PATTERN),
        "comparison_year": _number(q, COMPARISON_YEAR_PATTERN),
        "month": month,
        "month_extreme": F.when(_has(q, COLD_WORDS), "coldest").when(_has(q, WARM_WORDS), "warmest"),
        "year_extreme": F.when(_has(q, COLD_WORDS_YEAR), "coldest").when(_has(q, WARM_WORDS_YEAR), "warmest"),
        "compares": _has(q, ("warmer", "colder")),
        "says_this": F.contains(q, F.lit("this")),
        "target_date": F.when(_has(q, FORECAST_WORDS), target),
    })


def with_entity(slots: DataFrame, entities: DataFrame, entity: str, key: str) -> DataFrame:
    """Add ``chosen``: the alphabetically first entity whose name occurs in the question, or NULL.

    Every stretch of the question that is as long as some entity name is looked up by equality,
    which finds the same names as a containment test without comparing all pairs.
    """
    lengths = entities.agg(F.collect_set(F.length(entity))).scalar()
    names = entities.select(F.lower(entity).alias("_piece"), F.col(entity).alias("_name"))
    at = slots.select(key, "normalized", F.explode(lengths).alias("_len")).filter(F.length("normalized") >= F.col("_len"))
    starts = F.sequence(F.lit(1), F.length("normalized") - F.col("_len") + 1)
    pieces = at.select(key, F.explode(F.array_distinct(
        F.transform(starts, lambda s: F.substr(F.col("normalized"), s, F.col("_len"))))).alias("_piece"))
    found = pieces.join(names, "_piece").groupBy(key).agg(F.min("_name").alias("chosen"))
    return slots.join(found, key, "left")


def year_month_answers(slots: DataFrame, matrix: DataFrame, entity: str, key: str, baseline_label: str) -> DataFrame:
    """Which month of a year was the warmest or coldest. ``slots`` carries ``chosen``.

    A question without a known entity is about the alphabetically first one. ``matrix`` is the
    two-digit presentation form.
    """
    first = matrix.agg(F.min(entity)).scalar()
    asked = slots.filter(F.col("year").isNotNull() & F.col("year_extreme").isNotNull()).select(
        key, F.coalesce("chosen", first).alias(entity), "year", F.col("year_extreme").alias("extreme"))
    ranked = SEL.extreme_months(matrix, entity)
    text = F.struct("month", "mean_temp", "anomaly", F.coalesce("z_score", F.lit(0.0)).alias("z"))
    picks = ranked.groupBy(entity, "year", "extreme").agg(
        F.max(F.when(F.col("rank") == 1, text)).alias("best"), F.max(F.when(F.col("rank") == 2, text)).alias("next"))
    spans = matrix.groupBy(entity).agg(F.min("year").alias("y0"), F.max("year").alias("y1"))
    known = matrix.select(entity, "year").distinct().withColumn("has_rows", F.lit(True))
    runner = F.when(F.col("next").isNotNull(), F.concat(
        F.lit(" Runner-up: "), month_label(F.col("next.month")), F.lit(" (anomaly "), fixed(F.col("next.anomaly"), 2, True), F.lit(" °C)."),
    )).otherwise(F.lit(""))
    y = F.col("year").cast("string")
    answer = F.concat(
        F.lit("The "), F.col("extreme"), F.lit(" month in "), F.col(entity), F.lit(" "), y, F.lit(" was "),
        month_label(F.col("best.month")), F.lit(", with mean temperature "), fixed(F.col("best.mean_temp"), 1),
        F.lit(" °C and anomaly "), fixed(F.col("best.anomaly"), 2, True), F.lit(" °C (z-score "),
        fixed(F.col("best.z"), 2, True), F.lit(f" vs {baseline_label} baseline)."), runner)
    unknown = F.concat(F.lit("No data for "), F.col(entity), F.lit(" in "), y, F.lit(". Available years: "),
                       F.col("y0").cast("string"), F.lit("–"), F.col("y1").cast("string"), F.lit("."))
    note = F.concat(month_label(F.col("best.month")), F.lit(" "), y, F.lit(" was the "), F.col("extreme"),
                    F.lit(" month in "), F.col(entity), F.lit(" that year."))
    return (
        asked.join(spans, entity).join(known, [entity, "year"], "left").join(picks, [entity, "year", "extreme"], "left")
        .withColumns({
            "answer": F.when(F.col("has_rows").isNull(), unknown).otherwise(answer),
            "interpretation": F.when(F.col("has_rows").isNull(), F.lit("")).otherwise(note),
            "source_title": F.when(F.col("has_rows"), F.concat(F.col(entity), F.lit(" regional anomalies"))),
        }).select(key, *ANSWER_COLUMNS).filter(F.col("answer").isNotNull())
    )


def month_extreme_answers(
    slots: DataFrame, histories: DataFrame, entity: str, key: str, default_entity: str, pinned: bool = False
) -> DataFrame:
    """Which year had the warmest or coldest given month, with the opposite extreme for comparison.

    ``histories`` has (entity, month, year, mean_temp_c, anomaly_c, zscore). With ``pinned`` it is
    a stored table of the default entity, which answers whatever entity the question names.
    """
    full = histories.filter(F.col("anomaly_c").isNotNull() & F.col("mean_temp_c").isNotNull())
    ext = SEL.extreme_years(full, [entity, "month"], "anomaly_c", ["mean_temp_c", "zscore"])
    fallback = full.agg(F.coalesce(F.max(F.when(F.col(entity) == default_entity, F.col(entity))), F.min(entity))).scalar()
    place = F.lit(default_entity) if pinned else F.coalesce("chosen", fallback)
    asked = slots.filter(F.col("month").isNotNull() & F.col("month_extreme").isNotNull()).select(
        key, place.alias(entity), "month", F.col("month_extreme").alias("extreme"))
    cold = F.col("extreme") == "coldest"
    joined = asked.join(ext, [entity, "month"]).withColumns({
        "hit": F.when(cold, F.col("coldest")).otherwise(F.col("warmest")),
        "other": F.when(cold, F.col("warmest")).otherwise(F.col("coldest")),
        "opposite": F.when(cold, F.lit("warmest")).otherwise(F.lit("coldest")),
    })
    unit = F.lit(" °C") if pinned else F.lit(" degC")
    record = F.lit(" in the record was ") if pinned else F.concat(F.lit(" in the "), F.col(entity), F.lit(" record was "))
    where = F.lit("") if pinned else F.concat(F.lit(" in "), F.col(entity))
    label = month_name(F.col("month"))
    answer = F.concat(
        F.lit("The "), F.col("extreme"), F.lit(" "), label, record, F.col("hit.year").cast("string"),
        F.lit(", with a mean temperature of "), fixed(F.col("hit.mean_temp_c"), 1), unit, F.lit(" and anomaly "),
        fixed(F.col("hit.anomaly_c"), 2, True), unit, F.lit(" (z-score "), fixed(F.coalesce("hit.zscore", F.lit(0.0)), 2, True),
        F.lit("). For comparison, the "), F.col("opposite"), F.lit(" was "), F.col("other.year").cast("string"),
        F.lit(" with anomaly "), fixed(F.col("other.anomaly_c"), 2, True), unit, F.lit("."))
    note = F.concat(F.col("hit.year").cast("string"), F.lit(" was the "), F.col("extreme"), F.lit(" "), label, where, F.lit(" in the dataset."))
    title = F.concat(F.col(entity), F.lit(" "), label, F.lit(" anomaly table")) if pinned else F.concat(
        F.col(entity), F.lit(" regional anomalies"))
    return joined.withColumns({"answer": answer, "interpretation": note, "source_title": title}).select(key, *ANSWER_COLUMNS)


def comparison_answers(slots: DataFrame, histories: DataFrame, entity: str, key: str) -> DataFrame:
    """Is this month warmer than the same month of another year.

    ``histories`` holds stored slices. A question without ``chosen`` entity is left to later
    kinds; so is one that names neither "this" nor the latest year.
    """
    w = Window.partitionBy(entity, "month")
    latest = F.max(F.struct("year", "mean_temp_c", "anomaly_c")).over(w)
    rows = histories.withColumn("now", latest).select(
        entity, "month", F.col("year").alias("comparison_year"), F.col("mean_temp_c").alias("other_mean"),
        F.col("anomaly_c").alias("other_anomaly"), "now")
    asked = slots.filter(F.col("month").isNotNull() & F.col("compares") & F.col("comparison_year").isNotNull()).select(
        key, F.col("chosen").alias(entity), "month", "comparison_year", "says_this", "normalized")
    named = F.col("says_this") | F.contains("normalized", F.col("now.year").cast("string"))
    j = asked.join(rows, [entity, "month", "comparison_year"]).filter(named)
    delta = F.col("now.mean_temp_c") - F.col("other_mean")
    label = month_name(F.col("month"))
    year, other = F.col("now.year").cast("string"), F.col("comparison_year").cast("string")
    anomalies = F.concat(F.lit("Anomalies are "), fixed(F.col("now.anomaly_c"), 2, True), F.lit(" C and "),
                         fixed(F.col("other_anomaly"), 2, True), F.lit(" C respectively."))
    head = F.concat(F.col(entity), F.lit(" "), label, F.lit(" "), year)
    differs = F.concat(
        F.lit("Yes. "), head, F.when(delta > 0, " is warmer than ").otherwise(" is colder than "), other,
        F.lit(". Mean temperature is "), fixed(F.col("now.mean_temp_c"), 2), F.lit(" C versus "), fixed(F.col("other_mean"), 2),
        F.lit(" C, a difference of "), fixed(delta, 2, True), F.lit(" C over the same cutoff window. "), anomalies)
    same = F.concat(head, F.lit(" is the same as "), other, F.lit(" at "), fixed(F.col("now.mean_temp_c"), 2),
                    F.lit(" C over the same cutoff window. "), anomalies)
    relation = F.when(delta > 0, "warmer").when(delta < 0, "colder").otherwise("the same temperature as")
    note = F.concat(head, F.lit(" is "), relation, F.lit(" "), other, F.lit(" by "), fixed(delta, 2, True), F.lit(" C."))
    return j.withColumns({
        "answer": F.when(delta == 0, same).otherwise(differs), "interpretation": note,
        "source_title": F.concat(F.col(entity), F.lit(" "), label, F.lit(" anomaly table")),
    }).select(key, *ANSWER_COLUMNS).filter(F.col("answer").isNotNull())


def forecast_answers(slots: DataFrame, forecast: DataFrame, key: str, today: date, place: str, min_days: int = 7) -> DataFrame:
    """Temperature of a future day: seasonal baseline, bias of the year, adjusted figure, typical range.

    ``forecast`` has one row per target date: y_pred, ytd_bias, recent_bias, n_ytd, n_recent,
    typical_low, typical_high.
    """
    asked = slots.filter(F.col("target_date").isNotNull()).select(key, "target_date")
    base = F.round("y_pred", 1)
    ytd, recent = F.round(F.coalesce("ytd_bias", F.lit(0.0)), 1), F.round(F.coalesce("recent_bias", F.lit(0.0)), 1)
    enough = F.coalesce(F.col("n_ytd"), F.lit(0)) >= min_days
    j = asked.join(forecast, "target_date").withColumns({
        "base": base, "ytd": ytd, "recent": recent, "enough": enough, "day": F.col("target_date").cast("string"),
        "adjusted": F.when(enough, F.round(F.col("y_pred") + recent, 1)).otherwise(base),
    })
    label = F.when(F.col("target_date") == F.date_add(F.lit(today.isoformat()).cast("date"), 1), F.lit("tomorrow")).otherwise(F.col("day"))
    tone = lambda c: F.when(F.col(c) >= 0, "warmer").otherwise("colder")
    size = lambda c: fixed(F.abs(F.col(c)), 1)
    rng = F.when(F.col("typical_low").isNotNull(), F.concat(
        F.lit(" Typical daily range for this time of year: "), fixed(F.col("typical_low"), 1), F.lit("°C (low) to "),
        fixed(F.col("typical_high"), 1), F.lit("°C (high)."))).otherwise(F.lit(""))
    head = F.concat(F.lit("For "), label, F.lit(" ("), F.col("day"), F.lit(f") in {place}, the "))
    year = F.year("target_date").cast("string")
    tail = F.lit("This is a climatological trend estimate, not a live synoptic weather forecast.")
    full = F.concat(
        head, F.lit("adjusted temperature estimate is "), fixed(F.col("adjusted"), 1), F.lit("°C."), rng,
        F.lit(" The model's seasonal baseline for that date is "), fixed(F.col("base"), 1),
        F.lit("°C. This year has been running "), size("ytd"), F.lit("°C "), tone("ytd"),
        F.lit(" than the model baseline year-to-date, and the most recent "), F.col("n_recent").cast("string"),
        F.lit("-day window is "), size("recent"), F.lit("°C "), tone("recent"),
        F.lit(" than expected. That recent bias is applied as a correction to produce the adjusted estimate. "), tail)
    bare = F.concat(
        head, F.lit("current climatological baseline estimate is "), fixed(F.col("base"), 1), F.lit("°C."), rng,
        F.lit(" There are not enough "), year, F.lit(" observations yet to compute a reliable bias correction, so the answer is "
        "reported as the raw model baseline rather than an adjusted estimate. "), tail)
    note = F.concat(
        F.lit("Baseline: "), fixed(F.col("base"), 1), F.lit("°C | YTD bias: "), fixed(F.col("ytd"), 1, True), F.lit("°C | Recent "),
        F.coalesce(F.col("n_recent"), F.lit(0)).cast("string"), F.lit("d bias: "), fixed(F.col("recent"), 1, True),
        F.lit("°C | Adjusted: "), fixed(F.col("adjusted"), 1), F.lit("°C"))
    return j.withColumns({
        "answer": F.when(F.col("enough"), full).otherwise(bare), "interpretation": note,
        "source_title": F.lit("Temperature model forecast"),
    }).select(key, *ANSWER_COLUMNS)


def stack_answers(kinds: list[tuple[str, DataFrame]], key: str, first_order: int = 0) -> DataFrame:
    """All answer relations as one table, numbered by their precedence."""
    stacked = None
    for i, (name, rel) in enumerate(kinds, first_order):
        part = rel.select(key, F.lit(i).alias("order"), F.lit(name).alias("kind"), *ANSWER_COLUMNS)
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def route(questions: DataFrame, key: str, stacked: DataFrame) -> DataFrame:
    """Answer of the highest precedence for every question, else the standard refusal.

    The stacked relations are reduced once per question instead of being joined one by one.
    """
    first = stacked.groupBy(key).agg(F.min_by(F.struct("kind", *ANSWER_COLUMNS), "order").alias("a"))
    return questions.join(first, key, "left").select(
        *questions.columns,
        F.coalesce("a.kind", F.lit("none")).alias("kind"),
        F.coalesce("a.answer", F.lit(NO_ANSWER)).alias("answer"),
        F.coalesce("a.interpretation", F.lit("")).alias("interpretation"),
        F.col("a.source_title").alias("source_title"),
    )
