"""Text normalisation, tokens, sentence and paragraph cuts, label bands and answer scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.functions.numeric import fixed

# Words that carry no meaning for retrieval.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "how", "in",
    "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "vs", "what", "with",
)
# A token is a run of these characters.
TOKEN_PATTERN = "[a-z0-9_]+"
# Every character Unicode counts as white space, spelled out because engines differ on \s.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
# Phrases that raise or lower the answer score.
HEDGES = ("likely", "approximately", "around", "estimated", "about", "suggests")
REFUSALS = ("i don't know", "i do not know", "cannot answer", "no information")
NO_ANSWER = "No relevant pipeline artifacts were available for this question."
NO_ANSWER_MARK = "No relevant pipeline artifacts"
# How figures are found in an answer.
NUMBER_PATTERN = r"\b\d+(?:[.,]\d+)?(?:\s*%|°C|mm|hPa)?\b"
TEMP_ANOMALY_PATTERN = r"(?i)temperature anomaly of\s*([+-]?\d+\.?\d*)\s*[°C]"
ANY_ANOMALY_PATTERN = r"(?i)anomaly[:\s]+([+-]?\d+\.?\d*)\s*°?C"
ZSCORE_PATTERN = r"(?i)z[- ]?score[:\s]+([+-]?\d+\.?\d*)"
R2_PATTERN = r"[Rr][²2]\s*[=:]\s*([+-]?\d+\.?\d*)"


def normalize_text(c: Column) -> Column:
    """Heading marks off every line, white space collapsed to one blank."""
    plain = F.regexp_replace(c, rf"(?md)^#+{SPACE}*", "")
    return F.trim(F.regexp_replace(plain, f"{SPACE}+", " "))


def sentences(c: Column) -> Column:
    """The normalised text cut after every full stop, exclamation or question mark."""
    return F.split(normalize_text(c), r"(?<=[.!?]) +")


def first_sentences(c: Column, limit: int = 2) -> Column:
    return F.array_join(F.slice(sentences(c), 1, limit), " ")


def paragraphs(c: Column, limit: int = 3) -> Column:
    """The first ``limit`` non-empty blocks between blank lines."""
    blocks = F.transform(F.split(c, "\n\n"), lambda p: F.regexp_replace(p, f"^{SPACE}+|{SPACE}+$", ""))
    return F.slice(F.filter(blocks, lambda p: p != ""), 1, limit)


def words(c: Column) -> Column:
    """Lower-case tokens without stop words, in text order."""
    found = F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*STOP_WORDS))


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by an underscore; shifting by slice keeps this linear."""
    n = F.size(tokens) - 1
    left, right = F.slice(tokens, F.lit(1), F.greatest(n, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(n, F.lit(0)))
    return F.when(n > 0, F.zip_with(left, right, lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(
        F.array().cast("array<string>"))


def z_label(z: Column) -> Column:
    a = F.abs(z)
    return (
        F.when(a < 0.5, "near normal").when(a < 1.0, "slightly anomalous").when(a < 1.5, "anomalous")
        .when(a < 2.0, "very anomalous").when(z.isNotNull(), "extreme")
    )


def z_prose(z: Column, record: str = "35-year record") -> Column:
    a = F.abs(z)
    return (
        F.when(a < 0.5, "within the normal range").when(a < 1.0, "slightly unusual")
        .when(a < 1.5, "anomalous — outside typical variability")
        .when(a < 2.0, "very anomalous — in the ~5th percentile of historical years")
        .when(z.isNotNull(), f"extreme — a rare event in the {record}")
    )


def intensity(v: Column) -> Column:
    a = F.abs(v)
    return F.when(a < 1, "slightly").when(a < 3, "notably").when(v.isNotNull(), "significantly")


def direction(v: Column) -> Column:
    return F.when(v > 0, "warmer").when(v.isNotNull(), "colder")


def fit_sentence(r2: Column) -> Column:
    """One sentence on the explained variance; values above 1 are not a valid figure."""
    head = F.concat(F.lit("R² = "), fixed(r2, 2))
    return (
        F.when(r2 > 1, F.lit(None).cast("string"))
        .when(r2 >= 0.8, F.concat(head, F.lit(" indicates the model explains most of the variance — a good fit.")))
        .when(r2 >= 0.65, F.concat(head, F.lit(" means the model captures the main seasonal pattern reasonably well.")))
        .when(r2 >= 0, F.concat(head, F.lit(" suggests the model has limited predictive power.")))
        .when(r2 < 0, F.concat(head, F.lit(" means the model is worse than predicting the mean — it needs improvement.")))
    )


def first_number(c: Column, pattern: str) -> Column:
    """First captured number of a pattern, or NULL."""
    return F.regexp_extract(c, pattern, 1).try_cast("double")


def interpretation(answer: Column, average: str = "30-year average", record: str = "35-year record") -> Column:
    """Plain sentences on the anomaly, z-score and fit figures found in an answer; may be empty.

    ``average`` and ``record`` name the baseline and the whole period of the figures.
    """
    v = F.coalesce(first_number(answer, TEMP_ANOMALY_PATTERN), first_number(answer, ANY_ANOMALY_PATTERN))
    z = first_number(answer, ZSCORE_PATTERN)
    parts = [
        F.concat(F.lit("This means it has been "), intensity(v), F.lit(" "), direction(v),
                 F.lit(f" than the {average} ("), fixed(v, 1, plus=True), F.lit(" °C).")),
        F.concat(F.lit("A z-score of "), fixed(z, 2, plus=True), F.lit(" is "), z_prose(z, record), F.lit(".")),
        fit_sentence(first_number(answer, R2_PATTERN)),
    ]
    return F.concat_ws(" ", *parts)


def _any(c: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(c, F.lit(p))
    return out


def answer_score(answer: Column, n_sources: Column) -> Column:
    """0..5 from sources, length, figures, hedging and refusal."""
    low, size = F.lower(answer), F.length(answer)
    numbers = F.size(F.regexp_extract_all(answer, F.lit(NUMBER_PATTERN), F.lit(0)))
    raw = (
        F.lit(2.5)
        + F.when(n_sources >= 3, 1.0).when(n_sources >= 1, 0.5).otherwise(0.0)
        + F.when(size > 500, 1.0).when(size > 250, 0.5).when(size < 100, -1.0).otherwise(0.0)
        + F.when(numbers >= 3, 0.5).when(numbers >= 1, 0.25).otherwise(0.0)
        + F.when(_any(low, HEDGES), 0.25).otherwise(0.0)
        + F.when(_any(low, REFUSALS), -1.0).otherwise(0.0)
    )
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(5.0), raw))
    return F.when(F.contains(answer, F.lit(NO_ANSWER_MARK)), 0.0).otherwise(F.round(clipped, 2))
