"""Text, retrieval and evaluation queries over documents, benchmark, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog import climate
from tempora.catalog.base import MATRIX, query, with_sql
from tempora.functions import text as TX
from tempora.operators import dense
from tempora.operators import retrieval as R
from tempora.session import input_state, shared_dir
from tempora.sources import star

SP = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def norm_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({c}, '(?m)^#+{SP}*', '', 'g'), '{SP}+', ' ', 'g'))"


def sentences_sql(c: str) -> str:
    """Engines without look-behind: mark the cut, then split on the mark."""
    return rf"string_split(regexp_replace({norm_sql(c)}, '([.!?]) +', '\1' || chr(1), 'g'), chr(1))"


STOP = "[" + ", ".join(f"'{w}'" for w in TX.STOP_WORDS) + "]"


def words_sql(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '{TX.TOKEN_PATTERN}'), lambda w: NOT list_contains({STOP}, w))"


def index_sql(prefix: str, table: str, key: str) -> str:
    """Term counts of a table."""
    return f"""
{prefix}w AS (SELECT {key} AS k, {words_sql('text')} AS w FROM {table}),
{prefix}t AS (SELECT k, len(w) + greatest(len(w) - 1, 0) AS total, unnest(list_concat(w,
  list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]))) AS term FROM {prefix}w),
{prefix}c AS (SELECT k, term, count(*) AS n, max(total) AS total FROM {prefix}t GROUP BY k, term)"""


INDEX = index_sql("d", "documents", "doc_id") + """,
idf AS (SELECT term, count(*) AS df, ln((1 + (SELECT greatest(count(*), 1) FROM documents)) / (1 + count(*))) + 1.0 AS idf
  FROM dc GROUP BY term),
dv0 AS (SELECT k AS doc_id, term, n / total * idf AS w FROM dc JOIN idf USING (term)),
dnorm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dv0 GROUP BY doc_id),
dv AS (SELECT doc_id, term, w / norm AS weight FROM dv0 JOIN dnorm USING (doc_id))"""
QUESTIONS = index_sql("q", "benchmark", "item_id") + """,
qv0 AS (SELECT k AS item_id, term, n / total * idf AS w FROM qc JOIN idf USING (term)),
qnorm AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qv0 GROUP BY item_id),
qv AS (SELECT item_id, term, w / norm AS weight FROM qv0 JOIN qnorm USING (item_id)),
hits AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank
  FROM (SELECT item_id, doc_id, sum(dv.weight * qv.weight) AS score FROM dv JOIN qv USING (term) GROUP BY item_id, doc_id)
  WHERE score > 0) WHERE rank <= 3)"""


def documents(spark, path):
    return star.table(spark, path, "documents")


def corpus(spark, path):
    d = documents(spark, path)
    return d.select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), "source", "text")


_INDEXES: dict = {}


def stored_index(spark, path):
    """Index of the documents in the shared folder; written once for one state of the input file."""
    key = (spark.sparkContext.applicationId, input_state(spark, [f"{path}/documents.parquet"]))
    if key not in _INDEXES:
        _INDEXES[key] = R.write_index(documents(spark, path), "doc_id", "text", shared_dir(spark, "index"), buckets=16)
    return _INDEXES[key]


def hits(spark, path, k=3, first=0.5):
    index, vocabulary = stored_index(spark, path)
    return R.retrieve(index, vocabulary, star.table(spark, path, "benchmark"), "doc_id", "item_id", "text", k, first)


@query("normalize_text", "F11", f"SELECT doc_id, {norm_sql('text')} AS text FROM documents")
def _(spark, path):
    return documents(spark, path).select("doc_id", TX.normalize_text(F.col("text")).alias("text"))


@query(
    "first_sentences", "F12",
    f"SELECT doc_id, array_to_string(({sentences_sql('text')})[1:2], ' ') AS lead FROM documents",
)
def _(spark, path):
    return documents(spark, path).select("doc_id", TX.first_sentences(F.col("text"), 2).alias("lead"))


@query(
    "tokenize", "F13",
    with_sql(index_sql("d", "documents", "doc_id")) + """ SELECT k AS doc_id, array_to_string(list_concat(w,
      list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), ' ') AS tokens FROM dw""",
)
def _(spark, path):
    d = documents(spark, path).select("doc_id", TX.words(F.col("text")).alias("w"))
    return d.select("doc_id", F.array_join(F.concat("w", TX.bigrams(F.col("w"))), " ").alias("tokens"))


@query(
    "paragraphs", "F14",
    rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)),
        lambda x: regexp_replace(x, '^{SP}+|{SP}+$', '', 'g')), lambda x: x <> '')[1:3] AS p FROM documents)
      SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS pos, unnest(p) AS paragraph FROM p""",
)
def _(spark, path):
    return documents(spark, path).select("doc_id", F.posexplode(TX.paragraphs(F.col("text"))).alias("pos", "paragraph"))


Z_LABEL = """CASE WHEN abs(z_score) < 0.5 THEN 'near normal' WHEN abs(z_score) < 1 THEN 'slightly anomalous'
  WHEN abs(z_score) < 1.5 THEN 'anomalous' WHEN abs(z_score) < 2 THEN 'very anomalous' WHEN z_score IS NOT NULL THEN 'extreme' END"""


@query(
    "z_labels", "F8 F9",
    with_sql(MATRIX) + f""" SELECT city, year, month, {Z_LABEL} AS label,
      CASE WHEN abs(z_score) < 0.5 THEN 'within the normal range' WHEN abs(z_score) < 1 THEN 'slightly unusual'
        WHEN abs(z_score) < 1.5 THEN 'anomalous — outside typical variability'
        WHEN abs(z_score) < 2 THEN 'very anomalous — in the ~5th percentile of historical years'
        WHEN z_score IS NOT NULL THEN 'extreme — a rare event in the 35-year record' END AS prose,
      CASE WHEN abs(anomaly) < 1 THEN 'slightly' WHEN abs(anomaly) < 3 THEN 'notably' WHEN anomaly IS NOT NULL THEN 'significantly' END AS intensity,
      CASE WHEN anomaly > 0 THEN 'warmer' WHEN anomaly IS NOT NULL THEN 'colder' END AS direction FROM matrix""",
)
def _(spark, path):
    z, a = F.col("z_score"), F.col("anomaly")
    return climate.matrix(spark, path).select(
        "city", "year", "month", TX.z_label(z).alias("label"), TX.z_prose(z).alias("prose"),
        TX.intensity(a).alias("intensity"), TX.direction(a).alias("direction"))


R2_BANDS = """CASE WHEN r2 > 1 THEN NULL WHEN r2 >= 0.8 THEN 'R² = ' || printf('%.2f', r2) || ' indicates the model explains most of the variance — a good fit.'
  WHEN r2 >= 0.65 THEN 'R² = ' || printf('%.2f', r2) || ' means the model captures the main seasonal pattern reasonably well.'
  WHEN r2 >= 0 THEN 'R² = ' || printf('%.2f', r2) || ' suggests the model has limited predictive power.'
  ELSE 'R² = ' || printf('%.2f', r2) || ' means the model is worse than predicting the mean — it needs improvement.' END"""


@query(
    "fit_sentences", "F9",
    f"WITH r AS (SELECT o_orderkey, CAST(o_orderkey % 190 - 80 AS DOUBLE) / 100.0 AS r2 FROM orders) SELECT o_orderkey, {R2_BANDS} AS sentence FROM r",
)
def _(spark, path):
    r2 = (F.col("o_orderkey") % 190 - 80).cast("double") / 100.0
    return star.table(spark, path, "orders").select("o_orderkey", TX.fit_sentence(r2).alias("sentence"))


@query(
    "interpretation", "F10",
    f"""WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 97 - 48 AS DOUBLE) / 10.0 AS v, CAST(o_orderkey % 61 - 30 AS DOUBLE) / 10.0 AS z,
      CAST(o_orderkey % 190 - 80 AS DOUBLE) / 100.0 AS r2 FROM orders)
      SELECT o_orderkey, 'This means it has been ' || CASE WHEN abs(v) < 1 THEN 'slightly' WHEN abs(v) < 3 THEN 'notably' ELSE 'significantly' END
      || CASE WHEN v > 0 THEN ' warmer' ELSE ' colder' END || ' than the 30-year average (' || printf('%+.1f', v) || ' °C). A z-score of '
      || printf('%+.2f', z) || ' is ' || CASE WHEN abs(z) < 0.5 THEN 'within the normal range' WHEN abs(z) < 1 THEN 'slightly unusual'
        WHEN abs(z) < 1.5 THEN 'anomalous — outside typical variability'
        WHEN abs(z) < 2 THEN 'very anomalous — in the ~5th percentile of historical years'
        ELSE 'extreme — a rare event in the 35-year record' END || '.' || coalesce(' ' || {R2_BANDS}, '') AS interpretation FROM o""",
)
def _(spark, path):
    k = F.col("o_orderkey")
    answer = F.concat(
        F.lit("The region had an anomaly: "), F.format_string("%+.1f", (k % 97 - 48).cast("double") / 10.0), F.lit("°C, z-score "),
        F.format_string("%.1f", (k % 61 - 30).cast("double") / 10.0), F.lit(", R² = "), F.format_string("%.2f", (k % 190 - 80).cast("double") / 100.0))
    return star.table(spark, path, "orders").select("o_orderkey", TX.interpretation(answer).alias("interpretation"))


@query(
    "document_frequency", "R2",
    with_sql(INDEX) + " SELECT term, df, idf FROM idf", "idf",
)
def _(spark, path):
    return R.inverse_document_frequency(documents(spark, path), "doc_id", "text")


@query("tfidf_vectors", "R3", with_sql(INDEX) + " SELECT doc_id, term, weight FROM dv", "weight")
def _(spark, path):
    return R.build_index(documents(spark, path), "doc_id", "text")


@query(
    "tfidf_topk", "R5 J7",
    with_sql(INDEX, QUESTIONS) + " SELECT item_id, doc_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM hits",
)
def _(spark, path):
    return hits(spark, path).withColumn("score", F.round("score", 4))


@query(
    "tfidf_topk_frequent_terms", "R5 J7",
    with_sql(INDEX, QUESTIONS) + " SELECT item_id, doc_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM hits",
)
def _(spark, path):
    # a small share sends most terms down the bounded path
    return hits(spark, path, first=0.1).withColumn("score", F.round("score", 4))


@query(
    "dense_topk", "R6",
    """WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings),
      m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY label, pos),
      c AS (SELECT label, list(x ORDER BY pos) AS q FROM m GROUP BY label),
      s AS (SELECT c.label, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, c)
      SELECT label, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label
        ORDER BY round(score, 6) DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "score",
)
def _(spark, path):
    # the query vectors are the mean vectors of the labels, a set of fixed size
    e = star.table(spark, path, "embeddings")
    return dense.dense_top_k(e, R.mean_vectors(e, "label", "embedding"), "vec_id", "embedding", "label", 5)


@query(
    "dense_topk_cells", "R6",
    """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 10 = 0),
      s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, q)
      SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY round(score, 6) DESC, vec_id) AS rank FROM s) WHERE rank <= 3""",
    "score",
)
def _(spark, path):
    # every tenth vector asks for its neighbours: the number of queries grows with the table
    e = star.table(spark, path, "embeddings")
    q = e.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return dense.search_cells(dense.build_cells(e, "vec_id", "embedding"), e, q, "query_id", 3)[0]


PROMPT = "Answer using only the provided context.\n\nQuestion: {question}\n\nContext:\n{context}\n"


@query(
    "grounded_context", "R13",
    with_sql(INDEX, QUESTIONS) + """, x AS (SELECT item_id, string_agg('[' || rank || '] Document ' || doc_id || ' (' || source || ')' || chr(10)
        || left(d.text, 600), chr(10) || chr(10) ORDER BY rank) AS context FROM hits JOIN documents d USING (doc_id) GROUP BY item_id)
      SELECT item_id, 'Answer using only the provided context.' || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || chr(10)
        || 'Context:' || chr(10) || context || chr(10) AS prompt FROM x JOIN benchmark b USING (item_id)""",
)
def _(spark, path):
    h = R.with_documents(hits(spark, path), corpus(spark, path), "doc_id", "item_id")
    q = star.table(spark, path, "benchmark").withColumnRenamed("text", "question")
    ctx = R.grounded_context(h, "item_id").join(q, "item_id")
    return R.fill_template(ctx, PROMPT, ["question", "context"], "prompt").select("item_id", "prompt")


@query(
    "extractive_answers", "R11 F10",
    with_sql(INDEX, QUESTIONS) + f""" SELECT item_id, string_agg('**Document ' || doc_id || '**: ' ||
      array_to_string(({sentences_sql('d.text')})[1:2], ' '), chr(10) || chr(10) ORDER BY rank) AS answer,
      count(*) AS n_sources FROM hits JOIN documents d USING (doc_id) WHERE trim(d.text) <> '' GROUP BY item_id""",
)
def _(spark, path):
    h = R.with_documents(hits(spark, path), corpus(spark, path), "doc_id", "item_id")
    a = R.extractive_answers(h, "item_id")
    return a.select("item_id", "answer", F.size("sources").cast("long").alias("n_sources"))


def _contains_any(c: str, phrases) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(c, p.replace("'", "''")) for p in phrases) + ")"


SCORE = f"""CASE WHEN contains(answer, '{TX.NO_ANSWER_MARK}') THEN 0.0 ELSE round(greatest(0.0, least(5.0, 2.5
  + CASE WHEN n >= 3 THEN 1.0 WHEN n >= 1 THEN 0.5 ELSE 0 END
  + CASE WHEN length(answer) > 500 THEN 1.0 WHEN length(answer) > 250 THEN 0.5 WHEN length(answer) < 100 THEN -1.0 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(answer, '{TX.NUMBER_PATTERN}')) >= 3 THEN 0.5
         WHEN len(regexp_extract_all(answer, '{TX.NUMBER_PATTERN}')) >= 1 THEN 0.25 ELSE 0 END
  + CASE WHEN {_contains_any('lower(answer)', TX.HEDGES)} THEN 0.25 ELSE 0 END
  + CASE WHEN {_contains_any('lower(answer)', TX.REFUSALS)} THEN -1.0 ELSE 0 END)), 2) END"""


@query(
    "answer_evaluation", "R12 F15",
    f"""WITH a AS (SELECT conv_id, turn, text AS answer, least(turn, 4) AS n FROM conversations WHERE role = 'assistant')
      SELECT conv_id, turn, NOT contains(answer, 'No relevant pipeline artifacts') AS answered, n AS source_count,
        length(answer) AS answer_length, CAST({SCORE} AS DOUBLE) AS judge_score FROM a""",
    "judge_score",
)
def _(spark, path):
    a = star.table(spark, path, "conversations").filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("answer"), F.least("turn", F.lit(4)).alias("n_sources"))
    return R.evaluation_rows(a).drop("answer", "n_sources")


@query("index_refresh", "R4", with_sql(INDEX) + """ SELECT term, df, max(weight) AS max_weight, idf FROM dv JOIN idf USING (term)
  GROUP BY term, df, idf""", "max_weight idf")
def _(spark, path):
    return stored_index(spark, path)[1].drop("bucket")
