"""TF-IDF index of packed postings, cosine retrieval and grounded contexts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from tempora.functions.text import NO_ANSWER, answer_score, bigrams, first_sentences, interpretation, words
from tempora.operators.terms import block_scores, document_counts, posting_blocks, postings_of, smooth_idf, term_shares, text_norms, unit_vectors
from tempora.session import shared_table, shuffles_removed

#: Bytes of the corpus for each part of a folder; passes over the folders for the vocabulary; terms that one scan of the
#: index looks for; questions that one task scores together.
PART, PASSES, ASKED, TOGETHER = 8 << 20, 4, 1 << 18, 4096


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n, total): occurrences of each word and bigram; ``total`` counts every token.

    Texts are cut in the scan. The tokens of a text stand in one task, so its counts are
    complete before the exchange and only (key, term, count) rows travel, never text.
    """
    rows = docs.select(key, words(F.col(text)).alias("w")).select(
        key, F.explode(F.concat("w", bigrams(F.col("w")))).alias("term"),
        (F.size("w") + F.greatest(F.size("w") - 1, F.lit(0))).alias("total"))
    return rows.groupBy(key, "term").agg(F.count("*").alias("n"), F.max("total").alias("total"))


def inverse_document_frequency(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df, idf) of a corpus. Texts are cut and counted in the scan, a row per term and block of texts travels."""
    return smooth_idf(document_counts(docs, key, text), docs.agg(F.count("*")).scalar())


def _unit(w: DataFrame, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """tf x idf scaled to unit length per key."""
    raw = w.withColumn("w", F.col("n") / F.col("total") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"), *carry)


def build_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): unit-length vectors of a corpus in long form.

    The texts are cut once. Rows of a text and a term stand in the task that made them: blocks of
    texts ask for the document frequencies of their terms, so a term travels once per block.
    """
    return unit_vectors(docs, key, text)


@dataclass(frozen=True)
class Index:
    """Stored vectors: packed postings by folder of terms, and the texts of each block with their lengths."""

    postings: DataFrame
    texts: DataFrame


def write_index(docs: DataFrame, key: str, text: str, path: str, buckets: int = 64) -> tuple[Index, DataFrame]:
    """Full rebuild of the stored index; returns the stored vectors and vocabulary.

    Vectors are kept as counts, totals and lengths, from which a weight is one product: a row per
    block of texts and folder of terms, written by the task that cut the texts. A question reads
    only the folders of its terms.
    The vocabulary (term, df, max_weight, idf) is aggregated from the stored vectors, some folders
    at a time, so what travels for it is never on disk at once.
    """
    spark = docs.sparkSession
    stored = lambda name, df: spark.read.schema(df.schema).parquet(f"{path}/{name}")
    with shuffles_removed(spark):
        rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
        blocks = posting_blocks(docs, key, text, buckets, -(-(size or 0) // (PART * buckets)) or 1)
        blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/vectors")
        postings = stored("vectors", blocks)
        lengths = text_norms(postings, docs.schema[key], max(rows, 1))
        lengths.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/texts")
        texts = stored("texts", lengths)
        for i in range(passes := min(PASSES, buckets)):
            # the vocabulary carries each term's folder, so questions join on (bucket, term) and prune
            some = postings.filter(F.col("bucket").isin([*range(i, buckets, passes)]))
            vocabulary = smooth_idf(term_shares(some, texts), F.lit(rows)).withColumn("max_weight", F.col("share") * F.col("idf")).select("bucket", "term", "df", "max_weight", "idf")
            vocabulary.write.mode("append" if i else "overwrite").option("compression", "zstd").parquet(f"{path}/vocabulary")
    return Index(postings, texts), stored("vocabulary", vocabulary)


def top_per_question(scores: DataFrame, question: str, doc: str, k: int) -> DataFrame:
    """Best k documents per question. The row-number filter makes every task keep only k rows
    per question before the exchange, so a question that matches everything stays cheap."""
    w = Window.partitionBy(question).orderBy(F.round("score", 6).desc(), doc)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def question_vectors(questions: DataFrame, question: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(question, bucket, term, q_weight, df, max_weight, idf) of the question terms found in the vocabulary.

    Terms outside the vocabulary count in the length of the question but carry no weight. The
    terms are stored first: by their size the optimizer sees that the vocabulary need not travel.
    """
    known = shared_table(term_counts(questions, question, text), "question-terms").join(vocabulary, "term")
    return _unit(known, question, ("bucket", "df", "max_weight", "idf")).withColumnRenamed("weight", "q_weight")


def _dots(index: Index, terms: DataFrame, doc: str, question: str, k: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """(question, doc, score, block, code): dot products over shared terms, whole in the block of the text.

    Only postings of the terms asked for leave the scan. With ``k`` a block returns its k best per
    question; for questions that ``only`` (question, block, code) has, these texts alone are scored.
    """
    n_terms, n_questions = terms.agg(F.count_distinct("term"), F.approx_count_distinct(question)).first()
    groups, parts = -(-n_terms // ASKED) or 1, -(-n_questions // TOGETHER) or 1
    # at most a row per folder
    folders = F.broadcast(terms.select("bucket").distinct())
    postings = index.postings.join(folders, "bucket", "left_semi")
    found = None
    for g in range(groups):
        wanted = terms.filter(F.pmod(F.xxhash64("term"), F.lit(groups)) == g).select("term").distinct().toArrow()["term"].combine_chunks()
        some = postings_of(postings, wanted)
        found = some if found is None else found.unionByName(some)
    part = F.pmod(F.xxhash64(question), F.lit(parts)).cast("int").alias("part")
    hits = found.join(terms, ["bucket", "term"])
    if only is not None:
        asked, here = only.groupBy(question).agg(F.lit(True).alias("_limited")), only.groupBy("block", question).agg(F.collect_list("code").alias("only"))
        hits = hits.join(asked, question, "left").join(here.select("block", question, F.lit(True).alias("_here")), ["block", question], "left")
        hits = hits.filter(F.col("_limited").isNull() | F.col("_here"))
    hits = hits.select("block", part, question, "docs", "n", (F.col("q_weight") * F.col("idf")).alias("f"), F.lit(None).cast("array<int>").alias("only"))
    if only is not None:
        hits = hits.unionByName(here.select(
            "block", part, question, F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("n"), F.lit(None).cast("double").alias("f"), "only"))
    texts = index.texts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return block_scores(hits, texts, ["block", "part"], terms.schema[question], StructField(doc, index.texts.schema["keys"].dataType.elementType), k)


def retrieve(
    index: Index, vocabulary: DataFrame, questions: DataFrame, doc: str, question: str, text: str, k: int = 3,
    first: float = 0.5,
) -> DataFrame:
    """(question, doc, score, rank): the k most similar documents with a positive score.

    Each question's rarest terms, a share ``first`` of them, are matched with their documents.
    The largest possible contribution of its other terms is known from the vocabulary; where it
    cannot lift a document over the k-th best score found so far, only the documents that can
    still reach the top k are scored on all terms, in their block. Questions without such a
    guarantee are scored for all documents, in the same scan; each block returns its k best, so
    the result is exact in every case.

    Question vectors, first scores, lookups and hits are read several times and are stored in
    between, which also tells the optimizer their true size for the joins with other tables.
    """
    with shuffles_removed(questions.sparkSession):
        q = shared_table(question_vectors(questions, question, text, vocabulary), "question-vectors")
        w = Window.partitionBy(question)
        placed = q.withColumn("_place", F.row_number().over(w.orderBy("df", "term")) <= F.ceil(F.count("*").over(w) * first))
        placed = shared_table(placed, "question-places")
        rare, hot = placed.filter("_place").drop("_place"), placed.filter(~F.col("_place")).drop("_place")
        scores = shared_table(_dots(index, rare, doc, question), "first-scores")
        kth = top_per_question(scores, question, doc, k).groupBy(question).agg(
            F.when(F.count("*") == k, F.min("score")).alias("kth"))
        bound = hot.groupBy(question).agg(F.sum(F.col("q_weight") * F.col("max_weight")).alias("bound"))
        # scores are compared at six decimals, hence the margin
        decided = shared_table(bound.join(kth, question, "left").withColumn(
            "settled", F.coalesce(F.col("bound") < F.col("kth") - 2e-6, F.lit(False))), "settled")
        lookups = shared_table(
            scores.join(decided.filter("settled").select(question, "bound", "kth"), question).filter(F.col("score") + F.col("bound") >= F.col("kth") - 2e-6).select(question, "block", "code"), "lookups")
        whole = _dots(index, q.join(decided.select(question), question), doc, question, k, lookups)
        columns = [question, doc, "score"]
        part = scores.join(decided.select(question), question, "left_anti").select(columns)
        total = part.unionByName(whole.select(columns)).groupBy(question, doc).agg(F.sum("score").alias("score"))
        return shared_table(top_per_question(total.filter(F.col("score") > 0), question, doc, k), "hits")


def mean_vectors(vectors: DataFrame, label: str, embedding: str) -> DataFrame:
    """Component-wise mean vector per label, averaged as rows and reassembled."""
    parts = vectors.select(label, F.posexplode(embedding).alias("pos", "x"))
    means = parts.groupBy(label, "pos").agg(F.avg("x").alias("x"))
    return means.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("pos", "x")))["x"].alias("query"))


def with_documents(hits: DataFrame, docs: DataFrame, doc: str, question: str) -> DataFrame:
    """Hits with title, source and text of their documents."""
    return hits.join(docs.select(doc, "title", "source", "text"), doc)


def _ordered(hits: DataFrame, question: str, piece: Column, sep: str, out: str, extra: list[Column] = ()) -> DataFrame:
    """Join the pieces of each question in rank order; a question has at most k hits."""
    pieces = F.sort_array(F.collect_list(F.struct("rank", piece.alias("p"))))
    return hits.groupBy(question).agg(F.array_join(pieces["p"], sep).alias(out), *extra)


def grounded_context(hits: DataFrame, question: str, max_chars: int = 600) -> DataFrame:
    """Numbered passages, each cut to ``max_chars`` characters."""
    piece = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit(" ("),
                     F.col("source"), F.lit(")\n"), F.substring("text", 1, max_chars))
    return _ordered(hits, question, piece, "\n\n", "context")


def fill_template(df: DataFrame, template: str, fields: list[str], out: str) -> DataFrame:
    """Replace ``{field}`` marks of a template by columns."""
    c = F.lit(template)
    for f in fields:
        c = F.replace(c, F.lit("{" + f + "}"), F.coalesce(F.col(f), F.lit("")))
    return df.withColumn(out, c)


def extractive_answers(hits: DataFrame, question: str, top: int = 3, limit: int = 2) -> DataFrame:
    """Bold titles with the first sentences of the best hits, and the sources."""
    best = hits.filter((F.col("rank") <= top) & (F.trim("text") != ""))
    piece = F.concat(F.lit("**"), F.col("title"), F.lit("**: "), first_sentences(F.col("text"), limit))
    sources = F.sort_array(F.collect_list(F.struct("rank", "title", "source", F.round("score", 4).alias("score"))))
    out = _ordered(best, question, piece, "\n\n", "answer", [sources.alias("sources")])
    return out.withColumn("interpretation", interpretation(F.col("answer")))


def evaluation_rows(answers: DataFrame, answer: str = "answer", n_sources: str = "n_sources") -> DataFrame:
    """answered, source_count, answer_length and judge_score per answer."""
    a = F.col(answer)
    return answers.withColumns({
        "answered": ~F.contains(a, F.lit(NO_ANSWER[:30])),
        "source_count": F.col(n_sources).cast("long"),
        "answer_length": F.length(a).cast("long"),
        "judge_score": answer_score(a, F.col(n_sources)),
    })
