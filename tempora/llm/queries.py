"""Registered queries of the training-data operators: name -> (function of session and folder, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempora.llm import decontam, fingerprints, lines, packing, quality, repair, repeats, sharding, simhash, substrings, toxicity, tries, urls
from tempora.llm.common import documents, shipped


@shipped
def op1_suffix_array_dedup(spark: SparkSession, path: str) -> DataFrame:
    return repeats.repeated_bytes(documents(spark, path))


@shipped
def op2_simhash_near_dedup(spark: SparkSession, path: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, path))


#: Bytes of text a shard may hold.
SHARD_BYTES = 1 << 20


@shipped
def op3_extendible_sharding(spark: SparkSession, path: str) -> DataFrame:
    return sharding.shards(documents(spark, path), SHARD_BYTES)


def _shards_sql() -> str:
    """The first prefix of the path that fits, over the 60 bits of the key; keys are distinct here."""
    return f"""WITH r AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
l AS (SELECT doc_id, n_bytes, d, h >> (60 - d) AS prefix FROM r, range(0, 41) t(d)),
s AS (SELECT d, prefix, CAST(sum(n_bytes) AS BIGINT) AS bytes, count(*) AS n FROM l GROUP BY d, prefix),
f AS (SELECT l.*, s.bytes, s.n, row_number() OVER (PARTITION BY doc_id ORDER BY l.d) AS k
  FROM l JOIN s ON l.d = s.d AND l.prefix = s.prefix WHERE s.bytes <= {SHARD_BYTES} OR s.n = 1)
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE right(bin(prefix + (1::BIGINT << 50)), CAST(d AS INT)) END AS shard,
  CAST(d AS INTEGER) AS depth, bytes AS shard_bytes, n AS shard_rows, bytes > {SHARD_BYTES} AS oversized FROM f WHERE k = 1"""


@shipped
def op4_decontamination(spark: SparkSession, path: str) -> DataFrame:
    return decontam.leaked_documents(documents(spark, path), spark.read.parquet(f"{path}/benchmark.parquet"))


@shipped
def op5_substring_dedup(spark: SparkSession, path: str) -> DataFrame:
    return substrings.repeated_words(documents(spark, path))


@shipped
def op6_line_dedup(spark: SparkSession, path: str) -> DataFrame:
    return lines.line_digests(documents(spark, path))


LINES_SQL = r"""WITH l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos, len(ls) AS n FROM l),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE f.key IS NOT NULL) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id"""


@shipped
def op7_toxicity(spark: SparkSession, path: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, path), spark.read.parquet(f"{path}/labels.parquet"))


@shipped
def op8_document_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return fingerprints.document_fingerprints(documents(spark, path))


@shipped
def op9_best_fit_packing(spark: SparkSession, path: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(documents(spark, path), public_tokenizers.path("word_bpe_49k.json"))


@shipped
def op10_url_filter(spark: SparkSession, path: str) -> DataFrame:
    pages = spark.read.parquet(f"{path}/pages.parquet")
    return urls.judge(pages, urls.labelled(pages))


def _urls_sql() -> str:
    rules = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    rule = " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits)
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits)
    labels = ", ".join(f"'{x}'" for x in urls.LISTED_LABELS)
    return f"""WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
c AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') AS canonical FROM p),
l AS (SELECT DISTINCT canonical FROM c WHERE canonical <> '' AND list_has_any(string_split(host, '.'), [{labels}]))
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END AS verdict FROM c"""


CRC32 = """CAST(4294967295 - list_reduce(list_transform(string_split({0}, ''), lambda ch: CAST(ord(ch) AS BIGINT)),
  lambda c, x: list_reduce(range(8), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)), xor(c, x)), 4294967295) AS BIGINT)"""


@shipped
def op11_conversation_repair(spark: SparkSession, path: str) -> DataFrame:
    return repair.repairs(repair.damaged(spark.read.parquet(f"{path}/conversations.parquet")))


def _repair_sql() -> str:
    """The same costs, from the last row to the first, with the audit and the repaired lines of each state."""
    def cell(cost: str, edit: str, of: str, line: str = "") -> str:
        text = f"list_concat([{line}], {of}.t)" if line else f"{of}.t"
        return f"{{'c': {of}.c + {cost}, 'x': '{edit}' || {of}.x, 't': {text}}}"

    fits, roles, keeps = {"e": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}, {"e": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
    stays, cut = "fault NOT IN ('b', 'd')", "CASE WHEN fault = 't' THEN 5 ELSE 0 END"
    row, final = [], []
    for z, y in fits.items():
        kept = [f"CASE WHEN {stays} AND i = '{k}' THEN {cell(cut, 'K', k, chr(34) + 'line' + chr(34))} END" for k in keeps[z]]
        moved = f"CASE WHEN {stays} THEN {cell('1 + ' + cut, 'R', y, f"'{roles[y]}:' || text")} END"
        row.append(f"least({cell('2', 'D', z)}, {', '.join(kept)}, {moved}) AS {z}0")
    for z, y in (("u", "a0"), ("a", "u0"), ("e", "least(u0, {0})"), ("s", "least(u0, {0})")):
        via = cell("5", "I", "a0", "'assistant:'")
        if z in "ua":
            final.append(f"least({z}0, {cell('5', 'I', y, f"'{roles[y[0]]}:'")}) AS {z}")
        else:
            u = f"least(u0, {via})"
            final.append(f"least({z}0, {cell('5', 'I', '(' + u + ')', chr(39) + 'user:' + chr(39))}) AS {z}")
    number = CRC32.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    return rf"""WITH RECURSIVE d AS (SELECT conv_id, turn, {number} % 20 AS hit, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
r AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
  CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM r),
f AS (SELECT *, left(role, 1) AS i, role || ':' || text AS line, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN nth > 1 THEN 'd'
  WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 't' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair FROM o),
v AS (SELECT conv_id, count(*) AS k, {{'c': 0, 'x': '', 't': CAST([] AS VARCHAR[])}} AS e, {{'c': 10, 'x': 'II', 't': ['user:', 'assistant:']}} AS s,
    {{'c': 5, 'x': 'I', 't': ['assistant:']}} AS u, {{'c': 0, 'x': '', 't': CAST([] AS VARCHAR[])}} AS a FROM f GROUP BY conv_id
  UNION ALL
  SELECT conv_id, k - 1, {', '.join(final[2:] + final[:2])} FROM (
    SELECT v.conv_id, v.k, {', '.join(row)} FROM v JOIN f ON v.conv_id IS NOT DISTINCT FROM f.conv_id AND v.k = f.k)),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, {', '.join(f"CAST(coalesce({x}, 0) AS BIGINT) AS {x}" for x in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))},
  CAST(coalesce(v.e.c, 0) AS BIGINT) AS cost, coalesce(v.e.x, '') AS audit, sha256(coalesce(array_to_string(v.e.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id
LEFT JOIN v ON v.k = 0 AND c.conv_id IS NOT DISTINCT FROM v.conv_id"""


@shipped
def op12_quality_rules(spark: SparkSession, path: str) -> DataFrame:
    got = quality.quality_rules(documents(spark, path), spark.read.parquet(f"{path}/labels.parquet"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def _quality_sql() -> str:
    values = {
        "symbols": "n_symbols * 1000 // greatest(word_chars, 1)", "dup_lines": "n_dup_lines * 1000 // greatest(n_lines, 1)",
        "repeat_words": "n_repeat_words * 1000 // greatest(n_words, 1)", "upper": "n_upper * 1000 // greatest(word_chars, 1)",
        "word_length": "word_chars * 10 // greatest(n_words, 1)"}
    pairs = " UNION ALL ".join(f"SELECT stratum, quality, '{r}' AS rule, least({v}, 1000) AS value FROM held" for r, v in values.items())
    hits = " ".join(f"WHEN least({v}, 1000) > (SELECT value FROM cuts WHERE cuts.stratum = b.stratum AND rule = '{r}') THEN '{r}'" for r, v in values.items())
    risk, k = quality.RISK / len(quality.RULES), len(quality.RULES)
    return rf"""WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT row, regexp_extract_all(text, '[^ 	-
]+') AS ws FROM t)),
w3 AS (SELECT row, p, w || chr(0) || lead(w) OVER o || chr(0) || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY row ORDER BY p)),
rep AS (SELECT row, p FROM (SELECT row, p, count(*) OVER (PARTITION BY row, g) AS n FROM w3 WHERE g IS NOT NULL) WHERE n > 1),
cov AS (SELECT row, count(DISTINCT p + k) AS n FROM rep, range(3) x(k) GROUP BY row),
ln AS (SELECT row, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^ 	-
]') GROUP BY row),
wn AS (SELECT row, count(*) AS n, CAST(sum(length(w)) AS BIGINT) AS chars FROM w GROUP BY row),
m AS (SELECT doc_id, stratum, coalesce(wn.n, 0) AS n_words, coalesce(wn.chars, 0) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ln.dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
  coalesce(ln.n, 0) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper
  FROM t LEFT JOIN wn USING (row) LEFT JOIN ln USING (row) LEFT JOIN cov USING (row)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed FROM m),
held AS (SELECT b.*, quality FROM b JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed),
pv AS (SELECT stratum, rule, value, count(*) FILTER (quality > 0) AS good, count(*) FILTER (quality <= 0) AS bad FROM ({pairs}) GROUP BY ALL),
n AS (SELECT stratum, CAST(sum(good) AS BIGINT) AS n_good, CAST(sum(bad) AS BIGINT) AS n_bad FROM pv WHERE rule = 'symbols' GROUP BY stratum HAVING sum(good) > 0),
tail AS (SELECT stratum, k, sum(exp(lgamma(n_good + 1) - lgamma(k + 1) - lgamma(n_good - k + 1) + k * ln({risk}) + (n_good - k) * ln(1 - {risk})))
  OVER (PARTITION BY stratum ORDER BY k) AS p FROM n, unnest(range(n_good + 1)) x(k)),
lim AS (SELECT n.*, coalesce((SELECT max(k) FROM tail WHERE tail.stratum = n.stratum AND p <= {quality.DELTA} / {k} / (SELECT count(*) FROM n)), -1) AS allowed FROM n),
above AS (SELECT *, coalesce(sum(good) OVER o, 0) AS good_rejected, coalesce(sum(bad) OVER o, 0) AS bad_rejected FROM pv
  WINDOW o AS (PARTITION BY stratum, rule ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tested AS (SELECT stratum, rule, value, coalesce(bad_rejected / nullif(n_bad, 0), 0) - good_rejected / n_good AS gain FROM above JOIN lim USING (stratum) WHERE good_rejected <= allowed),
cuts AS (SELECT stratum, rule, arg_max(value, {{'g': gain, 'v': value}}) AS value FROM tested WHERE gain > 0 GROUP BY stratum, rule),
j AS (SELECT *, CASE {hits} END AS rule FROM b)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND rule IS NULL AS kept, rule FROM j"""


@shipped
def op13_conversation_prefix_trie(spark: SparkSession, path: str) -> DataFrame:
    return tries.conversation_trie(spark.read.parquet(f"{path}/conversations.parquet"))


TRIE_SQL = f"""WITH t AS (SELECT conv_id, octet_length(encode(coalesce(text, ''))) AS bytes, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS d FROM conversations),
c AS (SELECT conv_id, list({{'h': d, 'n': bytes}} ORDER BY turn NULLS FIRST, d) AS own, {CRC32.format("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS seq FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, d, array_to_string(list_transform(seq[1:d], lambda z: z.h), '/') AS key, array_to_string(list_transform(seq[1:d - 1], lambda z: z.h), '/') AS up,
  CASE WHEN d = 0 THEN 0 ELSE seq[d].n END AS bytes, len(seq) = d AS ends FROM r, unnest(range(len(seq) + 1)) x(d)),
n AS (SELECT key, d, any_value(up) AS up, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY key, d),
k AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up, d),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.key AND k.d = n.d),
s AS (SELECT t.key, t.d, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved_tokens
  FROM a t JOIN a b ON b.d >= t.d AND (t.d = 0 OR b.key = t.key OR starts_with(b.key, t.key || '/')) GROUP BY t.key, t.d)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM a JOIN s ON s.key = a.key AND s.d = a.d LEFT JOIN a u ON a.d > 0 AND u.key = a.up AND u.d = a.d - 1"""


@shipped
def pipeline(spark: SparkSession, path: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, path)


QUERIES = {
    "op1_suffix_array_dedup": (op1_suffix_array_dedup, None),
    "op2_simhash_near_dedup": (op2_simhash_near_dedup, None),
    "op3_extendible_sharding": (op3_extendible_sharding, _shards_sql()),
    "op4_decontamination": (op4_decontamination, None),
    "op5_substring_dedup": (op5_substring_dedup, None),
    "op6_line_dedup": (op6_line_dedup, LINES_SQL),
    "op7_toxicity": (op7_toxicity, None),
    "op8_document_fingerprints": (op8_document_fingerprints, None),
    "op9_best_fit_packing": (op9_best_fit_packing, None),
    "op10_url_filter": (op10_url_filter, _urls_sql()),
    "op11_conversation_repair": (op11_conversation_repair, _repair_sql()),
    "op12_quality_rules": (op12_quality_rules, _quality_sql()),
    "op13_conversation_prefix_trie": (op13_conversation_prefix_trie, TRIE_SQL),
    "pipeline": (pipeline, None),
}
