"""URL filter: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

A URL's verdict is that of the longest rule that fits it. The rest are looked up in a list of
canonical URLs: a blocked Bloom filter (one 64-byte block per URL, eight bits in it) passes the
possible hits, and an exact hash join with the list removes the false positives. The filter is
sized by the list, 32 URLs a block (16 bits each, some 0.2 % false positives), from 64 kB up to
``MOST_BLOCKS``, 128 MB for 67 million URLs; that bound is what executors hold of it. A longer
list passes more rows to the join, never other verdicts. Pages go through it once and are stored.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule and are on no list.
Very long URLs are values like any other. Of rules of one length that fit, the last in the
sorted list wins; the query's rules have no such ties. Repeated rows get a row each. Extra
columns are ignored. With an empty list everything without a rule is allowed, an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm import common as C

LEAST_BLOCKS, MOST_BLOCKS, URLS_A_BLOCK, PROBES = 1 << 10, 1 << 21, 32, 8
#: Rules of the query: (verdict, host, path).
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
#: Host labels whose pages make up the query's list.
LISTED_LABELS = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical() -> Column:
    """Host without a leading ``www.`` and the path without closing slashes."""
    return F.concat(F.regexp_replace("host", r"^www\.", ""), F.regexp_replace("path", "/+$", ""))


def parts(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))


def fitting_rule(rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def blocks_for(urls: int) -> int:
    """Number of blocks, a power of two, for a list of so many URLs."""
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, 1 << max(0, -(-urls // URLS_A_BLOCK) - 1).bit_length()))


def _slots(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit word and mask of each of the eight bits of a hash, all in one block."""
    h = h.view(np.uint64)
    block = (h >> np.uint64(40)) % np.uint64(blocks)
    bits = np.stack([(h * np.uint64(m) + np.uint64(m >> 7)) >> np.uint64(55) for m in _ODD], 1)
    return (block[:, None] * np.uint64(8) + (bits >> np.uint64(6))).astype(np.int64), np.uint64(1) << (bits & np.uint64(63))


_ODD = tuple((0x9E3779B97F4A7C15 * k | 1) % 2**64 for k in range(1, PROBES + 1))


def _bits(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        word, mask = _slots(b.column("h").to_numpy(), blocks)
        yield pa.RecordBatch.from_arrays([pa.array(word.ravel()), pa.array(mask.ravel().view(np.int64))], ["word", "mask"])


def bloom(listed: DataFrame) -> np.ndarray:
    """The filter of listed(canonical); bits are combined per 64-bit word before they reach the driver."""
    blocks = blocks_for(listed.count())
    words = listed.select(F.xxhash64("canonical").alias("h")).mapInArrow(lambda it: _bits(it, blocks), "word long, mask long")
    out = np.zeros(blocks * 8, np.uint64)
    got = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return out


def _probe(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    words = shared.value
    for b in batches:
        at, mask = _slots(b.column("h").to_numpy(), len(words) // 8)
        maybe = ((words[at] & mask) == mask).all(1)
        keep = [c for c in b.schema.names if c != "h"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(maybe)], [*keep, "maybe"])


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; ``listed`` has canonical URLs to block."""
    rule, verdict = fitting_rule(rules)
    ids = dict(pages.dtypes)["page_id"]
    p = parts(pages).withColumns({"rule": rule, "verdict": verdict, "canonical": canonical()})
    ruled = p.filter("rule is not null").drop("canonical")
    rest = p.filter("rule is null").drop("verdict").withColumn("h", F.xxhash64("canonical"))
    listed = C.store(listed.select("canonical").filter("canonical <> ''").distinct(), "listed")
    shared = pages.sparkSession.sparkContext.broadcast(bloom(listed))
    probed = C.store(rest.mapInArrow(
        lambda it: _probe(it, shared), f"page_id {ids}, host string, path string, rule string, canonical string, maybe boolean"), "probed")
    hits = probed.filter("maybe").join(listed.withColumn("listed", F.lit(True)), "canonical", "left")
    judged = hits.select("page_id", "host", "path", "rule", F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"))
    clear = probed.filter(~F.col("maybe")).select("page_id", "host", "path", "rule", F.lit("allow").alias("verdict"))
    return ruled.unionByName(judged).unionByName(clear)


def labelled(pages: DataFrame, labels=LISTED_LABELS) -> DataFrame:
    """Canonical URLs of the pages whose host has one of the labels."""
    named = F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, labels)))
    return parts(pages).filter(named).select(canonical().alias("canonical"))
