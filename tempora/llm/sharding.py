"""Sharding by extendible hashing, in DataFrame functions only.

A row's 60-bit hash is a path in a binary trie: the first ``depth`` bits name a bucket. Starting
from one bucket, only buckets over the byte limit are split on their next bit, until every
bucket fits. Bytes are summed per hash cell before anything is shuffled, one round looks
``STEP`` bits further, and only oversized buckets go on to the next round, so the number of
rounds is the logarithm of the number of shards divided by ``STEP``.

Keys that a hash cannot part (a key with a large share of the rows) are parted by the content
hash of the row, and exact copies of one row by a running salt: the path is 60 bits of the key,
then 60 bits of the row. A single row over the limit is a shard of its own and marked
``oversized``. Null keys are a key like any other; null texts have no bytes. Extra columns are
ignored. An empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm import common as C

HASH_BITS, STEP = 60, 4


def hash_bits(c: Column) -> Column:
    """The first 60 bits of the MD5 of a string."""
    return F.conv(F.substring(F.md5(c), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(depth: Column | int, h: str = "h") -> Column:
    """The first ``depth`` bits of a 60-bit hash."""
    return F.call_function("shiftright", F.col(h), F.lit(HASH_BITS) - depth)


def _split(rows: DataFrame, limit: int) -> DataFrame:
    """Leaves (bucket, depth, prefix, bytes, n) of the trie over rows(bucket, h, bytes, n).

    A leaf is the shortest prefix whose bytes fit; what no prefix of the hash can part comes
    back at the full depth.
    """
    leaves, base = None, 0
    here = rows.groupBy("bucket", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix")).agg(
        F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    fits = (F.col("bytes") <= limit) | (F.col("n") == 1)
    here = C.store(here, "trie")
    while True:
        done = here.filter(fits | (F.col("depth") == HASH_BITS))
        leaves = done if leaves is None else leaves.unionByName(done)
        open_ = here.filter(~fits & (F.col("depth") == base) & (F.col("depth") < HASH_BITS)).select("bucket", F.col("prefix").alias("open"))
        if not open_.limit(1).count():
            return leaves
        reach = min(base + STEP, HASH_BITS)
        # bytes per cell of the oversized buckets, combined before the exchange
        cells = rows.groupBy("bucket", prefix(F.lit(reach)).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        cells = cells.withColumn("open", F.call_function("shiftright", F.col("cell"), F.lit(reach - base))).join(
            open_, ["bucket", "open"], "left_semi")
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(base + 1), F.lit(reach)))).withColumn(
            "prefix", F.call_function("shiftright", F.col("cell"), F.lit(reach) - F.col("depth")))
        sums = levels.groupBy("bucket", "depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        # a prefix exists only if its parent was too large; sums fall with depth, so one look up suffices
        up = sums.select("bucket", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"),
                         (~fits).alias("parent_open"))
        here = sums.withColumn("parent", F.call_function("shiftright", F.col("prefix"), F.lit(1))).join(
            up, ["bucket", "depth", "parent"], "left").filter(
            (F.col("depth") == base + 1) | F.col("parent_open")).select("bucket", "depth", "prefix", "bytes", "n")
        here = C.store(here, "trie")
        base = reach


def _assign(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """rows with the leaf (depth, prefix, shard_bytes, shard_rows) that holds them.

    A row looks for its prefix at each depth that occurs, so the join is on equal keys.
    """
    depths = leaves.groupBy("bucket").agg(F.sort_array(F.collect_set("depth")).alias("depths"))
    tried = rows.join(depths, "bucket").withColumn("depth", F.explode("depths")).withColumn("prefix", prefix(F.col("depth")))
    found = leaves.select("bucket", "depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_rows"))
    return tried.drop("depths").join(found, ["bucket", "depth", "prefix"])


def shards(docs: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_bytes, shard (bits of its path), depth, shard_bytes, shard_rows, oversized."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(C.text()).cast("long").alias("bytes"), F.lit(1).cast("long").alias("n"),
        F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("k"), F.md5(F.concat_ws("\x1f", F.col("doc_id").cast("string"), C.text())).alias("row"),
    ).withColumn("h", hash_bits(F.col("k"))).withColumn("bucket", F.lit(""))
    rows = C.store(rows.select("doc_id", "bytes", "n", "bucket", "h", "row", F.monotonically_increasing_id().alias("salt")), "shard-rows")
    leaves = C.store(_split(rows, limit), "leaves")
    one = _assign(rows, leaves)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    one = one.withColumn("path", F.concat("bucket", bits))
    whole = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)
    settled = one.filter(whole)
    if leaves.filter((F.col("bytes") > limit) & (F.col("n") > 1)).limit(1).count():
        # one key alone is over the limit: go on with bits of the row
        stuck = one.filter(~whole).select(
            "doc_id", "bytes", "n", F.concat("path", F.lit(".")).alias("bucket"),
            hash_bits(F.concat_ws("\x1f", F.col("row"), F.col("salt").cast("string"))).alias("h"))
        stuck = C.store(stuck, "hot-key-rows")
        two = _assign(stuck, C.store(_split(stuck, limit), "hot-key-leaves")).withColumn("path", F.concat("bucket", bits))
        cols = ["doc_id", "bytes", "path", "depth", "shard_bytes", "shard_rows"]
        settled = settled.select(*cols).unionByName(two.select(*cols))
    return settled.select(
        "doc_id", F.col("bytes").alias("n_bytes"), F.col("path").alias("shard"),
        F.length(F.translate("path", ".", "")).cast("int").alias("depth"), "shard_bytes", "shard_rows",
        (F.col("shard_bytes") > limit).alias("oversized"))


def directory(sharded: DataFrame) -> DataFrame:
    """The directory: slot, shard. 2**global depth slots point at the shards; a shard of lower depth fills several.

    The global depth counts bits of the key's hash; shards of a parted hot key share a slot.
    """
    of = sharded.select(F.split_part("shard", F.lit("."), F.lit(1)).alias("bits"), "shard").distinct()
    depth = of.agg(F.max(F.length("bits"))).first()[0] or 0
    spare = F.lit(depth) - F.length("bits")
    base = F.coalesce(F.conv("bits", 2, 10).cast("long"), F.lit(0)) * F.pow(F.lit(2), spare).cast("long")
    return of.select(F.explode(F.sequence(base, base + F.pow(F.lit(2), spare).cast("long") - 1)).alias("slot"), "shard")
