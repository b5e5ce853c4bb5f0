"""One-permutation MinHash fingerprints, in DataFrame functions only.

Every shingle of ``SHINGLE`` words is hashed once. The first bits of the hash choose one of
``BINS`` bins, the smallest rest stays. An empty bin takes its value from a filled bin: bins are
probed in an order drawn by hash for each bin (optimal densification), so the choice agrees
between documents whenever the first filled bin does. The fingerprint packs the lowest ``BITS``
bits of each bin. Likeness is the share of equal bins, corrected for the 1 in 2**BITS that agree
by chance.

The whole computation stays inside a row. Only the successor of each document needs an
exchange: rows are dealt by ranges of (``doc_id``, text) and each range gets one guest row, the
first of the next range.

Null and empty texts have one shingle, the empty one, as have texts without words; texts of
fewer words have one shingle of all their words. A very long text is one row's arrays. A null
``doc_id`` stands before all others. Rows that repeat a ``doc_id`` follow one another in the
order of their texts. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm import common as C

SHINGLE, BINS, BITS = 5, 128, 8
RANGE_BYTES = 16 << 20
BIN_BITS = BINS.bit_length() - 1


def _bin(h: Column) -> Column:
    return F.call_function("shiftrightunsigned", h, F.lit(64 - BIN_BITS)).cast("int")


def fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of a text column as ``out``: an array of ``BINS`` bytes, less 128 each.

    Each step is a column of its own, because later steps read it many times over.
    """
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn("__w", F.transform(words, lambda w: F.xxhash64(w)))
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("__w") - (SHINGLE - 1), F.lit(1))),
        lambda i: F.xxhash64(*(F.get("__w", i - 1 + k) for k in range(SHINGLE))))
    # a bin is the hash's first bits, so a sorted list has the bins one after another, smallest hash first
    df = df.withColumn("__s", F.sort_array(runs))
    df = df.withColumn("__s", F.filter("__s", lambda h, i: (i == 0) | (_bin(h) != _bin(F.get("__s", i - 1)))))
    df = df.withColumn("__k", F.transform("__s", _bin))
    low = F.transform("__s", lambda h: (h.bitwiseAND(F.lit((1 << BITS) - 1)) - 128).cast("tinyint"))
    df = df.withColumn("__m", F.map_from_arrays("__k", low))

    def borrowed(b: Column) -> Column:
        # the first filled bin in b's probing order is the one of the smallest probe hash
        probes = F.transform("__k", lambda k: F.struct(F.xxhash64(b, k).alias("order"), k.alias("bin")))
        return F.element_at("__m", F.array_min(probes)["bin"])

    all_bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    df = df.withColumn(out, F.transform(all_bins, lambda b: F.coalesce(F.try_element_at(F.col("__m"), b), borrowed(b))))
    return df.drop("__w", "__s", "__k", "__m")


def packed(values: Column) -> Column:
    """Two hex digits per bin (``BITS`` is 8)."""
    return F.lower(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("int") + 128), BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins without the agreements that chance alone gives, 0 to 1."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, z: n + z)
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, f, next_text, next_f): each row with its successor by doc_id, the last with the first.

    Rows are range-partitioned by (doc_id, text) into partitions of some 16 MB of text, so rows
    of one id spread over as many as they need. The first row of each partition is a guest at
    the end of the one before.
    """
    d = docs.select(C.doc_id(), C.text())
    parts = C.count_for(C.text_bytes(docs), RANGE_BYTES, 32)
    dealt = d.repartitionByRange(parts, "doc_id", "text").sortWithinPartitions("doc_id", "text").select(
        "doc_id", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    # the number of a row counts from zero in each partition, above it stands the partition
    firsts = dealt.filter(F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) == 0)
    # a row per partition
    line = Window.orderBy("part")
    last = F.max("part").over(Window.partitionBy())
    to = firsts.select("part", "place").select("place", F.coalesce(F.lag("part").over(line), last).alias("to"))
    guests = firsts.drop("part").join(to, "place").select("doc_id", "text", F.col("to").alias("part"), "place", F.lit(1).alias("guest"))
    own = dealt.withColumn("guest", F.lit(0))
    both = fingerprinted(own.unionByName(guests).repartition(parts, "part"), "text", "f")
    order = Window.partitionBy("part").orderBy("guest", "place")
    both = both.withColumns({"next_text": F.lead("text").over(order), "next_f": F.lead("f").over(order)})
    return both.filter("guest = 0").select("doc_id", "text", "f", "next_text", "next_f")


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) characters replaced by the first as many of the next document."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    d = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    d = fingerprinted(d, "edited", "e")
    return d.select(
        C.null_id(), F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("f")).alias("fingerprint"), packed(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("next_f")).alias("near_next"))
