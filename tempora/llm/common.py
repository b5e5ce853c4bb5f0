"""Shared helpers: stored intermediates, blocks of documents, and byte/word arithmetic on Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import sys
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.session import shared_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Stands for a null document id inside the operators; results carry the null again.
NULL_ID = -(2**63)
WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MULTIPLIER = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def trim() -> None:
    """Give memory that earlier groups or batches have freed back to the system; workers live long."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)


_SHIPPED: set[str] = set()


#: Rows of text in an Arrow batch; Spark's default of 10,000 is for narrow rows.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application (as ``--py-files`` would), and keep batches of texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="tempora-"), f"tempora-{app}.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(to)
    _SHIPPED.add(app)


def shipped(f: Callable) -> Callable:
    """For functions whose first argument is the session."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args):
        ship(spark)
        return f(spark, *args)

    return run


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/documents.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and continue from the stored copy.

    The shuffle files of the write are removed when it ends, so only the table itself stays on
    disk; lost executors cost a re-read of it, not its computation.
    """
    spark = df.sparkSession
    path = shared_dir(spark, f"llm-{name}")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete tables made by :func:`store` that no later step reads."""
    for df in stored:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def doc_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id")


def null_id(c: str = "doc_id") -> Column:
    return F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)


def text() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).alias("text")


def count_for(total_bytes: int | None, each: int, least: int = 1) -> int:
    """How many parts of about ``each`` bytes; grows with the input without a limit."""
    return max(least, -(-int(total_bytes or 0) // each))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offset of each value (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts make up about ``size`` bytes; a longer text is a range of its own.

    After the last range of a batch, memory that is free again goes back to the system.
    """
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
    trim()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the index of each text's first word."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    space = WHITESPACE[data]
    first, last = ~space, ~space
    if n:
        first[1:] &= space[:-1] | edge[1:-1]
        last[:-1] &= space[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        m = _MULTIPLIER[which]
        up, down = np.full(n, m, np.uint64), np.full(n, pow(m, -1, 2**64), np.uint64)
        up[:1] = down[:1] = 1
        have = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        if n <= 1 << 22:
            _POWERS[which] = have
    return have


class Spans:
    """Polynomial hashes (mod 2**64) of any span of a sequence from its prefix sums."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values) + 1
        self.up, self.down = _powers(which, n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[: n - 1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


#: Bytes of text that one pass of the arithmetic takes in; its arrays are some hundred times as large.
PASS = 1 << 20


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def string_hashes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Both halves of the 128-bit XXH3 of every byte string that lies end to end in ``data``; equal strings are hashed once."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    values = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = values.dictionary_encode()
    raw = b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist()))
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)[coded.indices.to_numpy()]


#: Words up to so many bytes are hashed in whole arrays, longer ones one by one.
SHORT_WORD = 64


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: each 8 bytes go through :func:`mix` with what came before, so no two strings cancel by their form."""
    length = ends - starts
    out = mix(length.astype(np.uint64) + np.uint64(_MULTIPLIER[0]))
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    live = np.flatnonzero(length <= SHORT_WORD)
    for at in range(0, SHORT_WORD, 8):
        live = live[length[live] > at]
        if not len(live):
            break
        block = eight[starts[live] + at].view("<u8").ravel().astype(np.uint64)
        short = np.minimum(length[live] - at, 8).astype(np.uint64)
        block &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * short)
        out[live] = mix((out[live] ^ block) * np.uint64(_MULTIPLIER[1]) + np.uint64(at + 1))
    for k in np.flatnonzero(length > SHORT_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, and the index of each text's first word."""
    parts, first, n = [], [np.zeros(1, np.int64)], 0
    for i, j in slices(offsets, PASS):
        at = offsets[i]
        piece = data[at : offsets[j]]
        starts, ends, own = words(piece, offsets[i : j + 1] - at)
        parts.append((span_hashes(piece, starts, ends), starts + at, ends + at))
        first.append(own[1:] + n)
        n += len(starts)
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(1, np.int64)
    return (*(np.concatenate(x) for x in zip(*parts, strict=True)), np.concatenate(first))
