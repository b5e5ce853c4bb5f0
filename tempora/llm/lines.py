"""Line dedup by range-partitioned line hashes.

Line keys are hashed in the scan (128 bits), range-partitioned by (hash, document) and sorted
inside each partition by (hash, document, position). Partitions are as many as the bytes of text
ask for, so a hot line spreads over as many of them as it needs and the run that a task holds is
at most its partition. Each partition is streamed once; a run of one hash that touches a
partition's edge may go on next door, so at most two runs per partition are summed across
partitions afterwards. The decisions come back as one compressed bitmap per document, never as
text.

Null and empty texts are one empty line. A null ``doc_id`` is a document id of its own. Rows
that repeat a ``doc_id`` count as one document; each row is judged on its own text. Very long
texts are hashed one at a time. An empty table gives an empty one. Extra columns are ignored by
the digests and pass through the stage, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import common as C

NEWLINE = 0x0A
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
RUNS = "hash long, more long, doc_id long, text_id long, pos int, n_docs long, edge boolean"
#: Text whose line hashes make up one partition.
PART_BYTES = 16 << 20


def _line_hashes(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = C.string_bytes(b.column("text"))
        ids, tids = b.column("doc_id").to_numpy(), b.column("text_id").to_numpy()
        for i, j in C.slices(offsets, C.PASS):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            part = LOWER[part]
            starts, ends, _ = C.words(part, at)
            cuts = np.flatnonzero(part == NEWLINE)
            # a line's key runs from its first to its last word
            line = np.searchsorted(cuts, starts) + np.searchsorted(at, starts, "right") - 1
            first = np.flatnonzero(np.diff(line, prepend=-1))
            if not len(first):
                continue
            last = np.append(first[1:], len(line)) - 1
            s, e = starts[first], ends[last]
            row = np.searchsorted(at, s, "right") - 1
            pos = np.searchsorted(cuts, s) - np.searchsorted(cuts, at)[row]
            keep = np.ones(len(s), bool)
            if min_chars > 1:
                points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                keep = points[e] - points[s] >= min_chars
            within = np.zeros(len(part) + 1, np.int8)
            within[s] += 1
            within[e] -= 1
            h = C.string_hashes(part[np.cumsum(within[:-1], dtype=np.int8) > 0], e - s)[keep].view(np.int64)
            row = row[keep] + i
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(ids[row]), pa.array(tids[row]), pa.array(pos[keep].astype(np.int32))],
                ["hash", "more", "doc_id", "text_id", "pos"])


def _stream_runs(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Runs of one hash in a sorted partition; only those that can matter leave the task.

    The distinct documents of a run stand on its first row.
    """
    held: list[np.ndarray] = []
    at_start = True

    def emit(rows: np.ndarray, edge: bool) -> pa.RecordBatch | None:
        other = (rows["hash"][1:] != rows["hash"][:-1]) | (rows["more"][1:] != rows["more"][:-1])
        begin = np.flatnonzero(np.concatenate([[True], other]))
        new = np.ones(len(rows), np.int64)
        new[1:] = other | (rows["doc_id"][1:] != rows["doc_id"][:-1])
        docs = np.add.reduceat(new, begin)
        size = np.diff(np.append(begin, len(rows)))
        n = np.zeros(len(rows), np.int64)
        n[begin] = docs
        keep = np.repeat((docs >= min_docs) | edge, size)
        if not keep.any():
            return None
        rows, n = rows[keep], n[keep]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(rows[c])) for c in ("hash", "more", "doc_id", "text_id", "pos")]
            + [pa.array(n), pa.array(np.full(len(rows), edge))],
            ["hash", "more", "doc_id", "text_id", "pos", "n_docs", "edge"])

    def same(a: np.ndarray, b: np.void) -> np.ndarray:
        return (a["hash"] == b["hash"]) & (a["more"] == b["more"])

    kind = np.dtype([("hash", "<i8"), ("more", "<i8"), ("doc_id", "<i8"), ("text_id", "<i8"), ("pos", "<i4")])
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.empty(b.num_rows, kind)
        for c in kind.names:
            rows[c] = b.column(c).to_numpy()
        if held and same(held[-1][-1:], rows[-1])[0]:
            held.append(rows)
            continue
        tail = int(same(rows, rows[-1]).argmax())
        held.append(rows[:tail])
        done = np.concatenate(held)
        held = [rows[tail:]]
        if at_start and len(done):
            first = int(same(done, done[0]).sum())
            if (out := emit(done[:first], True)) is not None:
                yield out
            at_start, done = False, done[first:]
        if len(done) and (out := emit(done, False)) is not None:
            yield out
    if held and (out := emit(np.concatenate(held), True)) is not None:
        yield out


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = []
        for positions in b.column("positions"):
            p = np.asarray(positions.values, np.int64)
            bits = np.ones(p.max() // 8 * 8 + 8, np.uint8)  # lines beyond the last dropped one stay
            bits[p] = 0
            packed.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_id"), pa.array(packed, pa.binary())], ["doc_id", "text_id", "keep"])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(C.doc_id(), C.text()).withColumn("text_id", F.xxhash64("text"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, text_id, keep) of the documents that lose lines.

    ``keep`` is a zlib-compressed bitmap with a bit per line (1: stays) up to the last dropped
    line; all later lines stay. With ``keep_first`` the first occurrence of a repeated key in
    (doc_id, position) order stays. Documents without a row keep every line.
    """
    lines = keyed(docs).mapInArrow(
        lambda it: _line_hashes(it, min_chars), "hash long, more long, doc_id long, text_id long, pos int")
    parts = C.count_for(C.text_bytes(docs), PART_BYTES, 8)
    dealt = lines.repartitionByRange(parts, "hash", "more", "doc_id").sortWithinPartitions("hash", "more", "doc_id", "text_id", "pos")
    runs = C.store(dealt.mapInArrow(lambda it: _stream_runs(it, min_docs), RUNS), "line-runs")
    first = F.struct("doc_id", "text_id", "pos")
    sure, edges = runs.filter(~F.col("edge")), runs.filter("edge")
    # two runs per partition at most, so this table is bounded by the number of partitions
    key = ["hash", "more"]
    whole = F.broadcast(edges.groupBy(*key).agg(F.sum("n_docs").alias("all_docs"), F.min(first).alias("first")).filter(
        F.col("all_docs") >= min_docs))
    open_ = edges.join(whole, key).filter(~F.col("first").eqNullSafe(first) if keep_first else F.lit(True))
    if keep_first:
        heads = sure.groupBy(*key).agg(F.min(first).alias("first"))
        sure = sure.join(heads, key).filter(~F.col("first").eqNullSafe(first))
    drops = sure.select("doc_id", "text_id", "pos").unionByName(open_.select("doc_id", "text_id", "pos"))
    per_doc = drops.groupBy("doc_id", "text_id").agg(F.collect_set("pos").alias("positions"))
    return per_doc.mapInArrow(_bitmaps, "doc_id long, text_id long, keep binary")


def split_kept(text: str, keep: bytes | None) -> tuple[int, list[str] | None]:
    """Number of lines and the lines that stay (None: all)."""
    if keep is None:
        return text.count("\n") + 1, None
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    gone = set(np.flatnonzero(bits[: len(lines)] == 0).tolist())
    return len(lines), [x for i, x in enumerate(lines) if i not in gone]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, dropped, sha = [], [], []
        for text, keep in zip(b.column("text"), b.column("keep"), strict=True):
            s = text.as_py()
            k, kept = split_kept(s, keep.as_py())
            n.append(k)
            dropped.append(0 if kept is None else k - len(kept))
            sha.append(hashlib.sha256((s if kept is None else "\n".join(kept)).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def line_digests(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the remaining lines of every document."""
    keep = keep_bitmaps(docs, min_docs, min_chars).hint("shuffle_hash")
    joined = keyed(docs).join(keep, ["doc_id", "text_id"], "left").select("doc_id", "text", "keep")
    out = joined.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    return out.withColumn("doc_id", C.null_id())


def _apply(batches: Iterator[pa.RecordBatch], keep_name: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index("text")
        texts = []
        for text, keep in zip(b.column("text"), b.column(keep_name), strict=True):
            s = text.as_py()
            if s is not None and keep.is_valid:
                s = "\n".join(split_kept(s, keep.as_py())[1])
            texts.append(s)
        out = b.set_column(at, "text", pa.array(texts, pa.string()))
        yield out.drop_columns([keep_name])


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with the same columns and rows; frequent lines are gone from ``text``."""
    kid, ktext, kept = (C.unused(docs, n) for n in ("line_id", "line_text", "line_keep"))
    keep = keep_bitmaps(docs, min_docs, min_chars).select(
        F.col("doc_id").alias(kid), F.col("text_id").alias(ktext), F.col("keep").alias(kept))
    on = (F.coalesce(docs["doc_id"].cast("long"), F.lit(C.NULL_ID)) == F.col(kid)) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(ktext))
    joined = docs.join(keep.hint("shuffle_hash"), on, "left").drop(kid, ktext)
    return joined.mapInArrow(lambda it: _apply(it, kept), docs.schema)
