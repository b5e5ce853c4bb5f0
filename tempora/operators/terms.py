"""Words and bigrams of a corpus, counted in blocks of texts.

A task cuts its texts in whole arrays and names each block's terms once. Between tasks a term
travels once per block, not once per text, in packed rows: blocks meet their terms' document
frequencies by ``block``, the frequencies are summed by ``bucket``, a hash of the term.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

from tempora.functions.text import STOP_WORDS, TOKEN_PATTERN

#: Bytes of text in a block, at least one text; of the corpus for each bucket of terms; and for each task of blocks.
BLOCK, BUCKET, TASK = 4 << 20, 16 << 20, 16 << 20
_TOKEN = np.array([c < 128 and re.fullmatch(TOKEN_PATTERN, chr(c)) is not None for c in range(256)])
_STOP = pa.array(STOP_WORDS)
_PRIME = 2**31 - 1


@dataclass(frozen=True)
class Counts:
    """Terms of a block with a hash each, and (doc, code, n): how often a text of the block has a term; in text order."""

    terms: pa.StringArray
    hashes: np.ndarray
    doc: np.ndarray
    code: np.ndarray
    n: np.ndarray
    total: np.ndarray


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array end to end, and the offset of each string (null: empty)."""
    strings = strings.fill_null("")
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(strings.type) else np.int32)
    at = at[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _distinct(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Sorted distinct values, and the place of every value among them."""
    e = values.dictionary_encode()
    order = pc.sort_indices(e.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return e.dictionary.take(pa.array(order)), place[e.indices.to_numpy()]


def _joined_hashes(words: pa.StringArray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of ``left_right``: a string's bytes as one number modulo a prime, so equal strings agree."""
    size = pc.binary_length(words).to_numpy().astype(np.int64)
    power = np.ones(int(size.max(initial=0)) + 2, np.uint64)
    for i in range(1, len(power)):
        power[i] = int(power[i - 1]) * 256 % _PRIME
    h = np.array([int.from_bytes(w.encode()) % _PRIME for w in words.to_pylist()], np.uint64)
    of_pairs = (h[left] * power[size[right] + 1] % _PRIME + ord("_") * power[size[right]] + h[right]) % _PRIME
    return h, of_pairs


def count_terms(raw: np.ndarray, offsets: np.ndarray, doc: np.ndarray, docs: int) -> Counts:
    """Term counts of lower-cased texts; text ``i`` belongs to document ``doc[i]``, whose total is its longest text's."""
    kept = _TOKEN[raw]
    start = kept.copy()
    start[1:] &= ~kept[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    start[heads] = kept[heads]  # tokens end with their text
    text = np.searchsorted(offsets, np.flatnonzero(start), "right") - 1
    cut = np.flatnonzero(start[kept])
    words, code = _distinct(_strings(raw[kept], np.append(cut, int(kept.sum()))))
    meant = ~pc.is_in(words, value_set=_STOP).to_numpy(zero_copy_only=False)
    keep = meant[code]
    words, code, text = words.filter(pa.array(meant)), (np.cumsum(meant) - 1)[code[keep]], text[keep]

    v = max(len(words), 1)
    near = np.flatnonzero(text[1:] == text[:-1])
    pairs, pair = _distinct(pa.array(code[near] * v + code[near + 1]))
    left, right = np.divmod(pairs.to_numpy(), v)
    terms = pa.concat_arrays([words, pc.binary_join_element_wise(words.take(pa.array(left)), words.take(pa.array(right)), "_")])
    hashes = np.concatenate(_joined_hashes(words, left, right))
    code = np.concatenate([code, len(words) + pair])
    if pc.any(pc.match_substring(words, "_")).as_py():  # the word a_b and the bigram of a and b are one term
        terms, same = _distinct(terms)
        one = np.empty(len(terms), np.uint64)
        one[same] = hashes
        hashes, code = one, same[code]
    held = np.bincount(text, minlength=len(offsets) - 1)
    total = np.zeros(docs, np.int64)
    np.maximum.at(total, doc, held + np.maximum(held - 1, 0))
    t = max(len(terms), 1)
    met = np.sort(np.concatenate([doc[text], doc[text[near]]]) * t + code)
    first = np.flatnonzero(np.diff(met, prepend=-1))
    doc_, code_ = np.divmod(met[first], t)
    return Counts(terms, hashes, doc_, code_, np.diff(np.append(first, len(met))), total)


def _parts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, texts): a row per key. Keys are single as a rule; only texts of repeated keys are gathered."""
    lower = docs.select(key, F.lower(text).alias("text"))
    twice = docs.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)
    single = lower.select(key, F.array("text").alias("texts"))
    if twice.isEmpty():
        return single
    gathered = lower.join(twice, key, "left_semi").groupBy(key).agg(F.collect_list("text").alias("texts"))
    return single.join(twice, key, "left_anti").unionByName(gathered)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Counts]]:
    """Keys and counts of each block."""
    for b in batches:
        texts = b.column("texts")
        raw, at = _bytes(texts.flatten())
        size = pc.list_value_length(texts).fill_null(0).to_numpy().astype(np.int64)
        rows = np.append(0, np.cumsum(size))
        ends = at[rows]
        i = 0
        while i < len(size):
            j = min(max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1), len(size))
            part = at[rows[i] : rows[j] + 1]
            yield b.column(0).slice(i, j - i), count_terms(raw[part[0] : part[-1]], part - part[0], np.repeat(np.arange(j - i), size[i:j]), j - i)
            i = j


def document_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df): the number of documents of every term."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c in _blocks(batches):
            df = np.bincount(c.code, minlength=len(c.terms))
            yield pa.RecordBatch.from_arrays([c.terms, pa.array(df)], ["term", "df"])

    return _parts(docs, key, text).mapInArrow(cut, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _pack(x: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers as compressed planes of bytes."""
    planes = np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize).T)
    return len(x).to_bytes(8) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, kind: str = "<u4") -> np.ndarray:
    n, wide = int.from_bytes(packed[:8]), np.dtype(kind).itemsize
    raw = pa.decompress(packed[8:], n * wide, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, n).T).view(kind).ravel().astype(np.int64)


def _pack_strings(strings: pa.StringArray) -> bytes:
    data, offsets = _bytes(strings)
    sizes = _pack(np.diff(offsets))
    return len(sizes).to_bytes(8) + sizes + pa.compress(data.tobytes(), "zstd", asbytes=True)


def _unpack_strings(packed: bytes) -> pa.StringArray:
    cut = 8 + int.from_bytes(packed[:8])
    offsets = np.append(0, np.cumsum(_unpack(packed[8:cut])))
    return _strings(np.frombuffer(pa.decompress(packed[cut:], int(offsets[-1]), "zstd", asbytes=True), np.uint8), offsets)


def _added(chunks: pa.Table) -> pa.Array:
    """Document frequencies over all blocks of a bucket, back in each block's order."""
    terms = [_unpack_strings(x.as_py()) for x in chunks.column("terms")]
    place = pa.concat_arrays(terms).dictionary_encode().indices.to_numpy()
    df = np.bincount(place, np.concatenate([_unpack(x.as_py()) for x in chunks.column("df")])).astype(np.int64)[place]
    ends = np.cumsum([len(t) for t in terms])
    return pa.array([_pack(x, "<u8") for x in np.split(df, ends[:-1])], pa.binary())


def unit_vectors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): tf x idf of words and bigrams, scaled to unit length per key."""
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    size, many = size or 0, max(rows, 1)
    buckets = -(-size // BUCKET) or 1
    kind = docs.schema[key].dataType
    block = StructType([
        StructField("block", StringType()), StructField("keys", ArrayType(kind)), *(StructField(c, BinaryType()) for c in (
            "total", "held", "code", "n", "terms", "of_bucket"))])
    packed, out = to_arrow_schema(block), StructType([docs.schema[key], StructField("term", StringType()), StructField("weight", DoubleType())])
    named = to_arrow_schema(out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per block: its terms by bucket, and for each text the places of its terms, as gaps, with their counts."""
        for i, (keys, c) in enumerate(_blocks(batches)):
            bucket = (c.hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            by_text = np.argsort(c.doc * max(len(order), 1) + place[c.code])
            code, held = place[c.code][by_text], np.bincount(c.doc, minlength=len(keys))
            terms = _pack_strings(c.terms.take(pa.array(order)))
            gaps = np.diff(code, prepend=0)
            head = np.cumsum(held)[held > 0] - held[held > 0]
            gaps[head] = code[head]
            # the name tells a block from one that a repeated task cut otherwise
            name = f"{TaskContext.get().partitionId()}-{i}-{zlib.crc32(terms)}"
            yield pa.RecordBatch.from_pylist([{
                "block": name, "keys": keys.to_pylist(), "total": _pack(c.total), "held": _pack(held), "code": _pack(gaps), "n": _pack(c.n[by_text]),
                "terms": terms, "of_bucket": _pack(np.bincount(bucket.astype(np.int64), minlength=buckets))}], schema=packed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The terms of each block and bucket with the number of texts that have them."""
        for b in batches:
            for r in range(b.num_rows):
                name, held, gaps, terms, of_bucket = (b.column(c)[r].as_py() for c in ("block", "held", "code", "terms", "of_bucket"))
                terms = _unpack_strings(terms)
                df = np.bincount(_places(_unpack(held), _unpack(gaps)), minlength=len(terms))
                ends = np.cumsum(_unpack(of_bucket))
                full = [(k, s, e) for k, (s, e) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)) if e > s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(full), pa.string()), pa.array([k for k, _, _ in full], pa.int32()),
                     pa.array([_pack_strings(terms.slice(s, e - s)) for _, s, e in full], pa.binary()), pa.array([_pack(df[s:e]) for _, s, e in full], pa.binary())],
                    ["block", "bucket", "terms", "df"])

    def add(chunks: pa.Table) -> pa.Table:
        return pa.table({"block": chunks.column("block"), "bucket": chunks.column("bucket"), "df": _added(chunks)})

    def weigh(blocks: pa.Table, found: pa.Table) -> pa.Table:
        if blocks.num_rows != 1:
            raise ValueError("the texts came in another order when a task was repeated")
        b = {c: blocks.column(c)[0] for c in blocks.column_names}
        terms, held, total = _unpack_strings(b["terms"].as_py()), _unpack(b["held"].as_py()), _unpack(b["total"].as_py())
        df = np.concatenate([np.zeros(0, np.int64), *(_unpack(x.as_py(), "<u8") for x in found.sort_by("bucket").column("df"))])
        if len(df) != len(terms):
            raise ValueError("the texts came in another order when a task was repeated")
        code, doc = _places(held, _unpack(b["code"].as_py())), np.repeat(np.arange(len(held)), held)
        idf = np.log((1 + many) / (1 + df)) + 1.0
        w = _unpack(b["n"].as_py()) / total[doc] * idf[code]
        weight = w / np.sqrt(np.bincount(doc, w * w, minlength=len(held)))[doc]
        return pa.Table.from_arrays([b["keys"].values.take(pa.array(doc)), terms.take(pa.array(code)), pa.array(weight)], schema=named)

    # both readers of the blocks share this exchange
    blocks = _parts(docs, key, text).mapInArrow(cut, block).repartition(-(-size // TASK) or 1, "block")
    dealt = blocks.mapInArrow(deal, "block string, bucket int, terms binary, df binary")
    added = dealt.groupBy("bucket").applyInArrow(add, "block string, bucket int, df binary")
    return blocks.groupBy("block").cogroup(added.groupBy("block")).applyInArrow(weigh, out)


#: A block's terms of one folder, in ``sub`` after ``sub``: how many texts hold each, which ones, and how often.
#: The row of folder 0 names the texts and their totals, whether it has terms or not.
_POSTINGS = ("terms", "of_sub", "held", "docs", "n", "total")


def posting_type(key: StructField) -> StructType:
    return StructType([StructField("block", StringType()), *(StructField(c, BinaryType()) for c in _POSTINGS), StructField("keys", ArrayType(key.dataType)), StructField("bucket", IntegerType())])


def text_type(key: StructField) -> StructType:
    return StructType([StructField("block", StringType()), StructField("keys", ArrayType(key.dataType)), StructField("total", BinaryType()), StructField("norm", BinaryType())])


def _folders(terms: pa.StringArray, folders: int) -> np.ndarray:
    """Folder of each term, by its first eight bytes: neighbours in the alphabet stay together and pack well."""
    raw, at = _bytes(terms)
    head = np.append(raw, np.zeros(8, np.uint8))[at[:-1, None] + np.arange(8)]
    head[np.arange(8) >= np.diff(at)[:, None]] = 0
    return ((head.view(np.uint64).ravel() * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(folders)).astype(np.int64)


def posting_blocks(docs: DataFrame, key: str, text: str, folders: int, subs: int) -> DataFrame:
    """A row per block of texts and folder of terms, as :func:`posting_type`."""
    kind = posting_type(docs.schema[key])
    packed = to_arrow_schema(kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, (keys, c) in enumerate(_blocks(batches)):
            sub = (c.hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(subs)
            group = _folders(c.terms, folders) * subs + sub.astype(np.int64)
            order = np.argsort(group.astype(np.min_scalar_type(folders * subs)), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            code = place[c.code]
            by_term = np.argsort(code * max(len(keys), 1) + c.doc)
            held, doc, n = np.bincount(code, minlength=len(order)), c.doc[by_term], c.n[by_term]
            of_group = np.bincount(group, minlength=folders * subs).reshape(folders, subs)
            terms, ends = c.terms.take(pa.array(order)), np.append(0, np.cumsum(of_group.sum(1)))
            at = np.append(0, np.cumsum(held))[ends]
            name = f"{TaskContext.get().partitionId()}-{i}"
            yield pa.RecordBatch.from_pylist([{
                "block": name, "terms": _pack_strings(terms.slice(s, e - s)), "of_sub": _pack(of_group[f]), "held": _pack(held[s:e]), "docs": _pack(doc[p:q]), "n": _pack(n[p:q]),
                "total": None if f else _pack(c.total), "keys": None if f else keys.to_pylist(), "bucket": f,
            } for f, (s, e, p, q) in enumerate(zip(ends[:-1], ends[1:], at[:-1], at[1:], strict=True)) if e > s or not f], schema=packed)

    return _parts(docs, key, text).mapInArrow(cut, kind)


def _same_order(ok: bool) -> None:
    if not ok:
        raise ValueError("a block and its document frequencies do not fit")


def text_norms(postings: DataFrame, key: StructField, many: int) -> DataFrame:
    """A row per block: its texts, their totals and the length of their tf x idf vectors.

    Terms travel once per block to their document frequencies, places and counts once to their
    block, without the terms.
    """
    kind = text_type(key)
    named = to_arrow_schema(kind)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, bucket, packed, of_sub, held in zip(*(b.column(c).to_pylist() for c in ("block", "bucket", "terms", "of_sub", "held")), strict=True):
                of_sub, held = _unpack(of_sub), _unpack(held)
                terms = _unpack_strings(packed) if len(of_sub) > 1 else None
                ends = np.append(0, np.cumsum(of_sub)).tolist()
                full = [(k, s, e) for k, (s, e) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if e > s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(full), pa.string()), pa.array([bucket] * len(full), pa.int32()), pa.array([k for k, _, _ in full], pa.int32()),
                     pa.array([packed if terms is None else _pack_strings(terms.slice(s, e - s)) for _, s, e in full], pa.binary()), pa.array([_pack(held[s:e]) for _, s, e in full], pa.binary())],
                    ["block", "bucket", "sub", "terms", "df"])

    def add(chunks: pa.Table) -> pa.Table:
        df = _added(chunks)
        return pa.table({c: chunks.column(c) for c in ("block", "bucket", "sub")} | {"df": df})

    def measure(blocks: pa.Table, found: pa.Table) -> pa.Table:
        by_folder = {b: {} for b in blocks.column("bucket").to_pylist()}
        for bucket, sub, df in zip(*(found.column(c).to_pylist() for c in ("bucket", "sub", "df")), strict=True):
            by_folder[bucket][sub] = df
        first = blocks.filter(pc.equal(blocks.column("bucket"), 0))
        _same_order(first.num_rows == 1 and len(by_folder) == blocks.num_rows)
        total, keys = _unpack(first.column("total")[0].as_py()), first.column("keys")
        squares = np.zeros(len(total))
        for r in range(blocks.num_rows):
            held, doc, n = (_unpack(blocks.column(c)[r].as_py()) for c in ("held", "docs", "n"))
            subs = by_folder[blocks.column("bucket")[r].as_py()]
            df = np.concatenate([np.zeros(0, np.int64), *(_unpack(subs[k], "<u8") for k in sorted(subs))])
            _same_order(len(df) == len(held))
            w = n / total[doc] * np.repeat(np.log((1 + many) / (1 + df)) + 1.0, held)
            squares += np.bincount(doc, w * w, minlength=len(total))
        return pa.Table.from_arrays([first.column("block"), keys, first.column("total"), pa.array([_pack(np.sqrt(squares).view(np.uint64), "<u8")], pa.binary())], schema=named)

    dealt = postings.select("block", "bucket", "terms", "of_sub", "held").mapInArrow(deal, "block string, bucket int, sub int, terms binary, df binary")
    added = dealt.groupBy("bucket", "sub").applyInArrow(add, "block string, bucket int, sub int, df binary")
    places = postings.select("block", "bucket", "held", "docs", "n", "keys", "total")
    return places.groupBy("block").cogroup(added.groupBy("block")).applyInArrow(measure, kind)


def _norms(packed: bytes) -> np.ndarray:
    return _unpack(packed, "<u8").view(np.float64)


def term_shares(postings: DataFrame, texts: DataFrame) -> DataFrame:
    """(bucket, term, df, share): the texts with a term, and its largest tf over a text's length."""
    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, packed, of_sub, held, doc, n, total, norm in zip(*(b.column(c).to_pylist() for c in ("bucket", "terms", "of_sub", "held", "docs", "n", "total", "norm")), strict=True):
                of_sub, held, doc, n, total, norm = _unpack(of_sub), _unpack(held), _unpack(doc), _unpack(n), _unpack(total), _norms(norm)
                if not len(held):
                    continue
                share = np.maximum.reduceat(n / total[doc] / norm[doc], np.cumsum(held) - held)
                terms = _unpack_strings(packed) if len(of_sub) > 1 else None
                ends = np.append(0, np.cumsum(of_sub)).tolist()
                full = [(k, s, e) for k, (s, e) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if e > s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket] * len(full), pa.int32()), pa.array([k for k, _, _ in full], pa.int32()),
                     pa.array([packed if terms is None else _pack_strings(terms.slice(s, e - s)) for _, s, e in full], pa.binary()),
                     pa.array([_pack(held[s:e]) for _, s, e in full], pa.binary()), pa.array([share[s:e].tobytes() for _, s, e in full], pa.binary())],
                    ["bucket", "sub", "terms", "df", "share"])

    def meet(chunks: pa.Table) -> pa.Table:
        """The terms of a part of a folder over all blocks, in order."""
        met = pa.concat_arrays([_unpack_strings(x.as_py()) for x in chunks.column("terms")]).dictionary_encode()
        place, names = met.indices.to_numpy(), met.dictionary
        df = np.bincount(place, np.concatenate([_unpack(x.as_py()) for x in chunks.column("df")]), len(names)).astype(np.int64)
        share = np.zeros(len(names))
        np.maximum.at(share, place, np.concatenate([np.frombuffer(x.as_py()) for x in chunks.column("share")]))
        order = pc.sort_indices(names)
        bucket = pa.array(np.full(len(names), chunks.column("bucket")[0].as_py(), np.int32))
        return pa.table([bucket, names.take(order), pa.array(df).take(order), pa.array(share).take(order)], ["bucket", "term", "df", "share"])

    rows = postings.select("block", "bucket", "terms", "of_sub", "held", "docs", "n").join(texts.select("block", "total", "norm"), "block")
    dealt = rows.mapInArrow(largest, "bucket int, sub int, terms binary, df binary, share binary")
    return dealt.groupBy("bucket", "sub").applyInArrow(meet, "bucket int, term string, df long, share double")


def postings_of(postings: DataFrame, wanted: pa.StringArray) -> DataFrame:
    """(bucket, term, block, docs, n): the places and counts of some terms in each block, as bytes."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, bucket, terms, held, doc, n in zip(*(b.column(c).to_pylist() for c in ("block", "bucket", "terms", "held", "docs", "n")), strict=True):
                terms = _unpack_strings(terms)
                at = np.flatnonzero(pc.is_in(terms, value_set=wanted).to_numpy(zero_copy_only=False))
                if len(at):
                    ends, doc, n = np.append(0, np.cumsum(_unpack(held))), _unpack(doc).astype("<u4"), _unpack(n).astype("<u4")
                    cuts = [slice(s, e) for s, e in zip(ends[at].tolist(), ends[at + 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bucket] * len(at), pa.int32()), terms.take(pa.array(at)), pa.array([name] * len(at), pa.string()),
                         pa.array([doc[c].tobytes() for c in cuts], pa.binary()), pa.array([n[c].tobytes() for c in cuts], pa.binary())], ["bucket", "term", "block", "docs", "n"])

    return postings.select("block", "bucket", "terms", "held", "docs", "n").mapInArrow(find, "bucket int, term string, block string, docs binary, n binary")


def block_scores(hits: DataFrame, texts: DataFrame, by: list[str], question: StructField, doc: StructField, k: int | None) -> DataFrame:
    """(question, doc, score, block, code) from hits(question, docs, n, f, only) of one block at a time.

    A block holds all terms of its texts, so its scores are whole and with ``k`` only its best
    leave it. Rows with ``only`` name the texts of a question that are scored at all.
    """
    kind = StructType([question, doc, StructField("score", DoubleType()), StructField("block", StringType()), StructField("code", IntegerType())])
    named = to_arrow_schema(kind)

    def score(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        if not rows.num_rows or not blocks.num_rows:
            return named.empty_table()
        keys, name = blocks.column("keys").combine_chunks().flatten(), blocks.column("block")[0].as_py()
        length = _unpack(blocks.column("total")[0].as_py()) * _norms(blocks.column("norm")[0].as_py())
        rank = np.empty(len(keys), np.int64)
        rank[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
        asked = rows.column(question.name).combine_chunks().dictionary_encode(null_encoding="encode")
        of = asked.indices.to_numpy()
        order = np.argsort(of, kind="stable")
        docs, n, f, only = (rows.column(c).to_pylist() for c in ("docs", "n", "f", "only"))
        out = []
        for rs in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            met = [(np.frombuffer(docs[r], "<u4"), np.frombuffer(n[r], "<u4") * f[r]) for r in rs.tolist() if only[r] is None]
            if not met:
                continue
            code, at = np.unique(np.concatenate([d for d, _ in met]).astype(np.int64), return_inverse=True)
            s = np.bincount(at, np.concatenate([w for _, w in met])) / length[code]
            if some := [only[r] for r in rs.tolist() if only[r] is not None]:
                kept = np.isin(code, np.concatenate([np.asarray(x, np.int64) for x in some]))
                code, s = code[kept], s[kept]
            if k is not None and len(code) > k:  # texts without a key are one to their reader
                nameless = keys.take(pa.array(code)).is_null().to_numpy(zero_copy_only=False)
                best = np.lexsort((rank[code], -np.round(s, 6), nameless))[:k]
                kept = np.union1d(best, np.flatnonzero(nameless))
                code, s = code[kept], s[kept]
            out.append((int(of[rs[0]]), code, s))
        code = np.concatenate([np.zeros(0, np.int64), *(c for _, c, _ in out)])
        q = pa.array(np.repeat([i for i, _, _ in out], [len(c) for _, c, _ in out]).astype(np.int64))
        return pa.Table.from_arrays(
            [asked.dictionary.take(q), keys.take(pa.array(code)), pa.array(np.concatenate([np.zeros(0), *(s for _, _, s in out)])), pa.array([name] * len(code), pa.string()), pa.array(code.astype(np.int32))], schema=named)

    return hits.groupBy(*by).cogroup(texts.groupBy(*by)).applyInArrow(score, kind)


def _places(held: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Places of terms from their gaps; every text starts from zero."""
    run = np.cumsum(gaps)
    head = np.cumsum(held) - held
    before = np.append(0, run)[head]
    return run - np.repeat(before, held)


def smooth_idf(df: DataFrame, size: Column) -> DataFrame:
    """(term, df, idf), smoothed: ln((1 + N) / (1 + df)) + 1."""
    return df.withColumn("idf", F.log((1 + F.greatest(size, F.lit(1))) / (1 + F.col("df"))) + 1.0)
