"""Best-fit packing with swap-based local search.

Documents are cut into pieces of at most ``capacity`` tokens. Pieces are dealt by hash into
groups of a few thousand, which pack independently: best fit by falling length, then a local
search that empties underfull bins. The underfull bins that are left over in all groups are
unpacked and packed once more together, so a group costs almost nothing at its seam. Only
(id, length) rows are shuffled; texts never leave the scan.

Null and empty texts are a document of the end token alone. Rows that repeat a ``doc_id`` are
packed as documents of their own; a null ``doc_id`` stays null. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import common as C

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", row long, sequence_id long, offset long, fill long"
#: Words whose ids a worker keeps between batches.
CACHE_WORDS = 600_000


class WordEncoder(dict):
    """Little-endian unsigned 32-bit ids of each word (bytes to bytes), encoded when first asked for.

    The vocabulary's normalizer and splitter never join characters across ASCII white space, so
    a text's ids are its words' ids in order and each distinct word is encoded once. Words of
    Latin letters, with or without a closing full stop or comma, need only lower case and the
    vocabulary's model; all others take the whole way. Words not met for a while drop out: when
    the younger half is full, the older half goes.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.encoder = Tokenizer.from_file(vocabulary)
        self.tokens = self.encoder.model.tokenize
        self.older: dict[bytes, bytes] = {}
        # the character that stands for each byte of a Latin letter, as the library's own byte mapping has it
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_chars = {}
        for first in range(0xC2, 0xCA):
            for c in range(0x80, 0xC0):
                mapped = level.pre_tokenize_str(bytes([first, c]).decode())[0][0]
                self.byte_chars[first], self.byte_chars[c] = mapped[0], mapped[1]
        self.closing = {m: self._whole(m) for m in (b".", b",")}

    def _whole(self, word: bytes) -> bytes:
        return array("I", self.encoder.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def _latin(self, word: bytes) -> bytes | None:
        if word.isascii():
            if not word.isalpha():
                return None
            piece = word.lower().decode()
        else:
            s = word.decode()
            if not s.isalpha() or max(s) > "\u023a" or "\u0130" in s:
                return None
            piece = s.lower().encode().decode("latin-1").translate(self.byte_chars)
        return array("I", [t.id for t in self.tokens(piece)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            end = self.closing.get(word[-1:], b"")
            ids = self._latin(word[:-1] if end else word)
            ids = ids + end if ids else self._whole(word)
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Ids of a text."""
        if len(self) > CACHE_WORDS // 2:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


_ENCODERS: dict[str, WordEncoder] = {}


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, capacity: int) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = WordEncoder(vocabulary)
    encoder, width, end = _ENCODERS[vocabulary], 4 * capacity, b"\0\0\0\0"
    for b in batches:
        data, offsets = C.string_bytes(b.column("text"))
        ids = b.column("doc_id").to_pylist()
        for i, j in C.slices(offsets, 4 << 20):
            rows = []
            for k in range(i, j):
                d, coded = ids[k], encoder.encode(data[offsets[k] : offsets[k + 1]].tobytes()) + end
                rows += [(d, p // width, p // 4, len(x := coded[p : p + width]) // 4, zlib.crc32(x))
                         for p in range(0, len(coded), width)]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indices: each item, longest first, goes where it leaves the least space."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0  # bit s: there is a bin with s free places
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        fits = spaces >> n
        if fits:
            s = n + ((fits & -fits).bit_length() - 1)
            b = by_space[s].pop()
            if not by_space[s]:
                spaces ^= 1 << s
        else:
            s, b = capacity, len(bins)
            bins.append([])
        bins[b].append(k)
        s -= n
        by_space[s].append(b)
        spaces |= 1 << s
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int, rounds: int = 4) -> list[list[int]]:
    """Local search on underfull bins.

    The emptiest bin is the donor. A move, a one-for-one or a two-for-one exchange takes length
    from the donor to a fuller bin, so the sum of squared fills rises with each step and the
    donor empties. It ends when no step applies or the bins are as few as the total length allows.
    """
    least = -(-sum(lengths) // capacity)
    fill = [sum(lengths[k] for k in b) for b in bins]
    for _ in range(rounds):
        live = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: fill[b])
        changed = False
        for donor in live:
            if sum(1 for f in fill if f) <= least:
                return [b for b in bins if b]
            # (length, item, bin) of the other underfull bins, and their free places
            others = [b for b in live if b != donor and bins[b] and fill[b] >= fill[donor]]
            items = sorted((lengths[k], k, b) for b in others for k in bins[b])
            space = sorted((capacity - fill[b], b) for b in others if fill[b] < capacity)
            before = fill[donor]
            for k in sorted(bins[donor], key=lambda k: -lengths[k]):
                x = lengths[k]
                at = bisect_left(space, (x, -1))
                if at < len(space):  # move
                    s, b = space.pop(at)
                    _shift(bins, fill, lengths, donor, b, [k], [])
                    if s > x:
                        insort(space, (s - x, b))
                    continue
                if _exchange(bins, fill, lengths, capacity, donor, [k], items):
                    items = sorted((lengths[i], i, b) for b in others for i in bins[b])
                    space = sorted((capacity - fill[b], b) for b in others if fill[b] < capacity)
            mine = sorted(bins[donor], key=lambda k: lengths[k])[:12]
            for i, a in enumerate(mine):
                if any(_exchange(bins, fill, lengths, capacity, donor, [a, c], items)
                       for c in mine[i + 1 :] if a in bins[donor] and c in bins[donor]):
                    items = sorted((lengths[i], i, b) for b in others for i in bins[b])
            changed |= fill[donor] < before
        if not changed:
            break
    return [b for b in bins if b]


def _shift(bins, fill, lengths, donor, taker, give, take) -> None:
    for k in give:
        bins[donor].remove(k)
        bins[taker].append(k)
    for k in take:
        bins[taker].remove(k)
        bins[donor].append(k)
    gain = sum(lengths[k] for k in give) - sum(lengths[k] for k in take)
    fill[donor] -= gain
    fill[taker] += gain


def _exchange(bins, fill, lengths, capacity, donor, give, items) -> bool:
    """Give one or two documents for one shorter in all, if the taker has room for the difference."""
    x = sum(lengths[k] for k in give)
    for at in range(bisect_left(items, (x, -1, -1)) - 1, -1, -1):
        y, k, b = items[at]
        if x - y > capacity - min(fill[b], fill[donor]):
            return False
        if 0 < x - y <= capacity - fill[b] and k in bins[b] and fill[b] >= fill[donor] - (x - y):
            _shift(bins, fill, lengths, donor, b, give, [k])
            return True
    return False


def _pack(group: pd.DataFrame, capacity: int, base: int) -> pd.DataFrame:
    group = group.sort_values(["doc_id", "piece", "row"], kind="stable").reset_index(drop=True)
    lengths = group["length"].tolist()
    bins = improve(best_fit(lengths, capacity), lengths, capacity)
    n = len(group)
    seq, off, fill = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for b, items in enumerate(bins):
        at = 0
        for k in items:
            seq[k], off[k] = b, at
            at += lengths[k]
        fill[items] = at
    group["sequence_id"] = (base + group["part"].astype("int64")) * 2**24 + seq
    group["offset"], group["fill"] = off, fill
    return group.drop(columns="part")


def _pack_groups(pieces: DataFrame, capacity: int, group_size: int, base: int) -> tuple[DataFrame, int]:
    parts = C.count_for(pieces.count(), group_size)
    # by the stored row's number, so copies of one row are dealt over all groups
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("row", F.lit(base)), F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(lambda g: _pack(g, capacity, base), PACKED), parts


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long"), C.text())
    return d.mapInArrow(lambda it: _pieces(it, vocabulary, capacity), PIECES)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, group_size: int = 2500, loose: float = 0.97) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``vocabulary`` is the path of a tokenizer file that executors can read. Bins filled below
    ``loose`` after the first pass are packed once more across groups.
    """
    pieces = C.store(token_pieces(docs, vocabulary, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    first, parts = _pack_groups(pieces, capacity, group_size, 0)
    first = C.store(first, "packed")
    C.discard(pieces)
    tight = F.col("fill") >= int(loose * capacity)
    rest = first.filter(~tight).select("doc_id", "piece", "start", "length", "ids_crc32", "row")
    second, _ = _pack_groups(rest, capacity, group_size, parts)
    return first.filter(tight).unionByName(second).drop("fill", "row")
