"""Cheapest repair of the turn structure of conversations, by a rank-convergence parallel Viterbi.

A repaired conversation is empty or an optional system turn and one or more user/assistant pairs.
Keeping a row is free, giving it the role user or assistant costs 1, deleting it 2 (required for
blank rows and duplicates), inserting an empty turn 5, and a truncated row that stays 5 more.

Rows are range-partitioned by (conversation, turn, role, text), so a conversation may span any
number of tasks, and each task cuts its stream into chunks. The state before a row is what the
output ends with: nothing (E), a system (S), user (U) or assistant (A) turn. ``Costs`` holds the
vector of cheapest costs to the end from each state, less its minimum; there are few such vectors.

Only conversations of several chunks need more than one task. Their chunks start from speculative
vectors at their right end, one per state that could follow. Where these have become equal but
for a constant at the chunk's left end (rank one), the chunk does not depend on its neighbours;
the others go through fix-up passes, each of which takes the right neighbour's vector if that
is settled and else joins both chunks' transfers, so k unsettled neighbours take log2(k) passes.
From the stitched right vectors every chunk traces its cheapest edits for each state it could be
entered in; passes of the same kind from the left settle the entries. At equal cost a trace takes
the ASCII-least edit, which gives the ASCII-least audit, since the rest of the path is optimal.

Null roles and texts are one space (no role, blank). A null ``conv_id`` is a conversation, null
turns come first, equal turns are ordered by role and text. Rows repeated whole are counted, not
listed, until the audit is written. Long conversations are cut every 1,024 rows or some 4 MB of
text; a very long text is a chunk of its own. An empty table gives no rows, extra columns are
ignored. The audit and the hash of a conversation are one value each, made from its pieces in
order by a stream that holds a hash state and the audit.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm import common as C

CHUNK_ROWS, CHUNK_BYTES, PART_BYTES = 1024, 4 << 20, 8 << 20
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
E, S, U, A = range(4)
#: State after a user or assistant turn that fits: a user turn, but an assistant turn after a user's.
FITTING = (U, U, A, U)
ROLE = {U: "user", A: "assistant"}
#: Code of a row: initial (s, u, a, other) + 4 * fault.
INITIALS = "sua"
CLEAN, CUT_OFF, BLANK, DUPLICATE, ABSENT = range(5)
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Cost of a state that a speculative vector leaves out. Two states' true costs differ by under 20, since a few inserts or
#: deletions lead from one to the other, so what stands this far above never decides and may be cut off here.
FAR = 64


def kept_state(state: int, initial: int) -> int | None:
    if initial == 0:
        return S if state == E else None
    return FITTING[state] if (initial, FITTING[state]) in ((1, U), (2, A)) else None


def with_inserts(v: tuple[int, ...]) -> tuple[int, ...]:
    u, a = min(v[U], INSERT + v[A]), min(v[A], INSERT + v[U])
    return min(v[E], INSERT + u), min(v[S], INSERT + u), u, a


#: Costs where the conversation ends.
END = with_inserts((0, FAR, FAR, 0))


def options(state: int, code: int) -> list[tuple[str, int, int]]:
    """Edits of a row in ASCII order: name, cost and state after it."""
    initial, fault = code % 4, code // 4
    out = [("D", DELETE, state)]
    if fault in (CLEAN, CUT_OFF):
        more = TRUNCATED * (fault == CUT_OFF)
        if (k := kept_state(state, initial)) is not None:
            out.append(("K", more, k))
        out.append(("R", REROLE + more, FITTING[state]))
    return out


def _least(v: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    low = min(v)
    return tuple(min(x - low, FAR) for x in v), low


@functools.cache
def before(v: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """Vector before a row from the one after it, less its minimum, and that minimum."""
    if code // 4 == ABSENT:
        return v, 0
    return _least(with_inserts(tuple(min(c + v[t] for _, c, t in options(s, code)) for s in range(4))))


@functools.cache
def edits(v: tuple[int, ...], code: int, state: int) -> tuple[str, int, tuple[str, ...], str, int]:
    """ASCII-least cheapest edits up to and with a row, before vector ``v``: audit, cost, inserted roles, edit of the row, state."""
    if code // 4 == ABSENT:
        return "", 0, (), "", state
    full = with_inserts(tuple(min(c + v[t] for _, c, t in options(s, code)) for s in range(4)))
    audit, cost, inserted = "", 0, []
    while True:
        own = [(name, c, t) for name, c, t in options(state, code) if c + v[t] == full[state]]
        insert = INSERT + full[FITTING[state]] == full[state]
        if insert and not (own and own[0][0] < "I"):
            state = FITTING[state]
            audit, cost = audit + "I", cost + INSERT
            inserted.append(ROLE[state])
            continue
        name, c, t = own[0]
        return audit + name, cost + c, tuple(inserted), name, t


def last_inserts(state: int) -> list[str]:
    out = []
    while state not in (E, A):
        state = FITTING[state]
        out.append(ROLE[state])
    return out


def vectors(codes: list[int], right: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Vectors after every row, first row first, and before the first row (at the end of the list)."""
    v, out = right, []
    for code in reversed(codes):
        out.append(v)
        v = before(v, code)[0]
    return out[::-1] + [v]


def transfer(codes: list[int]) -> tuple[list[int], bool]:
    """Least costs from each state on the left to each on the right, row by row; and whether the chunk is of rank one."""
    columns, kinds = [], set()
    for state in range(4):
        v, total = tuple(0 if s == state else FAR for s in range(4)), 0
        for code in reversed(codes):
            v, low = before(v, code)
            total += low
        kinds.add(v)
        columns.append([x + total for x in v])
    low = min(map(min, columns))
    return [min(columns[j][s] - low, FAR) for s in range(4) for j in range(4)], len(kinds) == 1


def exits(codes: list[int], right: tuple[int, ...]) -> list[int]:
    """State after the chunk for each state before it."""
    after, out = vectors(codes, right), []
    for state in range(4):
        for code, v in zip(codes, after):  # noqa: B905  the last vector is the one before the first row
            state = edits(v, code, state)[4]
        out.append(state)
    return out


# --- rows -------------------------------------------------------------------------------------------------------------


def plain(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and how often each row is there."""
    return conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(C.NULL_ID)).alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.lit(1).cast("long").alias("copies"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``plain`` rows after a repeatable damage: a row's number of conversation and turn says what befalls it."""
    p = plain(conversations)
    key = F.when(F.col("conv_id") == C.NULL_ID, F.lit(" ")).otherwise(F.col("conv_id").cast("string"))
    name = F.concat(key, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    p = p.withColumn("hit", F.crc32(name.cast("binary")) % 20)
    hit = F.col("hit")
    stay = lambda c: F.when(hit != 0, c)  # noqa: E731  what is dropped leaves its conversation's name
    return p.select(
        "conv_id", stay(F.col("turn")).alias("turn"), stay(F.when(hit == 4, F.lit("user")).otherwise(F.col("role"))).alias("role"),
        stay(F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).cast("long").alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with their copies and codes. A row is a duplicate if an earlier turn has its role and text; further copies are counted later."""
    r = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    when = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    r = C.store(r.withColumns({"said": F.when((F.col("copies") > 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), said), "at": when}), "turns")
    again = r.filter("said is not null").groupBy("conv_id", "said").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = r.filter("said is not null").join(again, ["conv_id", "said"], "left").withColumn("later", F.coalesce(F.col("at") > F.col("first"), F.lit(False)))
    both = later.drop("first").unionByName(r.filter("said is null").withColumn("later", F.lit(False)))
    fault = (F.when(F.col("copies") == 0, ABSENT).when(F.col("said").isNull(), BLANK).when(F.col("later"), DUPLICATE)
             .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT_OFF).otherwise(CLEAN))
    initial = F.substring("role", 1, 1)
    letter = functools.reduce(lambda c, k: c.when(initial == INITIALS[k], k), range(1, 3), F.when(initial == INITIALS[0], 0)).otherwise(3)
    return both.select("conv_id", "turn", "role", "text", "copies", (letter + 4 * fault).cast("int").alias("code"))


# --- chunks -----------------------------------------------------------------------------------------------------------

LISTS = ("turn", "role", "text", "copies", "code")
CHUNKS = ("conv_id long, chunk long, goes_on boolean, comes_on boolean, edge int, "
          "turn array<long>, role array<string>, text array<string>, copies array<long>, code array<int>")


def _chunks(batches: Iterator[pa.RecordBatch], most_rows: int) -> Iterator[pa.RecordBatch]:
    """Chunks of a sorted partition. The last one is held until it is known whether its conversation goes on."""
    from pyspark import TaskContext

    number, held, comes_on, first = TaskContext.get().partitionId() << 33, None, False, True

    def emit(t: pa.Table, starts: np.ndarray, goes_on: np.ndarray, last: bool) -> pa.RecordBatch:
        nonlocal number, comes_on, first
        n = len(starts) - 1
        t = t.slice(int(starts[0]), int(starts[-1] - starts[0])).combine_chunks()
        offsets = pa.array((starts - starts[0]).astype(np.int32))
        before_ = np.concatenate([[comes_on], goes_on[:-1]])
        edge = np.zeros(n, np.int32)
        edge[0] += first
        edge[-1] += 2 * last
        columns = [t.column("conv_id").combine_chunks().take(offsets[:-1]), pa.array(number + np.arange(n)), pa.array(goes_on), pa.array(before_), pa.array(edge)]
        for c in LISTS:
            values = t.column(c).combine_chunks()
            columns.append(pa.ListArray.from_arrays(offsets, values.chunk(0) if isinstance(values, pa.ChunkedArray) else values))
        number, comes_on, first = number + n, bool(goes_on[-1]), False
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "chunk", "goes_on", "comes_on", "edge", *LISTS])

    for b in batches:
        if not b.num_rows:
            continue
        new = pa.Table.from_batches([b])
        t = new if held is None else pa.concat_tables([held, new])
        conv = t.column("conv_id").to_numpy()
        data = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(t.column("text")).fill_null(0)))])
        starts = _starts(conv, data, most_rows)
        if len(starts) > 1:
            goes_on = conv[starts[1:]] == conv[starts[:-1]]
            yield emit(t, starts, goes_on, False)
        held = t.slice(int(starts[-1]))
    if held is not None:
        yield emit(held, np.array([0, held.num_rows]), np.array([False]), True)


def _starts(conv: np.ndarray, data: np.ndarray, most_rows: int) -> np.ndarray:
    """Where chunks start: at a new conversation, after so many rows, or after so much text."""
    new = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
    out = []
    for s, e in zip(new.tolist(), np.append(new[1:], len(conv)).tolist(), strict=True):
        while s < e:
            out.append(s)
            s = min(s + most_rows, max(s + 1, int(np.searchsorted(data, data[s] + CHUNK_BYTES, "right")) - 1))
    return np.array(out)


def chunks(rows: DataFrame) -> DataFrame:
    """Stored chunks with the chunk before (``prev``) and after (``next``) in the same conversation."""
    r = C.store(faults(rows), "faults")
    parts = C.count_for(r.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32)).first()[0], PART_BYTES, 8)
    order = ["conv_id", F.col("turn").isNotNull(), "turn", "role", "text"]
    most = CHUNK_ROWS
    dealt = r.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    cut = C.store(dealt.mapInArrow(lambda it: _chunks(it, most), CHUNKS), "chunks")
    # one or two rows per task
    line = Window.orderBy("chunk")
    edges = cut.filter("edge > 0").select("chunk", "edge", "conv_id", F.lead("chunk").over(line).alias("to"), F.lead("conv_id").over(line).alias("to_conv"))
    links = C.store(edges.filter("edge >= 2 and to_conv = conv_id").select("chunk", "to"), "links")
    onward = F.broadcast(links.select(F.col("chunk"), F.col("to").alias("linked_next")))
    back = F.broadcast(links.select(F.col("to").alias("chunk"), F.col("chunk").alias("linked_prev")))
    return cut.join(onward, "chunk", "left").join(back, "chunk", "left").withColumns({
        "next": F.coalesce("linked_next", F.when(F.col("goes_on"), F.col("chunk") + 1)),
        "prev": F.coalesce("linked_prev", F.when(F.col("comes_on"), F.col("chunk") - 1))}).select("conv_id", "chunk", "prev", "next", *LISTS)


# --- stitching --------------------------------------------------------------------------------------------------------


PASS = "chunk long, at long, m array<long>, k array<long>"


def _pass_rows(chunk, at, m, k) -> pa.RecordBatch:
    row = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(at, pa.int64()), pa.array(m, row), pa.array(k, row)], ["chunk", "at", "m", "k"])


def _fitted(x: np.ndarray) -> list[list[int]]:
    """Vectors or transfers, one per row, less their minimum."""
    x = x.reshape(len(x), -1)
    return np.minimum(x - x.min(1, keepdims=True), FAR).tolist()


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass: rows (chunk, m) with the pointer, transfer and vector (at2, m2, k2) of the chunk they point to."""
    for b in batches:
        t = {c: b.column(c).to_pylist() for c in ("chunk", "m", "at2", "m2", "k2")}
        known = np.array([x is not None for x in t["k2"]], bool)
        out_m, out_k, at = [None] * len(known), [None] * len(known), [None if k else a for a, k in zip(t["at2"], known, strict=True)]
        rows = np.flatnonzero(known)
        if len(rows):
            m, k = (np.array([t[c][i] for i in rows], np.int64) for c in ("m", "k2"))
            for i, x in zip(rows, _fitted((m.reshape(-1, 4, 4) + k[:, None, :]).min(2)), strict=True):
                out_k[i] = x
        rows = np.flatnonzero(~known)
        if len(rows):
            m, n = (np.array([t[c][i] for i in rows], np.int64).reshape(-1, 4, 4) for c in ("m", "m2"))
            for i, x in zip(rows, _fitted((m[:, :, :, None] + n[:, None, :, :]).min(2)), strict=True):
                out_m[i] = x
        yield _pass_rows(t["chunk"], at, out_m, out_k)


def settled(chunk_transfers: DataFrame) -> DataFrame:
    """(chunk, k) for every row of (chunk, at, m, k): ``k`` is m applied to the ``k`` of chunk ``at``.

    Each pass settles the chunks that point to a settled one and lets the others point twice as far.
    """
    rows = C.store(chunk_transfers, "pass")
    while rows.filter("k is null").limit(1).count():
        there = rows.select(F.col("chunk").alias("at"), F.col("at").alias("at2"), F.col("m").alias("m2"), F.col("k").alias("k2"))
        moved = rows.filter("k is null").select("chunk", "at", "m").join(there, "at").mapInArrow(_stitch, PASS)
        rows = C.store(rows.filter("k is not null").unionByName(moved), "pass")
    return rows.select("chunk", "k")


def _speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transfer of every chunk; its left vector where it is the last one or of rank one."""
    for b in batches:
        m, k, at = [], [], []
        for codes, following in zip(b.column("code").to_pylist(), b.column("next").to_pylist(), strict=True):
            t, alike = transfer(codes)
            done = following is None or alike
            m.append(t)
            k.append(list(vectors(codes, END)[-1]) if done else None)
            at.append(None if done else following)
        yield _pass_rows(b.column("chunk").to_pylist(), at, m, k)


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State after a chunk by the state before it, as a transfer from the left; settled where the entry is known or does not matter."""
    for b in batches:
        m, k, at = [], [], []
        for codes, previous, right in zip(*(b.column(c).to_pylist() for c in ("code", "prev", "right")), strict=True):
            to = exits(codes, tuple(right))
            done = previous is None or len(set(to)) == 1
            m.append([0 if to[s] == t else FAR for t in range(4) for s in range(4)])
            k.append([0 if t == to[E] else FAR for t in range(4)] if done else None)
            at.append(None if done else previous)
        yield _pass_rows(b.column("chunk").to_pylist(), at, m, k)


def stitched(all_chunks: DataFrame) -> DataFrame:
    """(chunk, right, entry) of the chunks of conversations with several: the vector after them and the state before them."""
    several = C.store(all_chunks.filter("next is not null or prev is not null").select("chunk", "prev", "next", "code"), "several")
    left = settled(several.mapInArrow(_speculate, PASS))
    end = F.array(*[F.lit(x).cast("long") for x in END])
    right = several.join(left.select(F.col("chunk").alias("next"), F.col("k").alias("right")), "next", "left").withColumn("right", F.coalesce("right", end))
    right = C.store(right.select("chunk", "prev", "code", "right"), "right")
    out = settled(right.mapInArrow(_enter, PASS))
    entry = out.select(F.col("chunk").alias("prev"), (F.array_position("k", 0) - 1).cast("int").alias("entry"))
    return right.join(entry, "prev", "left").select("chunk", "right", F.coalesce("entry", F.lit(E)).alias("entry"))


# --- tracing ----------------------------------------------------------------------------------------------------------

COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
PIECE = ("conv_id long, chunk long, blank long, duplicate long, truncated long, illegal long, cost long, first_initial int, last_initial int, "
         "first_turn long, last_turn long, turns long, audit string, body string")
_PIECE_TYPES = [("conv_id", pa.int64()), ("chunk", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("first_initial", pa.int32()), ("last_initial", pa.int32()),
                ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("audit", pa.string()), ("body", pa.string())]


def traced(codes: list[int], copies: list[int], right: tuple[int, ...], state: int, is_last: bool) -> Iterator[tuple[int, str, int, tuple[str, ...], str, int]]:
    """Row, audit, cost, inserted roles, edit of the row (empty where the conversation ends) and the state after it."""
    after = vectors(codes, right)
    for k, (code, n) in enumerate(zip(codes, copies, strict=True)):
        audit, cost, inserted, edit, state = edits(after[k], code, state)
        more = max(n - 1, 0)  # copies of a row are duplicates or, like it, blank
        yield k, audit + "D" * more, cost + DELETE * more, inserted, edit, state
    if is_last and (roles := last_inserts(state)):
        yield len(codes), "I" * len(roles), INSERT * len(roles), tuple(roles), "", state


def new_turns(row: dict) -> Iterator[tuple[str, str]]:
    """Roles and texts of a chunk's repaired turns."""
    for k, _, _, inserted, edit, state in traced(row["code"], row["copies"], tuple(row["right"]), row["entry"], row["next"] is None):
        for r in inserted:
            yield r, ""
        if edit in ("K", "R"):
            yield (row["role"][k] if edit == "K" else ROLE[state]), row["text"][k]


def piece(row: dict) -> dict:
    codes, copies = row["code"], row["copies"]
    steps = list(traced(codes, copies, tuple(row["right"]), row["entry"], row["next"] is None))
    n = dict.fromkeys(COUNTS, 0)
    letters, turns = [], []
    for code, c, turn in zip(codes, copies, row["turn"], strict=True):
        fault = code // 4
        if fault == ABSENT:
            continue
        n["blank"] += c * (fault == BLANK)
        n["duplicate"] += c if fault == DUPLICATE else (c - 1) * (fault in (CLEAN, CUT_OFF))
        n["truncated"] += fault == CUT_OFF
        n["illegal"] += c - 1
        letters.append(code % 4)
        turns.append(turn)
    n["illegal"] += sum(p not in LEGAL for p in zip(letters, letters[1:]))  # noqa: B905
    n["cost"] = sum(s[2] for s in steps)
    numbered = [t for t in turns if t is not None]
    lines = [f"{r}:{t}" for r, t in new_turns(row)]
    return {
        "conv_id": row["conv_id"], "chunk": row["chunk"], **n, "first_initial": letters[0] if letters else None, "last_initial": letters[-1] if letters else None,
        "first_turn": numbered[0] if numbered else None, "last_turn": numbered[-1] if numbered else None, "turns": len(set(numbered)),
        "audit": "".join(s[1] for s in steps), "body": "\n".join(lines) if lines else None}


def _piece_dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(0, b.num_rows, 64):
            yield from map(piece, b.slice(i, 64).to_pylist())
        C.trim()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in _piece_dicts(batches):
        yield pa.RecordBatch.from_pylist([p], pa.schema(_PIECE_TYPES))


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT = pa.schema([(c, pa.int64()) for c in ("conv_id", "gaps", *COUNTS)] + [("audit", pa.string()), ("repaired_sha256", pa.string())])


class _Whole:
    """Sums up the pieces of one conversation in order."""

    def __init__(self, conv_id: int):
        self.conv_id, self.n, self.audit, self.sha, self.lines = conv_id, dict.fromkeys(COUNTS, 0), [], hashlib.sha256(), False
        self.initial = self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, p: dict) -> None:
        for c in COUNTS:
            self.n[c] += p[c]
        if p["first_initial"] is not None:
            self.n["illegal"] += self.initial is not None and (self.initial, p["first_initial"]) not in LEGAL
            self.initial = p["last_initial"]
        if p["first_turn"] is not None:
            self.turns += p["turns"] - (self.last_turn == p["first_turn"])
            self.first_turn = p["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = p["last_turn"]
        self.audit.append(p["audit"])
        if p["body"] is not None:
            self.sha.update(("\n" if self.lines else "").encode() + p["body"].encode())
            self.lines = True

    def row(self) -> dict:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, **self.n, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def _whole(pieces: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    open_, rows = None, []
    for p in pieces:
        if open_ is None or open_.conv_id != p["conv_id"]:
            if open_ is not None:
                rows.append(open_.row())
            open_ = _Whole(p["conv_id"])
        open_.add(p)
        if len(rows) >= 500:
            yield pa.RecordBatch.from_pylist(rows, _RESULT)
            rows = []
    if open_ is not None:
        rows.append(open_.row())
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _RESULT)


def _ready(all_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with ``right`` and ``entry``: those that are a whole conversation, and the others."""
    end = F.array(*[F.lit(x).cast("long") for x in END])
    single = all_chunks.filter("next is null and prev is null").withColumns({"right": end, "entry": F.lit(E)})
    several = all_chunks.filter("next is not null or prev is not null").join(stitched(all_chunks), "chunk")
    return single, several.select(single.columns)


def repairs(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, counts of faults, cost, audit and repaired_sha256 of every conversation of ``plain`` or ``damaged`` rows."""
    single, several = _ready(chunks(rows))
    whole = single.mapInArrow(lambda it: _whole(_piece_dicts(it)), RESULT)
    dealt = several.mapInArrow(_pieces, PIECE).repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    pieced = dealt.mapInArrow(lambda it: _whole(p for b in it for p in b.to_pylist()), RESULT)
    return whole.unionByName(pieced).withColumn("conv_id", C.null_id("conv_id"))


def _turn_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            got = list(new_turns(row))
            yield pa.RecordBatch.from_pydict({
                "conv_id": pa.array([row["conv_id"]] * len(got), pa.int64()), "chunk": pa.array([row["chunk"]] * len(got), pa.int64()), "place": pa.array(range(len(got)), pa.int32()),
                "role": pa.array([r for r, _ in got], pa.string()), "text": pa.array([t for _, t in got], pa.string())})


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, chunk, place, role, text of the repaired conversations; (chunk, place) gives the order."""
    single, several = _ready(chunks(rows))
    schema = "conv_id long, chunk long, place int, role string, text string"
    return single.unionByName(several).mapInArrow(_turn_rows, schema).withColumn("conv_id", C.null_id("conv_id"))
