"""Ops 11 and 13: conversation repair and the prefix trie, against brute force."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import repair, tries

SCHEMA = "conv_id long, turn long, role string, text string"
EXTRA = ("chunk", "code", "copies", "n", "key", "part", "depth", "x", "next", "edge", "hit", "at")


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in EXTRA})


def first(x):
    return (x is not None, 0 if x is None else x)


# --- repair -----------------------------------------------------------------------------------------------------------


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x
        out += [(c, t, "user" if hit == 4 else r, x)] * {0: 0, 3: 2}.get(hit, 1)
    return out


def best(rows):
    """rows: (role, text, fault). Least (cost, audit) with the repaired lines, by plain recursion over (row, last initial)."""
    want = {"": ("u",), "s": ("u",), "u": ("a",), "a": ("u",)}
    roles = {"u": "user", "a": "assistant"}

    @functools.cache
    def go(k, last, inserts):
        found = []
        if k == len(rows):
            if last in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, fault = rows[k]
            c, a, t = go(k + 1, last, 0)
            found.append((c + 2, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] in want[last] or (role[:1] == "s" and last == ""):
                    c, a, t = go(k + 1, role[:1], 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}", *t)))
                for i in want[last]:
                    c, a, t = go(k + 1, i, 0)
                    found.append((c + 1 + more, "R" + a, (f"{roles[i]}:{text}", *t)))
        if inserts < 3:
            for i in want[last]:
                c, a, t = go(k, i, inserts + 1)
                found.append((c + 5, "I" + a, (f"{roles[i]}:", *t)))
        return min(found) if found else (10**9, "", ())

    return go(0, "", 0)


def brute_repairs(rows, ids):
    out = {}
    for c in ids:
        own = sorted(((t, r, x) for i, t, r, x in rows if i == c), key=lambda z: (first(z[0]), z[1], z[2]))
        seen, judged = set(), []
        for _, r, x in own:
            full = re.findall(r"[^\x20\x09-\x0D]", x)
            judged.append((r, x, "blank" if not full else "duplicate" if (r, x) in seen else "truncated" if full[-1] not in ".!?" else ""))
            seen.add((r, x))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, lines = best(tuple(judged))
        faults = [f for _, _, f in judged]
        out[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(judged)),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_rows(df):
    return {x.conv_id: tuple(x)[1:] for x in df.collect()}


def talk(r, n, most=9):
    texts = ["Yes.", "No!", "Well, it is so", "  ", "", "Why?\n", "a b.", "...", "ends with a space. ", "x"]
    out = []
    for c in range(n):
        for t in range(r.randint(1, most)):
            out.append((c, r.choice([t, t, t, None, r.randint(0, 6)]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), r.choice([*texts, None, f"Turn {t} of {c}."])))
    return out


@pytest.mark.parametrize("rows_a_chunk", [1, 2, 1024])
def test_repairs(spark, monkeypatch, rows_a_chunk):
    r = random.Random(rows_a_chunk)
    rows = talk(r, 60) + [(None, 1, "user", "Who?"), (None, None, "assistant", "I."), (None, 2, "assistant", "You."), (900, None, None, None)]
    monkeypatch.setattr(repair, "CHUNK_ROWS", rows_a_chunk)
    monkeypatch.setattr(repair, "PART_BYTES", 2000)
    got = as_rows(repair.repairs(repair.damaged(table(spark, rows))))
    assert got == brute_repairs(damaged(rows), {x[0] for x in rows})
    plain = as_rows(repair.repairs(repair.plain(table(spark, rows))))
    spaced = [(c, t, " " if a is None else a, " " if x is None else x) for c, t, a, x in rows]
    assert plain == brute_repairs(spaced, {x[0] for x in rows})


def test_one_conversation_holds_all_rows(spark, monkeypatch):
    """Chunks that are never of rank one: only user turns, whose roles alternate by place from the end."""
    rows = [(7, t, "user", f"Turn {t}.") for t in range(500)] + [(7, 600, "user", "Same.")] * 300 + [(8, 1, "user", "a."), (8, 2, "assistant", "b.")]
    monkeypatch.setattr(repair, "CHUNK_ROWS", 8)
    monkeypatch.setattr(repair, "PART_BYTES", 8000)
    got = as_rows(repair.repairs(repair.plain(table(spark, rows))))
    # of 501 different rows one goes, at best the first, and every other one changes its role
    assert got[7][1:] == (0, 299, 0, 799, 250 + 2 * 300, "D" + "KR" * 250 + "D" * 299, got[7][7])
    assert got[8] == brute_repairs(rows, {8})[8]
    turns = repair.repaired_turns(repair.plain(table(spark, rows))).orderBy("conv_id", "chunk", "place").collect()
    sha = hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in turns if x.conv_id == 7).encode()).hexdigest()
    assert sha == got[7][7]


def test_rank_one_chunks_settle_alone():
    clean = [1, 2] * 40  # user, assistant
    assert repair.transfer(clean)[1]
    only_user = [1] * 80
    assert not repair.transfer(only_user)[1]
    m, _ = repair.transfer(only_user)
    for right in (repair.END, (2, 5, 0, 2), (0, 0, 2, 0)):
        v = repair._least(repair.with_inserts(right))[0]
        by_transfer = repair._fitted(np.array([[min(m[4 * s + j] + v[j] for j in range(4)) for s in range(4)]]))[0]
        assert tuple(by_transfer) == repair.vectors(only_user, v)[-1]


def test_no_conversations(spark):
    assert repair.repairs(repair.damaged(table(spark, []))).collect() == []
    assert tries.conversation_trie(table(spark, [])).collect() == []


def test_very_long_turn(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "end."), (1, 1, "assistant", "Short."), (1, 2, "user", "Cut"), (2, 0, "system", "s.")]
    assert as_rows(repair.repairs(repair.plain(table(spark, rows)))) == brute_repairs(rows, {1, 2})


# --- trie -------------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = {}
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        d = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
        own.setdefault(c, []).append((first(t), d, (r, x)))
    own = {c: [z[2] for z in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        head = [] if c is None else own.get(c - c % 5, [])
        seq = tuple(head[:h] + turns[h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], ([], []))[0].append(c)
        nodes[seq][1].append(c)
    order = lambda c: -(2**63) if c is None else c
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    total = {}
    for p in sorted(nodes, key=len, reverse=True):
        below = [total[q] for q in children.get(p, [])]
        total[p] = (sum(x for x, _ in below) or 1, sum(y for _, y in below) + ((len(nodes[p][0]) - 1) * len(p[-1][1].encode()) if p else 0))
    least = {p: min(v[0], key=order) for p, v in nodes.items()}
    text = lambda v: ",".join("" if c is None else str(c) for c in sorted(v, key=order))
    return sorted(((least[p], len(p), least[p[:-1]] if p else None, len(v[0]), len(children.get(p, [])), *total[p], hashlib.sha256(text(v[1]).encode()).hexdigest())
                   for p, v in nodes.items()), key=str)


def trie(spark, rows):
    return sorted((tuple(x) for x in tries.conversation_trie(table(spark, rows)).collect()), key=str)


@pytest.mark.parametrize("nodes", [2, 5, 1 << 16])
def test_trie(spark, monkeypatch, nodes):
    r = random.Random(nodes)
    monkeypatch.setattr(tries, "SHARD_NODES", nodes)
    rows = []
    for c in r.sample(range(200), 80):
        for t in range(r.randint(1, 7)):
            rows.append((c, r.choice([t, t, None, 3]), r.choice(["user", "assistant", None]), r.choice(["a", "b", "ä", None, "long " * 9])))
    rows += [(None, t, "user", "a") for t in range(4)] + [(1000 + c, t, "user", "copy") for c in range(150) for t in range(5)] + rows[:9]
    assert trie(spark, rows) == brute_trie(rows)


def test_deep_trie(spark, monkeypatch):
    monkeypatch.setattr(tries, "SHARD_NODES", 300)
    rows = [(c, t, "user", f"{t}" if t < 250 + c else f"{c} {t}") for c in (0, 5, 10) for t in range(400)]
    assert trie(spark, rows) == brute_trie(rows)


def test_find_close():
    r = random.Random(3)
    for n in (1, 2, 63, 64, 65, 1000, 9000):
        is_open, depth, left = [], 0, n
        while left or depth:
            up = left and (not depth or r.random() < 0.55)
            is_open.append(bool(up))
            depth += 1 if up else -1
            left -= bool(up)
        stack, close = [], {}
        for i, o in enumerate(is_open):
            if o:
                stack.append(i)
            else:
                close[stack.pop()] = i
        a = np.array(is_open)
        tree, opens = tries.Parentheses(a), np.flatnonzero(a)
        assert tree.find_close(opens).tolist() == [close[i] for i in opens.tolist()]
        got = tree.leaves(opens, tree.find_close(opens)).tolist()
        assert got == [sum(is_open[i] and not is_open[i + 1] for i in range(o, close[o])) for o in opens.tolist()]
