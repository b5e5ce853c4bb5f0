"""Plain single-process versions of the operators, for small inputs."""

import hashlib
import re
import zlib

import xxhash

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def repeated_bytes(docs, least=50):
    """docs: (doc_id, text) with distinct ids. doc_id -> (n_bytes, n_removed, n_spans, sha)."""
    first, out = {}, {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        for s in range(len(b) - least + 1):
            first.setdefault(b[s : s + least], i)
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - least + 1):
            if first[b[s : s + least]] < i:
                gone[s : s + least] = b"\1" * least
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g)))
    return out


def repeated_words(docs, window=20):
    first, out = {}, {}
    for i, t in sorted(docs):
        w = WORDS.findall((t or "").encode())
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (i, s))
    for i, t in docs:
        w = WORDS.findall((t or "").encode())
        gone = bytearray(len(w))
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone[s : s + window] = b"\1" * window
        out[i] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def fingerprint(text, shingle=3):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = WORDS.findall(b)
    if not w:
        return 0
    grams = [b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))


def simhash_components(docs, bits=2):
    fps = [(i, fingerprint(t)) for i, t in docs]
    parent = {i: i for i, _ in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in fps:
        for b, y in fps:
            if a < b and (x ^ y).bit_count() <= bits:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (f"{f:016x}", root(i)) for i, f in fps}


def lines(docs, min_docs=10):
    strip, seen, out = "\x20\x09\x0a\x0b\x0c\x0d", {}, {}
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def key(x):
        return x.strip(strip).translate(upper)

    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            seen.setdefault(k, set()).add(i)
    for i, t in docs:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not key(x) or len(seen[key(x)]) < min_docs]
        out[i] = (len(ls), len(ls) - len(kept), sha("\n".join(kept).encode()))
    return out


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            row[j], diagonal = (diagonal + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]
