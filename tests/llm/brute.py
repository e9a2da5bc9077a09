"""The operators' contracts, said plainly in Python."""

import hashlib
import zlib
from collections import Counter

LAST = 1 << 63


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def key(i):
    return LAST if i is None else i


def line_dedup(rows, least=10):
    keyed = lambda t: [(x, x.strip(b" \t\n\x0b\x0c\r").lower()) for x in (t or "").encode().split(b"\n")]
    n = Counter(k for _, t in rows for k in {k for _, k in keyed(t) if k})
    out = []
    for i, t in rows:
        lines = keyed(t)
        kept = [x for x, k in lines if not (k and n[k] >= least)]
        out.append((i, len(lines), len(lines) - len(kept), sha(b"\n".join(kept))))
    return out


def covered(n, hits, width):
    out = [False] * n
    for x in hits:
        out[x : x + width] = [True] * width
    return out


def suffix_dedup(rows, width=50):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for x in range(len(b) - width + 1):
            w = b[x : x + width]
            least[w] = min(least.get(w, LAST + 1), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = covered(len(b), [x for x in range(len(b) - width + 1) if least[b[x : x + width]] < key(i)], width)
        spans = sum(g and not (x and gone[x - 1]) for x, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


def substring_dedup(rows, width=35):
    words = [(t or "").encode().split() for _, t in rows]
    n = Counter(tuple(w[x : x + width]) for w in words for x in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = covered(len(w), [x for x in range(len(w) - width + 1) if n[tuple(w[x : x + width])] > 1], width)
        out.append((i, len(w), sum(gone), sha(b" ".join(c for c, g in zip(w, gone, strict=True) if not g))))
    return out


def shingles(t, width=5):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[x : x + width]) for x in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def ngram_join(rows, percent=80):
    """Rows that repeat an id are one node; a row without an id is one by its text, and never names a component."""
    sets = [shingles(t) for _, t in rows]
    nodes = [(0, i, "") if i is not None else (1, 0, t or "") for i, t in rows]
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(nodes[a]), find(nodes[b])
                parent[max(x, y)] = min(x, y)
    roots = [find(n) for n in nodes]
    return [(i, len(s), None if r[0] else r[1]) for (i, _), s, r in zip(rows, sets, roots, strict=True)]


def fold(i, m):
    return zlib.crc32(b"null" if i is None else str(i).encode()) % m
