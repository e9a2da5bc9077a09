"""Substring dedup: suffix automata of reference shards and matching statistics.

The reference is the whole corpus, cut by repeats.py into segments and dealt
into shards by their anchors, so that a segment and all text that could match
it meet in one shard.  A shard's automaton takes in each distinct segment once,
weighted with its occurrences; then the segments stream through it, and where
the longest match reaches the threshold, the state that holds the last
``min_words`` words tells how often they occur.  An automaton is handed out to
the segments of its own shard only: the automata of all shards together grow
with the corpus, so sending them everywhere would have no bound.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.llm import exchange, repeats
from curalith.llm.text import mix, sha256_hex

#: Symbols that one automaton takes in at most, but for those of one anchor.
SHARD_SYMBOLS = 1 << 16


class SuffixAutomaton:
    """Suffix automaton of several weighted strings over any hashable symbols."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _clone(self, p: int, c, q: int) -> int:
        new = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, string: list, weight: int) -> None:
        last = 0
        for c in string:
            q = self.next[last].get(c)
            if q is not None:  # the prefix is known from another string
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                p = last
                while p != -1 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p != -1:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
                last = new
            self.count[last] += weight

    def close(self) -> None:
        """Occurrences of a state's strings: its own and those of all states that link to it."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def occurrences(self, string: list, size: int) -> list[int]:
        """For each run of ``size`` symbols of the string how often the automaton's strings hold it, 0 where the match is shorter."""
        follow, link, length, count = self.next, self.link, self.length, self.count
        state = matched = 0
        out = []
        for k, c in enumerate(string):
            while state and c not in follow[state]:
                state = link[state]
                matched = length[state]
            if c in follow[state]:
                state = follow[state][c]
                matched += 1
            if matched >= size:
                while length[link[state]] >= size:  # the state that holds the last `size` symbols; longer matches matter no more
                    state = link[state]
                    matched = length[state]
            if k >= size - 1:
                out.append(count[state] if matched >= size else 0)
        return out


def decide(entries: list[repeats.Entries], window: int) -> list[np.ndarray]:
    """For each group's windows whether they occur twice or more in the corpus."""
    segment, lead, begin, sizes, symbols, anchor, count = repeats.collapse(entries, window)
    weight = np.zeros(len(lead), np.int64)
    np.add.at(weight, segment, np.concatenate([e.weight for e in entries]))
    values: list[np.ndarray] = [np.full(int(n), min(2, v), np.int8) for n, v in zip(count[lead].tolist(), weight.tolist(), strict=True)]
    edges = np.flatnonzero(np.diff(anchor, prepend=anchor[:1] + np.uint64(1), append=anchor[-1:] + np.uint64(1)))
    batch: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal batch, held
        if batch:
            automaton = SuffixAutomaton()
            strings = [symbols[begin[lead[i]] : begin[lead[i]] + sizes[lead[i]]].tolist() for i in batch]
            for i, s in zip(batch, strings, strict=True):
                automaton.add(s, int(weight[i]))
            automaton.close()
            for i, s in zip(batch, strings, strict=True):
                if weight[i] < 2:
                    values[i] = np.minimum(automaton.occurrences(s, window), 2).astype(np.int8)
        batch, held = [], 0

    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1 and (weight[a:b] < 2).any():
            batch += range(a, b)
            held += int(sizes[lead[a:b]].sum())
            if held >= SHARD_SYMBOLS:
                flush()
    flush()
    return [v >= 2 for v in repeats.spread(values, segment, entries)]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, unchanged."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def dedup(docs: DataFrame, *, min_words: int = 35, anchor_words: int = 20, hot_groups: int = 1024, carry: bool = False, group_bytes: int = exchange.GROUP_BYTES) -> DataFrame:
    """Remove each word covered by a run of ``min_words`` words that also starts anywhere else.

    All occurrences go, the first too; runs never cross documents and are
    judged on the input.  Returns one row per row of ``docs``: doc_id, n_words,
    n_removed, kept_sha256 (kept words joined by one space) and spans
    (array<struct<start, end>>, word offsets); with ``carry`` the columns of
    ``docs`` instead, the text being the kept words.  A null or empty text has
    no words; rows that repeat one another are occurrences of their own.
    """
    if not 1 <= anchor_words <= min_words:
        raise ValueError("an anchor must fit into a repeated run")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    dealt = exchange.grouped(docs, groups, carry)
    answers, read = repeats.verdicts(
        dealt,
        groups,
        symbols=word_hashes,
        hashed=mix,
        window=min_words,
        k=anchor_words,
        bits=min(64, max(40, math.ceil(math.log2(total + 2)) + 8)),
        hot_groups=hot_groups,
        weigh=lambda ids, lead: np.diff(np.append(lead, len(ids))),
        decide=lambda entries: decide(entries, min_words),
        later_too=False,
    )

    def last(grp: int, rows: pa.Table, ids: list, data: list[bytes], got: list[tuple[int, bytes]]) -> pa.Table:
        words = [t.split() for t in data]
        covered = read(ids, [len(w) for w in words], got)
        kept: list[bytes] = []
        spans: list[list[dict]] = []
        removed: list[int] = []
        for own, cover in zip(words, covered, strict=True):
            if cover is None:
                kept.append(b" ".join(own))
                spans.append([])
                removed.append(0)
                continue
            kept.append(b" ".join([w for w, c in zip(own, cover.tolist(), strict=True) if not c]))
            edges = np.flatnonzero(np.diff(cover.astype(np.int8), prepend=0, append=0)).tolist()
            spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            removed.append(int(cover.sum()))
        if carry:
            return exchange.with_text(rows, kept)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_words": pa.array([len(w) for w in words], pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array([sha256_hex(k) for k in kept], pa.string()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
        )

    schema = docs.schema if carry else "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    return exchange.finish(dealt, answers, last, schema)
