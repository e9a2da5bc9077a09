"""Language-model scoring: a bigram model with Katz backoff.

Counts are gathered from all training documents into tables that are
partitioned by ranges of word hashes: unigrams by word, bigrams by context, so
that a context's backoff weight comes from one partition exactly.  Good-Turing
discounts count up to CUT; larger counts stay whole.  What a context's
discounts set free is shared among the words that it never preceded, in
proportion to their unigram probabilities, which are discounted likewise and
leave the rest to one unknown word.  Every distribution sums to one.

A token is scored recursively: by its bigram where the training text has it,
else by the context's weight times its unigram, else by the unknown word's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.llm import exchange
from curalith.llm.text import crc32_mod

#: Counts up to this are discounted.
CUT = 5
BEGIN, END = b" begin", b" end"  # no word holds a space
#: Low bits of the following word's hash that the tables drop; within a context 48 bits tell words apart.
DROP = np.uint64(16)


def discounts(of_count: np.ndarray) -> np.ndarray:
    """Good-Turing factors d[0..CUT] (d[0] unused) from the numbers n[1..CUT + 1] of types that occur so often.

    Where the counts of counts are too few to give a factor in (0, 1], the
    absolute discount n1 / (n1 + 2 n2) of one occurrence serves.
    """
    n = of_count.astype(float)
    d = np.ones(CUT + 1)
    some = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    tail = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        turing = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        good = (turing - tail) / (1 - tail) if tail < 1 else 0.0
        d[r] = good if 0 < good <= 1 else (r - some) / r if 0 < some < 1 else (r - 0.5) / r
    return d


def counts_of_counts(r: np.ndarray) -> np.ndarray:
    """n[0..CUT + 1]; n[0] unused."""
    out = np.bincount(r[(r > 0) & (r <= CUT + 1)].astype(np.int64), minlength=CUT + 2)
    out[0] = 0
    return out


class Unigrams:
    """P(word) from its count: discounted if it occurs, else the rest, which is one unknown word's."""

    def __init__(self, tokens: int, types: int, of_count: np.ndarray):
        self.tokens, self.types = tokens, types
        self.d = discounts(of_count)
        held = float(tokens - sum(of_count[r] * r * (1 - self.d[r]) for r in range(1, CUT + 1)))
        self.scale = tokens / (tokens + 1.0) if held >= tokens else 1.0  # nothing discounted: the unknown word gets one count
        self.unknown = 1.0 - held / tokens * self.scale if tokens else 1.0

    def p(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(float)
        seen = c * np.append(self.d, 1.0)[np.minimum(counts, CUT + 1).astype(np.int64)] / max(self.tokens, 1) * self.scale
        return np.where(counts > 0, seen, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the add-one unigram probability."""
        return np.log10((counts + 1.0) / (self.tokens + self.types + 1.0))


class Group:
    """The words of a group of documents, numbered in the order of their hashes."""

    def __init__(self, ids: list, data: list[bytes], folds: int, held: int):
        words = [t.lower().split() for t in data]
        flat = [BEGIN, END, *[w for own in words for w in own]]
        unique = list(dict.fromkeys(flat))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, unique), np.uint64, len(unique))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.hashes = hashes[order]
        number = dict(zip(unique, rank.tolist(), strict=True))
        tokens = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        begin, end = tokens[:2]
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.held = np.array([crc32_mod(i, folds) == held for i in ids], bool)
        # each document's tokens are its words and an end; each token's context is the one before it, a begin at first
        n = self.lengths + 1
        self.doc = np.repeat(np.arange(len(words)), n)
        ends = np.cumsum(n) - 1
        self.token = np.empty(int(n.sum()), np.int64)
        inner = np.ones(len(self.token), bool)
        inner[ends] = False
        self.token[inner], self.token[ends] = tokens[2:], end
        self.context = np.roll(self.token, 1)
        self.context[ends - n + 1] = begin
        self.train = ~self.held[self.doc]
        self.begin = begin

    def bigrams(self):
        """(code of each distinct bigram = context * words + token, its training count, the bigram of each token)."""
        code = self.context * len(self.hashes) + self.token
        known, place = np.unique(code, return_inverse=True)
        return known, np.bincount(place, weights=self.train, minlength=len(known)).astype(np.int64), place


def score(docs: DataFrame, *, folds: int = 7, held: int = 2, group_bytes: int = exchange.GROUP_BYTES * 7 // 4) -> DataFrame:
    """Score every whole text under the model of the documents with crc32(doc_id) % folds != held.

    Returns one row per row of ``docs``: doc_id, held_out, n_tokens (words and
    one end), n_known (tokens that training has), train_tokens, base_score
    (add-one unigrams) and score, both log10 probabilities of the whole text.
    A null or empty text is one end.  Without training tokens every token is
    the unknown word, and score is 0.  A context's bigrams meet in one task,
    each at most once for each group: its size follows the vocabulary, not the
    number of the context's occurrences.
    """
    groups = exchange.group_count(docs, group_bytes)
    dealt = exchange.grouped(docs, groups)
    spark = docs.sparkSession

    def ask_words(grp: int, ids: list, data: list[bytes]) -> Iterable[tuple[int, bytes]]:
        g = Group(ids, data, folds, held)
        counts = np.bincount(g.token, weights=g.train, minlength=len(g.hashes)).astype(np.int64)
        for b, s in exchange.by_bucket(g.hashes, groups):
            yield b, exchange.pack(exchange.pack_sorted(g.hashes[s]), counts[s].astype(np.uint32))

    def tell_words(bucket: int, asked: list[tuple[int, bytes]]) -> Iterable[tuple[int, bytes]]:
        parts = [exchange.unpack(blob) for _, blob in asked]
        known, place = np.unique(np.concatenate([exchange.unpack_sorted(p[0]) for p in parts]), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([p[1] for p in parts]), minlength=len(known)).astype(np.int64)
        yield -1, exchange.pack(np.concatenate([[total.sum(), (total > 0).sum()], counts_of_counts(total)[1:]]).astype(np.int64))
        at = 0
        for (g, _), p in zip(asked, parts, strict=True):
            yield g, exchange.pack(total[place[at : at + len(p[1])]])
            at += len(p[1])

    def unigrams_of(blob: bytes) -> Unigrams:
        tokens, types, *counts = exchange.unpack(blob)[0].tolist()
        return Unigrams(tokens, types, np.array([0, *counts]))

    def ask_bigrams(grp: int, ids: list, data: list[bytes], answers: list[tuple[int, bytes]]) -> Iterable[tuple[int, bytes]]:
        g = Group(ids, data, folds, held)
        summary = next(blob for b, blob in answers if b == -1)
        counts = np.concatenate([exchange.unpack(blob)[0] for b, blob in answers if b >= 0])
        code, own, _ = g.bigrams()
        context, token = np.divmod(code, len(g.hashes))
        for b, s in exchange.by_bucket(g.hashes[context], groups):
            lead = np.flatnonzero(np.diff(context[s], prepend=-1))
            sizes = np.diff(np.append(lead, s.stop - s.start))
            following = np.ascontiguousarray((g.hashes[token[s]] >> DROP).view(np.uint8).reshape(-1, 8).T[:6])
            yield b, exchange.pack("bigrams", exchange.pack_sorted(g.hashes[context[s]][lead]), sizes.astype(np.uint32), following, exchange.planes(own[s]), exchange.planes(counts[token[s]]))
        yield grp % groups, exchange.pack("own", counts, summary)

    def tell_bigrams(bucket: int, asked: list[tuple[int, bytes]]) -> Iterable[tuple[int, bytes]]:
        parts, owners, unigrams = [], [], None
        for g, blob in asked:
            if g < 0:
                unigrams = unigrams_of(blob)
                continue
            kind, *rest = exchange.unpack(blob)
            if kind == "own":
                yield g, blob
            else:
                parts.append(rest)
                owners.append(g)
        if not parts:
            return
        contexts = [exchange.unpack_sorted(p[0]) for p in parts]
        known, context_place = np.unique(np.concatenate(contexts), return_inverse=True)
        context = np.repeat(context_place, np.concatenate([p[1] for p in parts]))
        following = np.concatenate([np.ascontiguousarray(np.vstack([p[2], np.zeros((2, p[2].shape[1]), np.uint8)]).T).view(np.uint64).ravel() for p in parts])
        own, word_count = (np.concatenate([exchange.unplanes(p[k]) for p in parts]).astype(np.int64) for k in (3, 4))
        order = np.lexsort((following, context))
        starts = np.ones(len(order), bool)
        starts[1:] = (np.diff(context[order]) != 0) | (np.diff(following[order]) != 0)
        lead = np.flatnonzero(starts)
        total = np.add.reduceat(own[order], lead)
        r = np.empty(len(order), np.int64)
        r[order] = total[np.cumsum(starts) - 1]
        yield -1, exchange.pack(counts_of_counts(total)[1:].astype(np.int64))
        run_context, seen = context[order][lead], total > 0
        table = np.zeros((CUT + 2, len(known)))
        for c in range(1, CUT + 1):
            table[c] = np.bincount(run_context[total == c], minlength=len(known))
        table[CUT + 1] = np.bincount(run_context[total > CUT], weights=total[total > CUT], minlength=len(known))
        table[0] = np.bincount(run_context[seen], weights=unigrams.p(word_count[order][lead][seen]), minlength=len(known))
        at = context_at = 0
        for g, p, c in zip(owners, parts, contexts, strict=True):
            rows = context_place[context_at : context_at + len(c)]
            n = p[3].shape[1]
            yield g, exchange.pack("told", exchange.planes(r[at : at + n]), np.ascontiguousarray(table[0, rows]), table[1:, rows].astype(np.uint32))
            at += n
            context_at += len(c)

    def last(grp: int, rows: pa.Table, ids: list, data: list[bytes], answers: list[tuple[int, bytes]]) -> pa.Table:
        g = Group(ids, data, folds, held)
        of_count, told, counts, unigrams = np.zeros(CUT + 2, np.int64), [], None, None
        for b, blob in answers:
            if b == -1:
                of_count = np.append(0, exchange.unpack(blob)[0][: CUT + 1])
                continue
            kind, *rest = exchange.unpack(blob)
            if kind == "own":
                counts, unigrams = rest[0], unigrams_of(rest[1])
            else:
                told.append(rest)
        code, _, place = g.bigrams()
        context, token = np.divmod(code, len(g.hashes))
        r = np.concatenate([exchange.unplanes(t[0]) for t in told]).astype(np.int64)
        below = np.concatenate([t[1] for t in told])
        table = np.concatenate([t[2] for t in told], axis=1).astype(float)
        d = discounts(of_count)
        factor = np.append(d, 1.0)
        times = np.append(np.arange(1, CUT + 1), 1.0)
        weight = table * times[:, None]
        whole = weight.sum(axis=0)  # the context's occurrences
        mass = (weight * np.append(d[1:], 1.0)[:, None]).sum(axis=0)
        scale = np.where(mass >= whole, whole / (whole + 1.0), 1.0)  # nothing discounted: one count is set free
        free = np.where(whole > 0, 1.0 - mass * scale / np.maximum(whole, 1.0), 1.0)
        backoff = free / np.maximum(1.0 - below, 1e-300)
        which = np.cumsum(np.diff(context, prepend=-1) != 0) - 1
        seen = r * factor[np.minimum(r, CUT + 1)] * scale[which] / np.maximum(whole[which], 1.0)
        p = np.where(r > 0, seen, backoff[which] * unigrams.p(counts[token]))
        n = len(ids)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "held_out": pa.array(g.held.tolist(), pa.bool_()),
                "n_tokens": pa.array(g.lengths + 1, pa.int64()),
                "n_known": pa.array(np.bincount(g.doc, weights=counts[g.token] > 0, minlength=n).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, unigrams.tokens, np.int64)),
                "base_score": pa.array(np.bincount(g.doc, weights=unigrams.base(counts)[g.token], minlength=n)),
                "score": pa.array(np.bincount(g.doc, weights=np.log10(p)[place], minlength=n)),
            }
        )

    def sums(told: DataFrame) -> DataFrame:
        """One row (blob): the sums of all buckets' summaries, which are a few numbers each."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([exchange.unpack(x)[0].tolist() for x in b.column(0).to_pylist()], pa.list_(pa.int64()))], names=["n"])

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([exchange.pack(np.array(x, np.int64)) for x in b.column(0).to_pylist()], pa.binary())], names=["blob"])

        numbers = told.where(F.col("grp") < 0).select("blob").mapInArrow(read, "n array<bigint>")
        return numbers.agg(F.array(*[F.coalesce(F.sum(F.get("n", F.lit(k))), F.lit(0)) for k in range(CUT + 3)]).alias("n")).mapInArrow(write, "blob binary")

    def to_all(one: DataFrame, key: str) -> DataFrame:
        """The one row for every group or bucket."""
        other = "bucket" if key == "grp" else "grp"
        return spark.range(groups).select(F.col("id").cast("int").alias(key), F.lit(-1).alias(other)).crossJoin(F.broadcast(one)).select("grp", "bucket", "blob")

    told = exchange.answer(exchange.ask(dealt, ask_words), tell_words)
    word_sums = sums(told)
    words = told.where(F.col("grp") >= 0).unionByName(to_all(word_sums, "grp"))
    asked = exchange.ask_again(dealt, words, ask_bigrams)
    told_bigrams = exchange.answer(asked.unionByName(to_all(word_sums, "bucket")), tell_bigrams)
    bigrams = told_bigrams.where(F.col("grp") >= 0).unionByName(to_all(sums(told_bigrams), "grp"))
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return exchange.finish(dealt, bigrams, last, schema)
