"""N-gram Jaccard join with token-combination prefixes.

A document's set holds its distinct shingles.  Sets that are equal are joined
by their hash and stand as one from there on.  All tokens have one order, by
document frequency and then by hash.  Two sets of Jaccard similarity s or more
share their smallest common token within prefixes of n - ceil(s n) + 1 tokens
each.  If that token is rare, it is the key.  If it is frequent, all common
tokens are; prefixes extended to the K smallest common tokens then hold, by
counting the tokens that aren't common, two successive common tokens with at
most GAP others between them in both sets, and such pairs of frequent tokens
are the keys.  A set of any size has keys in proportion to its size.  Every
pair that shares a key and whose sizes fit is verified on the whole sets,
unless both are known to be in one component already.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalith.llm import exchange
from curalith.llm.components import Tables, connected
from curalith.llm.text import GOLDEN, mix

#: Rows without an id are nodes by their text, numbered from here; real ids lie below.
NO_ID = (1 << 63) - (1 << 48)
#: Tokens in more sets than this are frequent.
FREQUENT = 32
#: Members of a key whose pairs are all candidates from the start.
SHORT_LIST = 4
#: The last round compares all that is left if that is at most so many comparisons for each of the keys' members.
LAST_ROUND = 256
#: 64-bit words of the bitmap in which every token of a set flips one bit.
WORDS = 8


def common(total: int, percent: int) -> int:
    """Tokens that two sets of ``total`` tokens together share at least if they link."""
    return -(-percent * total // (100 + percent))


@lru_cache(maxsize=None)
def gap(percent: int) -> int:
    """The least gap at which sets that may link, but aren't equal, have enough common tokens for extended()."""
    for g in range(100):
        if all((total - 2 * (o := common(total, percent))) // (g + 1) + 2 <= o for total in range(2, 4000) if total > 2 * common(total, percent) and common(total, percent) > 0):
            return g
    raise ValueError(percent)


@lru_cache(maxsize=100_000)
def extended(n: int, percent: int) -> int:
    """Tokens of a set's prefix that holds the K smallest common tokens of any pair that links.

    With D tokens that aren't common in both sets together, K = D // (gap + 1)
    + 2 common tokens have K - 1 gaps between them, one of which has at most
    ``gap`` others in both sets.
    """
    low, high, g = -(-percent * n // 100), 100 * n // percent, gap(percent)
    found = 0
    for m in {*range(low, min(low + 2 * (g + 2) + 20, high) + 1), high}:  # the bound falls with m but for rounding
        o = common(n + m, percent)
        found = max(found, n - o + (n + m - 2 * o) // (g + 1) + 2)
    return min(n, found)


def shingle_sets(data: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles of ``width`` words, hashed and ascending; fewer words count as one shingle."""
    words = [t.lower().split() for t in data]
    flat = [w for own in words for w in own]
    unique = list(dict.fromkeys(flat))
    number = dict(zip(unique, map(xxhash.xxh3_64_intdigest, unique), strict=True))
    h = np.fromiter(map(number.__getitem__, flat), np.uint64, len(flat))
    whole = np.empty(0, np.uint64)
    if len(h) >= width:
        whole = mix(h[: len(h) - width + 1])
        for j in range(1, width):
            whole = mix(whole * GOLDEN + h[j : len(h) - width + 1 + j])
    out, at = [], 0
    for own in words:
        n = len(own)
        if n >= width:
            out.append(np.unique(whole[at : at + n - width + 1]))
        elif n:
            one = np.uint64(n)
            for x in h[at : at + n]:
                one = mix(np.array([one], np.uint64) * GOLDEN + x)[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]), ">u8").astype(np.uint64).reshape(-1, 2)


def _least(sizes: np.ndarray | int, percent: int):
    """ceil(percent / 100 * size): tokens that a set shares at least with any set that it links to."""
    return (sizes * percent + 99) // 100


def _node(docs: DataFrame) -> Column:
    """A row's node: its id, or a number from its text where it has none."""
    return F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID) + F.xxhash64(docs["text"]).bitwiseAND(F.lit((1 << 48) - 1)))


def _tables(docs: DataFrame, width: int, percent: int, group_bytes: int) -> DataFrame:
    """A blob for each group: every row's (node, size, representative), the sets that have keys, and their keys."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    shift = np.uint64(64 - min(64, max(40, math.ceil(math.log2(total + 2)) + 8)))
    dealt = exchange.grouped(docs.select(_node(docs).alias("doc_id"), "text"), groups)
    skip = gap(percent)

    def numbered(ids: list) -> np.ndarray:
        return np.array(ids, np.int64)

    def signed(ids: list, sets: list[np.ndarray]):
        """(rows with a token, their distinct signatures in order, the signature of each row)."""
        full = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
        marks = _signatures([sets[k] for k in full.tolist()])
        order = np.lexsort((marks[:, 1], marks[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(marks[order, 0]) != 0) | (np.diff(marks[order, 1]) != 0)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return full, marks[order][new], which

    def ask_sets(grp: int, ids: list, data: list[bytes]) -> Iterable[tuple[int, bytes]]:
        full, marks, which = signed(ids, sets := shingle_sets(data, width))
        least = np.full(len(marks), np.iinfo(np.int64).max, np.int64)
        np.minimum.at(least, which, numbered(ids)[full])
        for b, s in exchange.by_bucket(marks[:, 0], groups):
            yield b, exchange.pack(marks[s], least[s])

    def tell_sets(bucket: int, asked: list[tuple[int, bytes]]) -> Iterable[tuple[int, bytes]]:
        parts = [exchange.unpack(blob) for _, blob in asked]
        marks, least = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.lexsort((least, marks[:, 1], marks[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(marks[order, 0]) != 0) | (np.diff(marks[order, 1]) != 0)
        out = np.empty(len(order), np.int64)
        out[order] = least[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        at = 0
        for (g, _), p in zip(asked, parts, strict=True):
            yield g, exchange.pack(out[at : at + len(p[1])])
            at += len(p[1])

    def represented(ids: list, sets: list[np.ndarray], answers: list[np.ndarray]):
        """(representative of each row, rows whose sets this group speaks for: one for each set whose representative is here)."""
        full, marks, which = signed(ids, sets)
        own = numbered(ids)
        rep = own.copy()
        if len(full):
            rep[full] = np.concatenate(answers)[which]
        lead: dict[int, int] = {}
        for k, w in zip(full.tolist(), which.tolist(), strict=True):
            if own[k] == rep[k]:
                lead.setdefault(w, k)
        return rep, sorted(lead.values())

    def tokens_of(sets: list[np.ndarray], rows: list[int]):
        cat = np.concatenate([sets[k] for k in rows]) if rows else np.empty(0, np.uint64)
        return cat, *np.unique(cat >> shift, return_inverse=True, return_counts=True)

    def ask_tokens(grp: int, ids: list, data: list[bytes], answers: list[tuple[int, bytes]]) -> Iterable[tuple[int, bytes]]:
        sets = shingle_sets(data, width)
        told = [exchange.unpack(blob)[0] for _, blob in answers]
        _, rows = represented(ids, sets, told)
        _, known, _, counts = tokens_of(sets, rows)
        for b, s in exchange.by_bucket(known << shift, groups):
            yield b, exchange.pack("tokens", exchange.pack_sorted(known[s]), np.minimum(counts[s], 255).astype(np.uint8))
        yield grp % groups, exchange.pack("own", told)

    def tell_tokens(bucket: int, asked: list[tuple[int, bytes]]) -> Iterable[tuple[int, bytes]]:
        parts, owners = [], []
        for g, blob in asked:
            kind, *rest = exchange.unpack(blob)
            if kind == "own":
                yield g, blob
            else:
                parts.append((exchange.unpack_sorted(rest[0]), rest[1]))
                owners.append(g)
        if parts:
            known, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([p[1] for p in parts]), minlength=len(known))
            clipped, at = np.minimum(total, 255).astype(np.uint8), 0
            for g, p in zip(owners, parts, strict=True):
                yield g, exchange.pack("frequency", clipped[place[at : at + len(p[0])]])
                at += len(p[0])

    def ask_keys(grp: int, ids: list, data: list[bytes], answers: list[tuple[int, bytes]]) -> Iterable[tuple[int, bytes]]:
        sets = shingle_sets(data, width)
        told, frequency = [], [np.empty(0, np.uint8)]
        for _, blob in answers:
            kind, value = exchange.unpack(blob)
            if kind == "own":
                told = value
            else:
                frequency.append(value)
        own = numbered(ids)
        rep, rows = represented(ids, sets, told)
        cat, _, place, _ = tokens_of(sets, rows)
        df = np.concatenate(frequency)[place].astype(np.int64)
        sizes = np.array([len(sets[k]) for k in rows], np.int64)
        begin = np.cumsum(sizes) - sizes
        alone = np.add.reduceat(df == 1, begin).astype(np.int64) if len(rows) else sizes
        prefix = sizes - _least(sizes, percent) + 1
        keys, members, kept = [], [], []
        # without keys: sets whose prefix holds only tokens of their own, for their smallest common token lies beyond it
        for i in np.flatnonzero(alone < prefix).tolist():
            n = int(sizes[i])
            part = slice(begin[i], begin[i] + n)
            tokens, f = cat[part], df[part]
            order = np.lexsort((tokens, f))[: max(prefix[i], extended(n, percent))]
            tokens, f = tokens[order], f[order]
            first = f[: prefix[i]]
            found = [mix(tokens[: prefix[i]][(first > 1) & (first <= FREQUENT)])]
            often = tokens[f > FREQUENT]
            for d in range(1, skip + 2):
                found.append(mix(mix(often[:-d]) * GOLDEN + often[d:]))
            found = np.concatenate(found)
            if len(found):
                keys.append(found)
                members.append(np.full(len(found), len(kept), np.int32))
                kept.append(i)
        key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        member = np.concatenate(members) if keys else np.empty(0, np.int32)
        yield 0, exchange.pack(
            own, np.array([len(s) for s in sets], np.int64), rep,
            own[rows][kept] if kept else np.empty(0, np.int64), [sets[rows[i]].tobytes() for i in kept],
            key, member, sizes[kept] if kept else np.empty(0, np.int64), alone[kept] if kept else np.empty(0, np.int64),
        )

    tell1 = exchange.answer(exchange.ask(dealt, ask_sets), tell_sets)
    tell2 = exchange.answer(exchange.ask_again(dealt, tell1, ask_tokens), tell_tokens)
    return exchange.ask_again(dealt, tell2, ask_keys).select("blob")


def _unpacked(blobs: DataFrame, columns: str, take) -> DataFrame:
    """Rows made of each group's blob; ``take(parts)`` -> arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in columns.split(", ")]
        for b in batches:
            for blob in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else pa.array(x, pa.binary()) for x in take(exchange.unpack(blob))], names=names)

    return blobs.select("blob").mapInArrow(run, columns)


def _rows(blobs: DataFrame) -> DataFrame:
    return _unpacked(blobs, "doc bigint, size bigint, rep bigint", lambda p: p[:3])


def _sets(blobs: DataFrame) -> DataFrame:
    return _unpacked(blobs, "doc bigint, tokens binary", lambda p: p[3:5])


def _lists(blobs: DataFrame) -> DataFrame:
    """(key, doc, size, alone) of every key; ``alone`` counts the tokens that no other set has."""
    return _unpacked(blobs, "key bigint, doc bigint, size bigint, alone bigint", lambda p: [p[5].view(np.int64), p[3][p[6]], p[7][p[6]], p[8][p[6]]])


def _bitmaps(blobs: DataFrame) -> DataFrame:
    """(doc, bits): the parity of each set's tokens by their low bits; two sets differ in at least as many tokens as their bitmaps in bits."""

    def flipped(parts: list) -> list:
        raw = np.zeros((len(parts[4]), WORDS * 64), bool)
        for k, tokens in enumerate(parts[4]):
            raw[k] = np.bincount((np.frombuffer(tokens, np.uint64) & np.uint64(WORDS * 64 - 1)).astype(np.int64), minlength=WORDS * 64) & 1
        bits = np.packbits(raw, axis=1).view(np.int64)
        return [parts[3], *(np.ascontiguousarray(bits[:, w]) for w in range(WORDS))]

    words = [f"w{k}" for k in range(WORDS)]
    return _unpacked(blobs, "doc bigint, " + ", ".join(f"{w} bigint" for w in words), flipped)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")  # merges the two runs
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    with_a = pairs.distinct().join(sets.withColumnsRenamed({"doc": "a", "tokens": "x"}), "a")
    with_both = with_a.join(sets.withColumnsRenamed({"doc": "b", "tokens": "y"}), "b")
    return with_both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def linked(blobs: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """(node, component) of the representatives that any link touches.

    Two sets share at most the tokens that neither has alone, which their sizes
    and those counts decide beforehand; so of two sets that link one at least
    is central: at most (100 - percent) of (100 + percent) of its tokens are
    its own.  A key's members are ordered by that share.  Short lists meet in
    full at once; in a long one the most central set meets all others in the
    first round, which mostly brings a text's copies into one component.  Keys
    whose members are in one component, or whose central members have all met
    the others, are done.  Of the other keys, all members outside the largest
    component meet all others, if that is in proportion to the keys' members;
    else twice as many central members as before meet them, and so on.  In
    these rounds bitmaps of the sets rule out most pairs that don't link before
    the sets are compared.  No pair that may link is left out.
    """
    sets = _sets(blobs)
    central = (100 + percent) * F.col("alone") <= (100 - percent) * F.col("size")
    rank = F.struct((F.col("alone") / F.col("size")).alias("share"), F.col("doc").alias("doc"))
    listed = _lists(blobs).withColumn("rank", rank).withColumn("central", central)
    many = listed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    live = tables.put(listed.join(many, "key"))
    members = live.count()
    # an id that several rows with different sets repeat is linked with each set's representative
    rows = _rows(blobs)
    repeated = rows.groupBy("doc").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("doc")
    edges = rows.join(repeated, "doc").where("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    order = Window.partitionBy("key").orderBy("rank")

    def leading(known: DataFrame, low: int, high: int) -> DataFrame:
        """The central members at the places from low + 1 to high; a partial limit goes before the shuffle."""
        return known.where("central").withColumn("place", F.row_number().over(order)).where(F.col("place") <= high).where(F.col("place") > low).drop("place")

    def met(leads: DataFrame, known: DataFrame, once: Column | None = None) -> DataFrame:
        x, y = leads.alias("x"), known.alias("y")
        total = F.col("x.size") + F.col("y.size")
        both = F.least(F.col("x.size") - F.col("x.alone"), F.col("y.size") - F.col("y.alone"))
        fits = (both * (100 + percent) >= percent * total) & (100 * F.least("x.size", "y.size") >= percent * F.greatest("x.size", "y.size"))
        if "w0" in known.columns:
            apart = sum((F.bit_count(F.col(f"x.w{k}").bitwiseXOR(F.col(f"y.w{k}"))) for k in range(1, WORDS)), F.bit_count(F.col("x.w0").bitwiseXOR(F.col("y.w0"))))
            least = F.expr(f"({percent} * (x.size + y.size) + {99 + percent}) div {100 + percent}")
            fits = fits & (apart <= total - 2 * least)
        if once is None:
            once = F.col("x.rank") < F.col("y.rank")
        found = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & once & fits)
        return found.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))

    first = live.withColumn("component", F.col("doc"))
    short, long = first.where(F.col("many") <= SHORT_LIST), first.where(F.col("many") > SHORT_LIST)
    pairs = met(short.where("central"), short).unionByName(met(leading(long, 0, 1), long))
    labels = connected(_verified(pairs, sets, percent).unionByName(edges), tables)
    low, high = 1, 3
    while low:
        known = long.drop("component").join(labels, F.col("doc") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc")).drop("node")
        unmet = known.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count_if("central").alias("centres"), F.min(F.when(F.col("central"), F.col("size"))).alias("least")).where(f"c1 <> c2 and centres > {low}")
        may = F.col("central") | ((F.col("size") - F.col("alone")) * (100 + percent) >= percent * (F.col("size") + F.col("least")))
        known = known.join(unmet.select("key", "least"), "key").where(may).drop("least")
        known = tables.put(known.join(_bitmaps(blobs), "doc"))  # an id with several sets takes part with the bitmap of each
        per = known.groupBy("key", "component").count()
        largest = per.groupBy("key").agg(F.sum("count").alias("n"), F.max_by("component", F.struct("count", "component")).alias("top"), F.max("count").alias("most"))
        left = largest.agg(F.sum((F.col("n") - F.col("most")) * F.col("n"))).first()[0] or 0
        last = left <= LAST_ROUND * members
        if left:
            if last:  # whoever isn't in the key's largest component meets all others
                apart = known.join(largest.select("key", "top"), "key")
                once = (F.col("x.central") | F.col("y.central")) & ((F.col("y.component") == F.col("x.top")) | (F.col("x.rank") < F.col("y.rank")))
                pairs = met(apart.where("component <> top"), known, once)
            else:
                pairs = met(leading(known, low, high), known)
            new = connected(_verified(pairs, sets, percent).unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))), tables)
            tables.drop(labels)
            labels = new
        tables.drop(known)
        low, high = (0, 0) if last else (high, 2 * high + 1)
    tables.drop(live)
    return labels


def _labelled(docs: DataFrame, words: int, percent: int, group_bytes: int) -> DataFrame:
    """node, size and root (the node of the component) of every row."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be in (50, 100]")
    tables = Tables(docs.sparkSession)
    blobs = tables.put(_tables(docs, words, percent, group_bytes))
    labels = linked(blobs, percent, tables)
    rows = _rows(blobs)
    return rows.join(labels, rows["rep"] == labels["node"], "left").select(F.col("doc").alias("node"), "size", F.coalesce("component", "rep").alias("root"))


def join(docs: DataFrame, *, words: int = 5, percent: int = 80, group_bytes: int = exchange.GROUP_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id.

    Two documents link when 100 * |intersection| >= percent * |union| of their
    shingle sets; component_id is the smallest doc_id reachable over links.  A
    null or empty text, or one without words, has an empty set and links with
    nothing.  Rows that repeat a doc_id are one node.  A row without an id is a
    document of its own; its component_id is null where it reaches no id.
    """
    back = lambda c: F.when(F.col(c) < F.lit(NO_ID), F.col(c))
    return _labelled(docs, words, percent, group_bytes).select(back("node").alias("doc_id"), F.col("size").alias("n_shingles"), back("root").alias("component_id"))


def representatives(docs: DataFrame, *, words: int = 5, percent: int = 80, group_bytes: int = exchange.GROUP_BYTES) -> DataFrame:
    """The rows of ``docs`` that are their component's smallest document.

    A row without an id stays if its component holds no id and no other such
    row before it.  Of rows that repeat a kept id and its text one stays; rows
    that repeat the id with another text all stay.
    """
    found = _labelled(docs, words, percent, group_bytes)
    drop = found.where("root <> node").select("node").distinct()
    kept = docs.join(drop, _node(docs) == drop["node"], "left_anti")
    repeated = found.groupBy("node").count().where("count > 1").select("node")
    once = kept.join(repeated, _node(docs) == repeated["node"], "left_anti")
    twice = kept.join(repeated, _node(docs) == repeated["node"], "left_semi")
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    single = twice.groupBy(_node(docs).alias("id"), F.coalesce(docs["text"], F.lit("")).alias("body")).agg(F.any_value(whole).alias("whole")).select("whole.*")
    return once.unionByName(single)
