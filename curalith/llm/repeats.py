"""Windows of symbols that repeat across a corpus: the part that byte and word dedup share.

A window is a run of ``window`` symbols of one document.  Each window has an
anchor, the leftmost of its k-grams with the smallest hash; equal windows have
equal anchors at equal places.  Consecutive windows mostly share their anchor:
an anchor and its windows make a *segment*, the stretch of symbols that these
windows cover.  Every window is in exactly one segment, so

1. groups of documents send the anchors' hashes, truncated; an anchor that
   occurs once in the corpus has no repeated window (a collision here only
   lets a segment through).  Least hashes crowd at the low end, about nine times
   as dense there as on average, so they are mixed anew before they are dealt;
2. segments of the other anchors go to the bucket that owns the anchor's
   hash, once for each group and content, with what their occurrences amount
   to; an index over the bucket's distinct segments decides each window;
3. the verdicts go back and every covered symbol is removed.

An anchor that very many groups hold would bring its bucket a segment of each
different neighbourhood, so its windows travel singly, dealt by their own hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from curalith.llm import exchange
from curalith.llm.text import mix

BASE = 0x9E3779B97F4A7C15 | 1
#: Symbols that are hashed at a time; a longer document goes in parts that overlap by a window.
CHUNK = 1 << 19
#: Low bits of a hash that give way to its place in a chunk; the same in chunks of all lengths, so equal windows have equal anchors everywhere.
PLACE_BITS = np.uint64(21)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            f = np.full(max(n, CHUNK + 4096), b, np.uint64)
            f[0] = 1
            _POWERS[k] = np.multiply.accumulate(f)
    return _POWERS[0][:n], _POWERS[1][:n]


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least of values[i : i + width], for each i with a whole window.

    Values (uint64) count by their leading bits; the place takes the others, so
    that one minimum decides both.
    """
    bits = PLACE_BITS
    if len(values) >> int(bits):
        raise ValueError("a chunk is longer than places can count")
    v = values >> bits << bits | np.arange(len(values), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        v = np.minimum(v[:-step], v[step:])
        have += step
    return (v & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


@dataclass
class Segments:
    """Segments of a chunk of documents, in order: the document, the first window's place, the number of windows, the anchor's place after it, the anchor's hash and the content's."""

    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    place: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def segments(symbols: np.ndarray, lengths: np.ndarray, window: int, k: int) -> Segments | None:
    """Segments of documents that lie behind one another in ``symbols`` (uint64); starts count from there."""
    n = len(symbols)
    if n < window:
        return None
    up, down = _powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * up[:n], dtype=np.uint64, out=prefix[1:])
    grams = mix((prefix[k:] - prefix[:-k]) * down[: n + 1 - k])
    anchor_of = least(grams, window - k + 1)
    ends = np.cumsum(lengths)
    tail = np.minimum(lengths, window - 1)  # places whose window would leave the document
    valid = np.ones(n, bool)
    valid[np.repeat(ends - np.cumsum(tail), tail) + np.arange(int(tail.sum()))] = False
    x = np.flatnonzero(valid[: len(anchor_of)])
    if len(x) == 0:
        return None
    a = anchor_of[x]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    start = x[first]
    count = np.diff(np.append(first, len(x)))
    size = count + window - 1
    place = a[first] - start
    return Segments(np.searchsorted(ends, start, "right"), start, count, place, _anchor(grams[a[first]]), _content(prefix, down, start, size, place))


def _anchor(gram: np.ndarray) -> np.ndarray:
    """The hash by which an anchor is known: one of equal chances over the whole range, unlike the least of many."""
    return mix(gram ^ np.uint64(BASE))


def _content(prefix: np.ndarray, down: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix((prefix[start + size] - prefix[start]) * down[start] ^ place.astype(np.uint64) * np.uint64(BASE) ^ size.astype(np.uint64))


def chunks(lengths: list[int], window: int) -> Iterable[list[tuple[int, int, int]]]:
    """Parts (document, from, to) that are hashed together: about CHUNK symbols, every window of a document in exactly one part."""
    batch: list[tuple[int, int, int]] = []
    total = 0
    for d, n in enumerate(lengths):
        for at in range(0, max(n - window + 1, 1), CHUNK):
            to = min(n, at + CHUNK + window - 1)
            if batch and total + to - at > CHUNK:
                yield batch
                batch, total = [], 0
            batch.append((d, at, to))
            total += to - at
    if batch:
        yield batch


def group_segments(docs: list[np.ndarray], hashed: Callable[[np.ndarray], np.ndarray], window: int, k: int) -> Segments:
    """Segments of a group's documents; starts count within the document."""
    parts: list[Segments] = []
    for batch in chunks([len(d) for d in docs], window):
        owner, origin, lengths = (np.array(x, np.int64) for x in zip(*[(d, a, b - a) for d, a, b in batch], strict=True))
        s = segments(hashed(np.concatenate([docs[d][a:b] for d, a, b in batch])), lengths, window, k)
        if s is not None:
            s.start = s.start - (np.cumsum(lengths) - lengths)[s.doc] + origin[s.doc]
            s.doc = owner[s.doc]
            parts.append(s)
    if not parts:
        return Segments(*[np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)])
    return Segments(*[np.concatenate([getattr(p, f) for p in parts]) for f in ("doc", "start", "windows", "place", "anchor", "content")])


@dataclass
class Entries:
    """What a bucket gets of a group: distinct segments with their symbols, and what their occurrences amount to (``weight``)."""

    anchor: np.ndarray
    content: np.ndarray
    windows: np.ndarray
    weight: np.ndarray
    symbols: np.ndarray  # of all segments, behind one another


#: Stands for the anchor's place where an entry is a window of its own.
SINGLE = 65_535


def received(windows: np.ndarray, place: np.ndarray, weight: np.ndarray, symbols: np.ndarray, hashed: Callable[[np.ndarray], np.ndarray], window: int, k: int) -> Entries:
    """Entries as they came, their hashes computed anew from the symbols: hashes don't compress, so they don't travel."""
    size = windows.astype(np.int64) + window - 1
    start = np.cumsum(size) - size
    values = hashed(symbols)
    up, down = _powers(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=prefix[1:])
    alone = place == SINGLE
    at = start + np.where(alone, 0, place)
    anchor = _anchor(mix((prefix[at + k] - prefix[at]) * down[at]))
    content = _content(prefix, down, start, size, place)
    single = mix((prefix[start + window] - prefix[start]) * down[start] ^ np.uint64(window))
    return Entries(np.where(alone, single, anchor), np.where(alone, single, content), windows, weight, symbols)


def window_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    up, down = _powers(len(symbols) + 1)
    prefix = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], dtype=np.uint64, out=prefix[1:])
    return mix((prefix[size:] - prefix[:-size]) * down[: len(symbols) + 1 - size] ^ np.uint64(size))


def bucket_count(groups: int) -> int:
    """A bucket for four groups, where there are many: each pair that talks costs a blob each way and time in its own right."""
    return min(groups, max(24, -(-groups // 4)))


def verdicts(
    docs: DataFrame,
    groups: int,
    *,
    symbols: Callable[[bytes], np.ndarray],
    hashed: Callable[[np.ndarray], np.ndarray],
    window: int,
    k: int,
    bits: int,
    hot_groups: int,
    weigh: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, Callable]],
    decide: Callable[[list[Entries]], list[np.ndarray]],
    later_too: bool,
) -> tuple[DataFrame, Callable[[list, list[tuple[int, bytes]]], list[np.ndarray]]]:
    """(blobs of answers by group, a function that turns a group's answers into the covered symbols of each document).

    ``weigh(ids of occurrences, first of each entry)`` -> a value for each
    entry.  ``decide(entries of each group)`` -> for each group, whether each
    window of its entries repeats elsewhere.  With ``later_too``, that is asked
    for an entry's smallest id only, and the group's larger ids repeat it anyway.
    """
    shift = np.uint64(64 - bits)
    buckets = bucket_count(groups)

    def found(data: list[bytes]):
        own = [symbols(t) for t in data]
        return own, group_segments(own, hashed, window, k)

    def first(grp: int, ids: list, data: list[bytes]) -> Iterable[tuple[int, bytes]]:
        _, s = found(data)
        keys, counts = np.unique(s.anchor >> shift, return_counts=True)
        for b, part in exchange.by_bucket(keys << shift, buckets):
            yield b, exchange.pack(exchange.pack_sorted(keys[part]), np.packbits(counts[part] > 1))

    def shared(bucket: int, asked: list[tuple[int, bytes]]) -> Iterable[tuple[int, bytes]]:
        parts = [exchange.unpack(blob) for _, blob in asked]
        keys = [exchange.unpack_sorted(p[0]) for p in parts]
        known, place, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        at = 0
        for (g, _), own, p in zip(asked, keys, parts, strict=True):
            many = n[place[at : at + len(own)]]
            at += len(own)
            hits = (many > 1) | np.unpackbits(p[1], count=len(own)).astype(bool)
            if hits.any():
                yield g, exchange.pack(exchange.pack_sorted(own[hits]), np.packbits(many[hits] > hot_groups))

    def flags(answers: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        keys, hot = [np.empty(0, np.uint64)], [np.empty(0, bool)]
        for _, blob in answers:
            planes, bit = exchange.unpack(blob)
            keys.append(exchange.unpack_sorted(planes))
            hot.append(np.unpackbits(bit, count=len(keys[-1])).astype(bool))
        return np.concatenate(keys), np.concatenate(hot)

    def second(grp: int, ids: list, data: list[bytes], answers: list[tuple[int, bytes]]) -> Iterable[tuple[int, bytes]]:
        known, hot = flags(answers)
        if len(known) == 0:
            return
        own, s = found(data)
        at = np.minimum(np.searchsorted(known, s.anchor >> shift), len(known) - 1)
        hit = known[at] == s.anchor >> shift
        is_hot = hit & hot[at]
        plain = np.flatnonzero(hit & ~is_hot)
        doc, start, count, place, anchor, content = (getattr(s, f)[plain] for f in ("doc", "start", "windows", "place", "anchor", "content"))
        single = np.flatnonzero(is_hot)
        if len(single):  # windows of their own
            reps = s.windows[single]
            inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            d, x = np.repeat(s.doc[single], reps), np.repeat(s.start[single], reps) + inner
            h = np.empty(len(d), np.uint64)
            for i in np.unique(d).tolist():
                mine = np.flatnonzero(d == i)
                for a in range(0, len(own[i]), CHUNK):
                    here = mine[(x[mine] >= a) & (x[mine] < a + CHUNK)]
                    if len(here):
                        h[here] = window_hashes(hashed(own[i][a : a + CHUNK + window - 1]), window)[x[here] - a]
            doc, start, count = np.concatenate([doc, d]), np.concatenate([start, x]), np.concatenate([count, np.ones(len(d), np.int64)])
            place, anchor, content = np.concatenate([place, np.full(len(d), SINGLE)]), np.concatenate([anchor, h]), np.concatenate([content, h])
        order = np.lexsort((content, anchor))
        doc, start, count, place, anchor, content = doc[order], start[order], count[order], place[order], anchor[order], content[order]
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(anchor) != 0) | (np.diff(content) != 0) | (np.diff(count) != 0)
        entry = np.cumsum(new) - 1
        lead = np.flatnonzero(new)
        id_of = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
        weight = weigh(id_of[doc], lead)
        for b, part in exchange.by_bucket(anchor[lead], buckets):
            e = lead[part]
            text = np.concatenate([own[i][x : x + n + window - 1] for i, x, n in zip(doc[e].tolist(), start[e].tolist(), count[e].tolist(), strict=True)])
            yield b, exchange.pack("entries", count[e].astype(np.uint16), place[e].astype(np.uint16), weight[part], text)
        # the way back: which segment of which document each entry stands for, echoed by a bucket of the group's own
        # the entries ascend by steps of one, so a bit tells each; a text in memory has less than 2**32 symbols
        yield grp % buckets, exchange.pack("places", exchange.planes(doc), exchange.planes(start), np.packbits(new), exchange.planes(count[lead]))

    def reply(bucket: int, asked: list[tuple[int, bytes]]) -> Iterable[tuple[int, bytes]]:
        entries, owners = [], []
        for g, blob in asked:
            kind, *rest = exchange.unpack(blob)
            if kind == "places":
                yield g, blob
            else:
                entries.append(received(*rest, hashed, window, k))
                owners.append(g)
        if entries:
            for g, hits in zip(owners, decide(entries), strict=True):
                yield g, exchange.pack("hits", np.packbits(hits), len(hits))

    def read(ids: list, lengths: list[int], answers: list[tuple[int, bytes]]) -> list[np.ndarray | None]:
        """For each document which of its symbols are covered, None where nothing is removed."""
        places, values = None, []
        for _, blob in answers:
            kind, *rest = exchange.unpack(blob)
            if kind == "places":
                places = rest
            else:
                values.append(np.unpackbits(rest[0], count=rest[1]).astype(bool))
        out: list[np.ndarray | None] = [None] * len(ids)
        if places is None or not values:
            return out
        doc, start, count = (exchange.unplanes(places[k]).astype(np.int64) for k in (0, 1, 3))
        entry = np.cumsum(np.unpackbits(places[2], count=len(doc)), dtype=np.int64) - 1
        value = np.concatenate(values)
        begin = np.cumsum(count) - count
        reps = count[entry]
        inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        d, x, v = np.repeat(doc, reps), np.repeat(start, reps) + inner, value[np.repeat(begin[entry], reps) + inner]
        id_of = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
        if later_too:
            least_id = np.full(len(count), np.iinfo(np.int64).max)
            np.minimum.at(least_id, entry, id_of[doc])
            v |= np.repeat(id_of[doc] > least_id[entry], reps)
        d, x = d[v], x[v]
        order = np.argsort(d, kind="stable")
        d, x = d[order], x[order]
        edges = np.flatnonzero(np.diff(d, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            i = int(d[a])
            cover = np.zeros(lengths[i] + 1, np.int32)
            np.add.at(cover, x[a:b], 1)
            np.subtract.at(cover, x[a:b] + window, 1)
            out[i] = np.cumsum(cover[:-1]) > 0
        return out

    asked = exchange.ask_again(docs, exchange.answer(exchange.ask(docs, first), shared), second)
    return exchange.answer(asked, reply), read


def collapse(entries: list[Entries], window: int):
    """Distinct segments of a bucket: (the segment of each entry, one entry of each segment, starts of symbols, their numbers, all symbols, anchors, windows).

    Entries of equal hashes are compared symbol by symbol with the one that
    stands for them; where hashes collide, contents are told apart in full.
    """
    anchor, content, count = (np.concatenate([getattr(e, f) for e in entries]) for f in ("anchor", "content", "windows"))
    symbols = np.concatenate([e.symbols for e in entries])
    sizes = count.astype(np.int64) + window - 1
    begin = np.cumsum(sizes) - sizes
    order = np.lexsort((count, content, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(anchor[order]) != 0) | (np.diff(content[order]) != 0) | (np.diff(count[order]) != 0)
    segment = np.empty(len(order), np.int64)
    segment[order] = np.cumsum(new) - 1
    lead = order[np.flatnonzero(new)]
    other = np.flatnonzero(lead[segment] != np.arange(len(order)))
    wrong = [i for part in _blocks(other, sizes) for i in part[_differ(symbols, begin[part], begin[lead[segment[part]]], sizes[part])].tolist()]
    if wrong:  # contents of equal hashes: each of its own becomes a segment
        known: dict[tuple[int, bytes], int] = {}
        leads = lead.tolist()
        for i in wrong:
            key = (int(segment[i]), symbols[begin[i] : begin[i] + sizes[i]].tobytes())
            if key not in known:
                known[key] = len(leads)
                leads.append(i)
            segment[i] = known[key]
        lead = np.array(leads, np.int64)
        place = np.argsort(anchor[lead], kind="stable")  # segments of one anchor stay together
        back = np.empty(len(place), np.int64)
        back[place] = np.arange(len(place))
        segment, lead = back[segment], lead[place]
    return segment, lead, begin, sizes, symbols, anchor[lead], count.astype(np.int64)


def _blocks(which: np.ndarray, sizes: np.ndarray) -> Iterable[np.ndarray]:
    """The entries in blocks of about CHUNK symbols."""
    ends = np.cumsum(sizes[which])
    at = 0
    while at < len(which):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        yield which[at:to]
        at = to


def _differ(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether stretches of symbols that start at a and at b differ."""
    first = np.cumsum(sizes) - sizes
    inner = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    return np.add.reduceat(symbols[np.repeat(a, sizes) + inner] != symbols[np.repeat(b, sizes) + inner], first) > 0


def spread(values: list[np.ndarray], segment: np.ndarray, entries: list[Entries]) -> list[np.ndarray]:
    """For each group the values of its entries' windows, given those of each segment."""
    out, at = [], 0
    for e in entries:
        n = len(e.windows)
        out.append(np.concatenate([values[s] for s in segment[at : at + n].tolist()]) if n else np.empty(0, values[0].dtype))
        at += n
    return out


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)
