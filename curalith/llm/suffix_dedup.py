"""Suffix-array dedup: repeated byte strings by merging shards' Burrows-Wheeler transforms.

What is indexed are the segments of repeats.py whose neighbourhoods differ.
Each shard of them is sorted once into its transform.  The shards are merged
by refining their interleave: after h rounds it orders all suffixes by their
first h symbols, each round being one stable distribution by the preceding
symbol, and no suffix is compared or sorted anew.  The round in which a
boundary first shows is the common prefix of the suffixes beside it; stretches
without a boundary after ``min_bytes`` rounds are the repeated intervals.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.llm import exchange, repeats
from curalith.llm.text import mix, sha256_hex

#: Bytes hash through a fixed table, so that their values aren't small numbers.
BYTE_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(repeats.BASE))
#: Symbols of segments that are indexed at a time; anchors with more go alone.
BATCH = 1 << 16
SHARDS = 3
#: Symbols of a shard; where a batch holds more, there are more shards, since sorting takes 200 bytes a symbol and merging 60.
SHARD = 1 << 18


@dataclass
class Shard:
    """The transform (0 ends a string, byte b is b + 1) and the sorted suffixes as (string, offset)."""

    bwt: np.ndarray
    string: np.ndarray
    offset: np.ndarray
    strings: int


def transform(symbols: np.ndarray, sizes: np.ndarray) -> Shard:
    """Sort all suffixes of the strings, each ended by a sentinel that sorts first, in the order of strings."""
    wide = -(-(int(sizes.max()) if len(sizes) else 1) // 8) * 8
    begin = np.cumsum(sizes) - sizes
    reps = sizes + 1
    string = np.repeat(np.arange(len(sizes)), reps)
    offset = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    at = begin[string] + offset
    left = sizes[string] - offset
    padded = np.append(symbols, np.zeros(wide, np.uint8))
    matrix = np.lib.stride_tricks.sliding_window_view(padded, wide)[at]
    matrix[np.arange(wide) >= left[:, None]] = 0
    keys = matrix.view(">u8").astype(np.uint64)
    order = np.lexsort((string, left, *[keys[:, j] for j in range(keys.shape[1] - 1, -1, -1)]))
    before = np.where(offset > 0, padded[np.maximum(at - 1, 0)].astype(np.uint16) + 1, 0).astype(np.uint16)
    return Shard(before[order], string[order], offset[order], len(sizes))


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(source of each suffix in merged order, common prefix with the one before it; -1 stands for ``depth`` or more)."""
    sizes = [len(s.bwt) for s in shards]
    n, strings = sum(sizes), sum(s.strings for s in shards)
    source = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    ends = np.repeat(np.arange(len(shards), dtype=np.uint8), [s.strings for s in shards])
    values, symbols = np.unique(np.concatenate([s.bwt for s in shards]), return_inverse=True)  # 0, the end, stays the least
    symbols = symbols.astype(np.uint8 if len(values) <= 256 else np.uint16)
    wide = np.int32 if n < 1 << 22 else np.int64
    prefix = np.full(n, -1, np.int16)
    prefix[:1] = 0
    block = np.zeros(n, wide)
    symbol = np.empty_like(symbols)
    boundary = np.ones(n, bool)  # sentinels differ from one another
    known = np.zeros(n, bool)
    known[:1] = True
    for h in range(depth):
        symbol[np.argsort(source, kind="stable")] = symbols  # each source's symbols in turn
        order = np.argsort(symbol, kind="stable")[strings:]
        source = np.concatenate([ends, source[order]])
        both = block[order] * wide(512) + symbol[order]
        boundary[strings + 1 :] = both[1:] != both[:-1]
        prefix[boundary > known] = h
        known |= boundary
        block = np.cumsum(boundary, dtype=wide)
    return source, prefix


def window_minima(symbols: list[np.ndarray], values: np.ndarray, shard_of: np.ndarray, window: int) -> list[np.ndarray]:
    """For each string the least value of the strings that hold each of its windows."""
    shards, members = [], []
    for j in np.unique(shard_of).tolist():
        own = np.flatnonzero(shard_of == j)
        shards.append(transform(np.concatenate([symbols[i] for i in own.tolist()]), np.array([len(symbols[i]) for i in own.tolist()], np.int64)))
        members.append(own)
    source, prefix = merge(shards, window)
    string, offset = np.empty(len(source), np.int64), np.empty(len(source), np.int64)
    for j, s in enumerate(shards):
        at = source == j
        string[at], offset[at] = members[j][s.string], s.offset
    starts = np.flatnonzero(prefix >= 0)
    least = np.minimum.reduceat(values[string], starts)
    least = np.repeat(least, np.diff(np.append(starts, len(prefix))))
    sizes = np.array([len(s) for s in symbols], np.int64)
    whole = offset <= sizes[string] - window
    out = [np.empty(n - window + 1, np.int64) for n in sizes.tolist()]
    flat_begin = np.cumsum(sizes - window + 1) - (sizes - window + 1)
    flat = np.empty(int((sizes - window + 1).sum()), np.int64)
    flat[flat_begin[string[whole]] + offset[whole]] = least[whole]
    for i, (a, n) in enumerate(zip(flat_begin.tolist(), (sizes - window + 1).tolist(), strict=True)):
        out[i] = flat[a : a + n]
    return out


def decide(entries: list[repeats.Entries], window: int) -> list[np.ndarray]:
    """For each group's windows whether a document of smaller id than the entry's least holds them."""
    segment, lead, begin, sizes, symbols, anchor, count = repeats.collapse(entries, window)
    least = np.full(len(lead), np.iinfo(np.int64).max, np.int64)
    np.minimum.at(least, segment, np.concatenate([e.weight for e in entries]))
    number = count[lead]
    first = np.cumsum(number) - number
    values = np.repeat(least, number)  # of all segments' windows, behind one another
    edges = np.flatnonzero(np.diff(anchor.astype(np.uint64), prepend=anchor[:1] + np.uint64(1), append=anchor[-1:] + np.uint64(1)))
    batch: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal batch, held
        if batch:
            shards = min(255, max(SHARDS, -(-held // SHARD)))
            got = window_minima([symbols[begin[lead[i]] : begin[lead[i]] + sizes[lead[i]]] for i in batch], least[batch], np.arange(len(batch)) % shards, window)
            for i, v in zip(batch, got, strict=True):
                values[first[i] : first[i] + len(v)] = v
        batch, held = [], 0

    several = np.flatnonzero(np.diff(edges) > 1)  # segments of one anchor with different neighbourhoods
    for a, b in zip(edges[several].tolist(), edges[several + 1].tolist(), strict=True):
        batch += range(a, b)
        held += int(sizes[lead[a:b]].sum())
        if held >= BATCH:
            flush()
    flush()
    out, at = [], 0
    for e in entries:
        own = segment[at : at + len(e.windows)]
        at += len(own)
        reps = number[own]
        inner = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        out.append(values[np.repeat(first[own], reps) + inner] < np.repeat(e.weight, reps))
    return out


def dedup(docs: DataFrame, *, min_bytes: int = 50, anchor_bytes: int = 34, hot_groups: int = 16_384, carry: bool = False, group_bytes: int = exchange.GROUP_BYTES // 2) -> DataFrame:
    """Remove every byte covered by a string of ``min_bytes`` that also starts in a document of smaller doc_id.

    Texts are UTF-8 bytes; strings never cross documents and are judged on the
    input.  Returns one row per row of ``docs``: doc_id, n_bytes, n_removed,
    n_spans, kept_sha256 and spans (array<struct<start, end>>, byte offsets);
    with ``carry`` the columns of ``docs`` instead, the text being what is left
    (characters cut in the middle lose their remaining bytes).  A null or empty
    text, and one shorter than ``min_bytes``, loses nothing; rows that share a
    doc_id don't reduce one another; a null doc_id counts as the largest.
    """
    if not 1 <= anchor_bytes <= min_bytes:
        raise ValueError("an anchor must fit into a repeated string")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    dealt = exchange.grouped(docs, groups, carry)
    answers, read = repeats.verdicts(
        dealt,
        groups,
        symbols=lambda t: np.frombuffer(t, np.uint8),
        hashed=lambda s: BYTE_TABLE[s],
        window=min_bytes,
        k=anchor_bytes,
        bits=min(64, max(40, math.ceil(math.log2(total + 2)) + 8)),
        hot_groups=hot_groups,
        weigh=lambda ids, lead: np.minimum.reduceat(ids, lead) if len(lead) else np.empty(0, np.int64),
        decide=lambda entries: decide(entries, min_bytes),
        later_too=True,
    )

    def last(grp: int, rows: pa.Table, ids: list, data: list[bytes], got: list[tuple[int, bytes]]) -> pa.Table:
        covered = read(ids, [len(t) for t in data], got)
        kept: list[bytes] = []
        spans: list[list[dict]] = []
        removed: list[int] = []
        for text, cover in zip(data, covered, strict=True):
            if cover is None:
                kept.append(text)
                spans.append([])
                removed.append(0)
                continue
            kept.append(np.frombuffer(text, np.uint8)[~cover].tobytes())
            edges = np.flatnonzero(np.diff(cover.astype(np.int8), prepend=0, append=0)).tolist()
            spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            removed.append(int(cover.sum()))
        if carry:
            return exchange.with_text(rows, [k.decode("utf-8", "ignore").encode() for k in kept])
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_bytes": pa.array([len(t) for t in data], pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array([len(s) for s in spans], pa.int64()),
                "kept_sha256": pa.array([sha256_hex(k) for k in kept], pa.string()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
        )

    schema: Iterable = docs.schema if carry else "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    return exchange.finish(dealt, answers, last, schema)
