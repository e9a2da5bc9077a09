"""Line dedup: ranges of hashes, sorted by document and position.

A line's key is the line stripped of ASCII white space at both ends, in ASCII
lower case.  Each group of documents sends every key's 128-bit hash once, with
the number of its documents that hold it and its first place there.  A bucket
owns a range of hashes; it sorts what it gets by hash, then document, then
position, and streams over it: a run's first row is the key's first occurrence
in the corpus, the run's sum its number of documents.  Back go one bit or two
for each key asked, from which the group makes a compressed keep bitmap for
each document; texts never leave it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from curalith.llm import exchange
from curalith.llm.text import sha256_hex

NULL_ID = np.iinfo(np.int64).max  # rows without an id come last in the order of documents


def _keys(ids: list, data: list[bytes], min_chars: int):
    """(lines of each document, hash row of each counted line, unique hashes, document counts, first document, first position)."""
    lines = [t.split(b"\n") for t in data]
    seen: dict[bytes, int] = {}
    keyed: list[list[int]] = []
    counts: list[int] = []
    first: list[tuple[int, int]] = []
    last: list[int] = []
    for d, own in enumerate(lines):
        row = []
        for pos, line in enumerate(own):
            key = line.strip().lower()
            if len(key) < min_chars or (len(key.decode()) if min_chars > 1 else len(key)) < min_chars or not key:
                row.append(-1)
                continue
            k = seen.setdefault(key, len(counts))
            if k == len(counts):
                counts.append(0)
                first.append((NULL_ID if ids[d] is None else ids[d], pos))
                last.append(-1)
            if last[k] != d:
                last[k] = d
                counts[k] += 1
            row.append(k)
        keyed.append(row)
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in seen]), ">u8").astype(np.uint64).reshape(-1, 2)
    return lines, keyed, digests, np.array(counts, np.uint32), np.array(first, np.int64).reshape(-1, 2)


def dedup(
    docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, keep: str = "none", carry: bool = False, group_bytes: int = exchange.GROUP_BYTES
) -> DataFrame:
    """Drop lines whose key is found in at least ``min_docs`` documents.

    ``keep='none'`` drops all lines of such a key, ``keep='first'`` all but the
    first of the first document (smallest doc_id, null last).  Returns one row
    per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256 and
    keep_bitmap (zlib-compressed bits, a line's bit is 1 if it stays); with
    ``carry`` the columns of ``docs`` instead, the text being what stays.  A
    null or empty text is one empty line, which no key matches.  Rows that
    repeat an id count as documents of their own.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is 'none' or 'first', not {keep!r}")
    groups = exchange.group_count(docs, group_bytes)
    dealt = exchange.grouped(docs, groups, carry)

    def question(grp: int, ids: list, data: list[bytes]) -> Iterable[tuple[int, bytes]]:
        _, _, digests, counts, first = _keys(ids, data, min_chars)
        order = np.lexsort((digests[:, 1], digests[:, 0]))
        high, low, counts, first = digests[order, 0], digests[order, 1], counts[order], first[order]
        for b, s in exchange.by_bucket(high, groups):
            yield b, exchange.pack(exchange.pack_sorted(high[s]), low[s], counts[s], first[s])

    def reply(bucket: int, asked: list[tuple[int, bytes]]) -> Iterable[tuple[int, bytes]]:
        parts = [exchange.unpack(blob) for _, blob in asked]
        sizes = [len(p[1]) for p in parts]
        high = np.concatenate([exchange.unpack_sorted(p[0]) for p in parts])
        low, counts, first = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        order = np.lexsort((first[:, 1], first[:, 0], low, high))
        starts = np.ones(len(order), bool)
        starts[1:] = (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)
        run = np.cumsum(starts) - 1
        frequent = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(starts)) >= min_docs
        drops, leads = np.zeros(len(order), bool), np.zeros(len(order), bool)
        drops[order], leads[order] = frequent[run], starts
        at = 0
        for (g, _), n in zip(asked, sizes, strict=True):
            yield g, exchange.pack(np.packbits(drops[at : at + n]), np.packbits(leads[at : at + n]), n)
            at += n

    def last(grp: int, rows: pa.Table, ids: list, data: list[bytes], answers: list[tuple[int, bytes]]) -> pa.Table:
        lines, keyed, digests, _, first = _keys(ids, data, min_chars)
        order = np.lexsort((digests[:, 1], digests[:, 0]))
        drop, lead = np.zeros(len(order), bool), np.zeros(len(order), bool)
        at = 0
        for _, blob in answers:  # by bucket, so in the order of the sorted hashes
            d, f, n = exchange.unpack(blob)
            drop[order[at : at + n]] = np.unpackbits(d, count=n).astype(bool)
            lead[order[at : at + n]] = np.unpackbits(f, count=n).astype(bool)
            at += n
        if keep == "none":
            lead[:] = False
        kept_lines: list[list[bytes]] = []
        bitmaps: list[np.ndarray] = []
        for d, own in enumerate(lines):
            row = np.array(keyed[d], np.int64)
            stays = np.ones(len(own), bool)
            known = row >= 0
            stays[known] = ~drop[row[known]]
            for p in np.flatnonzero(known & ~stays).tolist():
                k = row[p]
                if lead[k] and first[k, 1] == p and first[k, 0] == (NULL_ID if ids[d] is None else ids[d]):
                    lead[k] = False  # rows may repeat an id; the first of them keeps the line
                    stays[p] = True
            bitmaps.append(stays)
            kept_lines.append([x for x, s in zip(own, stays.tolist(), strict=True) if s])
        kept = [b"\n".join(x) for x in kept_lines]
        if carry:
            return exchange.with_text(rows, kept)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_lines": pa.array([len(x) for x in lines], pa.int64()),
                "n_dropped": pa.array([int(len(x) - x.sum()) for x in bitmaps], pa.int64()),
                "kept_sha256": pa.array([sha256_hex(x) for x in kept], pa.string()),
                "keep_bitmap": pa.array([zlib.compress(np.packbits(x).tobytes()) for x in bitmaps], pa.binary()),
            }
        )

    schema = docs.schema if carry else "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, keep_bitmap binary"
    return exchange.finish(dealt, exchange.answer(exchange.ask(dealt, question), reply), last, schema)
