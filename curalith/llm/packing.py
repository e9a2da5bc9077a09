"""Best-fit packing of tokenised documents with swap-based local search.

Pieces are dealt at random into groups of bounded size.  In a group, best fit
places the pieces, largest first, and a local search then exchanges one for
one, any two for one, or moves pieces between bins that aren't full.  Each step
raises the sum of squared fills, so the fullest bins become full and the
emptiest run empty.  What is still in bins that aren't nearly full is then
packed once more, together with the others' rests.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.llm.bpe import encoder
from curalith.llm.text import slices, texts


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: each piece, largest first, goes to the fullest bin that it fits."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has r left
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room[room - s].append(b)
        mask |= 1 << (room - s)
    return bins


def local_search(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Bins after moves and exchanges that each raise the sum of squared fills, until a pass finds none.

    A bin looks for the largest fitting piece of any emptier bin, or else for the
    exchange with one that fills it most: a piece for one or any two of its own.
    Sets of sizes are bits of an integer, so that all pairs are tried at once.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    while True:
        # donors: the emptiest bins; what they hold is sorted by size
        order = sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: (fill[b], b))
        if len(order) < 2:
            break
        rank = {b: k for k, b in enumerate(order)}
        pool = sorted((sizes[i], -rank[b], i, b) for b in order for i in bins[b])
        count = [0] * (capacity + 1)  # pieces of each size in bins emptier than the one at hand
        for entry in pool:
            count[entry[0]] += 1
        offered = sum(1 << s for s in range(1, capacity + 1) if count[s])  # bit s: there is one
        changed = False

        def add(size: int, n: int) -> None:
            nonlocal offered
            count[size] += n
            offered = offered | 1 << size if count[size] else offered & ~(1 << size)

        def emptiest(size: int):
            return pool[bisect_left(pool, (size + 1,)) - 1]  # of one size, the emptiest bin's comes last

        def move(entry, to: int) -> None:
            size, _, i, b = entry
            pool.pop(bisect_left(pool, entry))
            bins[b].remove(i)
            fill[b] -= size
            bins[to].append(i)
            fill[to] += size
            insort(pool, (size, -rank[to], i, to))

        for b in reversed(order):  # the fullest first
            for i in bins[b]:
                add(sizes[i], -1)
            while fill[b] and 0 < (room := capacity - fill[b]):
                fits = offered & ((2 << room) - 1)
                if fits and fill[b] + (size := fits.bit_length() - 1) > fill[(entry := emptiest(size))[3]]:  # else squared fill would fall
                    move(entry, b)
                    add(size, -1)
                    changed = True
                    continue
                own: dict[int, list[int]] = {}
                for i in sorted(bins[b]):
                    own.setdefault(sizes[i], []).append(i)
                ones = twos = 0
                for s, members in own.items():
                    twos |= ones << s | (1 << 2 * s if len(members) > 1 else 0)
                    ones |= 1 << s
                for gain in range(room, 0, -1):
                    if hit := ones << gain & offered or twos << gain & offered:
                        break
                else:
                    break
                entry = emptiest(size := (hit & -hit).bit_length() - 1)
                donor = entry[3]
                if fill[b] + gain <= fill[donor]:  # the donor has meanwhile become the fuller one; the next pass sees it anew
                    break
                if size - gain in own:
                    given = own[size - gain][:1]
                else:
                    s = next(s for s in own if size - gain - s in own and (2 * s != size - gain or len(own[s]) > 1))
                    given = [own[s][0], own[size - gain - s][-1]]
                move(entry, b)
                add(size, -1)
                for i in given:
                    move((sizes[i], -rank[b], i, b), donor)
                    add(sizes[i], 1)
                changed = True
        if not changed:
            break
    return [b for b in bins if b]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    return local_search(sizes, best_fit(sizes, capacity), capacity)


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Token pieces of every whole text: ids, then ``end_id``, cut into ``capacity`` tokens where longer.

    A null or empty text is the end id alone.  Map-only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for b in slices(batches):
            words.forget()
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                ids = words.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            doc, piece, start, length, crc = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, PIECES)


def _pack_groups(frame: DataFrame, capacity: int, nearly: int) -> DataFrame:
    """``frame`` has the pieces' columns and ``grp``; adds ``sequence_id``, ``offset``, and whether the bin is filled to ``nearly``."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        sizes = g["length"].tolist()
        seq, off, settled = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64), np.ones(len(g), bool)
        for k, members in enumerate(pack(sizes, capacity)):
            at = 0
            for i in members:
                seq[i], off[i] = k, at
                at += sizes[i]
            settled[members] = at >= nearly
        g["sequence_id"] = seq + (int(g["grp"].iloc[0]) << 24)
        g["offset"], g["settled"] = off, settled
        return g.drop(columns="grp")

    return frame.groupBy("grp").applyInPandas(run, PIECES + ", sequence_id bigint, offset bigint, settled boolean")


def pack_documents(docs: DataFrame, vocabulary: str, *, capacity: int = 4096, end_id: int = 1, group_rows: int = 16_000, nearly: float = 0.98) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as the search finds.

    Returns one row per piece: PIECES, ``sequence_id``, ``offset``.  Repeated
    rows are packed as documents of their own; an empty table gives no row.
    ``group_rows`` bounds the rows that one task packs; the deal by hash makes
    groups alike whatever the input's order.  Bins that a group leaves under
    ``nearly`` full are dissolved, and their pieces packed again, sixteen groups
    together.  Both rounds read the same exchange, so no text is encoded twice.
    """
    n = max(1, -(-docs.count() // group_rows))
    fewer = -(-n // 16)
    cut = pieces(docs, vocabulary, capacity, end_id)
    deal = F.xxhash64("doc_id", "piece", "ids_crc32")
    first = _pack_groups(cut.withColumn("grp", F.pmod(deal, F.lit(n)).cast("int")), capacity, int(nearly * capacity))
    rest = first.where(~F.col("settled")).drop("sequence_id", "offset", "settled")
    second = _pack_groups(rest.withColumn("grp", F.pmod(deal, F.lit(fewer)).cast("int") + F.lit(n)), capacity, capacity)
    return first.where("settled").drop("settled").unionByName(second.drop("settled"))
