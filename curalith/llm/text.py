"""Byte-level text helpers shared by the operators.

``bytes.split()`` and ``bytes.lower()`` know exactly the ASCII white space
``[\\x20\\x09-\\x0D]`` and the letters A-Z that the operators' contracts name,
so texts are handled as UTF-8 bytes and never as Python strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier and shifts of the 64-bit mixer (the golden ratio in 64 bits).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc32_mod(doc_id: int | None, m: int) -> int:
    """crc32 of the id as decimal text, modulo m; a null id counts as the text ``null``."""
    import zlib

    return zlib.crc32(b"null" if doc_id is None else str(doc_id).encode()) % m


def slices(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the ``text`` column of each holds about ``limit`` bytes; a longer text stands alone."""
    for b in batches:
        if b.num_rows == 0:
            continue
        lengths = pc.binary_length(b.column(b.schema.get_field_index("text"))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield b.slice(at, to - at)
            at = to
