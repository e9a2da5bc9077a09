"""Questions from groups of documents to ranges of keys, and the answers back.

Documents are dealt into groups of bounded size by a hash.  A group sends each
key that it holds once, however often its documents repeat it, to the bucket
that owns the key's range; a bucket sees a key at most once for each group, so
a key that a third of all documents hold costs its bucket no more than any
other.  The answers go back to the asking group, which has its documents at
hand again: the exchange of the documents stands twice in the plan and runs
once.  Nothing is collected on the driver, nothing is broadcast, and a lost
executor's groups and buckets are computed anew from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from curalith.llm.text import texts
from curalith.llm.workers import forget, tidy

BLOBS = "grp int, bucket int, blob binary"
#: Bytes of text that a group holds on average.
GROUP_BYTES = 8 << 20


#: Blobs under this many bytes aren't compressed: most hold a few hashes, and the shuffle compresses across rows.
SMALL = 512
_TYPES = [np.dtype(t) for t in ("u1", "u2", "u4", "u8", "i1", "i2", "i4", "i8", "f8", "?")]
_CODES = {t: k for k, t in enumerate(_TYPES)}
#: Codes above those of the array types.
_INT, _BYTES, _TEXT, _LIST = 100, 101, 102, 103


def _size(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _write(x, out: list[bytes]) -> None:
    if isinstance(x, np.ndarray):
        out.append(bytes([_CODES[x.dtype], x.ndim]) + b"".join([_size(n) for n in x.shape]))
        out.append(np.ascontiguousarray(x).tobytes())
    elif isinstance(x, bytes):
        out.append(bytes([_BYTES]) + _size(len(x)) + x)
    elif isinstance(x, str):
        raw = x.encode()
        out.append(bytes([_TEXT]) + _size(len(raw)) + raw)
    elif isinstance(x, (list, tuple)):
        out.append(bytes([_LIST]) + _size(len(x)))
        for y in x:
            _write(y, out)
    else:
        out.append(bytes([_INT]) + int(x).to_bytes(8, "little", signed=True))


def _read(raw: bytes, at: int):
    def size() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    code = raw[at]
    at += 1
    if code < len(_TYPES):
        dims = raw[at]
        at += 1
        shape = [size() for _ in range(dims)]
        count = 1
        for n in shape:
            count *= n
        kind = _TYPES[code]
        return np.frombuffer(raw, kind, count, at).reshape(shape), at + count * kind.itemsize
    if code == _INT:
        return int.from_bytes(raw[at : at + 8], "little", signed=True), at + 8
    n = size()
    if code == _LIST:
        items = []
        for _ in range(n):
            item, at = _read(raw, at)
            items.append(item)
        return items, at
    part = raw[at : at + n]
    return (part if code == _BYTES else part.decode()), at + n


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """A process's own pair: to make one takes longer than to compress a small blob."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*items) -> bytes:
    """Arrays, ints, bytes, texts and lists of them in one blob.

    A blob with one key costs a few bytes beside it: with very many groups and
    buckets most blobs hold no more, and the exchange then costs what as many
    rows would, in proportion to the keys and not to groups times buckets.
    """
    out: list[bytes] = []
    for x in items:
        _write(x, out)
    raw = b"".join(out)
    return b"\0" + raw if len(raw) < SMALL else b"\1" + _zstd()[0].compress(raw)


def unpack(blob: bytes) -> list:
    raw = blob[1:] if blob[0] == 0 else _zstd()[1].decompress(blob[1:])
    out, at = [], 0
    while at < len(raw):
        x, at = _read(raw, at)
        out.append(x)
    return out


def pack_sorted(values: np.ndarray) -> np.ndarray:
    """Ascending uint64 as byte planes of their differences, which compress well."""
    return np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def planes(values: np.ndarray) -> np.ndarray:
    """Byte planes of uint32: small numbers compress better apart from their zero bytes."""
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)


def unplanes(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts.T).view(np.uint32).ravel()


def group_count(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // group_bytes))


def grouped(docs: DataFrame, groups: int, carry: bool = False) -> DataFrame:
    """doc_id, text, grp; with ``carry`` all columns of the row as the struct ``row``."""
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")]
    if carry:
        columns.append(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return docs.select(*columns, F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("grp"))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each uint64 key: equal ranges of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def by_bucket(sorted_keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice of the sorted keys) for each bucket that has any."""
    if len(sorted_keys) == 0:
        return
    own = bucket_of(sorted_keys, buckets)
    edges = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(own[a]), slice(a, b)


def canonical(table: pa.Table) -> tuple[pa.Table, list[int | None], list[bytes]]:
    """The group's rows in an order that doesn't depend on how they arrived, their ids and texts."""
    forget()
    table = table.combine_chunks()
    ids = table.column("doc_id").to_pylist()
    data = texts(pa.concat_arrays(table.column("text").chunks) if table.num_rows else pa.array([], pa.string()))
    nulls = table.column("text").is_null().to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, data[i], nulls[i]))
    return table.take(pa.array(order, pa.int64())), [ids[i] for i in order], [data[i] for i in order]


def _rows(rows: Iterable[tuple[int, int, bytes]]) -> pa.Table:
    rows = list(rows)
    tidy()
    return pa.table({"grp": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})


def ask(docs: DataFrame, question: Callable[[int, list, list[bytes]], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """question(grp, ids, texts) -> (bucket, blob) of each bucket asked."""

    def run(table: pa.Table) -> pa.Table:
        grp = table.column("grp")[0].as_py()
        _, ids, data = canonical(table)
        return _rows((grp, b, blob) for b, blob in question(grp, ids, data))

    return docs.groupBy("grp").applyInArrow(run, BLOBS)


def ask_again(docs: DataFrame, answers: DataFrame, question: Callable[[int, list, list[bytes], list[tuple[int, bytes]]], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """Like ask(), with the answers to an earlier question at hand: question(grp, ids, texts, [(bucket, blob)])."""

    def run(table: pa.Table, answer: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return _rows([])
        grp = table.column("grp")[0].as_py()
        _, ids, data = canonical(table)
        return _rows((grp, b, blob) for b, blob in question(grp, ids, data, _pairs(answer, "bucket")))

    return docs.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(run, BLOBS)


def _pairs(table: pa.Table, key: str) -> list[tuple[int, bytes]]:
    return sorted(zip(table.column(key).to_pylist(), table.column("blob").to_pylist(), strict=True))


def answer(asked: DataFrame, reply: Callable[[int, list[tuple[int, bytes]]], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """reply(bucket, [(grp, blob)]) -> (grp, blob) for the groups that get one."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        return _rows((g, bucket, blob) for g, blob in reply(bucket, _pairs(table, "grp")))

    return asked.groupBy("bucket").applyInArrow(run, BLOBS)


def finish(docs: DataFrame, answers: DataFrame, last: Callable[[int, pa.Table, list, list[bytes], list[tuple[int, bytes]]], pa.Table], schema: str | StructType) -> DataFrame:
    """last(grp, rows, ids, texts, [(bucket, blob)]) -> the group's rows of the result."""

    nothing = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema).empty_table()

    def run(table: pa.Table, answer: pa.Table) -> pa.Table:
        if table.num_rows == 0:  # answers for a group without documents
            return nothing
        grp = table.column("grp")[0].as_py()
        rows, ids, data = canonical(table)
        out = last(grp, rows, ids, data, _pairs(answer, "bucket"))
        tidy()
        return out

    return docs.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(run, schema)


def with_text(table: pa.Table, kept: list[bytes], keep_null: bool = True) -> pa.Table:
    """The carried rows with their text replaced, and n_chars, where there is one, counted anew; a null text stays null."""
    row = table.column("row").combine_chunks()
    row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
    nulls = table.column("text").is_null().to_pylist()
    new = [None if n and keep_null else k.decode("utf-8", "replace") for n, k in zip(nulls, kept, strict=True)]
    out = {}
    for k, field in enumerate(row.type):
        values = row.field(k)
        if field.name == "text":
            values = pa.array(new, pa.string()).cast(field.type)
        elif field.name == "n_chars" and pa.types.is_integer(field.type):
            values = pa.array([None if x is None else len(x) for x in new], field.type)
        out[field.name] = values
    return pa.table(list(out.values()), names=list(out))
