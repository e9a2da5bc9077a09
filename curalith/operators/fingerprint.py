"""Fingerprints of tables and of files, whatever their row or column order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_line(columns: Sequence[str]) -> Column:
    """Columns by name, each as its text (missing: empty), joined by U+0000.  This is our own form."""
    return F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(columns)])


def ordered(frame: DataFrame, key: str, line: Column, parts: int = 0) -> DataFrame:
    """One row: rows, and the SHA-256 of all lines in the order of the key.

    With ``parts`` 0 the hash is of all lines joined by line feeds, which one
    task has to hold: right for manifests that a driver may hold too.  Beyond
    that give ``parts``: keys are dealt by their SHA-256 into so many parts,
    each is hashed in order, and the hash is of the parts' hashes; it equals
    only hashes made with the same number of parts.
    """
    rows = frame.select(F.col(key).alias("k"), line.alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")
    if not parts:
        return rows.agg(F.count("*").alias("n_rows"), F.sha2(joined.cast("binary"), 256).alias("fingerprint"))
    part = F.pmod(F.conv(F.substring(F.sha2(F.col("k").cast("binary"), 256), 1, 8), 16, 10).cast("bigint"), F.lit(parts)).alias("part")
    per = rows.groupBy(part).agg(F.count("*").alias("n"), F.sha2(joined.cast("binary"), 256).alias("h"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: F.concat_ws(":", x["part"].cast("string"), x["h"])), "\n")
    return per.agg(F.sum("n").alias("n_rows"), F.sha2(whole.cast("binary"), 256).alias("fingerprint"))


def canonical(frame: DataFrame, key: str = "relative_path", parts: int = 0) -> DataFrame:
    return ordered(frame, key, canonical_line(frame.columns), parts)


def content(frame: DataFrame, key: str = "relative_path") -> DataFrame:
    """Rows, bytes, and the hash over path, hash and size of every file."""
    line = F.concat_ws("\0", F.col(key), F.col("sha256"), F.col("file_size_bytes").cast("string"))
    return ordered(frame, key, line).crossJoin(F.broadcast(frame.agg(F.sum("file_size_bytes").alias("n_bytes"))))


def verify_files(files: DataFrame, manifest: DataFrame, key: str = "relative_path") -> DataFrame:
    """One row: files that match, differ, are missing, are unknown; ``files`` has the key, ``content`` and ``length`` (binaryFile)."""
    observed = files.select(key, F.sha2("content", 256).alias("seen"), "length")
    both = observed.join(manifest.select(key, "sha256"), key, "full_outer")
    return both.agg(
        F.count_if(F.col("seen") == F.col("sha256")).alias("n_ok"),
        F.count_if(F.col("seen") != F.col("sha256")).alias("n_different"),
        F.count_if(F.col("seen").isNull()).alias("n_missing"),
        F.count_if(F.col("sha256").isNull()).alias("n_unknown"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"),
    )
