"""Profiles of a manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(frame: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Counts by several groupings in one scan: (grouping, key, n); () is the total.

    ``grouping`` joins the columns' names with ``*`` and ``key`` their values with ``|``.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = frame.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    bit = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    name = key = None
    for s in sets:
        gid = sum(b for c, b in bit.items() if c not in s)
        hit = F.col("gid") == gid
        n, k = F.lit("*".join(s) or "total"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in s]) if s else F.lit("")
        name, key = (F.when(hit, n), F.when(hit, k)) if name is None else (name.when(hit, n), key.when(hit, k))
    return grouped.select(name.alias("grouping"), key.alias("key"), "n")


def dataset_summary(frame: DataFrame) -> DataFrame:
    return frame.groupBy("split", "surface", "label").agg(F.count("*").alias("n_rows"), F.count_distinct("source_group").alias("n_groups"))


def split_overview(frame: DataFrame) -> DataFrame:
    return frame.groupBy("split").agg(F.count("*").alias("images"), F.count_distinct("source_group").alias("groups"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))


def class_pivot(frame: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts with the given values as columns c_<value>, absent ones zero."""
    return frame.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"c_{v}") for v in values])


def unpivot(frame: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return frame.unpivot(list(ids), list(values), name, value)


def distinct_values(frame: DataFrame, column: str) -> DataFrame:
    return frame.select(column).distinct()


def sample(frame: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows by the order of a seeded hash of the key, sorted by the key: the same rows however the table is stored."""
    return frame.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key).limit(n).orderBy(key)


def shuffled(frame: DataFrame, seed: int, epoch: int, key: str) -> DataFrame:
    """All rows in an order that differs for each epoch."""
    return frame.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed + epoch)), key)
