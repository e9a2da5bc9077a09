"""Shapes of tables: column choice and order, ordered picks, fixed categories, aggregates over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalith.functions.scalar import at_threshold, outcome
from curalith.operators.checks import CheckError


def prefer(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of the list that the frame has, in the list's order."""
    return frame.select([f"`{c}`" for c in columns if c in frame.columns])


def insert(frame: DataFrame, at: int, name: str, value: Column) -> DataFrame:
    """The frame with a new column at a place; a name that it has already raises."""
    if name in frame.columns:
        raise ValueError(f"column {name} is there already")
    columns = [F.col(f"`{c}`") for c in frame.columns]
    return frame.select(*columns[:at], value.alias(name), *columns[at:])


def of_split(frame: DataFrame, split: str, column: str = "split") -> DataFrame:
    """Rows of one split, whatever the case and white space of its name."""
    return frame.where(F.lower(F.trim(column)) == split)


def of_status(frame: DataFrame, ok: bool = True, column: str = "audit_status") -> DataFrame:
    good = F.coalesce(F.col(column) == "ok", F.lit(False))
    return frame.where(good if ok else ~good)


def filled_groups(frame: DataFrame, group: str, least: int = 1) -> DataFrame:
    """(group, n) of the groups with at least so many rows."""
    return frame.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def first_of_each(frame: DataFrame, key: str, order: str, ties: Sequence[Column] = ()) -> DataFrame:
    """The first row of each key, in order, nulls last: an aggregate, so a frequent key is no burden to one task.

    A key without any value to order by keeps a row.  Rows that tie are told
    apart by ``ties``, columns that the result doesn't have; ``position()`` takes
    the first one read.  Without them any of the tied rows may come.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in frame.columns])
    rank = F.struct(F.col(order).isNull(), F.col(order), *ties)
    return frame.groupBy(F.col(key).alias("k")).agg(F.min_by(whole, rank).alias("w")).select("w.*")


def position() -> list[Column]:
    """Where a row stands in the files of a scan."""
    return [F.col("_metadata.file_path"), F.col("_metadata.row_index")]


def one_batch(frame: DataFrame, size: int, order: str) -> DataFrame:
    """All rows as one ordered batch; more than ``size`` raise."""
    if frame.limit(size + 1).count() > size:
        raise CheckError(f"more than one batch of {size}")
    return frame.orderBy(order)


def in_order(frame: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """Rows by a fixed order of categories, others last; ``place`` counts from 0."""
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(column)) - 1
    return frame.withColumn("place", F.when(place >= 0, place).otherwise(F.lit(len(categories))).cast("int")).orderBy("place", column)


def pivot_sum(frame: DataFrame, row: str, column: str, values: Sequence, amount: str) -> DataFrame:
    """Sums with the given values as columns s_<value>, absent ones zero."""
    return frame.groupBy(row).agg(*[F.coalesce(F.sum(F.when(F.col(column) == v, F.col(amount))), F.lit(0)).alias(f"s_{v}") for v in values])


def all_any(frame: DataFrame, group: str, flag: Column) -> DataFrame:
    """(group, all_true, any_true); a null flag counts as false."""
    sure = F.coalesce(flag, F.lit(False))
    return frame.groupBy(group).agg(F.bool_and(sure).alias("all_true"), F.bool_or(sure).alias("any_true"))


def total(frame: DataFrame, key: str, amount: str) -> DataFrame:
    return frame.groupBy(key).agg(F.sum(amount).alias("total"), F.count(amount).alias("n"))


def vocabulary(frame: DataFrame, column: str, expected: Sequence) -> DataFrame:
    """(value, n, state) of every value found or expected: ok, missing or extra; a null value is extra."""
    kind = frame.schema[column].dataType
    wanted = frame.sparkSession.createDataFrame([(v,) for v in expected], ["value"]).select(F.col("value").cast(kind).alias("value"), F.lit(True).alias("wanted"))
    found = frame.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    both = found.join(F.broadcast(wanted), "value", "full_outer")
    return both.select("value", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "missing").when(F.col("wanted"), "ok").otherwise("extra").alias("state"))


def two_thresholds(frame: DataFrame, first: float, second: float, names: tuple[str, str] = ("default", "tuned")) -> DataFrame:
    """Classes and outcomes of scored rows at two thresholds, side by side."""
    out = frame
    for name, t in zip(names, (first, second), strict=True):
        out = out.withColumn(f"y_pred_{name}", at_threshold("score", t))
        out = out.withColumn(f"outcome_{name}", outcome("y_true", f"y_pred_{name}"))
    return out


def split_objective(frame: DataFrame, ratios: Mapping[str, float], group: str = "source_group") -> DataFrame:
    """One row, objective: how far the splits are from their shares of strata, of rows (weight 0.35) and of groups (0.05).

    Each part is a mean of squared errors relative to the target, at least one.
    """
    spark = frame.sparkSession
    shares = F.broadcast(spark.createDataFrame(list(ratios.items()), "split string, share double"))
    square = lambda n: F.pow((F.coalesce(n, F.lit(0)) - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0)), 2)
    cells = frame.groupBy("split", "surface", "label").agg(F.count("*").alias("n"))
    strata = frame.groupBy("surface", "label").agg(F.count("*").alias("whole"))
    by_stratum = strata.crossJoin(shares).join(cells, ["split", "surface", "label"], "left").withColumn("target", F.col("whole") * F.col("share")).agg(F.avg(square(F.col("n"))).alias("a"))
    totals = frame.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct(group).alias("g"))
    whole = frame.agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups"))
    each = shares.join(totals, "split", "left").crossJoin(F.broadcast(whole))
    by_rows = each.withColumn("target", F.col("rows") * F.col("share")).agg(F.avg(square(F.col("n"))).alias("b"))
    by_groups = each.withColumn("target", F.col("groups") * F.col("share")).agg(F.avg(square(F.col("g"))).alias("c"))
    return by_stratum.crossJoin(by_rows).crossJoin(by_groups).select((F.col("a") + 0.35 * F.col("b") + 0.05 * F.col("c")).alias("objective"))


def synthetic_manifest(spark, surfaces: Sequence[str], groups: int, patches: int) -> DataFrame:
    """A made-up set: every surface, both labels, ``groups`` groups each with ``patches`` rows."""
    n = len(surfaces) * 2 * groups * patches
    i = F.col("id")
    surface = F.element_at(F.array(*[F.lit(s) for s in surfaces]), (F.floor(i / (2 * groups * patches)) + 1).cast("int"))
    label = (F.floor(i / (groups * patches)) % 2).cast("bigint")
    group = F.lpad(F.floor(i / patches).cast("string"), 4, "0")
    path = F.concat_ws("/", surface, F.concat(F.when(label == 1, "C").otherwise("U"), surface), F.concat(group, F.lit("-"), (i % patches).cast("string"), F.lit(".png")))
    return spark.range(n).select(path.alias("relative_path"), surface.alias("surface"), label.alias("label"), group.alias("source_group"), F.sha2(path.cast("binary"), 256).alias("sha256"))
