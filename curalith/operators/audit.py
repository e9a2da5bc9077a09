"""Audit of a split: counts, fractions, dense strata, balance and leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.functions.scalar import blank, ratio
from curalith.schema import EPSILON, LABEL_TOLERANCE, RATIOS, SPLITS, STRATUM_TOLERANCE, SURFACE_TOLERANCE


def counts(frame: DataFrame) -> DataFrame:
    """Per split: rows, groups, fraction of all rows and its deviation from the wanted one."""
    target = F.create_map(*[x for k, v in RATIOS.items() for x in (F.lit(k), F.lit(v))])
    per = frame.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("source_group").alias("n_groups"))
    total = per.agg(F.sum("n_rows").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("split", "n_rows", "n_groups", ratio(F.col("n_rows"), F.col("total")).alias("fraction")).withColumn("deviation", F.abs(F.col("fraction") - F.try_element_at(target, F.col("split"))))


def strata(frame: DataFrame) -> DataFrame:
    """Every split x surface x label with its rows (0 where there are none), and its share of the stratum.

    The grid is made of the distinct values, a few of each; it is no join of rows.
    """
    n = frame.groupBy("split", "surface", "label").agg(F.count("*").alias("n"))
    splits = frame.sparkSession.createDataFrame([(x,) for x in SPLITS], "split string")
    kinds = n.select("surface", "label").distinct()
    grid = F.broadcast(splits).crossJoin(kinds)
    dense = grid.join(n, ["split", "surface", "label"], "left").select("split", "surface", "label", F.coalesce("n", F.lit(0)).alias("n"))
    totals = dense.groupBy("surface", "label").agg(F.sum("n").alias("stratum_total"))
    return dense.join(totals, ["surface", "label"]).select("split", "surface", "label", "n", "stratum_total", ratio(F.col("n"), F.col("stratum_total")).alias("fraction"))


def violations(frame: DataFrame) -> DataFrame:
    """Strata and splits whose fraction is off by more than its tolerance, and empty strata."""
    target = F.create_map(*[x for k, v in RATIOS.items() for x in (F.lit(k), F.lit(v))])
    row = lambda kind, key, n, fraction: F.struct(F.lit(kind).alias("kind"), F.col("split").alias("split"), key.alias("key"), n.alias("n"), fraction.alias("fraction"))
    dense = strata(frame).withColumn("off", F.abs(F.col("fraction") - F.try_element_at(target, F.col("split"))))
    key = F.concat_ws("|", "surface", F.col("label").cast("string"))
    by = dense.where((F.col("n") == 0) | (F.col("off") > STRATUM_TOLERANCE + EPSILON)).select(row("stratum", key, F.col("n"), F.col("fraction")).alias("r"))
    size = counts(frame).where(F.col("deviation") > LABEL_TOLERANCE + EPSILON).select(row("split", F.lit(""), F.col("n_rows"), F.col("fraction")).alias("r"))
    surface = dense.groupBy("split", "surface").agg(F.sum("n").alias("n"), F.sum("stratum_total").alias("t")).withColumn("fraction", ratio(F.col("n"), F.col("t")))
    surface = surface.where(F.abs(F.col("fraction") - F.try_element_at(target, F.col("split"))) > SURFACE_TOLERANCE + EPSILON).select(row("surface", F.col("surface"), F.col("n"), F.col("fraction")).alias("r"))
    return by.unionByName(size).unionByName(surface).select("r.*")


def overlaps(frame: DataFrame, columns: tuple[str, ...] = ("relative_path", "source_group", "sha256")) -> DataFrame:
    """Values that two splits share, counted by column and pair of splits: one pass over (column, value, split).

    A value has three splits at most, so its pairs come from three flags of a partial aggregate.
    """
    long = frame.select("split", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("v"))
    flags = long.where(~blank("v.value")).groupBy("v.column_name", "v.value").agg(*[F.max(F.col("split") == s).alias(s) for s in SPLITS])
    pairs = [(a, b) for i, a in enumerate(SPLITS) for b in SPLITS[i + 1 :]]
    wide = flags.groupBy("column_name").agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    return wide.select("column_name", F.explode(F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(f"{a}|{b}").alias("n_shared")) for a, b in pairs])).alias("r")).select("column_name", "r.*")
