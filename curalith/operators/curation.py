"""Duplicates, label conflicts and what curation leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.functions.scalar import blank


def duplicate_groups(frame: DataFrame, column: str = "sha256") -> DataFrame:
    """Values that more than one row has, with their number of rows; blank values don't count."""
    return frame.where(~blank(column)).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_summary(frame: DataFrame, column: str = "sha256") -> DataFrame:
    """One row: groups, rows in groups."""
    return duplicate_groups(frame, column).agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def largest_duplicates(frame: DataFrame, column: str = "sha256", limit: int = 20) -> DataFrame:
    """A report's first ``limit`` groups by descending size, then value."""
    return duplicate_groups(frame, column).orderBy(F.desc("n"), column).limit(limit)


def conflicting_hashes(frame: DataFrame, column: str = "sha256", label: str = "label") -> DataFrame:
    """Values whose rows have more than one label.  Labels are two at most, so least and greatest tell; partial aggregates suffice."""
    found = frame.where(~blank(column)).groupBy(column).agg(F.min(label).alias("low"), F.max(label).alias("high"), F.count("*").alias("n"))
    return found.where("low <> high").select(column, "n")


def conflict_rows(frame: DataFrame) -> DataFrame:
    """The rows of conflicting hashes with the group's size and labels."""
    groups = frame.where(~blank("sha256")).groupBy("sha256").agg(F.count("*").alias("hash_group_row_count"), F.array_join(F.array_sort(F.collect_set("label")), "|").alias("conflicting_labels"), F.min("label").alias("low"), F.max("label").alias("high"))
    bad = groups.where("low <> high").drop("low", "high")
    return frame.join(bad, "sha256").select(
        F.col("sha256").alias("exact_sha256"), "relative_path", "label", "surface", "source_group", "hash_group_row_count", "conflicting_labels", F.lit("exact_hash_label_conflict").alias("exclusion_reason")
    )


def conflict_detail(frame: DataFrame) -> DataFrame:
    """One row for each conflicting hash: its size, labels and least path."""
    found = conflict_rows(frame)
    return found.groupBy("exact_sha256").agg(F.count("*").alias("n"), F.min("conflicting_labels").alias("labels"), F.min("relative_path").alias("first_path"), F.max("relative_path").alias("last_path"))


def curated(frame: DataFrame) -> DataFrame:
    """The rows whose hash has no conflict."""
    return frame.join(conflicting_hashes(frame).select("sha256"), "sha256", "left_anti").select(frame.columns)


def curation_counts(frame: DataFrame) -> DataFrame:
    """Totals before and after in one aggregate; which rows go is marked by one join."""
    bad = conflicting_hashes(frame).select("sha256", F.lit(True).alias("bad"))
    marked = frame.join(bad, "sha256", "left").withColumn("goes", F.coalesce("bad", F.lit(False)))
    stays = ~F.col("goes")
    return marked.agg(
        F.count("*").alias("parent_rows"),
        F.count_if(F.col("goes")).alias("excluded_rows"),
        F.count_if(stays).alias("curated_rows"),
        F.count_distinct(F.when(F.col("goes"), F.col("sha256"))).alias("conflicting_hashes"),
        F.count_if(F.col("label") == 0).alias("parent_label_0"),
        F.count_if(F.col("label") == 1).alias("parent_label_1"),
        F.count_if(stays & (F.col("label") == 0)).alias("curated_label_0"),
        F.count_if(stays & (F.col("label") == 1)).alias("curated_label_1"),
        F.count_distinct("source_group").alias("parent_groups"),
        F.count_distinct(F.when(stays, F.col("source_group"))).alias("curated_groups"),
    )


def partition_check(parent: DataFrame, kept: DataFrame, excluded: DataFrame, key: str = "relative_path") -> DataFrame:
    """Proof that ``kept`` and ``excluded`` partition ``parent``: overlap, missing and extra keys, each 0 if they do."""
    side = lambda df, name: df.select(key, F.lit(1).alias(name))
    union = side(parent, "p").unionByName(side(kept, "k"), allowMissingColumns=True).unionByName(side(excluded, "e"), allowMissingColumns=True)
    per = union.groupBy(key).agg(F.count("p").alias("p"), F.count("k").alias("k"), F.count("e").alias("e"))
    return per.agg(F.count_if(F.expr("k > 0 and e > 0")).alias("overlap"), F.count_if(F.expr("p > k + e")).alias("missing"), F.count_if(F.expr("k + e > p")).alias("extra"))


def column_drift(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """For each column the number of common keys whose values differ as text, missing being the empty text."""
    as_text = lambda side, c: F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit(""))
    joined = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"))
    wide = joined.agg(*[F.count_if(as_text("a", c) != as_text("b", c)).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_different")) for c in columns])).alias("r")).select("r.*")


def functional_dependency_violations(frame: DataFrame, determinant: str, dependent: str) -> DataFrame:
    found = frame.where(~blank(determinant)).groupBy(determinant).agg(F.count_distinct(dependent).alias("n_values"))
    return found.where("n_values > 1")


def duplicated(frame: DataFrame, *keys: str) -> DataFrame:
    """The rows with ``is_duplicated``: another row has the same keys (nulls equal nulls)."""
    counts = frame.groupBy(*keys).agg((F.count("*") > 1).alias("is_duplicated"))
    on = [frame[k].eqNullSafe(counts[k]) for k in keys]
    return frame.join(counts, on).select(frame["*"], "is_duplicated")
