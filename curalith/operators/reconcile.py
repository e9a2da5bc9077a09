"""Joins that prove two tables agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.functions.scalar import blank, experiment_rank


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys of both, of the left only, of the right only.  Both are (0, 0) exactly if the key sets agree."""
    tag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    both = tag(left, "l").join(tag(right, "r"), key, "full_outer")
    return both.agg(F.count_if(F.col("l") & F.col("r")).alias("n_both"), F.count_if(F.col("r").isNull()).alias("n_left_only"), F.count_if(F.col("l").isNull()).alias("n_right_only"))


def prediction_coverage(predictions: DataFrame, manifest: DataFrame, key: str = "relative_path") -> DataFrame:
    """Full outer reconciliation: missing and extra keys, differing labels and hashes."""
    p = predictions.select(key, F.col("y_true").alias("p_label"), F.col("sha256").alias("p_sha"), F.lit(True).alias("p"))
    m = manifest.select(key, F.col("label").alias("m_label"), F.col("sha256").alias("m_sha"), F.lit(True).alias("m"))
    both = F.col("p") & F.col("m")
    return p.join(m, key, "full_outer").agg(
        F.count_if(both).alias("n_matched"),
        F.count_if(F.col("p").isNull()).alias("n_missing"),
        F.count_if(F.col("m").isNull()).alias("n_extra"),
        F.count_if(both & ~F.col("p_label").eqNullSafe(F.col("m_label"))).alias("n_label_mismatch"),
        F.count_if(both & ~F.col("p_sha").eqNullSafe(F.col("m_sha"))).alias("n_sha_mismatch"),
    )


def stale_hashes(manifest: DataFrame, group_map: DataFrame, key: str = "relative_path") -> DataFrame:
    """Rows whose hash differs from the map's, where both have one."""
    joined = manifest.select(key, F.col("sha256").alias("observed")).join(group_map.select(key, F.col("sha256").alias("recorded")), key)
    return joined.where(~blank("observed") & ~blank("recorded") & (F.col("observed") != F.col("recorded")))


def with_groups(manifest: DataFrame, group_map: DataFrame, key: str = "relative_path") -> DataFrame:
    """The manifest with the map's groups; raises unless each key is in both exactly once."""
    found = coverage(manifest, group_map, key).first()
    repeated = group_map.groupBy(key).count().where("count > 1").count()
    if found["n_left_only"] or found["n_right_only"] or repeated:
        raise ValueError(f"group map doesn't cover the manifest: {found['n_left_only']} without a group, {found['n_right_only']} unknown, {repeated} repeated")
    return manifest.drop("source_group").join(group_map.select(key, "source_group"), key)


def sorted_experiments(frame: DataFrame, name: str, threshold: str, run: str) -> DataFrame:
    """Adds ``position``: E<number> by number, others last; then name, threshold and run.

    Each group of one rank is numbered on its own and shifted by the rows of
    the ranks before, so no task numbers all rows.
    """
    from pyspark.sql import Window

    ranked = frame.withColumn("rank", experiment_rank(name))
    sizes = ranked.groupBy("rank").count()
    before = sizes.select("rank", F.coalesce(F.sum("count").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("rank").orderBy(name, threshold, run))
    return ranked.join(F.broadcast(before), "rank").select(frame["*"], "rank", (F.col("before") + within).alias("position"))


def consistent_value(*frames: DataFrame, column: str) -> DataFrame:
    """The number of distinct values of a column over several tables; 1 if they agree."""
    union = None
    for f in frames:
        one = f.select(column)
        union = one if union is None else union.unionByName(one)
    return union.agg(F.count_distinct(column).alias("n_values"))


def lookup(frame: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The frame with columns of the other table's row of the same key; null where there is none.  A key that the other table repeats takes its least row."""
    once = other.groupBy(key).agg(F.min(F.struct(*columns)).alias("found"))
    return frame.join(once, key, "left").select(*[frame[c] for c in frame.columns], *[F.col(f"found.{c}").alias(c) for c in columns])


def field_agreement(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, n_different, different): the fields in which two records of a key differ, null-safely; keys of both tables only."""
    l, r = left.alias("l"), right.alias("r")
    off = F.array_compact(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in fields]))
    return l.join(r, F.col(f"l.{key}") == F.col(f"r.{key}")).select(F.col(f"l.{key}").alias(key), F.size(off).cast("bigint").alias("n_different"), F.array_join(off, ",").alias("different"))


def allowed(frame: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose tuple of these columns is a known one."""
    return frame.join(known.select(*columns).distinct(), columns, "left_semi")


def same_set(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """One row: values of both, of the left only, of the right only."""
    return coverage(left, right, column)


def changed_inputs(before: DataFrame, after: DataFrame, key: str = "relative_path", column: str = "sha256") -> DataFrame:
    """(key, change) of what was removed, added or altered between two inventories; empty if nothing was."""
    b, a = before.select(key, F.col(column).alias("b"), F.lit(True).alias("was")), after.select(key, F.col(column).alias("a"), F.lit(True).alias("is"))
    change = F.when(F.col("is").isNull(), "removed").when(F.col("was").isNull(), "added").when(~F.col("a").eqNullSafe(F.col("b")), "altered")
    return b.join(a, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def summary_agreement(stored: DataFrame, again: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(metric, agrees) of two one-row summaries with the same columns."""
    pairs = stored.select(F.struct("*").alias("s")).crossJoin(F.broadcast(again.select(F.struct("*").alias("a"))))
    rows = [F.struct(F.lit(c).alias("metric"), F.coalesce(F.abs(F.col(f"s.{c}") - F.col(f"a.{c}")) <= tolerance, F.lit(False)).alias("agrees")) for c in stored.columns]
    return pairs.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
