"""Epoch journals and latency samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curalith.functions.scalar import close


def keep_last(journal: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``, by one aggregate."""
    rest = [c for c in journal.columns if c not in keys]
    return journal.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def conflicting_epochs(journal: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys whose repeated rows differ in a column."""
    return journal.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*columns)).alias("n_values")).where("n_values > 1")


def global_epochs(history: DataFrame, run: str, phases: list[str]) -> DataFrame:
    """Adds phase_epoch and global_epoch (from 1), phases in the given order."""
    ordinal = F.array_position(F.array(*[F.lit(p) for p in phases]), F.col("phase"))
    phase = Window.partitionBy(run, "phase").orderBy("epoch")
    overall = Window.partitionBy(run).orderBy("phase_ordinal", "epoch")
    out = history.withColumn("phase_ordinal", ordinal)
    return out.select(history["*"], F.row_number().over(phase).alias("phase_epoch"), F.row_number().over(overall).alias("global_epoch"))


def best_epochs(history: DataFrame, run: str) -> DataFrame:
    """Per run: the first epoch with the least val_loss, that loss, and the epochs since."""
    best = history.groupBy(run).agg(F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"), F.min("val_loss").alias("best_loss"), F.count("*").alias("n_epochs"), F.max("epoch").alias("last_epoch"))
    after = history.join(best.select(run, "best_epoch"), run).groupBy(run).agg(F.count_if(F.col("epoch") > F.col("best_epoch")).alias("early_wait"))
    return best.join(after, run)


def learning_rate_changes(history: DataFrame, run: str, rate: str = "learning_rate") -> DataFrame:
    """Per run: number of changes (relative tolerance 1e-12) and epochs since the last."""
    order = Window.partitionBy(run).orderBy("epoch")
    before = F.lag(rate).over(order)
    marked = history.select(run, "epoch", F.row_number().over(order).alias("at"), (before.isNotNull() & ~close(F.col(rate), before, 1e-12, 0.0)).alias("changed"))
    return marked.groupBy(run).agg(F.count_if("changed").alias("n_changes"), (F.max("at") - F.coalesce(F.max(F.when(F.col("changed"), F.col("at"))), F.lit(1))).alias("reduce_wait"))


def concatenated(head: DataFrame, tail: DataFrame) -> DataFrame:
    """UNION ALL of two phases; columns that one lacks are null."""
    return head.withColumn("phase", F.lit("head")).unionByName(tail.withColumn("phase", F.lit("fine_tune")), allowMissingColumns=True)


def winner(runs: DataFrame, loss: str, key: str) -> DataFrame:
    """The run with the least loss, ties by key."""
    return runs.agg(F.min_by(F.struct(key, loss), F.struct(loss, key)).alias("w")).select("w.*")


def latency(samples: DataFrame, value: str, target: float, *keys: str) -> DataFrame:
    """n, mean, median, p50, p95 (linear interpolation), least, greatest and whether p95 meets the target."""
    out = samples.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean_ms"),
        F.median(value).alias("median_ms"),
        F.percentile(value, 0.5).alias("p50_ms"),
        F.percentile(value, 0.95).alias("p95_ms"),
        F.min(value).alias("min_ms"),
        F.max(value).alias("max_ms"),
    )
    return out.withColumn("target_met", F.col("p95_ms") <= target)
