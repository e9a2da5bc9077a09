"""Confusion matrices, binary metrics and the exact threshold sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalith.functions.scalar import at_threshold, outcome, ratio

#: Score ranges in which the sweep's prefix sums run side by side.
SWEEP_RANGES = 1024


def confusion(pred: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """tn, fp, fn, tp of (y_true, score), for each combination of ``keys``; one aggregate, absent classes are zero."""
    hit = at_threshold("score", threshold)
    count = lambda t, p: F.count_if((F.col("y_true") == t) & (hit == p))
    return pred.groupBy(*keys).agg(count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(1, 1).alias("tp"))


def _class(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    return ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)


def binary_metrics(pred: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """Accuracy, precision, recall, F1 and support by class, macro averages and the row-normalised matrix.

    Each ratio is one division of integers, so that equal ratios are equal
    doubles in every engine.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    p1, r1, f1 = _class(tp, fp, fn)
    p0, r0, f0 = _class(tn, fn, fp)
    n = tn + fp + fn + tp
    m = confusion(pred, threshold, *keys).select(
        *keys,
        "tn",
        "fp",
        "fn",
        "tp",
        n.alias("n"),
        ratio(tp + tn, n).alias("accuracy"),
        p0.alias("precision_0"),
        r0.alias("recall_0"),
        f0.alias("f1_0"),
        (tn + fp).alias("support_0"),
        p1.alias("precision_1"),
        r1.alias("recall_1"),
        f1.alias("f1_1"),
        (fn + tp).alias("support_1"),
        ratio(tn, tn + fp).alias("rate_00"),
        ratio(fp, tn + fp).alias("rate_01"),
        ratio(fn, fn + tp).alias("rate_10"),
        ratio(tp, fn + tp).alias("rate_11"),
    )
    return m.withColumns({f"macro_{x}": (F.col(f"{x}_0") + F.col(f"{x}_1")) / 2 for x in ("precision", "recall", "f1")})


def classification_report(pred: DataFrame, threshold: float) -> DataFrame:
    """Five rows: both classes, accuracy, macro and support-weighted averages."""
    m = binary_metrics(pred, threshold)
    weighted = lambda x: ratio(F.col(f"{x}_0") * F.col("support_0") + F.col(f"{x}_1") * F.col("support_1"), F.col("n"))
    row = lambda name, p, r, f, s: F.struct(F.lit(name).alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.alias("support"))
    c = F.col
    rows = [
        row("0", c("precision_0"), c("recall_0"), c("f1_0"), c("support_0")),
        row("1", c("precision_1"), c("recall_1"), c("f1_1"), c("support_1")),
        row("accuracy", c("accuracy"), c("accuracy"), c("accuracy"), c("n")),
        row("macro avg", c("macro_precision"), c("macro_recall"), c("macro_f1"), c("n")),
        row("weighted avg", weighted("precision"), weighted("recall"), weighted("f1"), c("n")),
    ]
    return m.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def prediction_table(pred: DataFrame, threshold: float) -> DataFrame:
    """The rows with threshold, y_pred and outcome."""
    return pred.withColumns({"threshold": F.lit(float(threshold)), "y_pred": at_threshold("score", threshold)}).withColumn("outcome", outcome("y_true", "y_pred"))


def outcome_counts(pred: DataFrame, threshold: float) -> DataFrame:
    return prediction_table(pred, threshold).groupBy("outcome").agg(F.count("*").alias("n"))


def errors_only(pred: DataFrame, threshold: float) -> DataFrame:
    return prediction_table(pred, threshold).where(F.col("outcome").isin("FP", "FN"))


def examples(pred: DataFrame, threshold: float, key: str = "relative_path") -> DataFrame:
    """The clearest example of each outcome: highest score for TP and FP, lowest for TN and FN, ties by path.

    A partial aggregate finds each; an outcome without rows has nulls.
    """
    scored = prediction_table(pred, threshold)
    rank = F.struct(F.when(F.col("outcome").isin("TP", "FP"), -F.col("score")).otherwise(F.col("score")).alias("r"), F.col(key).alias("k"))
    best = scored.groupBy("outcome").agg(F.min_by(F.struct(F.col(key), F.col("score"), F.col("y_true")), rank).alias("b"))
    all_four = scored.sparkSession.createDataFrame([(x,) for x in ("TP", "TN", "FP", "FN")], "outcome string")
    return all_four.join(best, "outcome", "left").select("outcome", F.col(f"b.{key}").alias(key), "b.score", "b.y_true")


def threshold_curve(pred: DataFrame) -> DataFrame:
    """Metrics at every candidate threshold: the distinct scores, 0, 0.5 and 1.

    Counts are aggregated by score first.  Scores are then dealt into fixed
    ranges; a window within a range and the totals of the ranges above (at most
    SWEEP_RANGES + 1 rows, so they are broadcast) add up to the suffix sums, and
    no task sees all scores.  Rows with a null label or a score that is null or
    outside [0, 1] don't count.
    """
    valid = pred.where(F.col("y_true").isin(0, 1) & F.col("score").between(0.0, 1.0) & ~F.isnan("score"))
    extra = pred.sparkSession.createDataFrame([(0.0,), (0.5,), (1.0,)], "threshold double").select("threshold", F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg"))
    by_score = valid.select(F.col("score").cast("double").alias("threshold"), F.col("y_true").cast("bigint").alias("pos"), (1 - F.col("y_true")).cast("bigint").alias("neg")).unionByName(extra)
    by_score = by_score.groupBy("threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).withColumn("rng", F.floor(F.col("threshold") * SWEEP_RANGES).cast("int"))
    totals = by_score.groupBy("rng").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = Window.orderBy(F.desc("rng")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "rng", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p_above"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"), F.sum("p").over(everything).alias("n_pos"), F.sum("n").over(everything).alias("n_neg")
    )
    within = Window.partitionBy("rng").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = by_score.join(F.broadcast(offsets), "rng").select(
        "threshold", (F.sum("pos").over(within) + F.col("p_above")).alias("tp"), (F.sum("neg").over(within) + F.col("n_above")).alias("fp"), "n_pos", "n_neg"
    )
    tp, fp = F.col("tp"), F.col("fp")
    return swept.select(
        "threshold",
        "tp",
        "fp",
        (F.col("n_pos") - tp).alias("fn"),
        (F.col("n_neg") - fp).alias("tn"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, F.col("n_pos")).alias("recall"),
        ratio(2 * tp, tp + fp + F.col("n_pos")).alias("f1"),
    )


def best_threshold(pred: DataFrame) -> DataFrame:
    """The candidate with the highest F1, then recall, then nearest to 0.5, then smallest; by one aggregate."""
    rank = F.struct(F.col("f1"), F.col("recall"), -F.abs(F.col("threshold") - 0.5), -F.col("threshold"))
    return threshold_curve(pred).agg(F.max_by(F.struct("threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1"), rank).alias("b")).select("b.*")


def class_weights(frame: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (2 n_c)."""
    counts = frame.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("total") / (2 * F.col("n"))).alias("weight"))
