"""Connected components of groups that share a hash, by minimum labels over a bipartite graph."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the session's spark.checkpoint.dir; where it is unset, a temporary folder on a local master, an error on a cluster."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def components(frame: DataFrame, group: str, value: str) -> DataFrame:
    """(group, component): groups that share a value are linked; the component is its smallest group.

    Each round, a value takes the least label of its groups and a group the
    least of its values' labels and of its label's own label, which shortens
    long chains; rounds go on until no label changes.  Labels are cut from
    their lineage in the checkpoint folder.  Values are never collected, and
    each aggregate has a partial one before the shuffle.
    """
    ensure_checkpoints(frame.sparkSession)
    edges = frame.select(F.col(group).alias("g"), F.col(value).alias("v")).where("g is not null").distinct().checkpoint()
    labels = edges.groupBy("g").agg(F.first("g").alias("label")).checkpoint()
    shared = edges.where("v is not null and v <> ''")
    while True:
        of_value = shared.join(labels, "g").groupBy("v").agg(F.min("label").alias("label"))
        near = shared.join(of_value, "v").groupBy("g").agg(F.min("label").alias("near"))
        step = labels.join(near, "g", "left").select("g", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("g").alias("label"), F.col("label").alias("further"))
        new = step.join(jump, "label", "left").select("g", "was", F.least("label", "further").alias("label")).checkpoint()
        changed = new.where("was <> label").limit(1).count()
        labels = new.select("g", "label")
        if not changed:
            return labels.select(F.col("g").alias(group), F.col("label").alias("component"))
