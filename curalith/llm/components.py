"""Connected components by alternating stars, and tables that cut lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def use_checkpoints(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, a temporary folder on a local master, an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


class Tables:
    """Written tables in the checkpoint folder: a lost executor reads them again, and they go when their round is over."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{use_checkpoints(spark)}/tables-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for f in frames:
            if f is not None and (path := self.paths.pop(id(f), None)):
                remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever the session's file systems keep it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def connected(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b: bigint, no nulls).

    Edges lead from the larger node to the smaller.  In a round each node keeps
    its least neighbour as its parent and links the others to it, and then
    takes its parent's parent; rounds go on until every node has one neighbour
    that has none itself, about log2 of the longest path times and once for
    stars.  A node's neighbours are never collected: their least comes from a
    partial aggregate, so a hub is no burden to one task.  An edge from a node
    to itself, and an empty table, give no rows.  The result is a written table
    of ``tables``.
    """
    tables = tables or Tables(edges.sparkSession)
    links = tables.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        parent = links.groupBy("u").agg(F.min("v").alias("m"))
        above = parent.select(F.col("u").alias("m"), F.col("m").alias("mm"))
        up = parent.join(above, "m", "left").select("u", F.coalesce("mm", "m").alias("v"), F.col("mm").isNotNull().alias("moved"))
        side = links.join(parent, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved"))
        new = tables.put(up.unionByName(side).groupBy("u", "v").agg(F.bool_or("moved").alias("moved")))
        tables.drop(links)
        links = new
        if links.where("moved").isEmpty():
            break
    out = tables.put(links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    tables.drop(links)
    return out
