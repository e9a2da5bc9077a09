"""The provided tables as manifests, predictions, histories and samples, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _split(k):
    return F.when(k < 70, "train").when(k < 85, "validation").otherwise("test")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a file, its language the surface, its source the group, its id's parity the label."""
    k = (F.substring("source", 4, 9).cast("int") * 37 + 11) % 100
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("relative_path"),
        F.col("lang").alias("surface"),
        (F.col("doc_id") % 2).cast("bigint").alias("label"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.col("source").alias("source_group"),
        F.col("n_chars").alias("file_size_bytes"),
        _split(k).alias("split"),
    )


MANIFEST = """manifest as (
  select concat_ws('/', lang, source, doc_id) as relative_path, lang as surface, (doc_id % 2)::bigint as label, sha256(text) as sha256,
         source as source_group, n_chars as file_size_bytes,
         case when k < 70 then 'train' when k < 85 then 'validation' else 'test' end as split
  from (select *, (cast(substr(source, 4) as int) * 37 + 11) % 100 as k from documents)
)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: purchases and signups are positive, the value the score."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("relative_path"), F.col("event_type").isin("purchase", "signup").cast("int").alias("y_true"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 1000.0)).alias("score"), F.col("event_type").alias("kind")
    )


PREDICTIONS = """pred as (
  select event_id::varchar as relative_path, (event_type in ('purchase', 'signup'))::int as y_true,
         greatest(0.0::double, least(1.0::double, value / 1000.0::double)) as score, event_type as kind
  from events
)"""


def tied_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: returned ones are positive; eleven discounts make the scores tie heavily, with signal added."""
    t = table(spark, sf_dir, "lineitem")
    positive = (F.col("l_returnflag") == "R").cast("int")
    return t.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("relative_path"), positive.alias("y_true"), F.least(F.lit(1.0), F.col("l_discount") * 5.0 + positive * 0.3).alias("score"))


TIED = """pred as (
  select concat_ws('-', l_orderkey, l_linenumber) as relative_path, (l_returnflag = 'R')::int as y_true,
         least(1.0::double, l_discount * 5.0::double + (l_returnflag = 'R')::int * 0.3::double) as score
  from lineitem
)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations: a conversation is a run, a turn an epoch, the text's length the loss, the role the phase."""
    t = table(spark, sf_dir, "conversations")
    return t.select(
        F.col("conv_id").alias("run"), F.col("turn").cast("bigint").alias("epoch"), F.length("text").cast("double").alias("val_loss"), F.when(F.col("turn") % 2 == 0, "head").otherwise("fine_tune").alias("phase"), F.pow(F.lit(0.5), F.floor(F.col("turn") / 2)).alias("learning_rate")
    )


HISTORY = """history as (
  select conv_id as run, turn::bigint as epoch, length(text)::double as val_loss, case when turn % 2 = 0 then 'head' else 'fine_tune' end as phase,
         pow(0.5::double, floor(turn / 2)) as learning_rate
  from conversations
)"""


def allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer: the nation is the group, the market segment the surface, whether the order is filled the label."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.concat_ws("/", "c_mktsegment", F.col("o_orderkey").cast("string")).alias("relative_path"),
        F.col("c_mktsegment").alias("surface"),
        (F.col("o_orderstatus") == "F").cast("bigint").alias("label"),
        F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("sha256"),
        F.col("c_nationkey").cast("string").alias("source_group"),
    )
