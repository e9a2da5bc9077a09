"""The corpus pipeline: five stages over ``documents``, each an operator of ``curalith.llm``.

1. language: null texts, texts without a letter (``und``) and texts for which
   no learned language has half of the posterior go.  On texts of more than a
   few words the posterior is nearly always about 1, so of those hardly any go.
2. lines: lines that at least ten of the remaining documents share go.
3. near_duplicates: of each group of near duplicates (five-word shingles,
   similarity of 0.8 or more) the document with the smallest id stays.
4. repeats: bytes of strings of 50 bytes that an earlier document has go.
5. packing: what is left is packed into sequences of at most 4096 tokens.

A stage works on what its predecessor has kept and written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curalith.llm import bpe, langid, line_dedup, ngram_join, packing, suffix_dedup
from curalith.llm.components import remove, use_checkpoints
from curalith.llm.queries import PIECES, VOCABULARY

#: Posterior under which a text counts as being in no one language.
CERTAIN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language.  Null texts and texts without a letter go: they have none."""
    return langid.keep_certain(docs, langid.fit(docs, bpe.vocabulary_path(PIECES)), CERTAIN)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the lines that ten or more rows share; a text may end up empty, a null one stays null."""
    return line_dedup.dedup(docs, carry=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each group.  Null, empty and wordless texts are near nothing and stay; rows without an id stand for themselves."""
    return ngram_join.representatives(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the bytes that an earlier id's text repeats; a null id is the largest, a null text stays null."""
    return suffix_dedup.dedup(docs, carry=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece; a null or empty text is one piece, the end id.  Repeated rows are packed each."""
    return packing.pack_documents(docs, bpe.vocabulary_path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("packing", pack),
]

#: No SQL expresses the language stage or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written in the checkpoint folder and read again.

    A stage's table goes when its successor's is written; the last one stays
    for the result to read.
    """
    folder = f"{use_checkpoints(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
