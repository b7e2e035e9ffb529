"""A corpus from documents to packed sequences: quality, line dedup, near dedup, personal data, packing.

Each stage takes what its predecessor kept, as Parquet in the shared folder, and all but the last return
the columns of documents, whatever further columns there are and whatever they are called (but for other
columns called doc_id, text or n_chars). An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueframe.llm import linechunks, minhash, packing, pii, quality
from cueframe.llm.common import forget_path, has_table, new_path, private, table
from cueframe.llm.queries import WORD_BPE


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keeping_columns(stage: Stage) -> Stage:
    """The stage on documents whose further columns have names of their own, so that none can clash with an operator's."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = docs.toDF(*[c if c in ("doc_id", "text", "n_chars") else f"further_{i}" for i, c in enumerate(docs.columns)])
        return stage(spark, inner, sf_dir).toDF(*docs.columns)

    return run


@keeping_columns
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the compression bands keep; the bands' limits are learnt from the labels,
    where that table is there, and are the wide ones where it is not. Null and empty texts have no words and go; repeated
    rows are judged alike, each stays or goes with its text."""
    bands = quality.learn(docs, table(spark, sf_dir, "labels")) if has_table(spark, sf_dir, "labels") else quality.Bands()
    return quality.judge(docs, bands=bands).where("kept").select(docs.columns)


@keeping_columns
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier; those of which nothing is left go. Of equal passages the one
    with the smallest doc_id, then place, stays; rows that repeat doc_id and text keep the same lines; a null doc_id
    is left as it is, a null text stays null."""
    out = linechunks.remove_repeats(docs, linechunks.RUNS).where("n_removed_lines < n_lines")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@keeping_columns
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates. Texts without words are in no group and
    stay, as does a null doc_id; rows that repeat the doc_id that stays all stay."""
    (own,) = private(docs, "kept_id")
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


@keeping_columns
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms give way to placeholders. No row goes; null texts stay null."""
    out = pii.find(docs).withColumn("text", pii.redacted(F.col("text"), F.col("all_spans")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens. Each row is packed, a null text as an empty one."""
    return packing.pack(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("quality", good_quality),
    ("line dedup", without_repeated_lines),
    ("near dedup", one_of_each_group),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: Compression, shingle sets and token ids have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            forget_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
