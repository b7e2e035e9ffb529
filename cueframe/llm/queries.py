"""The registered queries of this subpackage: one thin query for each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, divergence, interaction, itq, linechunks, minhash, packing, pii, quality, retrieval, sharding, urls, warc
from .common import table

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE_50K = "byte_bpe_50k.json"


def op1_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.link(table(spark, sf_dir, "embeddings"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_and_read(spark, table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op5_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op6_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judge(docs, bands=quality.learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "n_chunks", "n_bad_chunks", "kept")


def op8_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linechunks.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), linechunks.RUNS)
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_words", "kept_sha256")



def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE_50K))


QUERIES = {f.__name__: f for f in (op1_disclosure, op2_itq, op3_warc, op4_byte_bpe, op5_hash_tree_shards, op6_linear_grouping, op7_compression_bands, op8_template_tree, op9_bbit_minhash, op10_line_chunks, op11_filter_audit, op12_source_divergence, op13_retrieval_packing)}
ORACLES: dict[str, str] = {"op2_itq": itq.SQL, "op3_warc": warc.SQL, "op9_bbit_minhash": minhash.SQL, "op10_line_chunks": linechunks.SQL, "op11_filter_audit": interaction.SQL, "op12_source_divergence": divergence.SQL}
