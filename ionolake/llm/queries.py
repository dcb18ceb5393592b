"""The registered query of each operator: queries() and oracle_sql() for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, language_id, license_scan, lm_score, near_dedup, packing, pii, prefix_trie, quality, sentencepiece_viterbi, token_counts, topk
from .common import small_batches


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_documents(_documents(spark, sf_dir))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode_documents(_documents(spark, sf_dir)).drop("ids")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licences(_documents(spark, sf_dir))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(_documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the tables are invented: without a key in the session, the example key will do for them
    return pii.scrub_report(_documents(spark, sf_dir), pii.key_of(spark, without=pii.EXAMPLE_KEY))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_language_id": op1_language_id, "op2_topk": op2_topk, "op3_sentencepiece": op3_sentencepiece, "op4_quality": op4_quality, "op5_license_scan": op5_license_scan, "op6_decontaminate": op6_decontaminate, "op7_lm_score": op7_lm_score, "op8_token_counts": op8_token_counts, "op9_pii": op9_pii, "op10_near_dedup": op10_near_dedup, "op11_collocations": op11_collocations, "op12_packing": op12_packing, "op13_prefix_trie": op13_prefix_trie}


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": topk.ORACLE_SQL, "op5_license_scan": license_scan.oracle_sql(), "op11_collocations": collocations.ORACLE_SQL, "op13_prefix_trie": prefix_trie.ORACLE_SQL}
