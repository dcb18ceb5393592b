"""The corpus pipeline: documents of a known language, one of each near-duplicate class, without benchmark passages, with PII as pseudonyms, encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder and reads it back as the next stage's docs. The stages
but the last return the columns of documents, further ones included; the last returns doc_id, source, lang, ids, n_tokens, n_bytes and round_trip. Every stage takes an empty table, nulls in any column and texts of
any length, which none of them cuts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionolake.llm import decontaminate, language_id, near_dedup, pii, sentencepiece_viterbi
from ionolake.llm.common import fold_of, materialise, small_batches

#: A document goes if its text has no letter, or no language of the model reaches this score.
LEAST_SCORE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model can tell; the labelled documents outside the held-out fold train it. Null and empty texts and texts without a letter go; each row is judged by itself, repeated or not."""
    small_batches(spark)
    model = language_id.train(docs, F.coalesce(fold_of("doc_id") != 0, F.lit(False)))
    told = language_id.identify(docs, model, "_lang_pred", "_score")
    return told.where((F.col("_lang_pred") != "und") & (F.col("_score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class. Of equal rows one stays; texts of one doc_id that are no copies of each other stay; texts without words are classes of their own, and rows of null doc_id all stay."""
    small_batches(spark)
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; each row is judged by itself."""
    small_batches(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with PII as format-preserving pseudonyms by the session's key (spark.ionolake.pii.secret; the example key, named here, without: the tables are invented); n_chars follows the text. A null text stays null."""
    small_batches(spark)
    done = pii.scrub_documents(docs, pii.key_of(spark, without=pii.EXAMPLE_KEY), spans=None)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as SentencePiece ids, row by row. A null text has null ids, an empty one none."""
    small_batches(spark)
    return sentencepiece_viterbi.encode_documents(docs, keep=("source", "lang"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pseudonyms),
    ("sentencepiece", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs


#: The stages' models and signatures have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
