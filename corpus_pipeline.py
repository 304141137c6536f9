"""A corpus pipeline of five operators: language, near duplicates, benchmark leaks, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder and reads it
again for the next. Stages keep all columns of their input but the last, which returns the pieces of packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import decontamination, language_id, ngram_join, packing, pii_crf
from cohortspark.llm.common import held_out, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no known language: null texts, texts without a letter, and texts far from every centroid.

    Repeated rows are judged alike and stay as often, very long texts are read whole, an empty table stays empty.
    """
    return language_id.accepted(docs, language_id.fit(docs.where(~held_out(F.col("doc_id")))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest doc_id; texts without words and rows without a doc_id stay.

    Rows that repeat the doc_id which stays all stay, as one document. An empty table stays empty.
    """
    found = ngram_join.near_duplicates(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(found, docs["doc_id"] == found["_gone"], "left_anti")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item; null and empty texts hold none.

    Documents are told apart by the SHA-256 of their text, on which alone the decision depends: rows with repeated or null doc_ids are decided each by its text.
    An empty table stays empty, very long texts are searched whole.
    """
    name = lambda text: F.unhex(F.sha2(text, 256))
    named = docs.select(name(F.col("text")).alias("_text"), "text")
    found = decontamination.decontaminate(named, table(spark, sf_dir, "benchmark"), key="_text").select("_text").distinct()
    return docs.join(found, name(docs["text"]) == found["_text"], "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows the new text.

    Null and empty texts stay as they are; repeated rows become alike and stay as often; very long texts are read whole; an empty table stays empty.
    """
    out = pii_crf.redacted(docs, pii_crf.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences: one row per piece; null and empty texts are pieces of one id, rows without a doc_id keep their pieces."""
    return packing.pack(docs, packing.vocabulary_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("personal_data", personal_data), ("packing", packed)]

#: Tokenisation, fitted models and components have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
