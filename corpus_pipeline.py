"""Corpus pipeline: documents go through the stages in order; each works on all that its predecessor kept.

Stages get and return the columns of documents, the last one returns pieces with their places in
sequences. Rows with a null text or id go through every stage: a null text has no letter, so the
first stage rejects it; a null id is like any other id, but is never linked with a near copy. Of rows
with equal texts one is left by the second stage, also where they repeat ids. Columns of documents
that are named like those an operator adds go through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import exactdedup, langid, neardup, packing, pii
from lamina.llm.queries import VOCABULARY
from lamina.session import saved

#: Below this the language of a text isn't trusted.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages learned; rejected ones have no letter or no language that stands out."""
    named = langid.judged(docs, langid.learn(docs))
    return named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("_row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exactdedup.deduplicated(docs, once=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, on five-word shingles and a similarity of 0.8."""
    gone = neardup.near_duplicates(docs, shingle=5, percent=80).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token pieces in sequences of 4096."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [("language id", language), ("exact dedup", exact), ("near dedup", near), ("personal data", private), ("packing", packed)]

#: The networks, signatures and patterns of the stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
