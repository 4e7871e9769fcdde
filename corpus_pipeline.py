"""Corpus preparation: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the
last return the columns of documents, so that a stage can be written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import exact_dedup, minhash, packing, queries, toxicity
from lexloom.llm.common import Table

#: Documents at or above this score are rejected.
REJECT = 0.5


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models accept; the models learn from all labelled rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels), score_col="__toxicity")
    return scored.filter(F.col("__toxicity") < REJECT).select(*docs.columns)


def exact_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs).select(*docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return minhash.drop_near_copies(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their sequence and place."""
    return packing.pack(docs, queries.TOKENIZER)


STAGES = [
    ("toxicity", toxic_out),
    ("exact_dedup", exact_copies_out),
    ("minhash", near_copies_out),
    ("packing", packed),
]

#: The stages are models and searches that SQL has no words for; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written to the shared folder once, and dropped when the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        written = Table(stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        docs, before = written.df(), written
    return STAGES[-1][1](spark, docs, sf_dir)
