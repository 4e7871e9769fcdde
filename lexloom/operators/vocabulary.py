"""Corpus vocabularies and cosine similarities over exploded terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def terms(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """One row for each token of each document: id, token."""
    return docs.select(F.col(id_col).alias("id"), F.explode(tokens).alias("token"))


def term_counts(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """id, token, n; counted before the exchange."""
    return terms(docs, id_col, tokens).groupBy("id", "token").agg(F.count(F.lit(1)).alias("n"))


def idf(documents: Column, seen_in: Column) -> Column:
    return F.log((documents + 1) / (seen_in + 0.5))


def vocabulary(docs: DataFrame, tokens: Column) -> DataFrame:
    """token, idf of tokens in two or more documents; ``unknown_idf`` is the weight of any other.

    Tokens are made distinct inside the row, so only one row for each document and token is
    shuffled, and counts are combined before that.
    """
    n = docs.agg(F.count(F.lit(1)).cast("double")).scalar()
    seen = docs.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    return seen.withColumn("documents", n).select("token", "df", "documents", idf(F.col("documents"), F.col("df")).alias("idf"), idf(F.col("documents"), F.lit(1)).alias("unknown_idf"))


def cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, cosine of all pairs that share a token.  Inputs: id, token, weight."""
    dot = left.select(F.col("id").alias("left_id"), "token", F.col("weight").alias("a")).join(right.select(F.col("id").alias("right_id"), "token", F.col("weight").alias("b")), "token")
    dot = dot.groupBy("left_id", "right_id").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    size = lambda x, name: x.groupBy(F.col("id").alias(f"{name}_id")).agg(F.sum(F.col("weight") * F.col("weight")).alias(f"{name}_size"))
    both = dot.join(size(left, "left"), "left_id").join(size(right, "right"), "right_id")
    return both.select("left_id", "right_id", (F.col("dot") / F.sqrt(F.col("left_size") * F.col("right_size"))).alias("cosine"))


def weighted(counts: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Term weights: counts, or counts times idf (the unknown weight for words not in the vocabulary)."""
    if words is None:
        return counts.select("id", "token", F.col("n").cast("double").alias("weight"))
    joined = counts.join(words.select("token", "idf"), "token", "left").withColumn("unknown", words.agg(F.max("unknown_idf")).scalar())
    return joined.select("id", "token", (F.col("n") * F.coalesce("idf", "unknown", F.lit(1.0))).alias("weight"))


def specificity(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """id, mean idf of the distinct tokens as a part of the unknown weight, in [0, 1]."""
    joined = tokens.distinct().join(words.select("token", "idf"), "token", "left").withColumn("unknown", words.agg(F.max("unknown_idf")).scalar())
    mean = F.avg(F.coalesce("idf", "unknown"))
    return joined.groupBy("id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean / F.max("unknown"))).alias("specificity"))


def top_k(scores: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The k first rows of every group, with their rank; Spark limits groups before the shuffle."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def vocabulary_faults(words: DataFrame) -> DataFrame:
    """Rows that no lookup may use: empty or unnormalized tokens, weights that are not positive, too large, or given twice."""
    twice = F.count(F.lit(1)).over(Window.partitionBy("token")) > 1
    bad = (F.col("token") == "") | (F.col("token") != F.lower(F.trim("token"))) | F.isnan("idf") | (F.col("idf") <= 0) | (F.col("idf") > F.col("unknown_idf") + 1e-12)
    return words.withColumn("twice", twice).filter(bad | F.col("twice") | F.col("token").isNull()).drop("twice")
