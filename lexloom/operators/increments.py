"""Vocabularies that follow their documents: each batch adds what it changes to the counts, and a daily run folds these.

A folder holds the tokens of every document as a keyed table, one delta of document frequencies for each batch, and
folded counts as versions named after the batch that they reach.  A batch writes its delta first and then its
documents, under its number: until these count, the delta does not, and a batch that is repeated writes the same
delta again or finds its documents there.  Work of a batch grows with the buckets that it touches, not with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from ..sources import manifest, versions
from .vocabulary import idf

KEY = ["id"]
COUNTS = "token string, n long"


def documents(changes: DataFrame, id_col: str, content: Column, tokens: Column) -> DataFrame:
    """id, content_hash, tokens (distinct): what a batch tells of a document; null content takes the document away."""
    there = content.isNotNull()
    return changes.select(F.col(id_col).alias("id"), F.sha2(content, 256).alias("content_hash"), F.when(there, F.array_distinct(tokens)).alias("tokens"))


def delta(before: DataFrame, changes: DataFrame) -> DataFrame:
    """token, n: by how much the frequency of each token changes; the row of a null token has the number of documents.

    changes: one row for each id.  Documents whose content hash is as before are passed over before a token is read.
    Identifiers and hashes meet first; tokens of a side are dealt by identifier only if there are documents to tell apart.
    """
    same_id = F.col("new.id").eqNullSafe(F.col("old.id"))
    same_text = F.col("new.content_hash").eqNullSafe(F.col("old.content_hash"))
    told = lambda rows, name: rows.select("id", "content_hash").alias(name)
    met, same = told(changes, "new").join(told(before, "old"), same_id).agg(F.count(F.lit(1)), F.count_if(same_text)).first()
    new = changes.alias("new").join(told(before, "old"), same_id & same_text, "left_anti") if same else changes
    old = before.alias("old").join(told(changes, "new"), same_id & ~same_text, "left_semi") if met > same else before.limit(0)
    # the null that each side adds stands for the document itself
    side = lambda rows, sign: rows.filter("tokens IS NOT NULL").select(F.explode(F.array_append(F.array_compact("tokens"), F.lit(None))).alias("token"), F.lit(sign).cast("long").alias("n"))
    return side(old, -1).union(side(new, 1)).groupBy("token").agg(F.sum("n").alias("n")).filter("n != 0")


def apply_batch(changes: DataFrame, folder: str, batch: int, buckets: int = 64) -> bool:
    """Take in a batch (from 0, rising) of ``documents`` rows, one for each id; False if it is in already."""
    _, held = manifest.current(f"{folder}/documents")
    if held and held["batch"] is not None and batch <= held["batch"]:
        return False
    with scratch(changes.sparkSession) as keep:
        changes = keep(changes)
        delta(manifest.near(changes, f"{folder}/documents"), changes).write.mode("overwrite").parquet(f"{folder}/deltas/{batch}")
        manifest.merge(changes, f"{folder}/documents", KEY, drop=F.col("new").isNotNull() & F.col("new.tokens").isNull(), buckets=buckets, batch=batch, written=True)
    return True


def frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """token, n: the folded counts and the deltas after them that count."""
    _, held = manifest.current(f"{folder}/documents")
    last = -1 if not held else held["batch"]
    folded = versions.versions(spark, f"{folder}/counts")
    reach = folded[-1] if folded else 0  # version v holds the batches before v
    parts = [f"{folder}/counts/v{reach}"] * bool(folded) + [f"{folder}/deltas/{b}" for b in _batches(spark, folder, reach, last)]
    rows = spark.read.schema(COUNTS).parquet(*parts) if parts else spark.createDataFrame([], COUNTS)
    return rows.groupBy("token").agg(F.sum("n").alias("n")).filter("n != 0")


def _batches(spark: SparkSession, folder: str, first: int, last: int) -> list[int]:
    fs, path = versions._files(spark, f"{folder}/deltas")
    names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n) for n in names if n.isdecimal() and first <= int(n) <= last)


def compact(spark: SparkSession, folder: str) -> int | None:
    """Fold all deltas that count into one version; the number of batches that it holds, None before the first batch."""
    _, held = manifest.current(f"{folder}/documents")
    if not held:
        return None
    return versions.replace(frequencies(spark, folder), f"{folder}/counts", held["batch"] + 1)


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """As ``vocabulary.vocabulary`` over all documents that are there: token, df, documents, idf, unknown_idf."""
    counts = frequencies(spark, folder)
    n = counts.filter("token IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).scalar()
    seen = counts.filter("token IS NOT NULL AND n > 1").select("token", F.col("n").alias("df")).withColumn("documents", n)
    return seen.select("token", "df", "documents", idf(F.col("documents"), F.col("df")).alias("idf"), idf(F.col("documents"), F.lit(1)).alias("unknown_idf"))
