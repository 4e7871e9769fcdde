"""Queries over tables that are kept and changed in batches.  They write files, so tests hold them against brute force."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import increments, vacancies
from ..registry import query
from ..session import scratch, shared_folder, table
from ..sources import manifest


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("S16 K10 W12")
def client_states(spark, sf):
    """The last state of every client, merged from its changes in four batches of change_id; earlier changes that come later do not count.

    Rows without a client have one state of their own; deleted clients stay with their op, so that no late change brings them back.
    """
    folder = _folder(spark, "clients")
    rows = table(spark, sf, "client_changes")
    most = rows.agg(F.coalesce(F.max("change_id"), F.lit(0))).first()[0]
    for k in range(4):
        batch = rows.filter(F.coalesce(F.floor(F.col("change_id") * 4 / (most + 1)), F.lit(0)) == k)
        counted = batch.groupBy("client_id").agg(F.count(F.lit(1)).alias("n_changes"))
        last = manifest.latest(batch, ["client_id"], ["seq", "change_id"])
        last = last.join(counted.withColumnRenamed("client_id", "c"), F.col("client_id").eqNullSafe(F.col("c"))).drop("c")
        order = lambda x: F.struct(f"{x}.seq", f"{x}.change_id")
        newer = F.col("new").isNotNull() & (F.col("old").isNull() | (order("new") >= order("old")))
        values = {c: F.when(newer, F.col("new")[c]).otherwise(F.col("old")[c]) for c in last.columns}
        values["n_changes"] = F.coalesce("old.n_changes", F.lit(0)) + F.coalesce("new.n_changes", F.lit(0))
        manifest.merge(last, folder, ["client_id"], values=values, batch=k)
    return manifest.read(spark, folder)


@query("A15 K9 R10")
def vocabulary_increments(spark, sf):
    """The vocabulary after all documents came in three batches, those of one source in four were taken away and all German ones lost their first line.

    The counts are folded after the second batch, and the last batch is handed in twice.
    """
    folder = _folder(spark, "vocabulary")
    told = lambda rows, content: increments.documents(rows.withColumn("content", content), "doc_id", F.col("content"), t.search_tokens(F.col("content")))
    whole = F.coalesce("text", F.lit(""))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    with scratch(spark) as keep:
        docs = keep(manifest.latest(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), ["doc_id"], ["text"]))
        for k in range(3):
            increments.apply_batch(told(docs.filter(part == k), whole), folder, k)
            if k == 1:
                increments.compact(spark, folder)
        gone = gone_source(F.col("source"))
        changes = told(docs.filter(gone | (F.col("lang") == "de")), F.when(~F.coalesce(gone, F.lit(False)), F.regexp_replace(whole, r"^[^\n]*\n?", "")))
        for _ in range(2):
            increments.apply_batch(changes, folder, 3)
    return increments.vocabulary(spark, folder)


def gone_source(source):
    return F.pmod(F.xxhash64(source), F.lit(4)) == 0


def later_text():
    """What a document says when it comes again: every other one without its last line."""
    return F.when(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.regexp_replace("text", r"\n[^\n]*$", "")).otherwise(F.col("text"))


@query("W2 J15 S16")
def vacancy_upserts(spark, sf):
    """All documents as vacancies, and all once more after half of them changed: which ones are duplicates, and of which."""
    folder = _folder(spark, "vacancies")
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    with scratch(spark) as keep:
        # texts travel only if a key comes twice
        if docs.groupBy("source", "doc_id").count().filter("count > 1").limit(1).count():
            docs = keep(manifest.latest(docs, ["source", "doc_id"], ["text"]))
        for k, said in enumerate([F.col("text"), later_text()]):
            rows = docs.withColumn("said", F.coalesce(said, F.lit("")))
            told = vacancies.vacancies(rows, F.col("source"), F.col("doc_id"), F.col("doc_id"), t.fingerprint(F.substring_index("said", "\n", 1), F.col("lang")), t.words(F.col("said"), t.PLAIN), F.sha2("said", 256))
            vacancies.upsert_batch(told, folder, k)
    return manifest.read(spark, f"{folder}/vacancies").drop("content_hash")
