"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, html, late, lines, lm, minhash, packing, quality, search, topk, toxicity

#: The vocabulary file that op1 and op4 use.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.bpe_round_trip(docs, TOKENIZER).drop("text"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"  # control strings of a template inside texts
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(chat.as_events(turns.unionByName(more))))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = toxicity.bucket(F.col("doc_id")) % 10 == 0
    scores = lm.score(docs, ~held_out)
    return scores.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lambda c: toxicity.bucket(c) % 5 == 0
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~held_out(F.col("id")))
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.Index(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search.search(index, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late.sales_report(_table(spark, sf_dir, "sales").select("sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_chat": op2_chat,
    "op3_lm": op3_lm,
    "op4_packing": op4_packing,
    "op5_minhash": op5_minhash,
    "op6_html": op6_html,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_lines": op9_lines,
    "op10_topk": op10_topk,
    "op11_quality": op11_quality,
    "op12_search": op12_search,
    "op13_late": op13_late,
}
SQL = {"op2_chat": chat.ORACLE_SQL, "op8_exact_dedup": exact_dedup.ORACLE_SQL, "op10_topk": topk.ORACLE_SQL, "op12_search": search.ORACLE_SQL}
