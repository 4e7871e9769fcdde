"""Ranked lexical search over document-sharded postings with precomputed integer impacts.

Documents are indexed where they are read: a shard is a run of rows of one scan partition with about
``SHARD_TEXT`` bytes of text, and holds its postings as a compressed sparse matrix: terms, where each
one's postings begin, and the documents of the shard with the term's impact there.  An impact is
``(1000000000 * tf) div (1000 * tf + 8 * m)``, whole numbers that need the corpus's N and L but no
query; so it is worked out once, when the corpus is counted.

Queries go to every shard's task.  Term at a time, the weighted impacts of a term's postings are added
to a dense accumulator over the shard's documents; a partition finds the kth largest score, all
documents at or above it are ordered by score and identifier, and the first k stay.  A task keeps the best
k of its shards for each query, so what is merged grows with the tasks and not with the shards.

Defined results: a null text has no terms; documents without a term are not counted; equal scores by
ascending identifier, a null one last, then by row; rows that repeat an identifier are separate documents,
and items that repeat one separate queries; an item without a known term, or a null one, gives no row; scores of 0 give no row; a very
long text is a shard of its own; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, materialize, shuffle_partitions, slices

K = 10
#: Bytes of text of a shard, about.
SHARD_TEXT = 8 << 20
#: Shards of a file: Parquet's writer and Spark's reader would hold all of a scan partition at once, as it has fewer than they count in.
FILE_SHARDS = 4
#: Queries that a task holds at once; more queries take further passes over the shards.
PASS = 4096
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: UTF-8 bytes outside terms become spaces, upper-case letters lower-case ones; a byte above 127 always belongs to a term.
FOLD = bytes(b if b > 127 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
LATEST = (1 << 63) - 1


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Numbers(dict):
    """Terms numbered as they come."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def _shards(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """One row for each shard: documents with a term, terms, number of postings of each, and packed ids, lengths, begins, documents, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in slices(batch.column(1), size):
                part = batch.slice(first, end - first)
                numbers, found, lengths = Numbers(), [], []
                for text in part.column(1):
                    words = terms_of((text.as_py() or "").encode())
                    lengths.append(len(words))
                    found.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                n = np.array(lengths, np.int64)
                width = max(1, len(n))
                key, tf = np.unique(np.concatenate(found) * width + np.repeat(np.arange(len(n)), n), return_counts=True)
                held = np.bincount(key // width, minlength=len(numbers))
                ids = np.asarray(part.column(0).fill_null(LATEST), np.int64)
                packed = [x.tobytes() for x in (ids, n, np.append(0, np.cumsum(held)), (key % width).astype(np.int32), tf)]
                row = [[first], [int((n > 0).sum())], [int(n.sum())], [[x.decode() for x in numbers]], [held], [packed]]
                kinds = [pa.int64()] * 3 + [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["begin", "n_docs", "n_terms", "terms", "df", "packed"])

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = read.mapInArrow(run, "begin long, n_docs long, n_terms long, terms array<string>, df array<long>, packed array<binary>")
    return out.withColumn("shard", F.monotonically_increasing_id()).drop("begin")


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """Whole-number impacts of postings in documents of n terms; docs and length: of the corpus."""
    if 75 * float(n.max(initial=0)) * docs >= 2.0**62 or 1e9 * float(tf.max(initial=0)) >= 2.0**62:
        tf, n = tf.astype(object), n.astype(object)  # beyond 64 bits Python's integers divide
    m = 25 + 75 * n * docs // max(1, length)
    return (1_000_000_000 * tf // (1000 * tf + 8 * m)).astype(np.int32)  # at most a million


class Index:
    """Shards with their impacts, and the corpus's number of documents and of terms."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_text: int = SHARD_TEXT):
        counted = Table(_shards(docs, id_col, text_col, shard_text), "postings", file_rows=FILE_SHARDS)
        self.docs, self.length = (x or 0 for x in counted.df().agg(F.sum("n_docs"), F.sum("n_terms")).first())
        n_docs, n_terms = self.docs, self.length

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1)
                    ids, n, begins, where, tf = (np.frombuffer(x, k) for x, k in zip(row.column(3)[0].as_py(), (np.int64, np.int64, np.int64, np.int32, np.int64), strict=True))
                    packed = [x.tobytes() for x in (ids, begins, where, impacts(tf, n[where], n_docs, n_terms))]
                    yield pa.RecordBatch.from_arrays([*(row.column(k) for k in range(3)), pa.array([packed], pa.list_(pa.binary()))], names=["shard", "terms", "df", "packed"])

        self.shards = materialize(counted.df().select("shard", "terms", "df", "packed").mapInArrow(weigh, "shard long, terms array<string>, df array<long>, packed array<binary>"), "impacts", FILE_SHARDS)
        counted.drop()

    def weights(self, terms: DataFrame) -> DataFrame:
        """term, w: of the terms asked for that the corpus has."""
        held = self.shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
        df = held.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        share = F.lit(float(2 * self.docs + 2)) / (2 * F.col("df") + 1).cast("double")
        return df.select("term", F.floor(1000 * F.log(share)).cast("long").alias("w"))


class Best:
    """The k best documents of one query so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores, self.rows = k, *(np.zeros(0, np.int64) for _ in range(3))

    def add(self, ids: np.ndarray, scores: np.ndarray, rows: np.ndarray) -> None:
        ids, scores, rows = np.append(self.ids, ids), np.append(self.scores, scores), np.append(self.rows, rows)
        best = np.lexsort((rows, ids, -scores))[: self.k]
        self.ids, self.scores, self.rows = ids[best], scores[best], rows[best]


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the scores above 0 that are at or above the kth largest: k, and all that tie with the last one."""
    some = np.flatnonzero(scores > 0)
    if len(some) <= k:
        return some
    held = scores[some]
    least = held[np.argpartition(held, len(held) - k)[len(held) - k]]
    return some[held >= least]


def search(index: Index, items: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text", queries_at_once: int = PASS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    spark = items.sparkSession
    read = items.select(F.monotonically_increasing_id().alias("query"), F.col(id_col).cast("long").alias("item"), F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(TERM), F.lit(0)).alias("terms"))
    asked = read.select("query", "item", F.explode("terms").alias("term"))
    asked = materialize(asked.groupBy("query", "item", "term").agg(F.count(F.lit(1)).alias("times")), "asked")
    weighed = asked.join(index.weights(asked.select("term").distinct()), "term").select("query", "item", "term", (F.col("times") * F.col("w")).alias("w"))
    queries = weighed.groupBy("query", "item").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("x"))
    passes = max(1, -(-asked.select("query").distinct().count() // queries_at_once))
    tasks = shuffle_partitions(spark)
    # every task meets all queries, and each shard once in each pass; the queries of a pass stand before its shards
    turn = F.pmod(F.xxhash64("query"), F.lit(passes)).cast("int")
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    told = queries.select(many(tasks).alias("task"), turn.alias("turn"), F.lit(0).alias("later"), F.col("query").alias("id"), "item", F.col("x.term").alias("terms"), F.col("x.w").alias("w"), F.lit(None).cast("array<binary>").alias("packed"))
    dealt = index.shards.select(F.pmod(F.xxhash64("shard"), F.lit(tasks)).cast("int").alias("task"), many(passes).alias("turn"), F.lit(1).alias("later"), F.col("shard").alias("id"), F.lit(None).cast("long").alias("item"), "terms", F.lit(None).cast("array<bigint>").alias("w"), "packed")
    # by the number itself, as a hash of it would put the shards of several into one task and leave others idle
    met = told.unionByName(dealt).repartitionById(tasks, F.col("task")).sortWithinPartitions("task", "turn", "later", "id")
    names = ["query", "item", "doc", "score", "shard", "place"]

    def answers(asked: dict) -> Iterator[pa.RecordBatch]:
        for query, (item, _, best) in asked.items():
            if len(best.ids):
                cols = [np.full(len(best.ids), query), pa.array([item] * len(best.ids), pa.int64()), best.ids, best.scores, best.rows >> 32 << 32, best.rows]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                x = batch.slice(row, 1).to_pydict()
                if at != (here := (x["task"][0], x["turn"][0])):
                    yield from answers(held)
                    at, held = here, {}
                if not x["later"][0]:
                    held[x["id"][0]] = x["item"][0], list(zip(x["terms"][0], x["w"][0], strict=True)), Best(k)
                    continue
                ids, begins, where, impact = (np.frombuffer(b, kind) for b, kind in zip(x["packed"][0], (np.int64, np.int64, np.int32, np.int32), strict=True))
                place = {term: n for n, term in enumerate(x["terms"][0])}
                for _, terms, best in held.values():
                    scores = np.zeros(len(ids), np.int64)
                    for term, w in terms:
                        if (n := place.get(term)) is not None:
                            mine = slice(begins[n], begins[n + 1])
                            scores[where[mine]] += w * impact[mine].astype(np.int64)
                    found = top(scores, k)
                    if len(found):
                        best.add(ids[found], scores[found], x["id"][0] + found)
        yield from answers(held)

    found = met.mapInArrow(run, ", ".join(f"{x} long" for x in names))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc", "place")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", F.nullif("doc", F.lit(LATEST)).alias("doc_id"), "score")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM n),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, c GROUP BY term),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), c GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
