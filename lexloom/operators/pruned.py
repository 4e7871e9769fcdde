"""Exact top-k cosine by impact-ordered postings, bounds and early stops.

Documents are indexed where they are read, in shards of a bounded number of tokens.  A shard keeps
its postings twice: by term, in falling order of impact (a term's weight over the document's length)
with the largest impact of every block, and by document.  A query's terms are taken in falling order
of the most they can add.  Postings are scanned block by block while they, and the terms to come, could
add more than a small part of the kth score; what is left unscanned bounds every document from above, those
not met at all too.  Documents whose bound reaches the kth score are read whole, best bound first, until the next bound is below it.
The kth score goes from shard to shard inside a task, so later shards are scanned less and less.

No pair of document and query becomes a row: a task sends at most k rows for each query.
Queries go to all tasks and are held there ``PASS`` at a time; the shards are repeated for further passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import vocabulary

#: Tokens of a shard, about; postings of a block; documents read at a time; queries held by a task.
SHARD, BLOCK, READ, PASS = 1 << 20, 64, 64, 2048
#: Part of the kth score that may be left unscanned: more of it, and fewer postings are scanned but more documents read.
SLACK = 0.08
#: Scores are compared to six places, so bounds leave that much room.
ROOM = 1e-6


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """shard, terms, packed: documents (id, tokens) as term counts, in runs of about ``size`` tokens of a partition."""

    def pack(ids: list[pa.Array], lists: list[pa.Array]) -> pa.RecordBatch:
        number = np.concatenate([np.asarray(x, np.int64) for x in ids])
        held = pa.concat_arrays(lists)
        counts = np.asarray(held.value_lengths().fill_null(0), np.int64)
        coded = held.flatten().dictionary_encode()
        codes, terms = np.asarray(coded.indices, np.int64), coded.dictionary
        key, n = np.unique(np.repeat(np.arange(len(counts)), counts) * max(1, len(terms)) + codes, return_counts=True)
        packed = [number.tobytes(), (key // max(1, len(terms))).astype(np.int32).tobytes(), (key % max(1, len(terms))).astype(np.int32).tobytes(), n.astype(np.float64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([terms], pa.list_(pa.string())), pa.array([packed], pa.list_(pa.binary()))], names=["terms", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists, tokens = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # a batch may hold more than a shard
                part = batch.slice(at, 256)
                ids.append(part.column(0))
                lists.append(part.column(1))
                tokens += len(part.column(1).flatten())
                if tokens >= size:
                    yield pack(ids, lists)
                    ids, lists, tokens = [], [], 0
        if ids:
            yield pack(ids, lists)

    known = docs.select(F.col("id").cast("long").alias("id"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).filter("id IS NOT NULL")
    return known.mapInArrow(run, "terms array<string>, packed array<binary>").withColumn("shard", F.monotonically_increasing_id())


def with_weights(shards: DataFrame, words: DataFrame | None) -> DataFrame:
    """Each shard's terms with their weights (1 without a vocabulary); a term of a shard is looked up once, however many documents hold it."""
    if words is None:
        return shards.withColumn("idf", F.transform("terms", lambda x: F.lit(1.0)))
    each = shards.select("shard", F.posexplode("terms").alias("place", "token")).join(words.select("token", "idf"), "token", "left")
    each = each.withColumn("w", F.coalesce("idf", words.agg(F.max("unknown_idf")).scalar(), F.lit(1.0)))
    found = each.groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "w"))), lambda x: x["w"]).alias("idf"))
    return shards.join(found, "shard", "left").withColumn("idf", F.coalesce("idf", F.array().cast("array<double>")))


class Shard:
    """Postings by term in falling impact with block maxima, and by document."""

    def __init__(self, terms: list[str], idf: np.ndarray, packed: list[bytes]):
        self.ids, docs, codes, n = (np.frombuffer(x, k) for x, k in zip(packed, (np.int64, np.int32, np.int32, np.float64), strict=True))
        weight = n * idf[codes] if len(codes) else n
        length = np.sqrt(np.bincount(docs, weight * weight, len(self.ids)))
        impact = weight / length[docs]
        self.place = {x: k for k, x in enumerate(terms)}
        self.doc_codes, self.doc_impacts, self.doc_begins = codes, impact, np.searchsorted(docs, np.arange(len(self.ids) + 1))
        order = np.lexsort((-impact, codes))
        self.docs, self.impacts, self.begins = docs[order], impact[order], np.searchsorted(codes[order], np.arange(len(terms) + 1))
        self.dense = np.zeros(len(terms))
        self.read = self.scanned = 0

    def cut(self, term: int, least: float) -> int:
        """End of the blocks of a term that hold an impact of ``least`` or more."""
        begin, end = self.begins[term], self.begins[term + 1]
        maxima = self.impacts[begin:end:BLOCK]
        return min(int(begin) + int(np.searchsorted(-maxima, -least, side="right")) * BLOCK, int(end))

    def exact(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of some documents under the query that ``dense`` holds."""
        self.read += len(docs)
        begins, ends = self.doc_begins[docs], self.doc_begins[docs + 1]
        size = ends - begins
        at = np.arange(size.sum()) + np.repeat(begins - np.append(0, np.cumsum(size)[:-1]), size)
        return np.bincount(np.repeat(np.arange(len(docs)), size), self.dense[self.doc_codes[at]] * self.doc_impacts[at], len(docs))

    def best(self, query: list[tuple[str, float]], best: Best) -> None:
        known = [(self.place[x], share) for x, share in query if x in self.place and share > 0]
        most = np.array([share * self.impacts[self.begins[c]] for c, share in known])
        order = np.argsort(-most, kind="stable")
        after = np.append(np.cumsum(most[order][::-1])[::-1], 0.0)  # the most that the terms from here on can add
        need, missing = best.least() - ROOM, 0.0
        slack, scores = SLACK * max(0.0, need), np.zeros(len(self.ids))
        for k, n in enumerate(order.tolist()):
            if missing + after[k] <= slack:  # the rest of the terms can be left
                missing += after[k]
                break
            term, share = known[n]
            begin, stop = int(self.begins[term]), self.cut(term, slack / len(order) / share)
            self.scanned += stop - begin
            scores[self.docs[begin:stop]] += share * self.impacts[begin:stop]
            if stop < self.begins[term + 1]:
                missing += share * self.impacts[stop]
        left = np.flatnonzero((scores > 0) & (scores + missing >= need))
        if not len(left):
            return
        left = left[np.lexsort((self.ids[left], -scores[left]))]
        codes = [c for c, _ in known]
        self.dense[codes] = [share for _, share in known]
        for at in range(0, len(left), READ):
            part = left[at : at + READ]
            if scores[part[0]] + missing < best.least() - ROOM:
                break
            best.add(self.ids[part], self.exact(part))
        self.dense[codes] = 0.0


class Best:
    """The k best (score to six places, then the smaller id) so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0)

    def least(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else 0.0

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.append(self.ids, ids), np.append(self.scores, scores)
        order = np.lexsort((ids, -np.floor(scores * 1e6 + 0.5)))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


def top_cosine(docs: DataFrame, queries: DataFrame, k: int, words: DataFrame | None = None, shard: int = SHARD, at_once: int = PASS) -> DataFrame:
    """query_id, rank, id, cosine (six places): the k most similar documents of each query, ties to the smaller id.

    docs, queries: id, tokens; ids are whole numbers.  A pair that shares no token is no result.
    """
    spark = docs.sparkSession
    indexed = with_weights(cut_lineage(shards(docs, shard)), words)
    asked = vocabulary.weighted(vocabulary.term_counts(queries, "id", F.col("tokens")), words)
    asked = cut_lineage(asked.groupBy("id").agg(F.collect_list(F.struct("token", "weight")).alias("x"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size")))
    tasks, passes = int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, -(-asked.count() // at_once))
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    turn = F.pmod(F.xxhash64("id"), F.lit(passes)).cast("int")
    none = F.lit(None).cast("array<binary>")
    # every task meets all queries, and the queries of a pass stand before its shards
    told = asked.select(many(tasks).alias("task"), turn.alias("turn"), F.lit(0).alias("later"), F.col("id").cast("long").alias("number"), F.col("x.token").alias("terms"), F.transform("x", lambda x: x["weight"] / F.col("size")).alias("idf"), none.alias("packed"))
    dealt = indexed.select(F.pmod(F.xxhash64("shard"), F.lit(tasks)).cast("int").alias("task"), many(passes).alias("turn"), F.lit(1).alias("later"), F.col("shard").alias("number"), "terms", "idf", "packed")
    met = told.unionByName(dealt).repartition(tasks, "task").sortWithinPartitions("task", "turn", "later", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def answers():
            for number, (_, best) in held.items():
                if len(best.ids):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.ids), number)), pa.array(best.ids), pa.array(best.scores)], names=["query_id", "id", "cosine"])

        for batch in batches:
            for row in range(batch.num_rows):
                x = batch.slice(row, 1)
                task, when, later, number = (x.column(c)[0].as_py() for c in range(4))
                if at != (task, when):
                    yield from answers()
                    at, held = (task, when), {}
                terms, idf = x.column(4)[0].as_py(), np.asarray(x.column(5)[0].values, np.float64)
                if not later:
                    held[number] = list(zip(terms, idf.tolist(), strict=True)), Best(k)
                    continue
                here = Shard(terms, idf, x.column(6)[0].as_py())
                for query, best in held.values():
                    here.best(query, best)
        yield from answers()

    found = met.mapInArrow(run, "query_id long, id long, cosine double").withColumn("cosine", F.round("cosine", 6))
    return vocabulary.top_k(found, "query_id", k, F.desc("cosine"), F.col("id")).select("query_id", "rank", "id", "cosine")
