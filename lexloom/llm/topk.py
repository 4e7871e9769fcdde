"""Exact top-k search by inner product with vector-approximation files.

Vectors are dealt into blocks of bounded size.  In a block every dimension is cut into
cells, and a vector's approximation is the row of its cell numbers, one byte each.  A block
of queries scans the approximations with one product in single precision, which gives every
score but for a known spread: that of the cells, and that of rounding.  Vectors whose upper bound
is below the kth largest lower bound are out; the exact vectors of the others are read in
falling order of the bound until the kth best exact score is above the next upper bound.
The best of all blocks are merged for each query.

A block of vectors goes to one task once; the blocks of queries stream past it in the
order of an exchange, a bounded number at a time.  Defined results: vectors that are null, or
hold null or non-finite components, and rows without an identifier take no part; vectors of
unequal length are filled up with zeros; rows that repeat an identifier are separate
candidates and queries; ties go to the smaller identifier; a scaled component or a score beyond 64 bits
counts as the nearest 64-bit number; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 64
K = 20
BLOCK = 8192
QUERY_BLOCK = 128
CELLS = 256
#: Exact vectors read at a time.
READ = 64
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and the integer vector floor(scale * x) of every row that takes part."""
    x = F.col("x")
    ok = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.filter(ok & F.col("vec_id").isNotNull()).select("vec_id", F.transform("x", lambda v: F.floor(F.lit(float(scale)) * v)).alias("v"))


class Approximation:
    """Cell numbers of a block's vectors, and the edges of the cells."""

    def __init__(self, codes: np.ndarray, low: np.ndarray, width: np.ndarray):
        self.codes, self.low, self.width = codes, low, width

    @classmethod
    def of(cls, data: np.ndarray, cells: int = CELLS) -> Approximation:
        low, high = data.min(0, initial=0).astype(np.float64), data.max(0, initial=0).astype(np.float64)
        width = np.maximum(np.ceil((high - low + 1) / cells), 1)
        return cls(np.clip((data - low) // width, 0, cells - 1).astype(np.uint8), low, width)

    def scan(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Base (queries x vectors), and for each query what to add for the lower and the upper bounds.

        A cell spans [low + code * width, that + width - 1]; so a bound is the product with the codes, scaled
        by the widths, plus a constant of the query.  Rounding in single precision is part of the bounds.
        """
        step = queries * self.width
        base = step.astype(np.float32) @ self.codes.T.astype(np.float32)
        rounding = np.abs(step).sum(1) * 255 * (queries.shape[1] + 4) * 2.0**-23
        edge = queries @ self.low
        span = self.width - 1
        return base, edge + np.minimum(queries, 0) @ span - rounding, edge + np.maximum(queries, 0) @ span + rounding


def _blocks(rows: DataFrame, block: int, approximate: bool) -> DataFrame:
    """Rows packed in blocks of about ``block``: number, row numbers, identifiers, components, and cell numbers with their edges if asked for."""
    n = max(1, -(-rows.count() // block))

    def run(key, table):
        v = table["v"].combine_chunks()
        sizes = np.asarray(v.value_lengths(), np.int64)
        dim = int(sizes.max(initial=0))
        data = np.zeros((len(sizes), dim), np.int64)
        data[np.arange(dim) < sizes[:, None]] = np.asarray(v.flatten(), np.int64)
        kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if data.size == 0 or (data.min() >= np.iinfo(k).min and data.max() <= np.iinfo(k).max))
        packed = [table["row"].to_numpy().tobytes(), table["vec_id"].to_numpy().tobytes(), data.astype(kind).tobytes()]
        if approximate:
            a = Approximation.of(data)
            packed += [a.codes.tobytes(), a.low.tobytes(), a.width.tobytes()]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "kind": pa.array([np.dtype(kind).str]), "packed": pa.array([packed], pa.list_(pa.binary()))})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
    return materialize(dealt.groupBy("block").applyInArrow(run, "block int, kind string, packed array<binary>"), "vectors")


class Block:
    """A block as it was packed: row numbers, identifiers, integer vectors, and their approximation."""

    def __init__(self, kind: str, packed: list[bytes]):
        self.rows, self.ids = (np.frombuffer(x, np.int64) for x in packed[:2])
        self.data = np.frombuffer(packed[2], kind).reshape(len(self.ids), -1)
        self.most = float(np.abs(self.data.astype(np.float64)).max(initial=0))
        if len(packed) > 3:
            self.approximation = Approximation(np.frombuffer(packed[3], np.uint8).reshape(len(self.ids), -1), *(np.frombuffer(x, np.float64) for x in packed[4:]))
            self.order = np.argsort(self.rows)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Where rows stand in the block; -1 for those of other blocks."""
        at = self.order[np.minimum(np.searchsorted(self.rows[self.order], rows), len(self.rows) - 1)]
        return np.where(self.rows[at] == rows, at, -1)


def search(block: Block, queries: Block, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, the places of its k best vectors in the block, and their scores."""
    dim, n = block.data.shape[1], len(block.ids)
    q = queries.data[:, :dim].astype(np.int64)  # components that the block has not are zeros there
    q = np.pad(q, ((0, 0), (0, dim - q.shape[1])))
    own = block.place(queries.rows)
    # float64 sums are exact below 2**53; beyond that Python's integers are used, on all vectors
    if queries.most * block.most * max(1, dim) >= 2.0**52:
        for m in range(len(q)):
            others = np.flatnonzero(np.arange(n) != own[m])
            scores = block.data[others].astype(object) @ q[m].astype(object) if dim else np.zeros(len(others), object)
            scores = np.array([min(max(int(x), LOWEST), HIGHEST) for x in scores], np.int64)
            best = np.lexsort((block.ids[others], ~scores))[:k]
            yield m, others[best], scores[best]
        return
    q = q.astype(np.float64)
    base, down, up = block.approximation.scan(q)
    mine = np.flatnonzero(own >= 0)
    base[mine, own[mine]] = -np.inf
    most = min(k, n)
    least = np.partition(base, n - most, axis=1)[:, n - most].astype(np.float64)
    for m in range(len(q)):
        left = np.flatnonzero(base[m] >= least[m] + down[m] - up[m]) if np.isfinite(least[m]) else np.flatnonzero(base[m] > -np.inf)
        left = left[np.argsort(-base[m][left], kind="stable")]
        scores = np.zeros(0)
        for at in range(0, len(left), READ):
            if len(scores) >= k and np.partition(scores, len(scores) - k)[len(scores) - k] > base[m][left[at]] + up[m]:
                left = left[:at]
                break
            scores = np.append(scores, block.data[left[at : at + READ]].astype(np.float64) @ q[m])
        best = np.lexsort((block.ids[left], -scores))[:k]
        yield m, left[best], scores[best].astype(np.int64)


def top_k(vectors: DataFrame, is_query: F.Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row for which ``is_query`` (on vec_id) holds."""
    rows = materialize(scaled(vectors, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), "scaled")
    blocks = _blocks(rows, block, True)
    n_blocks = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    # the queries, a small part of the rows, go to every block of vectors, which stands before them there
    queries = _blocks(rows.filter(is_query), query_block, False).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    met = blocks.withColumn("later", F.lit(0)).unionByName(queries.withColumn("later", F.lit(1)))
    met = met.repartition(n_blocks, "block").sortWithinPartitions("block", "later").select("block", "later", "kind", "packed")
    names = ["q_row", "query_id", "vec_id", "row", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = None, -1
        for batch in batches:
            for at in range(batch.num_rows):
                x = batch.slice(at, 1).to_pylist()[0]
                if not x["later"]:
                    held, number = Block(x["kind"], x["packed"]), x["block"]
                elif number == x["block"]:
                    q = Block(x["kind"], x["packed"])
                    out = [(np.full(len(p), q.rows[n]), np.full(len(p), q.ids[n]), held.ids[p], held.rows[p], scores) for n, p, scores in search(held, q, k)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=names)

    found = met.mapInArrow(run, ", ".join(f"{x} long" for x in names))
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
