"""Ranked lexical search against SQL, and against a plain reading of its definition."""

import math
import random
import re
from collections import Counter
from pathlib import Path
from urllib.parse import unquote, urlparse

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexloom.llm import queries, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans(search.UPPER, search.LOWER)))


def expected(docs, items, k=10):
    held = [(i, row, Counter(terms(t))) for row, (i, t) in enumerate(docs) if terms(t)]
    n_docs, length = len(held), sum(sum(c.values()) for *_, c in held)
    df = Counter(t for *_, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, row, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, row, i))
        out += [(item, rank + 1, i, -score) for rank, (score, *_, i) in enumerate(sorted(found, key=lambda x: x[:4])[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(search.ORACLE_SQL).df()[["item_id", "rank", "doc_id", "score"]]
    assert rows(queries.op12_search(spark, sf)) == sorted(want.itertuples(index=False, name=None), key=str)


@pytest.mark.parametrize(("size", "at_once"), [(1 << 20, 4096), (40, 2)])
def test_odd_rows(spark, size, at_once):
    """Nulls, ties, repeated rows and identifiers, no terms, a very long text; small shards and several passes give the same."""
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma2", "Дельта", "é", "x", "42", "日本"]
    texts = [" -\x7f".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    docs = [*enumerate(texts), *[(100 + k, "same same text") for k in range(30)], (200, None), (201, ""), (202, "-- !"), (None, "alpha beta"), (None, None), (7, "x x x"), (7, "x x x"), (300, "alpha " * 30_000)]
    items = [(1, "ALPHA beta beta"), (2, None), (3, ""), (4, "unknown"), (5, "same"), (6, "Дельта, 42; é 日本"), (6, "x"), (None, "gamma2")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, term int").repartition(3)
    q = spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, w string")
    got = search.search(search.Index(d, shard_text=size), q, queries_at_once=at_once)
    assert rows(got) == expected(docs, items)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(search.Index(none), items).count() == 0
    assert search.search(search.Index(some), items.limit(0)).count() == 0
    assert rows(search.search(search.Index(some), items)) == expected([(1, "a b")], [(1, "a")])


def test_impacts_beyond_64_bits():
    tf, n = np.array([1, 3 * 10**9]), np.array([5, 4 * 10**12])
    want = [10**9 * t // (1000 * t + 8 * (25 + 75 * m * 10**9 // 10**13)) for t, m in zip(tf.tolist(), n.tolist(), strict=True)]
    assert search.impacts(tf, n, 10**9, 10**13).tolist() == want


def test_top_keeps_ties():
    scores = np.array([5, 0, 7, 5, 5, 9, -1])
    assert search.top(scores, 3).tolist() == [0, 2, 3, 4, 5]
    assert search.top(scores, 9).tolist() == [0, 2, 3, 4, 5]


def test_files_hold_few_shards(spark):
    """A scan partition of many shards is not one row group, which a writer and a reader would hold whole."""
    docs = spark.createDataFrame([(k, f"some words of text {k}") for k in range(50)], "doc_id long, text string").coalesce(1)
    index = search.Index(docs, shard_text=40)
    held = [pq.ParquetFile(unquote(urlparse(x).path)).metadata.num_rows for x in index.shards.inputFiles()]
    assert sum(held) >= 20 and max(held) <= search.FILE_SHARDS
    items = spark.createDataFrame([(1, "text 7")], "item_id long, text string")
    assert [r.doc_id for r in search.search(index, items, k=2).orderBy("rank").collect()] == [7, 0]


def test_shards_are_dealt_by_number(spark, monkeypatch):
    """As many tasks with rows as were dealt: a hash of their numbers would leave some idle and give others several shares."""
    docs = spark.createDataFrame([(k, f"some words of text {k}") for k in range(50)], "doc_id long, text string")
    ids, local = [], type(docs).sortWithinPartitions

    def seen(df, *cols, **kw):
        out = local(df, *cols, **kw)
        if "packed" in out.columns:
            ids.extend(r[0] for r in out.select(F.spark_partition_id()).distinct().collect())
        return out

    index = search.Index(docs, shard_text=40)
    monkeypatch.setattr(type(docs), "sortWithinPartitions", seen)
    monkeypatch.setattr(search, "shuffle_partitions", lambda _: 13)
    search.search(index, spark.createDataFrame([(1, "text 7")], "item_id long, text string"), k=2).collect()
    assert sorted(ids) == list(range(13))
