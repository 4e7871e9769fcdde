"""Vocabularies by batches against full rebuilds, and the queries over stored tables against brute force."""

import random
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from lexloom import registry
from lexloom.functions import text as t
from lexloom.operators import increments, vocabulary
from lexloom.plans.store_plans import gone_source
from lexloom.session import shared_folder
from lexloom.sources import manifest

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def told(rows):
    return increments.documents(rows, "id", F.col("text"), F.split("text", " "))


def rebuilt(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "id int, text string")
    return {tuple(r) for r in vocabulary.vocabulary(rows, F.split("text", " ")).collect()}


def test_batches_equal_a_rebuild(spark, folder):
    """Inserts, changes, deletes, unchanged texts, a null identifier, repeated batches, folding between them."""
    rng, texts = random.Random(3), {}
    for batch in range(4):
        rows = {rng.choice([None, *range(25)]): rng.choice([None, " ".join(rng.choices("abcdefgh", k=4))]) for _ in range(15)}
        rows |= {k: v for k, v in list(texts.items())[:3] if k not in rows}
        texts = {k: v for k, v in (texts | rows).items() if v is not None}
        changes = told(spark.createDataFrame(list(rows.items()), "id int, text string"))
        assert increments.apply_batch(changes, folder, batch, buckets=4)
        assert not increments.apply_batch(changes, folder, batch)
        if batch == 1:
            assert increments.compact(spark, folder) == 2
        assert {tuple(r) for r in increments.vocabulary(spark, folder).collect()} == rebuilt(spark, texts)


def test_a_batch_that_broke_off(spark, folder, monkeypatch):
    """Its delta is there, its documents are not: nothing counts, and the same batch comes in whole later."""
    first, second = {1: "a b", 2: "a"}, {2: "b", 3: "a b"}
    rows = lambda x: told(spark.createDataFrame(list(x.items()), "id int, text string"))
    increments.apply_batch(rows(first), folder, 0)
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(manifest, "merge", lambda *a, **k: (_ for _ in ()).throw(OSError()))
        increments.apply_batch(rows(second), folder, 1)
    assert {tuple(r) for r in increments.vocabulary(spark, folder).collect()} == rebuilt(spark, first)
    assert increments.apply_batch(rows(second), folder, 1)
    assert {tuple(r) for r in increments.vocabulary(spark, folder).collect()} == rebuilt(spark, first | second)


def test_the_delta_passes_over_unchanged_texts(spark):
    rows = told(spark.createDataFrame([(1, "a b b"), (2, "a")], "id int, text string"))
    later = told(spark.createDataFrame([(1, "a b b"), (2, "c"), (3, ""), (4, None)], "id int, text string"))
    assert {tuple(r) for r in increments.delta(rows, later).collect()} == {("a", -1), ("c", 1), ("", 1), (None, 1)}


def test_empty(spark, folder):
    assert increments.compact(spark, folder) is None and increments.vocabulary(spark, folder).collect() == []
    increments.apply_batch(told(spark.createDataFrame([], "id int, text string")), folder, 0)
    assert increments.vocabulary(spark, folder).collect() == []


def test_vocabulary_increments(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").filter(~F.coalesce(gone_source(F.col("source")), F.lit(False)))
    cut = F.when(F.col("lang") == "de", F.regexp_replace("text", r"^[^\n]*\n?", "")).otherwise(F.col("text"))
    want = {tuple(r) for r in vocabulary.vocabulary(docs.withColumn("text", F.coalesce(cut, F.lit(""))), t.search_tokens(F.col("text"))).collect()}
    assert want and {tuple(r) for r in registry.QUERIES["vocabulary_increments"](spark, DIR).collect()} == want


def test_client_states(spark):
    """The change with the highest (seq, change_id) of each client, and how many there were."""
    got = {r["client_id"]: r.asDict() for r in registry.QUERIES["client_states"](spark, DIR).collect()}
    cur = duckdb.execute(f"SELECT * FROM '{DIR}/client_changes.parquet'")
    names = [d[0] for d in cur.description]
    groups = {}
    for r in cur.fetchall():
        row = dict(zip(names, r, strict=True))
        groups.setdefault(row["client_id"], []).append(row)
    low = lambda x: (x is not None, x if x is not None else 0)
    assert got.keys() == groups.keys()
    for k, rows in groups.items():
        last = max(rows, key=lambda r: (low(r["seq"]), low(r["change_id"])))
        assert got[k]["n_changes"] == len(rows)
        assert all(got[k][c] == last[c] or got[k][c] != got[k][c] for c in names), k
