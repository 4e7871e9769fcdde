"""Tables behind a manifest: merges against a replay, failed tasks, racing writers, versions that stay whole."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from lexloom.session import shared_folder
from lexloom.sources import manifest


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


COLS = "k int, seq int, v string"


def held(spark, folder, version=None):
    return sorted(map(tuple, manifest.read(spark, folder, version).collect()), key=str)


def test_merges_equal_a_replay(spark, folder):
    """Null keys, repeated changes, rows that go and come back, buckets that run empty."""
    rng, state = random.Random(5), {}
    for batch in range(4):
        rows = [(rng.choice([None, *range(30)]), 100 * batch + i, rng.choice(["a", "b", "gone", None])) for i in range(25)]
        for k, s, v in rows:
            state[k] = (k, s, v)
        state = {k: r for k, r in state.items() if r[2] != "gone"}
        changes = manifest.latest(spark.createDataFrame(rows, COLS), ["k"], ["seq"])
        assert manifest.merge(changes, folder, ["k"], drop=F.col("new.v") == "gone", buckets=8, batch=batch) == batch + 1
        assert held(spark, folder) == sorted(state.values(), key=str)
    assert manifest.merge(changes, folder, ["k"], batch=3) == 4  # a batch that is repeated
    assert manifest.current(folder)[0] == 4


def test_columns_over_old_and_new(spark, folder):
    manifest.merge(spark.createDataFrame([(1, 1, "first"), (2, 1, "stays")], COLS), folder, ["k"])
    both = F.concat_ws("+", "old.v", "new.v")
    manifest.merge(spark.createDataFrame([(1, 2, "second"), (3, 2, None)], COLS), folder, ["k"], values={"v": F.when(F.col("new").isNull(), F.col("old.v")).otherwise(both)})
    assert held(spark, folder) == [(1, 2, "first+second"), (2, 1, "stays"), (3, 2, "")]
    assert held(spark, folder, 1) == [(1, 1, "first"), (2, 1, "stays")]


def test_only_touched_buckets_are_written(spark, folder):
    manifest.merge(spark.range(200).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("seq"), F.lit("x").alias("v")), folder, ["k"], buckets=16)
    before = {x["name"]: x["bucket"] for x in manifest.current(folder)[1]["files"]}
    manifest.merge(spark.createDataFrame([(7, 2, "y")], COLS), folder, ["k"])
    after = {x["name"]: x["bucket"] for x in manifest.current(folder)[1]["files"]}
    assert len(before) == 16 and len(before.keys() & after.keys()) == 15
    assert sum(x["rows"] for x in manifest.current(folder)[1]["files"]) == 200
    gone = manifest.drop_old(folder, keep=1, age=-60)
    assert gone == [n for n in before if n not in after] and len(held(spark, folder)) == 200


def test_a_failed_job_changes_nothing(spark, folder):
    manifest.merge(spark.createDataFrame([(k, 1, "x") for k in range(20)], COLS), folder, ["k"])
    bad = F.when(F.col("new.k") == 13, F.raise_error("lost").cast("string")).otherwise(F.col("new.v"))
    with pytest.raises(Exception, match="lost"):
        manifest.merge(spark.createDataFrame([(k, 2, "y") for k in range(20)], COLS), folder, ["k"], values={"v": bad})
    with pytest.raises(Exception, match="several changes"):
        manifest.merge(spark.createDataFrame([(1, 2, "y"), (1, 3, "z")], COLS), folder, ["k"])
    assert manifest.current(folder)[0] == 1 and held(spark, folder) == sorted([(k, 1, "x") for k in range(20)], key=str)


def test_a_writer_that_comes_second_starts_anew(spark, folder, monkeypatch):
    """Both work from version 1; the second finds 2 taken, and its merge holds the first one's rows as well."""
    manifest.merge(spark.createDataFrame([(1, 1, "x")], COLS), folder, ["k"], buckets=1)
    looked, real = [], manifest.current

    def current(where):
        out = real(where)
        if not looked:  # between this writer's look and its commit another one writes
            looked.append(1)
            manifest.merge(spark.createDataFrame([(2, 2, "other")], COLS), folder, ["k"])
        return out

    monkeypatch.setattr(manifest, "current", current)
    assert manifest.merge(spark.createDataFrame([(3, 2, "mine")], COLS), folder, ["k"]) == 3
    assert held(spark, folder) == [(1, 1, "x"), (2, 2, "other"), (3, 2, "mine")]
    with pytest.raises(FileExistsError):
        manifest.Store(folder).publish(3, {})


def test_empty_tables(spark, folder):
    none = spark.createDataFrame([], COLS)
    assert manifest.merge(none, folder, ["k"]) == 1 and held(spark, folder) == []
    with pytest.raises(FileNotFoundError):
        manifest.read(spark, folder + "x")
    with pytest.raises(ValueError):
        manifest.merge(none.drop("v"), folder, ["k"])


def test_new_keys_leave_the_files_of_their_buckets(spark, tmp_path):
    """Only buckets that hold a key of the changes are written anew, or those of many files."""
    folder = f"file://{tmp_path}/new"
    rows = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id int, v string")
    names = lambda: {x["name"] for x in manifest.current(folder)[1]["files"]}
    manifest.merge(rows(None, *range(40)), folder, ["id"], buckets=2)
    first = names()
    manifest.merge(rows(*range(40, 80)), folder, ["id"])
    assert first < names()
    manifest.merge(rows(None), folder, ["id"])
    assert len(first - names()) == 1
    for k in range(80, 80 + manifest.FILES):
        manifest.merge(rows(*range(k * 10, k * 10 + 10)), folder, ["id"])
    assert not first & names() and len(names()) <= 2 * manifest.FILES
    assert manifest.read(spark, folder).count() == 81 + 10 * manifest.FILES
