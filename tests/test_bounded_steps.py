"""Steps whose work was more than it need be: what travels, and what a task holds."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import scoring, search, usage


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_index_is_built_without_an_exchange(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (None, ["a", None]), (3, None)], "id long, tokens array<string>")
    index = search.positional_index(docs)
    assert "Exchange" not in plan(index)
    assert sorted(map(tuple, index.collect()), key=str) == sorted([("a", 1, [2]), ("b", 1, [1, 3]), ("a", None, [1])], key=str)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_alerts_go_out_by_user_without_a_call_for_each(spark, kind):
    rows = [(None, 1, 9.0), (None, 2, 8.0), (7, 3, 5.0), (7, 4, 6.0), (7, 5, 1.0), (8, 6, 1.0)]
    queue = spark.createDataFrame(rows, "user_id long, id long, score double").withColumn("user_id", F.col("user_id").cast(kind))
    out = scoring.delivered(queue, lambda row: row["id"] not in (1, 3), 2)
    assert "FlatMapGroups" not in plan(out)
    assert sorted((r["id"], r["sent"]) for r in out.collect()) == [(1, False), (2, False), (3, False), (4, True), (6, True)]


def test_tasks_of_shares_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(usage, "TASK_ROWS", 10)
    rows = spark.range(100).select((F.col("id") % 40).alias("b"), "id")
    costs = spark.range(0, 41, 2).select(F.col("id").alias("b"), F.lit(6.0).alias("c"))
    out = usage.cost_share(rows, costs, "b", "c")
    assert "hashpartitioning(b" in plan(out) and ", 11)" in plan(out)
    assert {(r["b"], r["share"]) for r in out.collect()} == {(b, 2.0 if b < 20 else 3.0) for b in range(0, 40, 2)}
