"""Ranked full text: known ranks, and matches like those of a scan over all texts."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import search

TEXTS = ["a", "a b", "a x b", "a a a", "b a", "c", "the quick brown fox", "quick the fox brown", "a " * 300 + "b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, x.split()) for k, x in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id int, tokens array<string>").cache()


def found(docs, query, k=50):
    return {r.id: r["rank"] for r in search.ranked(search.positional_index(docs), docs.select("id"), query, k, "id").collect()}


def test_known_ranks(docs):
    """Values that the usual implementation prints (single precision there)."""
    one = found(docs, "a")
    assert one[0] == pytest.approx(0.06079271, abs=1e-7)
    assert one[3] == pytest.approx(0.06079271 * (1 + 1 / 4 + 1 / 9), abs=1e-7)
    both = found(docs, "a b")
    assert set(both) == {1, 2, 4, 8}
    assert both[1] == both[4] == pytest.approx(0.09910322, abs=1e-7)
    assert both[2] == pytest.approx(0.09850092, abs=1e-7)
    assert found(docs, '"quick brown"') == {6: pytest.approx(0.09910322, abs=1e-7)}
    assert found(docs, "a -b")[0] == 1e-20  # nothing to measure a distance to
    assert found(docs, "a or b")[2] == pytest.approx(0.06079271, abs=1e-7)


@pytest.mark.parametrize("query", ["a b", "a or c", '"a b"', '-a', 'a -"a b"', '"quick brown" or "fox brown"', "the -quick or c", "", "zzz", '"a a"'])
def test_matches_are_those_of_a_scan(docs, query):
    want = {r.id for r in docs.filter(search.matches(F.col("tokens"), query)).collect()}
    assert set(found(docs, query)) == want


def test_query_reads_its_words_only(docs):
    plan = search.ranked(search.positional_index(docs), docs.select("id"), "a b", 5, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "token#" in plan and " IN (a,b)" in plan
    assert [k for k in found(docs, "a b", 2)] == [1, 4]
