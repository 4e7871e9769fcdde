"""Every registered query against its SQL."""

import decimal
from pathlib import Path

import duckdb
import pytest

from lexloom import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def same(rows, cols):
    def one(x):
        return "null" if x is None or x != x else repr(float(x)) if isinstance(x, float | decimal.Decimal) else str(x)

    return sorted(tuple(map(one, x)) for x in rows[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.SQL])
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    want = con.execute(registry.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert same(got, cols) == same(want, cols)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.SQL])
def test_runs(spark, name):
    rows = registry.QUERIES[name](spark, DIR)
    assert rows.columns and rows.toPandas().shape[0] > 0


def test_covers():
    assert all(registry.COVERS[n] for n in registry.QUERIES)
