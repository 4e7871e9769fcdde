"""Late-arrival overwrite against a brute-force layout of the same rows."""

import datetime as dt
import hashlib
import math
import random
import zlib
from collections import defaultdict
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexloom.llm import late, queries

NAMES = ["sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority"]
KINDS = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
CUTOFF = dt.datetime(2024, 4, 10)
EPOCH = dt.datetime(1970, 1, 1)


def micros(t):
    return "" if t is None else str((t - EPOCH) // dt.timedelta(microseconds=1))


def day(t):
    return -1 if t is None else (t - EPOCH).days


def crc(x) -> int:
    return zlib.crc32(str(x).encode())


def expected(rows: list[tuple], parts: int = 700) -> list[tuple]:
    """(day, file_no, n_rows, cents, rows_crc, ids_sha256, rewritten) of every final file."""
    size, rows = 1 + len(rows) // parts, list(rows)
    for r in list(rows):
        if r[0] is not None and crc(r[0]) % 3 == 0 and day(r[4]) % 7 == 0:
            h = crc(r[0])
            rows.append((*r[:3], None if r[3] is None else r[3] + 1, r[4] + dt.timedelta(days=h % 2), None if r[5] is None else r[5] + dt.timedelta(days=1 + h % 97), r[6]))
    low = lambda x: (x is not None, x if x is not None else 0)

    def latest(some):
        best = {}
        for r in some:
            order = (low(r[5]), low(r[4]), low(r[1]), (r[2] is not None, r[2] or ""), low(r[3]), low(r[6]))
            if r[0] not in best or order > best[r[0]][0]:
                best[r[0]] = order, r
        return {k: r for k, (_, r) in best.items()}

    def layout(held):
        days = defaultdict(list)
        for r in held.values():
            days[day(r[4])].append(r)
        out = {}
        for d, mine in days.items():
            mine.sort(key=lambda r: (low(r[4]), low(r[0])))
            out[d] = [mine[k : k + size] for k in range(0, len(mine), size)]
        return out

    is_early = lambda r: r[5] is not None and r[5] < CUTOFF
    start, final = latest(filter(is_early, rows)), latest(rows)
    dirty = set()
    for k, r in final.items():
        if not is_early(r):
            dirty |= {day(r[4])} | ({day(start[k][4])} if k in start else set())
    out = []
    for d, files in layout(final).items():
        for n, mine in enumerate(files):
            cents = sum(0 if r[3] is None else math.floor(100 * r[3] + 0.5) for r in mine)
            crcs = sum(crc(f"{'' if r[0] is None else r[0]}:{micros(r[4])}:{micros(r[5])}") for r in mine)
            ids = ",".join("" if r[0] is None else str(r[0]) for r in mine)
            out.append((d, n, len(mine), cents, crcs, hashlib.sha256(ids.encode()).hexdigest(), d in dirty))
    return sorted(out)


def told(rows) -> list[tuple]:
    return sorted((r.day, r.file_no, r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten) for r in rows)


def folder(rows) -> Path:
    return Path(unquote(urlparse(rows[0].path).path)).parents[2]


def check_files(rows):
    """The files on disk are those of the report, hold the columns in order, and the rows in order."""
    assert {p.resolve() for p in folder(rows).rglob("*.parquet")} == {Path(unquote(urlparse(r.path).path)).resolve() for r in rows}
    for r in rows[:40]:
        held = pq.ParquetFile(unquote(urlparse(r.path).path)).read()
        assert held.column_names == NAMES == r.columns.split(",")
        ids = ",".join("" if x is None else str(x) for x in held["sale_id"].to_pylist())
        assert hashlib.sha256(ids.encode()).hexdigest() == r.ids_sha256


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.op13_late(spark, sf).collect()
    sales = [tuple(r) for r in spark.read.parquet(f"{sf}/sales.parquet").select(*NAMES).collect()]
    assert told(rows) == expected(sales)
    assert {r.rewritten for r in rows} == {True, False}
    check_files(rows)


def odd_sales(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        sold = None if rng.random() < 0.1 else dt.datetime(2024, 3, 20) + dt.timedelta(days=rng.randrange(12), microseconds=rng.randrange(3) * 1_000_001)
        arrived = None if rng.random() < 0.1 else dt.datetime(2024, 4, 5) + dt.timedelta(hours=rng.randrange(240))
        key = None if rng.random() < 0.05 else 7 if rng.random() < 0.3 else rng.randrange(-40, 120)
        out.append((key, rng.choice([None, 1, 2]), rng.choice([None, "a", "b"]), rng.choice([None, 1.005, 2.5, -3.1]), sold, arrived, rng.choice([None, 1])))
    return out + out[:5]


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, seed):
    """Null keys, times and arrivals, repeated rows, ties, a hot key; files of one row, so that days shrink."""
    rows = odd_sales(seed, 260)
    got = late.sales_report(spark.createDataFrame(rows, KINDS)).collect()
    assert told(got) == expected(rows)
    check_files(got)


def test_untouched_files_keep_their_bytes(spark):
    rows = [(k, 1, "a", 1.0, dt.datetime(2024, 3, 1 + k % 9), dt.datetime(2024, 4, 1), 1) for k in range(90)]
    sales = spark.createDataFrame(rows, KINDS)
    layout = late.new_layout(sales, "sale_id", "sold_at", "arrived_at", 4)
    layout.write(layout.cut(layout.latest(sales)))
    index = late.Index(layout, spark)
    before = {p: p.read_bytes() for p in Path(urlparse(layout.path).path).rglob("*.parquet")}
    assert len(before) == 9 * 3
    # all rows of one day leave it for another
    moved = sales.filter("sale_id % 9 = 2").withColumns({"sold_at": F.lit("2024-03-05").cast("timestamp_ntz"), "arrived_at": F.lit("2024-05-01").cast("timestamp_ntz")})
    dirty = {r.day for r in late.overwrite(layout, index, moved).collect()}
    index.close()
    after = {p: p.read_bytes() for p in Path(urlparse(layout.path).path).rglob("*.parquet")}
    assert dirty == {(dt.datetime(2024, 3, d) - EPOCH).days for d in (3, 5)}
    assert len(after) == 7 * 3 + 5
    same = {p for p in after if p in before}
    assert len(same) == 7 * 3 and all(after[p] == before[p] for p in same)
    assert not any(p.parts[-3].endswith(f"day={(dt.datetime(2024, 3, 3) - EPOCH).days}") for p in after)


def test_nothing_and_nothing_late(spark):
    none = spark.createDataFrame([], KINDS)
    assert late.sales_report(none).count() == 0
    rows = [(k, None, None, None, None, dt.datetime(2024, 1, 1), None) for k in range(5)]
    got = late.sales_report(spark.createDataFrame(rows, KINDS)).collect()
    assert told(got) == expected(rows) and not any(r.rewritten for r in got)
    only_late = [(*r[:5], dt.datetime(2024, 5, 1), r[6]) for r in rows]
    got = late.sales_report(spark.createDataFrame(only_late, KINDS)).collect()
    assert told(got) == expected(only_late) and all(r.rewritten for r in got)


def test_clashing_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, 2, "x")], "sale_id long, day int, extra string")
    with pytest.raises(ValueError, match="day"):
        late.new_layout(rows, "sale_id", "sold_at", "arrived_at", 1)
    rows = [(1, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), "x"), (1, dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 4), "y")]
    df = spark.createDataFrame(rows, "key long, at timestamp_ntz, came timestamp_ntz, old_day string")
    layout = late.new_layout(df, "key", "at", "came", 10)
    layout.write(layout.cut(layout.latest(df)))
    assert [r.old_day for r in layout.read(spark).collect()] == ["y"]
