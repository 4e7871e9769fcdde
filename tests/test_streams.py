"""Paged listings as a stream: budgets, restarts, and pages that are fetched once."""

import os
import uuid
from collections import Counter

from lexloom.sources import readers, streams


def paged(log: str, broken: str = "") -> readers.PageSource:
    """Searches a (7 pages), b (2 pages) and c (a cursor that repeats); every fetch leaves a file in ``log``."""

    def fetch(search, cursor):
        import os as o
        import uuid as u

        page = int(cursor or 0)
        if broken and o.path.exists(broken) and search.name == "a" and page == 4:
            raise OSError("the site is away")
        with open(f"{log}/{search.name}-{page}-{u.uuid4().hex}", "w"):
            pass
        last = {"a": 6, "b": 1, "c": 3}[search.name]
        rows = [{"id": f"{search.name}{page}{k}", "title": "t", "url": "https://example.org"} for k in range(3)]
        following = str(page + 1) if page < last else ("1" if search.name == "c" else None)
        return rows, following

    return readers.PageSource("pages", fetch, lambda x: x, searches=[readers.Search(x, x) for x in "abc"])


def run(spark, name, base):
    query = spark.readStream.format(name).load().writeStream.format("parquet").option("checkpointLocation", f"{base}/check").option("path", f"{base}/out").trigger(availableNow=True).start()
    query.awaitTermination(120)
    if query.exception():
        raise query.exception()
    return spark.read.parquet(f"{base}/out").select("search_name", "source_id", "position").collect()


def fetched(log) -> Counter:
    return Counter(x.rsplit("-", 1)[0] for x in os.listdir(log))


def test_budget_restart_and_failure(spark, tmp_path):
    log, broken = tmp_path / "log", tmp_path / "broken"
    log.mkdir()
    broken.touch()
    name = f"pages_{uuid.uuid4().hex[:8]}"
    spark.dataSource.register(streams.stream_source(name, paged(str(log), str(broken)), f"file://{tmp_path}/landed", 6))
    first = run(spark, name, tmp_path)
    # six pages: two for each search; b has ended then
    assert Counter(r.search_name for r in first) == {"a": 6, "b": 6, "c": 6}
    try:
        run(spark, name, tmp_path)
        raise AssertionError("the site was away")
    except Exception as e:  # noqa: BLE001
        assert "away" in str(e)
    broken.unlink()
    for _ in range(4):
        rows = run(spark, name, tmp_path)
    want = {f"{s}{p}{k}" for s, n in (("a", 7), ("b", 2), ("c", 4)) for p in range(n) for k in range(3)}
    assert Counter(r.source_id for r in rows) == dict.fromkeys(want, 1)
    assert fetched(log) == {f"{s}-{p}": 1 for s, n in (("a", 7), ("b", 2), ("c", 4)) for p in range(n)}
    order = [r.source_id for r in sorted((r for r in rows if r.search_name == "a"), key=lambda r: r.position)]
    assert order == sorted(order)


def test_no_searches(tmp_path):
    reader = streams.PageStream(readers.PageSource("none", lambda s, c: None, lambda x: x), f"file://{tmp_path}", 5)
    assert reader.initialOffset() == reader.latestOffset() == {} and reader.partitions({}, {}) == []


def test_streamed_listing_is_one_run(spark):
    """A run that starts again reads all landed pages again, so a listing of many pages took the square of them."""
    from pyspark.sql.streaming import StreamingQueryListener

    from lexloom import registry

    class Starts(StreamingQueryListener):
        n = 0

        def onQueryStarted(self, event):
            self.n += 1

        def onQueryProgress(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    starts = Starts()
    spark.streams.addListener(starts)
    try:
        rows = registry.QUERIES["streamed_listing"](spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.streams.removeListener(starts)
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    assert starts.n == 1 and {r[0]: (r[1], r[2]) for r in rows} == {r[0]: (r[1], r[1]) for r in part.groupBy("p_brand").count().collect()}


def test_parts_are_read_on(spark, tmp_path):
    from lexloom.plans.service_plans import _Parts

    spark.range(12).selectExpr("id AS p_partkey", "'n' || id AS p_name").coalesce(1).write.parquet(f"{tmp_path}/brand=58")
    parts, cursor, got = _Parts(f"file://{tmp_path}"), None, []
    while True:
        rows, cursor = parts.page("X", cursor, 5)
        got.append([x["id"] for x in rows])
        if cursor is None:
            break
    assert got == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [10, 11]] and not parts.open
    assert [x["id"] for x in parts.page("X", "5", 5)[0]] == [5, 6, 7, 8, 9] and [x["id"] for x in parts.page("X", "10", 2)[0]] == [10, 11]
