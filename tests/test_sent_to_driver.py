"""What is sent to the driver does not grow with the tables, however small Spark takes exploded rows to be."""

import random

import pytest

from lexloom import registry


def broadcasts(spark, known: int = -1) -> tuple[int, int]:
    """The most rows that an execution after ``known`` sent to the driver, and the last execution."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, most, last = spark._jsparkSession.sharedState().statusStore(), 0, known
    listed = lambda seq: [seq.apply(k) for k in range(seq.size())]
    for x in listed(store.executionsList()):
        if x.executionId() <= known:
            continue
        last, values = max(last, x.executionId()), store.executionMetrics(x.executionId())
        for node in listed(store.planGraph(x.executionId()).allNodes()):
            if node.name() == "BroadcastExchange":
                told = {m.name(): values.get(m.accumulatorId()) for m in listed(node.metrics())}
                rows = told["number of output rows"]
                most = max(most, int(rows.get().replace(",", "")) if rows.isDefined() else 0)
    return most, last


@pytest.mark.parametrize("name", ["title_match", "streaming_matches"])
def test_letters_of_all_runs_do_not_go_to_the_driver(spark, tmp_path, name):
    some = random.Random(5)
    run = lambda: "".join(some.choices("abcdfghijkmn", k=12))  # noqa: E731  no word of the searches is in it
    texts = [" ".join(run() for _ in range(10)) for _ in range(1500)] + ["the lot of it", "des", "und"]
    rows = spark.createDataFrame([(k, x, "en", "s", len(x)) for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    _, last = broadcasts(spark)
    got = {r.posting_id: (r.named_by, r.recipients) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {1500: ("the of", 1), 1501: ("des", 1)} | ({1502: ("und", 1)} if name == "title_match" else {})
    assert broadcasts(spark, last)[0] < 1000
