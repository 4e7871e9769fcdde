"""Queues, schedules, demand, states and streams on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexloom.operators import demand, lifecycle, queues, scheduling, usage, vocabulary
from lexloom.sources import readers
from lexloom.streaming import lanes

NOW = dt.datetime(2024, 1, 2, 12)


def rows(df, *cols):
    return sorted(tuple(x) for x in df.select(*cols).collect())


@pytest.mark.parametrize(("current", "news", "want"), [(5, True, 15), (500, False, 240), (61, True, 31), (61, False, 92)])
def test_cadence(spark, current, news, want):
    assert spark.range(1).select(scheduling.next_cadence(F.lit(current), F.lit(news), 15, 240)).first()[0] == want


def test_wake(spark):
    frame = lambda *x: spark.createDataFrame([(v,) for v in x], "next_run_at timestamp_ntz")
    of = lambda df: scheduling.wake_after_ms(df, NOW).first()[0]
    assert of(frame()) == 300_000 and of(frame(dt.datetime(2020, 1, 1))) == 15_000 and of(frame(dt.datetime(2030, 1, 1))) == 300_000


def test_pace_and_workers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scheduling.pace(F.lit(1.0), 12, NOW)) == "drained" and one(scheduling.pace(F.lit(9.0), 12, NOW)) == "skipped" and one(scheduling.pace(F.lit(0.0), 0, NOW)) == "skipped"
    assert one(scheduling.workers(F.lit(7), 2, 5)) == 3


def test_pick_due(spark):
    units = spark.createDataFrame(
        [("web", "oldest", dt.datetime(2024, 1, 1), ["a"]), ("web", "shared", dt.datetime(2024, 1, 2), ["a", "b", "c"]), ("web", "later", dt.datetime(2025, 1, 1), ["z"]), ("api", "x", dt.datetime(2024, 1, 1), ["q"])],
        "platform string, unit_id string, next_run_at timestamp_ntz, subscribers array<string>",
    )
    of = lambda n: [r[0] for r in scheduling.pick_due(units, n, NOW).filter("platform = 'web'").orderBy("picked").select("unit_id").collect()]
    assert of(1) == ["shared"] and sorted(of(2)) == ["oldest", "shared"]


def test_pick_due_equals_brute_force(spark):
    """The registered query over the whole table, against a choice that counts all units anew each time."""
    from lexloom import registry

    sf, now, budget = "/root/testdata/sf0.001", dt.datetime(1996, 1, 1), 5
    orders, lines = spark.read.parquet(f"{sf}/orders.parquet").collect(), spark.read.parquet(f"{sf}/lineitem.parquet").collect()
    users: dict = {}
    for r in lines:
        users.setdefault(r.l_orderkey, set()).add(r.l_suppkey)
    want = {}
    for platform in {r.o_orderpriority for r in orders}:
        units = sorted((r.o_orderdate, r.o_orderkey) for r in orders if r.o_orderpriority == platform and r.o_orderdate <= (now.date() if not isinstance(r.o_orderdate, dt.datetime) else now) and users.get(r.o_orderkey))
        left, taken = set().union(*(users[k] for _, k in units)) if len(units) > budget else set(), []
        while len(taken) < budget and left:
            gain, at = max(((len(users[k] & left), -n) for n, (_, k) in enumerate(units) if k not in taken), default=(0, 0))
            if not gain:
                break
            taken.append(units[-at][1])
            left -= users[units[-at][1]]
        want[platform] = (taken + [k for _, k in units if k not in taken])[:budget]
    got: dict = {}
    for r in registry.QUERIES["max_coverage_pick"](spark, sf).orderBy("picked").collect():
        got.setdefault(r.platform, []).append(r.unit_id)
    assert got == {p: x for p, x in want.items() if x}


def test_duplicates_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    docs = []
    for k in range(120):
        words = [w for w in base if rng.random() > 0.03] + [f"x{rng.randrange(40)}" for _ in range(rng.randrange(4))]
        docs.append((k, f"f{k % 3}", sorted(set(words if k % 10 else []))))
    rows_ = spark.createDataFrame(docs, "id int, fingerprint string, tokens array<string>")
    want = {}
    for a, f, x in docs:
        alike = [b for b, g, y in docs if b < a and f == g and (len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 1.0) >= 0.92]
        if alike:
            want[a] = min(alike)
    got = lifecycle.duplicate_of(rows_, rows_)
    assert dict(rows(got, "candidate", "duplicate_of")) == want and len(want) > 40
    assert lifecycle.duplicate_of(rows_.limit(0), rows_).count() == 0
    assert "Nested" not in got._jdf.queryExecution().executedPlan().toString()


def test_postings_equal_brute_force(spark):
    import random

    from lexloom.operators import matching

    rng = random.Random(5)
    vocabulary = ["data", "base", "database", "c++", "go", "golang", "ml", "ops", "mlops", "Инженер", "qa"]
    titles = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5)))) for k in range(150)] + [(900, None)]
    asked = [(k, " ".join(rng.choice([*vocabulary, "zzz", "a"]) for _ in range(rng.randrange(4)))) for k in range(60)]
    want = {}
    import re

    for k, title in titles:
        mine = [s for s, q in asked if (w := re.findall(r"[\w+#.]{2,}", q.lower())) and all(x in (title or "").lower() for x in w)]
        if mine:
            want[k] = (dict(asked)[min(mine)], len(mine))
    got = matching.postings_for_searches(spark.createDataFrame(titles, "posting_id int, title string"), spark.createDataFrame(asked, "search_id int, query string"))
    assert {r.posting_id: (r.named_by, r.recipients) for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


def test_extensions(spark):
    from lexloom import extensions

    seen = []
    fetch = lambda search, cursor: search.text
    read = lambda payload: ([{"id": payload, "title": payload}], None)

    def good(api):
        api.register_source(readers.PageSource("ext_source", fetch, read, searches=[readers.Search("a", "x"), readers.Search("b", "y")]), ["Example.org"])
        api.register_model("echo", lambda prompt: prompt + api.env["SUFFIX"])
        api.on_startup(lambda: seen.append("begin"))
        api.on_shutdown(lambda: seen.append("end 1"))
        api.on_shutdown(lambda: 1 / 0)
        api.on_shutdown(lambda: seen.append("end 2"))

    def broken(api):
        api.register_model("echo", str)

    api = extensions.Api(spark, {"SUFFIX": "!"})
    assert extensions.load(api, {"a": good, "b": broken}) == ["a"]
    with api:
        assert rows(spark.read.format("ext_source").load(), "search_name", "source_id") == [("a", "x"), ("b", "y")]
        assert api.models["echo"]("hi") == "hi!" and api.sources.hosts["ext_source"] == {"example.org"}
    assert seen == ["begin", "end 2", "end 1"]
    with pytest.raises(ValueError):
        api.register_source(readers.PageSource("late", fetch, read), [])


def test_store_is_empty_or_refused(spark):
    readers.require_empty(spark, "default")
    spark.sql("CREATE TEMPORARY VIEW something AS SELECT 1")
    with pytest.raises(ValueError):
        readers.require_empty(spark, "default")
    spark.catalog.dropTempView("something")


def test_prefixes(spark):
    codes = spark.createDataFrame([("abcdef",), ("abcxyz",), ("zbcdef",), ("qwerty",)], "code string")
    assert rows(queues.shortest_prefixes(codes, "code"), "code", "prefix") == [("abcdef", "abcd"), ("abcxyz", "abcx"), ("qwerty", "q"), ("zbcdef", "z")]
    assert len(queues.prefix_matches(codes, "code", "abc").collect()) == 2


def test_pages(spark):
    of = lambda total, page: spark.range(1).select(queues.page_of(F.lit(total), F.lit(page), 10)).first()[0]
    assert tuple(of(25, 0)) == (0, 3, False, True) and of(25, 99)["page"] == 2 and of(0, 0)["pages"] == 1


def test_equivalences(spark):
    tracks = spark.createDataFrame([(1, ["Developer", "Разработчик"]), (2, ["Senior Accountant", "Бухгалтер"]), (3, ["Developer", "Programmer"])], "track int, titles array<string>")
    assert rows(demand.mine_equivalences(tracks), "token_a", "token_b", "support") == [("accountant", "бухгалтер", 1), ("developer", "разработчик", 1)]
    pairs = spark.createDataFrame([("developer", "разработчик", 1), ("developer", "programmer", 1)], "token_a string, token_b string, support int")
    assert {r[1] for r in rows(demand.resolver(pairs), "token", "representative")} == {"developer"}


def test_demand_is_shared_whatever_the_order(spark):
    base = [("web", "u1", "{}", "id1", ["backend", "developer"], "n", "backend developer", "s1"), ("web", "u2", "{}", "id2", ["backend", "разработчик"], "n", "backend разработчик", "s2")]
    schema = "platform string, user_id string, filters string, unit_id string, tokens array<string>, name string, wording string, search string"
    for order in (base, base[::-1]):
        resolver = spark.createDataFrame([("разработчик", "developer"), ("developer", "developer")], "token string, representative string")
        units, subscriptions = demand.compile_demand(spark.createDataFrame(order, schema), 0.9, resolver=resolver)
        assert units.count() == 1 and rows(subscriptions, "unit_id", "user_id") == [("id1", "u1"), ("id1", "u2")]


def test_registered_queries_read_the_whole_part_table(spark):
    from collections import Counter

    from lexloom import registry
    from lexloom.functions import json as j
    from lexloom.functions import text as t

    sf = "/root/testdata/sf0.01"
    part = spark.read.parquet(f"{sf}/part.parquet")
    rows_ = part.select("p_partkey", "p_brand", "p_name", "p_type", t.search_tokens(F.concat_ws(" ", "p_name", "p_type")).alias("tokens")).withColumn("unit_id", j.unit_identity(F.col("p_brand"), F.lit("{}"), F.col("tokens"))).collect()
    similar = lambda a, b: max(demand._jaccard(set(a), set(b)), demand._jaccard(demand._grams(a), demand._grams(b)))
    units, want = {}, set()
    for r in sorted(rows_, key=lambda r: (r.p_brand, r.p_partkey % 40, r.unit_id)):
        known = units.setdefault(r.p_brand, {})
        likely = [] if r.unit_id in known else [x for x in ((similar(u, r.tokens), k) for k, u in known.items()) if x[0] >= 0.6]
        unit = min(likely, key=lambda x: (-x[0], x[1]))[1] if likely else r.unit_id
        known.setdefault(unit, r.tokens)
        want.add((unit, r.p_partkey % 40, r.p_brand))
    assert set(rows(registry.QUERIES["demand_units"](spark, sf), "unit_id", "user_id", "platform")) == want

    assert dict(rows(registry.QUERIES["paged_listing"](spark, sf), "search_name", "found")) == Counter(r.p_brand for r in rows_)

    owner: dict[int, int] = {}

    def root(x):
        while owner.setdefault(x, x) != x:
            x = owner[x]
        return x

    for r in rows_:
        if r.p_partkey % 7:
            owner[root(r.p_partkey + 50)] = root(r.p_partkey)
    groups: dict[int, list] = {}
    for x in list(owner):
        groups.setdefault(root(x), []).append(f"t{x}")
    assert rows(registry.QUERIES["role_components"](spark, sf), "token", "representative") == sorted((x, min(g)) for g in groups.values() for x in g)


def test_transitions(spark):
    m = spark.createDataFrame([(1, "scored", None), (2, "scored", None), (3, "applied", NOW)], "id int, state string, delivered_at timestamp_ntz")
    moves = spark.createDataFrame([(1, "scored", "alerted"), (2, "queued", "scored"), (3, "applied", "matched")], "id int, source string, target string")
    assert rows(lifecycle.transition(m, moves, NOW), "id", "state", "moved") == [(1, "alerted", True), (2, "scored", False), (3, "applied", False)]


def test_collector(spark):
    found = spark.createDataFrame([("s", "1", 1, ["Backend", "TypeScript"]), ("s", "1", 2, ["x"]), ("s", "2", 3, ["Backend", "TypeScript"]), ("s", "3", 4, ["Backend"])], "source string, source_id string, position int, names array<string>")
    new, by_name = demand.novelty(found, found.limit(0), 2)
    assert new.count() == 2 and rows(by_name, "name", "discovered") == [("Backend", 2), ("TypeScript", 2)]


def test_hours_are_filled_and_budget_shared(spark):
    events = spark.createDataFrame([(dt.datetime(2024, 1, 2, 11, 59), 5, 1.0)], "at timestamp_ntz, tokens long, cost double")
    out = usage.hourly(events, NOW).orderBy("hour").collect()
    assert len(out) == 25 and [r.tokens for r in out][-2:] == [5, 0]
    assert readers.allocations(3, 7, 2) == [2, 2, 2]


def test_listing_source(spark):
    def fetch(search, cursor):
        return (search.text, int(cursor or 0))

    def read(payload):
        text, page = payload
        return [{"id": f"{text}{page}", "title": text}], str(page + 1) if page < 5 else None

    source = readers.PageSource("demo", fetch, read, searches=[readers.Search("a", "x"), readers.Search("b", "y")])
    spark.dataSource.register(readers.listing_source("demo", source, 5))
    got = spark.read.format("demo").load()
    assert rows(got, "search_name", "source_id") == [("a", "x0"), ("a", "x1"), ("a", "x2"), ("b", "y0"), ("b", "y1")]


def test_stream_equals_batch(spark, tmp_path):
    data = spark.range(200).select((F.lit(NOW).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int") * 7)).alias("at"), F.col("id").alias("tokens"), F.lit(1.0).alias("cost"), (F.col("id") % 50).alias("update_id"))
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    got = []
    lanes.lane(lanes.once(stream), lambda df, _: got.extend(df.collect()), str(tmp_path / "c1"), "once").awaitTermination(120)
    assert len(got) == 50
    run = lanes.hourly(stream).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = data.groupBy(F.date_trunc("hour", "at").alias("hour")).agg(F.sum("tokens").alias("tokens"))
    assert rows(spark.table("hours"), "hour", "tokens") == rows(batch, "hour", "tokens")


def test_streamed_leases(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    data = spark.createDataFrame([("a", "x", at(0)), ("a", "y", at(1)), ("a", "x", at(2)), ("a", "y", at(10)), ("b", "z", at(0))], "key string, token string, at timestamp")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    got = []
    lanes.lane(lanes.leases(stream, 300), lambda df, _: got.extend(df.collect()), str(tmp_path / "c"), "leases").awaitTermination(120)
    assert sorted((r.key, r.token, r.at.minute, r.granted) for r in got) == [("a", "x", 0, True), ("a", "x", 2, True), ("a", "y", 1, False), ("a", "y", 10, True), ("b", "z", 0, True)]


def test_scoring_by_an_injected_model(spark):
    from lexloom.operators import scoring

    asked = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "late")], "id int, prompt string")
    model = lambda p: '{"total": 7}' if p == "good" or p.startswith("late\n") else "no idea"
    assert sorted(map(tuple, scoring.scored(asked, model).collect())) == [(1, '{"total": 7}', 1), (2, None, 3), (3, '{"total": 7}', 2)]
    queue = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 8.0), ("a", 3, 7.0), ("a", 4, 9.0), ("b", 5, 1.0), ("c", 3, 1.0)], "user_id string, id int, score double")
    sent = scoring.delivered(queue, lambda row: row["id"] != 2, 4)
    assert rows(sent, "user_id", "id", "sent") == [("a", 1, True), ("a", 2, False), ("a", 3, False), ("a", 4, True), ("b", 5, True), ("c", 3, True)]
    assert scoring.delivered(queue, lambda row: True, 2).count() == 4


def test_registry_only_grows():
    registry = readers.Registry()
    registry.add(readers.PageSource("a", None, None), ["X.org"])
    registry.allow("a", ["y.org"])
    assert registry.hosts["a"] == {"x.org", "y.org"}
    with pytest.raises(ValueError):
        registry.add(readers.PageSource("a", None, None))
    registry.close()
    registry.close()
    with pytest.raises(ValueError):
        registry.add(readers.PageSource("b", None, None))


def test_vocabulary(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a"]), (3, ["c"])], "id int, tokens array<string>")
    words = vocabulary.vocabulary(docs, F.col("tokens"))
    assert rows(words, "token", "df") == [("a", 2)] and vocabulary.vocabulary_faults(words).count() == 0


def test_plans_have_no_nested_loops(spark):
    from lexloom import registry

    for name in ("hourly_series", "source_funnel", "lexical_cosine_topk", "near_duplicate_block", "due_units_recipients"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
