"""Queries over matches, units and queues; orders and lineitem stand in for the tables of work."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import json as j
from ..functions import text as t
from ..operators import accounts, demand, lifecycle, queues, scheduling, scoring
from ..registry import query
from ..session import at, table

NOW = dt.datetime(2001, 8, 1)
SQL_NOW = "TIMESTAMP '2001-08-01 00:00:00'"

M = """m AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_custkey % 500 AS vacancy_id, CASE o_orderstatus WHEN 'P' THEN 'matched' WHEN 'O' THEN 'queued' ELSE 'scored' END AS state,
  CAST(o_orderkey % 101 AS DOUBLE) AS lexical, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 89 AS DOUBLE) END AS prescore, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS score,
  o_orderdate AS matched_at, o_orderdate + to_hours(CAST(o_orderkey % 2 AS INTEGER) * 24) AS updated_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS scored_at,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN o_orderdate END AS delivered_at, o_orderpriority AS source FROM orders)"""


def matches(spark, sf):
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    done = F.col("o_orderstatus") == "F"
    state = F.when(F.col("o_orderstatus") == "P", "matched").when(F.col("o_orderstatus") == "O", "queued").otherwise("scored")
    return o.select(
        key.alias("id"), F.col("o_custkey").alias("user_id"), (F.col("o_custkey") % 500).alias("vacancy_id"), state.alias("state"), (key % 101).cast("double").alias("lexical"),
        F.when(key % 3 != 0, (key % 89).cast("double")).alias("prescore"), F.when(done, F.col("o_totalprice")).alias("score"), F.col("o_orderdate").alias("matched_at"),
        (F.col("o_orderdate") + F.make_dt_interval((key % 2).cast("int"))).alias("updated_at"), F.when(done, F.col("o_orderdate")).alias("scored_at"),
        F.when(done & (key % 4 == 0), F.col("o_orderdate")).alias("delivered_at"), F.col("o_orderpriority").alias("source"),
    )


def _sql(text: str) -> str:
    return f"WITH {M} {text}"


@query("J1 J11", _sql("SELECT id, user_id, c_mktsegment AS segment, state FROM m JOIN customer ON c_custkey = user_id WHERE state IN ('matched', 'queued') AND c_acctbal > 0"))
def matches_with_listing(spark, sf):
    users = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return matches(spark, sf).filter(F.col("state").isin("matched", "queued")).select("id", "user_id", "state").join(users, "user_id").select("id", "user_id", "segment", "state")


@query("O1 F14 K1 O10", _sql(f"SELECT id, coalesce(prescore, lexical) AS evidence FROM m JOIN customer ON c_custkey = user_id AND c_acctbal > 0 WHERE state = 'matched' AND (updated_at = matched_at OR updated_at <= {SQL_NOW} - INTERVAL 6 HOUR) ORDER BY evidence DESC NULLS LAST, matched_at, id LIMIT 100"))
def scoring_queue_topk(spark, sf):
    users = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return queues.scoring_queue(matches(spark, sf), users, 100, NOW).select("id", "evidence")


@query("O2", _sql("SELECT id, lexical FROM m WHERE state = 'matched' AND prescore IS NULL ORDER BY lexical DESC NULLS LAST, matched_at, id LIMIT 50"))
def prescoring_queue(spark, sf):
    return queues.prescoring_queue(matches(spark, sf), 50).select("id", "lexical")


@query("O3", _sql("SELECT id, score FROM m WHERE score >= 400000 AND delivered_at IS NULL ORDER BY score DESC NULLS LAST, id LIMIT 30"))
def alert_queue(spark, sf):
    return queues.alert_queue(matches(spark, sf), 400000).select("id", "score")


@query("O4 F12", _sql("SELECT id, score, scored_at FROM m WHERE score >= 100000 AND score < 300000 AND scored_at > TIMESTAMP '2000-01-01' AND scored_at <= TIMESTAMP '2001-01-01'"))
def digest_window(spark, sf):
    return queues.digest_window(matches(spark, sf), 100000, 300000, dt.datetime(2000, 1, 1), dt.datetime(2001, 1, 1)).select("id", "score", "scored_at")


@query("O5 J18 W13", _sql("SELECT id, score, CAST(place AS INTEGER) AS place FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS place FROM m WHERE score IS NOT NULL QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 100) WHERE place >= 20 AND place < 30"))
def digest_page(spark, sf):
    m = matches(spark, sf).filter("score IS NOT NULL")
    best = queues.first(m, 100, F.desc("score"), "id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), lambda x: x["id"]).alias("ids"))
    return queues.snapshot_page(best, m, 2, 10).select("id", "score", F.col("place").cast("int").alias("place"))


@query("O6", "WITH t AS (SELECT p_size AS total, CAST(p_partkey % 9 AS INTEGER) - 2 AS asked, p_partkey FROM part), c AS (SELECT p_partkey, greatest(1, CAST(ceil(total / 10.0) AS INTEGER)) AS pages, asked FROM t) SELECT p_partkey, least(greatest(asked, 0), pages - 1) AS page, pages, least(greatest(asked, 0), pages - 1) > 0 AS has_previous, least(greatest(asked, 0), pages - 1) < pages - 1 AS has_next FROM c")
def page_meta(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", queues.page_of(F.col("p_size"), (F.col("p_partkey") % 9).cast("int") - 2, 10).alias("p"))
    return rows.select("p_partkey", "p.*")


@query("O7 K7", "SELECT c_custkey AS user_id FROM customer ORDER BY c_custkey = 7 DESC, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, c_name, c_custkey LIMIT 40 OFFSET 20")
def users_page(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") == 7).alias("is_owner"), F.col("c_mktsegment").alias("status"), F.col("c_name").alias("created_at"))
    return queues.users_page(users, {"HOUSEHOLD": 0, "MACHINERY": 1}, 20, 40).select("user_id")


@query("O8", "SELECT s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 20")
def refresh_queue(spark, sf):
    return queues.first(table(spark, sf, "supplier"), 20, "s_acctbal", "s_suppkey").select("s_suppkey")


@query("N1 O13 W3 J12", _sql("SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY matched_at, id) AS nth FROM m) WHERE nth <= 10 ORDER BY matched_at, id LIMIT 30"))
def source_fair_claim(spark, sf):
    return queues.fair(matches(spark, sf), "source", 10, 30, "matched_at", "id").select("id")


@query("O15", _sql("SELECT id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY id) - 1) // 3 AS INTEGER) AS batch FROM m"))
def batch_slices(spark, sf):
    return queues.batches(matches(spark, sf), 3, "user_id", "id").select("id", "batch")


CODE = "(" + " || ".join(f"chr(97 + CAST((o_orderkey * 7919 % 308915776) // {26**k} % 26 AS INTEGER))" for k in reversed(range(6))) + ")"


def _codes(spark, sf):
    return table(spark, sf, "orders").select(queues.letters_code(F.col("o_orderkey") * 7919 % 308915776).alias("code"))


@query("H5 O11", f"SELECT {CODE} AS code FROM orders ORDER BY code")
def letter_codes(spark, sf):
    return _codes(spark, sf).orderBy("code")


@query("N2 K22", f"WITH c AS (SELECT {CODE} AS code FROM orders), p AS (SELECT code, unnest(range(1, 7)) AS n FROM c), a AS (SELECT code[1:n] AS prefix, min(code) AS code, min(n) AS n FROM p GROUP BY 1 HAVING count(*) = 1), b AS (SELECT code, min(n) AS n FROM a GROUP BY code) SELECT code, coalesce(code[1:b.n], code) AS prefix FROM c LEFT JOIN b USING (code)")
def unique_prefix(spark, sf):
    return queues.shortest_prefixes(_codes(spark, sf), "code")


@query("F6", f"SELECT code FROM (SELECT {CODE} AS code FROM orders) WHERE starts_with(code, 'aa') ORDER BY code LIMIT 2")
def prefix_lookup(spark, sf):
    return queues.prefix_matches(_codes(spark, sf), "code", "aa")


@query("J7 K1", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def users_with_cv_semi(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("J8 X3 W10", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def retire_orphans(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("J9 W5 O9", "SELECT doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (toxic = 1 OR quality = 1)) AND n_chars < 5000 ORDER BY n_chars, doc_id LIMIT 100")
def retention_purge(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars").withColumn("last_seen_at", at(dt.datetime(2000, 1, 1)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("n_chars").cast("decimal(18,6)")))
    held = table(spark, sf, "labels").select(F.col("doc_id").alias("vacancy_id"), F.when(F.col("toxic") == 1, at(NOW)).alias("delivered_at"), F.lit(None).cast("string").alias("application"), (F.col("quality") * 100.0).alias("score"))
    return lifecycle.unprotected(rows, held, 60.0, dt.datetime(2000, 1, 1) + dt.timedelta(seconds=5000), 100).select("id")


SUBS = "s AS (SELECT DISTINCT l_orderkey AS unit_id, l_suppkey AS user_id FROM lineitem)"


def _subscriptions(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_suppkey").alias("user_id"), F.lit("search").alias("search_name")).distinct()


def _units(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderpriority").alias("platform"), F.col("o_orderdate").alias("next_run_at"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("retired_at"))


@query("J2 A9 K7", f"WITH {SUBS} SELECT o_orderkey AS unit_id, o_orderpriority AS platform, o_orderdate AS next_run_at, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) AS recipients FROM orders JOIN s ON unit_id = o_orderkey JOIN supplier ON s_suppkey = user_id AND s_acctbal > 0 WHERE o_orderdate <= TIMESTAMP '1996-01-01' AND o_orderstatus <> 'P' GROUP BY ALL")
def due_units_recipients(spark, sf):
    users = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("user_id"))
    out = scheduling.due_units(_units(spark, sf), _subscriptions(spark, sf), users, dt.datetime(1996, 1, 1))
    return out.withColumn("recipients", F.array_join(F.transform("recipients", lambda x: x["user_id"].cast("string")), ","))


@query("A10 D2 K7", "SELECT CAST(least(300000, greatest(15000, date_diff('millisecond', TIMESTAMP '1995-01-01', min(o_orderdate)))) AS BIGINT) AS wake_ms FROM orders")
def next_wake(spark, sf):
    return scheduling.wake_after_ms(_units(spark, sf), dt.datetime(1995, 1, 1))


@query("D1 W11", "WITH c AS (SELECT p_partkey, least(240, greatest(15, p_size * 6)) AS c, p_partkey % 2 = 0 AS news FROM part) SELECT p_partkey, CAST(CASE WHEN news THEN greatest(15, floor(c / 2.0 + 0.5)) ELSE least(240, floor(c * 1.5 + 0.5)) END AS INTEGER) AS cadence FROM c")
def cadence_update(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scheduling.next_cadence(F.col("p_size") * 6, F.col("p_partkey") % 2 == 0, 15, 240).alias("cadence"))


@query("D3 W4", "SELECT p_partkey, CAST(least(1440, 2 ** greatest(0, p_size - 1)) AS INTEGER) AS minutes FROM part")
def retry_backoff(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scheduling.backoff_minutes(F.col("p_size")).alias("minutes"))


@query("D5 U5", "SELECT p_partkey, CASE WHEN p_size <= 5 THEN p_size ELSE CAST(least(p_size, 10, 5 + (p_size - 5) // 5) AS INTEGER) END AS workers FROM part")
def adaptive_workers(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scheduling.workers(F.col("p_size"), 5, 10).alias("workers"))


@query("D6 F10", _sql("SELECT id, least(coalesce(scored_at, matched_at), matched_at) AS published_at FROM m"))
def earliest_publication(spark, sf):
    return matches(spark, sf).select("id", F.least(F.coalesce("scored_at", "matched_at"), "matched_at").alias("published_at"))


@query("D8", "SELECT event_id, CAST(ceil(greatest(0, 86400 - date_diff('microsecond', ts, TIMESTAMP '2024-01-31') / 1000000.0)) AS INTEGER) AS seconds FROM events")
def access_cooldown(spark, sf):
    return table(spark, sf, "events").select("event_id", scheduling.cooldown_seconds(F.col("ts"), dt.datetime(2024, 1, 31), 86400).alias("seconds"))


@query("O12 A20", None)
def max_coverage_pick(spark, sf):
    """Due units of every platform within a budget; tests/test_operators.py compares the whole table with brute force."""
    subs = _subscriptions(spark, sf).groupBy("unit_id").agg(F.array_sort(F.collect_set("user_id")).alias("subscribers"))
    units = _units(spark, sf).join(subs, "unit_id")
    return scheduling.pick_due(units, 5, dt.datetime(1996, 1, 1))


@query("R2 W11 A20", "SELECT o_orderkey AS unit_id, CASE WHEN o_orderkey % 10 = 0 THEN 60 WHEN o_orderkey % 3 = 0 THEN 30 ELSE 90 END AS cadence_minutes, CASE WHEN o_orderkey % 10 = 0 THEN o_orderdate ELSE TIMESTAMP '2001-08-01' + to_minutes(CASE WHEN o_orderkey % 3 = 0 THEN 30 ELSE 90 END) END AS next_run_at FROM orders")
def scheduler_tick(spark, sf):
    units = _units(spark, sf).select("unit_id", "next_run_at", F.lit(60).alias("cadence_minutes"))
    results = units.select("unit_id", (F.col("unit_id") % 3 == 0).cast("int").alias("novelty"), (F.col("unit_id") % 10 == 0).alias("failed"))
    return scheduling.tick(units, results, NOW, 15, 240).select("unit_id", "cadence_minutes", "next_run_at")


@query("A20", "SELECT o_orderpriority AS platform, count(*) AS selected, count(*) FILTER (o_orderkey % 10 <> 0) AS run, CAST(coalesce(sum(o_orderkey % 3) FILTER (o_orderkey % 10 <> 0), 0) AS BIGINT) AS discovered, count(*) FILTER (o_orderkey % 10 = 0) AS failed FROM orders GROUP BY 1")
def scheduler_report(spark, sf):
    return scheduling.run_report(_units(spark, sf).select("platform", (F.col("unit_id") % 3).alias("novelty"), (F.col("unit_id") % 10 == 0).alias("failed")))


@query("W7 K15 F2", _sql("SELECT id, CASE WHEN (state = 'queued' AND id % 2 = 0) THEN 'scored' WHEN state = 'scored' AND id % 2 = 0 THEN 'alerted' ELSE state END AS state, coalesce(delivered_at, CASE WHEN state = 'scored' AND id % 2 = 0 THEN TIMESTAMP '2001-08-01' END) AS delivered_at, (state IN ('queued', 'scored') AND id % 2 = 0) AS moved FROM m"))
def state_transition(spark, sf):
    m = matches(spark, sf).select("id", "state", "delivered_at")
    target = F.when(F.col("state") == "queued", "scored").when(F.col("state") == "scored", "alerted").otherwise("applied")
    moves = m.filter("id % 2 = 0").select("id", F.col("state").alias("source"), target.alias("target"))
    return lifecycle.transition(m, moves, NOW).select("id", "state", "delivered_at", "moved")


@query("W9 R10", _sql("SELECT id, CASE WHEN state = 'matched' AND score IS NULL AND matched_at < TIMESTAMP '2001-08-01' - INTERVAL 30 DAY THEN 'expired' ELSE state END AS state FROM m"))
def expire_stale(spark, sf):
    m = matches(spark, sf)
    dated = m.select("id", F.col("matched_at").alias("published_at"))
    return lifecycle.expire_stale(m.drop("vacancy_id").withColumn("vacancy_id", F.col("id")), dated.withColumnRenamed("id", "vacancy_id"), NOW, 30).select("id", "state")


@query("W8 K6", _sql("SELECT id, CASE WHEN state = 'queued' AND id % 5 = 0 THEN 'scored' ELSE state END AS state, CASE WHEN state = 'queued' AND id % 5 = 0 THEN CAST(id % 100 AS DOUBLE) ELSE score END AS score FROM m"))
def save_scores(spark, sf):
    m = matches(spark, sf)
    return lifecycle.save_scores(m, m.filter("id % 5 = 0").select("id", (F.col("id") % 100).cast("double").alias("value")), "score", NOW, "scored").select("id", "state", "score")


@query("W6", "WITH n AS (SELECT DISTINCT l_suppkey AS user_id, l_partkey AS vacancy_id FROM lineitem WHERE l_quantity < 10), s AS (SELECT DISTINCT l_suppkey AS user_id, l_partkey AS vacancy_id FROM lineitem WHERE l_quantity >= 30) SELECT count(*) AS added FROM (SELECT * FROM n EXCEPT SELECT * FROM s)")
def match_insert_ignore(spark, sf):
    pairs = lambda c: table(spark, sf, "lineitem").filter(c).select(F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("vacancy_id"))
    _, added = lifecycle.add_new(pairs("l_quantity >= 30").distinct(), pairs("l_quantity < 10"), "user_id", "vacancy_id")
    return added.agg(F.count(F.lit(1)).alias("added"))


@query("W1 H3 S16", "SELECT coalesce(o.c_custkey, n.c_custkey) AS source_id, CASE WHEN n.c_custkey IS NOT NULL THEN 'new ' || n.c_name ELSE o.c_name END AS title, o.c_custkey IS NULL AS is_new, CASE WHEN n.c_custkey IS NOT NULL THEN TIMESTAMP '2001-08-01' ELSE TIMESTAMP '2000-01-01' END AS last_seen_at FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) n ON o.c_custkey = n.c_custkey WHERE coalesce(o.c_custkey, n.c_custkey) IS NOT NULL")
def listing_upsert(spark, sf):
    c = table(spark, sf, "customer")
    listing = lambda x, title: x.select(F.lit("s").alias("source"), F.col("c_custkey").alias("source_id"), F.concat(F.lit("https://example.org/"), "c_custkey").alias("url"), title.alias("title"), F.lit("").alias("summary"), F.sha2("c_name", 256).alias("listing_hash"))
    old_at = at(dt.datetime(2000, 1, 1))
    state = listing(c.filter("c_custkey % 3 != 0"), F.col("c_name")).withColumns({"status": F.lit("listed"), "attempts": F.lit(0), "first_seen_at": old_at, "last_seen_at": old_at, "next_normalization_at": old_at})
    found = listing(c.filter("c_custkey % 2 = 0"), F.concat(F.lit("new "), "c_name")).withColumn("position", F.col("source_id"))
    return lifecycle.upsert_listings(state, found, NOW).select("source_id", "title", "is_new", "last_seen_at")


@query("W2 W15", _sql("SELECT id, CASE WHEN vacancy_id % 7 = 0 AND delivered_at IS NULL THEN 'matched' ELSE state END AS state, CASE WHEN vacancy_id % 7 = 0 AND delivered_at IS NULL THEN NULL ELSE score END AS score FROM m"))
def content_change_reset(spark, sf):
    m = matches(spark, sf)
    return lifecycle.reset_changed(m, m.filter("vacancy_id % 7 = 0").select("vacancy_id")).select("id", "state", "score")


def _claimable(spark, sf):
    o = table(spark, sf, "orders")
    lease = F.when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 2 == 0, at(dt.datetime(2001, 7, 1))).otherwise(at(dt.datetime(2001, 9, 1))))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderstatus") == "P", "listed").when(F.col("o_orderstatus") == "O", "normalizing").otherwise("normalized").alias("status"), F.lit(1).alias("attempts"), lease.alias("lease_until"), F.col("o_orderdate").alias("next_normalization_at"))


@query("W3 N1", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS nth FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderkey % 2 = 0)) SELECT o_orderkey AS id, 2 AS attempts FROM r WHERE nth <= 20 ORDER BY o_orderdate, o_orderkey LIMIT 60")
def claim_leases(spark, sf):
    return lifecycle.claim(_claimable(spark, sf), NOW, 20, 60).filter("claimed").select("id", "attempts")


@query("W4 D3", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'listed' WHEN o_orderstatus = 'F' THEN 'normalized' WHEN o_orderkey % 3 = 0 THEN 'listed' WHEN o_orderkey % 3 = 1 THEN 'normalized' ELSE 'closed' END AS status, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN TIMESTAMP '2001-08-01 00:01:00' ELSE o_orderdate END AS next_at FROM orders")
def finish_normalization(spark, sf):
    rows = _claimable(spark, sf).withColumn("last_error", F.lit(None).cast("string"))
    outcome = F.when(F.col("id") % 3 == 0, "failed").when(F.col("id") % 3 == 1, "normalized").otherwise("closed")
    return lifecycle.finish(rows, rows.select("id", outcome.alias("outcome"), F.lit("x").alias("error")), NOW).select("id", "status", F.col("next_normalization_at").alias("next_at"))


@query("W10 X5", "WITH keep AS (SELECT DISTINCT l_orderkey AS unit_id FROM lineitem WHERE l_suppkey % 2 = 1 UNION SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey % 2 = 0 AND l_quantity > 40) SELECT o_orderkey AS unit_id, keep.unit_id IS NULL AS retired FROM orders LEFT JOIN keep ON unit_id = o_orderkey")
def apply_demand(spark, sf):
    units = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), F.lit("q").alias("query"), F.lit(None).cast("timestamp_ntz").alias("retired_at"))
    line = table(spark, sf, "lineitem")
    sub = lambda x: x.select(F.col("l_orderkey").alias("unit_id"), F.col("l_suppkey").alias("user_id")).distinct()
    users = table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("user_id"))
    out, _ = lifecycle.apply_demand(units, sub(line), units.filter("unit_id % 50 = 0"), sub(line.filter("l_suppkey % 2 = 0 AND l_quantity > 40")), users, NOW)
    return out.select("unit_id", F.col("retired_at").isNotNull().alias("retired"))


@query("W18 K5 R5", "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN (CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END) ELSE 'new' END AS token, c_custkey % 2 = 1 OR c_custkey % 3 = 0 AS granted FROM customer")
def session_leases(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("chat").alias("kind"))
    until = F.when(F.col("user_id") % 3 == 0, at(dt.datetime(2001, 7, 1))).otherwise(at(dt.datetime(2001, 9, 1)))
    state = c.filter("user_id % 2 = 0").withColumns({"token": F.lit("old"), "expires_at": until})
    asks = c.withColumns({"token": F.lit("new"), "asked_at": at(NOW)})
    return lifecycle.lease(state, asks, NOW, dt.timedelta(minutes=5)).select("user_id", "token", "granted")


@query("W19 R4", "SELECT DISTINCT l_orderkey AS update_id FROM lineitem WHERE l_orderkey % 4 <> 0 AND l_orderkey % 4 <> 1")
def update_ledger(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderkey % 4 IN (0, 1, 2)").select(F.col("o_orderkey").alias("update_id"))
    status = F.when(F.col("update_id") % 4 == 0, "done").otherwise("working")
    until = F.when(F.col("update_id") % 4 == 1, at(NOW + dt.timedelta(minutes=1))).otherwise(at(NOW - dt.timedelta(minutes=1)))
    ledger = o.withColumns({"status": status, "lease_until": until, "updated_at": at(NOW)})
    updates = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("update_id"))
    return lifecycle.begin_updates(ledger, updates, NOW).select("update_id")


@query("W16 F3", "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 AND c_custkey <> 0 THEN 'blocked' ELSE 'approved' END AS status FROM customer")
def user_status(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("approved").alias("status"), (F.col("c_custkey") == 0).alias("is_owner"))
    return lifecycle.set_users(users, users.filter("user_id % 2 = 0").select("user_id", F.lit("blocked").alias("status")), NOW).select("user_id", "status")


@query("H2 T25", "SELECT p_partkey, sha256('lexloom.unit.v1' || chr(0) || 'web' || chr(0) || '{}' || chr(0) || '[\"' || array_to_string(list_sort(list_distinct(string_split(lower(p_name), ' '))), '\",\"') || '\"]') AS unit_id FROM part")
def content_hash(spark, sf):
    tokens = F.array_distinct(F.split(F.lower("p_name"), " "))
    return table(spark, sf, "part").select("p_partkey", j.unit_identity(F.lit("web"), F.lit("{}"), tokens).alias("unit_id"))


@query("G3 N4 H2 J14 W10", None)
def demand_units(spark, sf):
    """Demand of all parts; tests/test_operators.py compares the whole table with brute force."""
    part = table(spark, sf, "part")
    tokens = t.search_tokens(F.concat_ws(" ", "p_name", "p_type"))
    searches = part.select(F.col("p_brand").alias("platform"), (F.col("p_partkey") % 40).alias("user_id"), F.lit("{}").alias("filters"), tokens.alias("tokens"), F.col("p_type").alias("name"), F.col("p_name").alias("wording"), F.concat(F.lit('{"text":"'), "p_name", F.lit('"}')).alias("search"))
    searches = searches.withColumn("unit_id", j.unit_identity(F.col("platform"), F.col("filters"), F.col("tokens")))
    units, subscriptions = demand.compile_demand(searches, 0.6)
    return subscriptions.join(units.select("unit_id", "platform"), "unit_id")


@query("S12 X2 X3", "WITH once AS (SELECT l_partkey AS source_id, min(l_orderkey * 10 + l_linenumber) AS position FROM lineitem GROUP BY 1), new AS (SELECT * FROM once WHERE source_id % 3 <> 0 ORDER BY position, source_id LIMIT 200) SELECT 'n' || (source_id % 5) AS name, count(*) AS discovered FROM new GROUP BY 1")
def collector_novelty(spark, sf):
    found = table(spark, sf, "lineitem").select(F.lit("s").alias("source"), F.col("l_partkey").alias("source_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.array(F.concat(F.lit("n"), (F.col("l_partkey") % 5).cast("string"))).alias("names"))
    known = table(spark, sf, "part").filter("p_partkey % 3 = 0").select(F.lit("s").alias("source"), F.col("p_partkey").alias("source_id"))
    return demand.novelty(found, known, 200)[1]


@query("T27", "SELECT p_partkey, p_size < 20 AND CAST(('0x' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 < 0.1 AS explored FROM part")
def prescore_exploration(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scoring.explored(F.col("p_size"), 20, 0.1, F.col("p_partkey")).alias("explored"))


@query("X6 K16", "SELECT l_orderkey AS batch, count(*) = count(DISTINCT l_linenumber) AND bool_and(l_linenumber <= 6) AS exact FROM lineitem GROUP BY 1")
def exact_cover(spark, sf):
    """Answers of a batch cover the lines asked for: none twice, none that was not asked (line 7)."""
    answers = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("id"))
    return scoring.covered(answers.filter("id <= 6").distinct(), answers, "batch", "id")


@query("X7 K13 K14", "SELECT c_custkey AS user_id FROM customer WHERE NOT (c_custkey % 2 = 0 AND c_custkey % 3 = 0 AND c_custkey % 5 <> 0)")
def missing_profiles(spark, sf):
    """Users without a profile made for their present CV, with the present template, and valid."""
    users, usable = _profiles(spark, sf)
    return accounts.without_profile(users, usable, F.col("profile").startswith("{"))


def _profiles(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.sha2("c_name", 256).alias("cv_hash"))
    stored = users.select("user_id", F.when(F.col("user_id") % 2 == 0, F.col("cv_hash")).otherwise("old").alias("made_for"), F.when(F.col("user_id") % 3 == 0, 2).otherwise(1).alias("template"), F.when(F.col("user_id") % 5 == 0, "broken").otherwise("{}").alias("profile"))
    return users.select("user_id"), accounts.profile_for(users, stored, 2)


@query("K2 K13 K14 U4", "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 = 0 THEN 'broken' ELSE '{}' END AS profile FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0")
def stored_profiles(spark, sf):
    return _profiles(spark, sf)[1].select("user_id", "profile")


@query("W7", _sql("SELECT id, CASE WHEN state = 'matched' AND id % 3 = 0 THEN 'queued' WHEN state = 'queued' AND id % 2 = 0 AND score IS NULL THEN 'matched' ELSE state END AS state FROM m"))
def match_claims(spark, sf):
    """Claims of every third row, then releases of every second one that was queued before."""
    m = matches(spark, sf).withColumns({"queued_at": F.lit(None).cast("timestamp_ntz"), "updated_at": F.lit(None).cast("timestamp_ntz")})
    claimed = lifecycle.claim_matches(m, m.filter("id % 3 = 0").select("id"), NOW)
    back = claimed.filter("id % 2 = 0 AND NOT claimed").select("id")
    return lifecycle.release_matches(claimed, back, NOW).select("id", "state")


@query("W13", _sql("SELECT id, CASE WHEN state = 'scored' AND delivered_at IS NULL AND id % 4 = 0 THEN 'alerted' WHEN state = 'scored' AND id % 4 = 1 THEN 'skipped' WHEN state = 'scored' AND id % 4 = 2 THEN 'digested' ELSE state END AS state, CASE WHEN state = 'scored' AND id % 4 < 3 THEN coalesce(delivered_at, TIMESTAMP '2001-08-01') ELSE delivered_at END AS delivered_at, CASE WHEN state = 'scored' AND delivered_at IS NULL AND id % 4 = 0 THEN NULL ELSE 'why' END AS short_summary FROM m"))
def match_deliveries(spark, sf):
    """Alerts, skips and digests; an alert that has gone out keeps no short texts."""
    m = matches(spark, sf).withColumns({"short_summary": F.lit("why"), "updated_at": F.lit(None).cast("timestamp_ntz")})
    of = lambda k: m.filter(F.col("id") % 4 == k).select("id", "user_id")
    out = lifecycle.skip(lifecycle.alert(m, of(0), NOW), of(1), NOW)
    users = m.select("user_id").distinct().withColumns({"digest_snapshot": F.array().cast("array<long>"), "last_digest_at": F.lit(None).cast("timestamp_ntz")})
    digests = of(2).groupBy("user_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return lifecycle.send_digests(out, users, digests, NOW)[0].select("id", "state", "delivered_at", "short_summary")


@query("W13 O5", _sql("SELECT user_id, array_to_string(list_sort(list(id) FILTER (id % 4 = 2)), ',') AS ids FROM m GROUP BY user_id"))
def digest_snapshots(spark, sf):
    m = matches(spark, sf).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    users = m.select("user_id").distinct().withColumns({"digest_snapshot": F.lit(None).cast("array<long>"), "last_digest_at": F.lit(None).cast("timestamp_ntz")})
    digests = m.filter("id % 4 = 2").groupBy("user_id").agg(F.sort_array(F.collect_list(F.col("id").cast("long"))).alias("ids"))
    return lifecycle.send_digests(m, users, digests, NOW)[1].select("user_id", F.array_join("digest_snapshot", ",").alias("ids"))


_EVENTS = "['begin', 'ready', 'failed', 'delivered'][id % 4 + 1]"


@query("W14", _sql(f"SELECT id, CASE WHEN id % 4 = 0 AND s = 'alerted' AND id % 3 <> 0 THEN 'applying' WHEN id % 4 = 2 AND s = 'applying' THEN (CASE WHEN delivered_at IS NOT NULL THEN 'alerted' ELSE 'skipped' END) WHEN id % 4 = 3 AND s = 'applying' AND a = 'ready' THEN 'applied' ELSE s END AS state, CASE WHEN id % 4 = 0 AND s = 'alerted' AND id % 3 <> 0 THEN 'preparing' WHEN id % 4 = 1 AND s = 'applying' AND a = 'preparing' THEN 'ready' WHEN id % 4 = 2 AND s = 'applying' THEN 'failed' WHEN id % 4 = 3 AND s = 'applying' AND a = 'ready' THEN NULL ELSE a END AS application FROM (SELECT *, CASE WHEN id % 4 = 0 THEN 'alerted' ELSE 'applying' END AS s, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 3 AND id % 8 = 3 THEN 'ready' ELSE 'preparing' END AS a FROM m)"))
def application_events(spark, sf):
    """Begun unless the artifact is there for this CV, made ready, failed, and delivered only when ready."""
    first = F.when(F.col("id") % 4 == 0, "alerted").otherwise("applying")
    status = F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 8 == 3, "ready").otherwise("preparing")
    m = matches(spark, sf).withColumns({"state": first, "application": status, "application_error": F.lit(None).cast("string"), "artifacts": F.lit(None).cast(lifecycle.ARTIFACTS)})
    m = lifecycle.save_artifacts(m, m.filter("id % 3 = 0").select("id", F.lit("cv").alias("artifact"), F.lit("h1").alias("cv_hash"), F.lit("text").alias("text")), NOW)
    event = F.array(*[F.lit(x) for x in ("begin", "ready", "failed", "delivered")])[(F.col("id") % 4).cast("int")]
    events = m.select("id", event.alias("event"), F.lit("cv").alias("artifact"), F.lit("h1").alias("cv_hash"), F.lit("why").alias("error"))
    return lifecycle.set_application(m, events, NOW).select("id", "state", "application")


@query("W15", "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 <> 0 THEN 'new' ELSE 'old' END AS cv_hash, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 <> 0 THEN NULL ELSE 'p' END AS career_profile, (c_custkey % 2 = 0 AND NOT (c_custkey % 4 = 0 AND c_custkey % 3 <> 0)) AND c_custkey % 5 <> 0 AS pending FROM customer")
def cv_imports(spark, sf):
    """Staged CVs are confirmed while they last, or discarded; a new CV drops the profiles of the old one."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    until = F.when(F.col("user_id") % 3 == 0, at(NOW)).otherwise(at(NOW + dt.timedelta(minutes=1)))
    pending = c.filter("user_id % 2 = 0").withColumns({"cv_hash": F.lit("new"), "cv_text": F.lit("t"), "expires_at": until})
    documents = c.withColumns({"cv_hash": F.lit("old"), "cv_text": F.lit("t"), "search_profiles": F.lit("{}"), "career_profile": F.lit("p"), "updated_at": at(NOW)})
    m = matches(spark, sf).withColumns({"queued_at": F.lit(None).cast("timestamp_ntz"), "updated_at": F.lit(None).cast("timestamp_ntz")})
    left, saved, _ = accounts.confirm_cvs(pending, documents, m, c.filter("user_id % 4 = 0"), NOW)
    left = accounts.discard_cvs(left, c.filter("user_id % 5 = 0")).select("user_id", F.lit(True).alias("p"))
    return saved.join(left, "user_id", "left").select("user_id", "cv_hash", "career_profile", F.coalesce("p", F.lit(False)).alias("pending"))


_STATUS = "['new', 'pending', 'approved', 'rejected', 'revoked'][c_custkey % 5 + 1]"


@query("W16 D8 K1", f"SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 <> 0 AND (c_custkey % 5 = 0 OR (c_custkey % 5 IN (3, 4) AND c_custkey % 2 = 0)) THEN 'pending' ELSE {_STATUS} END AS status, CAST(CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 IN (3, 4) AND c_custkey % 2 = 1 THEN 1800 ELSE 0 END AS INTEGER) AS retry_after_seconds, CASE WHEN c_custkey % 7 = 0 THEN 'ru' WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'de' END AS locale FROM customer")
def user_requests(spark, sf):
    """Requests for access with their cooldown, chosen locales, and what a later visit changes."""
    c = table(spark, sf, "customer")
    status = F.array(*[F.lit(x) for x in ("new", "pending", "approved", "rejected", "revoked")])[(F.col("c_custkey") % 5).cast("int")]
    since = F.when(F.col("c_custkey") % 2 == 0, at(NOW - dt.timedelta(hours=2))).otherwise(at(NOW - dt.timedelta(minutes=30)))
    none = F.lit(None).cast("timestamp_ntz")
    users = c.select(F.col("c_custkey").alias("user_id"), F.lit(None).cast("string").alias("username"), F.col("c_name").alias("first_name"), F.lit(None).cast("string").alias("last_name"), F.lit("de").alias("locale"), F.lit(False).alias("locale_selected"), status.alias("status"), F.lit(False).alias("is_owner"), since.alias("status_changed_at"), none.alias("access_requested_at"), none.alias("updated_at"))
    users = accounts.choose_locale(users, users.filter("user_id % 7 = 0").select("user_id", F.lit("ru").alias("locale")), NOW)
    users = accounts.touch(users, users.filter("user_id % 2 = 0").select("user_id", F.lit("u").alias("username"), "first_name", "last_name", F.lit("en").alias("locale")), NOW)
    return accounts.request_access(users, users.filter("user_id % 3 != 0"), NOW, dt.timedelta(hours=1)).select("user_id", "status", "retry_after_seconds", "locale")


@query("W16 J8", "SELECT o_orderkey AS unit_id, NOT bool_or(coalesce(l_suppkey % 2 = 1, false)) AS retired FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def deleted_users(spark, sf):
    """Every second user goes with all rows; units without a subscriber retire."""
    subs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_suppkey").alias("user_id")).distinct()
    none = F.lit(None).cast("timestamp_ntz")
    users = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id")).withColumns({"locale": F.lit("en"), "locale_selected": F.lit(True), "delivery_settings": F.lit("{}"), "digest_snapshot": F.array().cast("array<long>"), "last_digest_at": none, "updated_at": none})
    units = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), none.alias("retired_at"))
    _, _, kept = accounts.delete_user_data({"subscriptions": subs}, users, units, users.filter("user_id % 2 = 0").select("user_id"), NOW)
    return kept.select("unit_id", F.col("retired_at").isNotNull().alias("retired"))


@query("W18 K5", "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS token FROM customer WHERE c_custkey % 3 <> 0 AND NOT (c_custkey % 5 = 0 AND c_custkey % 2 = 0) AND c_custkey % 7 <> 0")
def session_releases(spark, sf):
    """Sessions that are left: not expired, not released by their holder's token, not deleted."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("chat").alias("kind"))
    state = c.withColumns({"token": F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"), "expires_at": F.when(F.col("user_id") % 3 == 0, at(NOW)).otherwise(at(NOW + dt.timedelta(minutes=1)))})
    releases = c.filter("user_id % 5 = 0").withColumn("token", F.lit("a")).union(c.filter("user_id % 7 = 0").withColumn("token", F.lit(None).cast("string")))
    return accounts.live_sessions(accounts.release_sessions(state, releases), NOW).select("user_id", "token")


@query("W19", "SELECT o_orderkey AS update_id, CASE WHEN o_orderkey % 3 = 0 THEN 'done' WHEN o_orderkey % 3 = 1 THEN 'failed' ELSE 'working' END AS status, CASE WHEN o_orderkey % 3 = 1 THEN repeat('e', 120) END AS error FROM orders WHERE o_orderkey % 4 <> 0")
def update_outcomes(spark, sf):
    """Updates in work are done or failed; those received more than a week ago are forgotten."""
    received = F.when(F.col("o_orderkey") % 4 == 0, at(NOW - dt.timedelta(days=8))).otherwise(at(NOW - dt.timedelta(days=7)))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("update_id"), received.alias("received_at")).withColumns({"status": F.lit("working"), "lease_until": at(NOW), "error": F.lit(None).cast("string"), "updated_at": at(NOW)})
    outcomes = o.filter("update_id % 3 < 2").select("update_id", F.when(F.col("update_id") % 3 == 1, F.repeat(F.lit("e"), 300)).alias("error"))
    return accounts.forget_updates(accounts.finish_updates(o, outcomes, NOW), NOW).select("update_id", "status", "error")
