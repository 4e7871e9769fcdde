"""Queries over usage events: summaries, series, funnels, spend."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import lifecycle, scheduling, usage
from ..registry import query
from ..session import NOW, table

U = "u AS (SELECT event_id, user_id, event_type AS kind, ts, CAST(props->>'$.k' AS BIGINT) AS tokens, value AS cost FROM events)"
DAY = "TIMESTAMP '2024-01-30 00:00:00'"


def events(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "user_id", F.col("event_type").alias("kind"), F.col("ts").alias("at"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").alias("cost"))


@query(
    "A1 J3 R7 F12",
    f"""WITH {U}, s AS (SELECT user_id, count(*) AS events, count(*) FILTER (ts >= {DAY}) AS events_24h, sum(cost) AS cost, max(ts) AS last_at FROM u GROUP BY user_id)
SELECT c_custkey AS user_id, coalesce(events, 0) AS events, coalesce(events_24h, 0) AS events_24h, round(coalesce(cost, 0), 4) AS cost, last_at FROM customer LEFT JOIN s ON user_id = c_custkey""",
)
def user_usage_summary(spark, sf):
    return usage.per_user(table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), events(spark, sf), NOW)


@query(
    "A2 R7",
    f"""WITH {U} SELECT count(*) AS events, count(*) FILTER (ts >= {DAY}) AS events_24h, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(coalesce(sum(tokens) FILTER (ts >= {DAY}), 0) AS BIGINT) AS tokens_24h,
round(sum(cost), 4) AS cost, round(coalesce(sum(cost) FILTER (ts >= {DAY}), 0), 4) AS cost_24h, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (ts >= {DAY}) AS users_24h,
{', '.join(f"count(*) FILTER (kind = '{k}') AS {k}_events" for k in usage.KINDS)} FROM u""",
)
def usage_totals(spark, sf):
    return usage.totals(events(spark, sf), NOW)


HOURS = "h AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-30 00:00:00', TIMESTAMP '2024-01-31 00:00:00', INTERVAL 1 HOUR)) AS hour)"


@query(
    "A3 J4 D7 R6",
    f"""WITH {U}, {HOURS} SELECT hour, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, round(coalesce(sum(cost), 0), 4) AS cost FROM h LEFT JOIN u ON ts >= hour AND ts < hour + INTERVAL 1 HOUR GROUP BY hour""",
)
def hourly_series(spark, sf):
    return usage.hourly(events(spark, sf), NOW)


@query(
    "A2 R7",
    f"""WITH {U}, m AS (SELECT ts >= {DAY} AS new, tokens AS t, cost FROM u WHERE kind = 'view')
SELECT count(*) AS turns, count(*) FILTER (new) AS turns_24h, {', '.join(f"CAST(coalesce(sum({x}), 0) AS BIGINT) AS {n}, CAST(coalesce(sum({x}) FILTER (new), 0) AS BIGINT) AS {n}_24h" for n, x in (('total_tokens', 't'), ('input_tokens', 't % 7'), ('output_tokens', 't % 5'), ('cache_read_tokens', 't % 3'), ('cache_write_tokens', 't % 2')))},
round(coalesce(sum(cost), 0), 4) AS cost, round(coalesce(sum(cost) FILTER (new), 0), 4) AS cost_24h FROM m""",
)
def model_usage(spark, sf):
    rows = events(spark, sf).withColumns({n: F.col("tokens") % k for n, k in zip(usage.TOKENS, (1 << 40, 7, 5, 3, 2), strict=True)})
    return usage.model_totals(rows, NOW, "view")


@query(
    "A4 J5",
    f"""WITH {U}, {HOURS}, o AS (SELECT o_orderkey, ts AS scored_at FROM orders JOIN u ON event_id = o_orderkey)
SELECT hour, (SELECT count(DISTINCT user_id) FROM u WHERE ts >= hour AND ts < hour + INTERVAL 1 HOUR AND kind = 'view') AS first, (SELECT count(DISTINCT o_orderkey % 7) FROM o WHERE scored_at >= hour AND scored_at < hour + INTERVAL 1 HOUR) AS second FROM h""",
)
def hourly_dual_distinct(spark, sf):
    """Listings by the time they were checked, and matches of another table by the time they were scored."""
    checked = events(spark, sf).filter("kind = 'view'").select(F.col("user_id").alias("key"), "at")
    scored = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id")).join(events(spark, sf), "event_id").select((F.col("event_id") % 7).alias("key"), "at")
    return usage.hourly_pair(checked, scored, NOW)


_RECENT = "c_custkey % 10 < 3"


@query(
    "A5 J6",
    f"""SELECT n_nationkey AS source, count(c_custkey) FILTER ({_RECENT}) AS discovered, count(*) FILTER (c_acctbal > 0 AND {_RECENT}) AS normalized, count(*) FILTER (c_acctbal < 0) AS failed, count(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS queued, count(*) FILTER (c_mktsegment = 'MACHINERY' AND {_RECENT}) AS closed,
(SELECT count(*) FROM orders JOIN customer s ON s.c_custkey = o_custkey WHERE s.c_nationkey = n_nationkey AND o_orderdate >= TIMESTAMP '2001-07-01') AS scored
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""",
)
def source_funnel(spark, sf):
    """Stages of the listings of each source, those of the last day among them, and the scores that their matches got."""
    sources = table(spark, sf, "nation").select(F.col("n_nationkey").alias("source"))
    hours = F.when(F.col("c_custkey") % 10 < 3, 20).otherwise(30)
    items = table(spark, sf, "customer").withColumns({"source": F.col("c_nationkey"), "at": F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), hours)})
    recent, balance, kind = F.col("at") >= F.lit(NOW - dt.timedelta(hours=24)).cast("timestamp_ntz"), F.col("c_acctbal"), F.col("c_mktsegment")
    scored = table(spark, sf, "orders").filter("o_orderdate >= timestamp_ntz'2001-07-01'").join(items.select(F.col("c_custkey").alias("o_custkey"), "source"), "o_custkey")
    return usage.funnel(sources, items, "source", scored, discovered=recent, normalized=(balance > 0) & recent, failed=balance < 0, queued=kind == "HOUSEHOLD", closed=(kind == "MACHINERY") & recent)


@query("A6", "SELECT o_orderpriority AS platform, count(*) AS units, count(*) FILTER (o_orderdate <= TIMESTAMP '1998-01-01') AS overdue, min(30 + o_orderkey % 690) AS low, max(30 + o_orderkey % 690) AS high, max(o_orderdate) FILTER (o_orderkey % 3 = 0) AS last_novelty_at FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1")
def unit_stats(spark, sf):
    date = F.col("o_orderdate").cast("timestamp_ntz")
    units = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("platform"), date.alias("next_run_at"), (30 + F.col("o_orderkey") % 690).alias("cadence_minutes"), F.when(F.col("o_orderkey") % 3 == 0, date).alias("last_novelty_at"), F.when(F.col("o_orderkey") % 11 == 0, date).alias("retired_at"))
    return usage.unit_stats(units, dt.datetime(1998, 1, 1))


@query("A7 F1 K12 F13", "SELECT count(*) FILTER (s IN (0, 1) AND due) AS queued, count(*) FILTER (s = 2 AND NOT due) AS active_claims, count(*) FILTER (s = 2 AND due) AS expired_claims, count(*) FILTER (s < 4 AND (c_custkey % 7 = 0 OR c_custkey % 5 = 0)) AS undecodable FROM (SELECT c_custkey, c_custkey % 6 AS s, c_custkey % 4 <> 0 AS due FROM customer)")
def queue_health(spark, sf):
    c = table(spark, sf, "customer")
    status = F.array(*[F.lit(x) for x in ("listed", "failed", "normalizing", "normalized", "closed", "duplicate")])[(F.col("c_custkey") % 6).cast("int")]
    turn = F.lit(NOW).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.when(F.col("c_custkey") % 4 != 0, -1).otherwise(1))
    url = F.when(F.col("c_custkey") % 7 == 0, "ftp://x").otherwise("https://example.org/a")
    number = F.when(F.col("c_custkey") % 5 == 0, " padded").otherwise(F.col("c_custkey").cast("string"))
    good = lifecycle.decodable(F.lit("site"), number, url, F.sha2("c_name", 256))
    return usage.queue_health(c.withColumns({"status": status, "next_normalization_at": turn}), good, NOW)


@query("A8", "SELECT p_name[1:6] AS text, count(*) AS n FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 5 <> 0 GROUP BY 1 ORDER BY n DESC, text LIMIT 3")
def top_errors(spark, sf):
    """The most frequent errors of the last day, cut short."""
    hours = F.when(F.col("p_partkey") % 2 == 0, 24).otherwise(25)
    rows = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("error"), (F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), hours)).alias("at"))
    return usage.top_texts(rows, "error", 3, 6, F.col("at") >= F.lit(NOW - dt.timedelta(hours=24)).cast("timestamp_ntz"))


@query("A12 W17", f"WITH {U} SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, CAST(sum(CAST(cost AS DECIMAL(14, 8))) AS DOUBLE) AS spent FROM u GROUP BY ALL")
def daily_spend(spark, sf):
    return usage.daily_spend(events(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query("A13 F11", f"WITH {U} SELECT user_id, round(sum(cost), 4) AS spent FROM u WHERE ts >= {DAY} AND ts < {DAY} + INTERVAL 1 DAY GROUP BY user_id")
def spent_today(spark, sf):
    return usage.spent_on(events(spark, sf), dt.date(2024, 1, 30)).select("user_id", F.round("spent", 4).alias("spent"))


@query(
    "D4 A13",
    f"WITH {U}, s AS (SELECT user_id, sum(cost) AS spent FROM u WHERE ts >= {DAY} AND ts < {DAY} + INTERVAL 1 DAY GROUP BY user_id) SELECT c_custkey AS user_id, CASE WHEN coalesce(spent, 0) >= 30.0 THEN 'skipped' ELSE 'drained' END AS outcome FROM customer LEFT JOIN s ON user_id = c_custkey",
)
def budget_pace(spark, sf):
    spent = usage.spent_on(events(spark, sf), dt.date(2024, 1, 30))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return users.join(spent, "user_id", "left").select("user_id", scheduling.pace(F.col("spent"), 60.0, dt.datetime(2024, 1, 30, 12)).alias("outcome"))


@query("A18", f"WITH {U}, x AS (SELECT CASE WHEN kind <> 'error' THEN kind END AS kind, 'model' || (event_id % 3) AS model, tokens FROM u) SELECT 'agent' AS \"grouping\", kind AS name, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM x GROUP BY kind UNION ALL SELECT 'model', model, count(*), CAST(sum(tokens) AS BIGINT) FROM x GROUP BY model")
def usage_by_agent_and_model(spark, sf):
    rows = events(spark, sf).withColumns({"model": F.concat(F.lit("model"), (F.col("event_id") % 3).cast("string")), "kind": F.when(F.col("kind") != "error", F.col("kind"))})
    return usage.by_agent_and_model(rows, "kind", "model")


@query("A18", f"WITH {U} SELECT user_id, count(*) - count(*) FILTER (ts < {DAY}) AS calls, CAST(sum(tokens) - coalesce(sum(tokens) FILTER (ts < {DAY}), 0) AS BIGINT) AS tokens FROM u GROUP BY user_id")
def usage_since(spark, sf):
    rows = events(spark, sf)
    total = lambda x: x.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))
    return usage.since(total(rows), total(rows.filter(F.col("at") < F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))), "user_id", "calls", "tokens")


@query("A19", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("A22", "SELECT l_orderkey, l_linenumber, l_partkey, round(o_totalprice / count(*) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def cost_share(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    shares = usage.cost_share(lines, table(spark, sf, "orders"), "o_orderkey", "o_totalprice")
    return shares.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_partkey", F.round("share", 6).alias("share"))


@query("A21", "WITH p AS (SELECT min(l_linenumber) AS m FROM lineitem) SELECT CAST(min(l_linenumber) AS INTEGER) AS phase, CAST(sum(l_quantity) AS BIGINT) AS current, count(*) AS total FROM lineitem, p WHERE l_linenumber = m")
def ordered_progress(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("phase"), F.col("l_quantity").cast("long").alias("current"), F.lit(1).alias("total"))
    return usage.progress(rows)


@query("A11", "SELECT DISTINCT user_id FROM events")
def distinct_users(spark, sf):
    return events(spark, sf).select("user_id").distinct()
