"""Queries for single rules of matching, accounting and sources, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json as j
from ..functions import text as t
from ..operators import lifecycle, matching, reporting
from ..registry import query
from ..session import NOW, table
from ..sources import readers
from ..streaming import lanes
from . import usage_plans, work_plans
from .text_plans import _NAME, _TYPE, _name_and_type, sql_jaccard, sql_ngrams

_RESOLVED = lambda x: f"list_distinct(list_transform({x}, lambda t: t[1:3]))"


@query("T7 T19", f"SELECT p_partkey, round(greatest({sql_jaccard(_RESOLVED(_NAME), _RESOLVED(_TYPE))}, {sql_jaccard(sql_ngrams(_NAME), sql_ngrams(_TYPE))}), 6) AS likeness FROM part")
def resolved_similarity(spark, sf):
    """Tokens compared by what a resolver makes of them (here their first three letters), raw ones by their n-grams."""
    likeness = t.token_similarity(F.col("a"), F.col("b"), lambda x: F.substring(x, 1, 3))
    return _name_and_type(spark, sf).select("p_partkey", F.round(likeness, 6).alias("likeness"))


@query("S6", """WITH d AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' Greenhouse:' || lower(p_brand[1:5]) || p_size || ' ' WHEN 1 THEN 'lever:' || p_size WHEN 2 THEN 'nowhere:' || p_size ELSE 'ashby' END AS text FROM part),
k AS (SELECT lower(split_part(trim(text), ':', 1)) AS provider, split_part(trim(text), ':', 2) AS slug FROM d WHERE contains(text, ':'))
SELECT provider, slug, count(*) AS declared FROM k WHERE provider IN ('greenhouse', 'lever', 'ashby', 'smartrecruiters') GROUP BY ALL""")
def declared_boards(spark, sf):
    """Declarations provider:slug, each board once with the number of times it was declared; other texts are passed over."""
    part = table(spark, sf, "part")
    size, kind = F.col("p_size").cast("string"), (F.col("p_partkey") % 4).cast("int")
    brand = F.lower(F.substring("p_brand", 1, 5))
    texts = F.array(F.concat(F.lit(" Greenhouse:"), brand, size, F.lit(" ")), F.concat(F.lit("lever:"), size), F.concat(F.lit("nowhere:"), size), F.lit("ashby"))
    keys = part.select(readers.board_key(F.get(texts, kind)).alias("k")).filter("k IS NOT NULL")
    return keys.groupBy("k.provider", "k.slug").agg(F.count(F.lit(1)).alias("declared"))


@query("H7", """SELECT p_partkey, '{"brand":"' || p_brand || '","size":"' || CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END || '"}' AS stored FROM part""")
def changed_fields(spark, sf):
    """One field of a stored object set and another dropped; the others stay in their order."""
    part = table(spark, sf, "part")
    stored = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.lit("?"), F.lit("type"), F.col("p_type"))
    new = j.drop_field(j.set_field(stored, "size", F.when(F.col("p_size") > 25, "large").otherwise("small")), "type")
    return part.select("p_partkey", F.to_json(new).alias("stored"))


@query("T20", f"SELECT p_partkey, array_to_string(list_filter({_NAME}, lambda x: list_contains(['almond', 'blue', 'green', 'red'], x)), ' ') AS matched FROM part")
def title_tokens_matched(spark, sf):
    """The tokens of a title that a track has too, in the title's order."""
    track = t.strings(["red", "green", "blue", "almond"])
    return table(spark, sf, "part").select("p_partkey", F.array_join(matching.matched_title_tokens(F.split(F.lower("p_name"), " "), track), " ").alias("matched"))


@query("F10 D6", f"""WITH e AS (SELECT event_id, event_id % 4 = 0 AS known, CASE WHEN ts <= TIMESTAMP '{NOW}' - INTERVAL 3 DAY THEN ts END AS published_at FROM events)
SELECT event_id, published_at, coalesce(NOT known AND published_at < TIMESTAMP '{NOW}' - INTERVAL 13 DAY, false) AS dropped FROM e""")
def fresh_publications(spark, sf):
    """Dates after the clock are unknown; stale ones drop rows that are not known yet."""
    import datetime as dt

    told = lifecycle.fresh_publication(F.col("ts"), F.col("event_id") % 4 == 0, NOW - dt.timedelta(days=3), 10)
    return table(spark, sf, "events").select("event_id", told.alias("p")).select("event_id", "p.published_at", F.coalesce("p.dropped", F.lit(False)).alias("dropped"))


@query("W14 W17", work_plans._sql("SELECT user_id, 'application' AS kind, 'tailor-application' AS agent, count(*) AS n FROM m WHERE id % 8 = 3 GROUP BY user_id"))
def delivered_applications(spark, sf):
    """Usage booked with the applications that events delivered: ready ones only."""
    ready = F.when(F.col("id") % 8 == 3, "ready").otherwise("preparing")
    before = work_plans.matches(spark, sf).withColumns({"state": F.lit("applying"), "application": ready, "application_error": F.lit(None).cast("string"), "artifacts": F.lit(None).cast(lifecycle.ARTIFACTS)})
    events = before.filter("id % 4 = 3").select("id", F.lit("delivered").alias("event"), F.lit("cv").alias("artifact"), F.lit("h1").alias("cv_hash"), F.lit(None).cast("string").alias("error"))
    booked = lifecycle.application_usage(before, lifecycle.set_application(before, events, NOW), events, NOW)
    return booked.groupBy("user_id", "kind", "agent").agg(F.count(F.lit(1)).alias("n"))


@query("R7 A13", f"""WITH {usage_plans.U}, w AS (SELECT user_id, cost, unnest(range(0, 24)) AS back, date_trunc('hour', ts) AS hour FROM u)
SELECT user_id, hour - to_hours(CAST(back AS INTEGER)) + INTERVAL 24 HOUR AS until, count(*) AS events, round(sum(cost), 4) AS cost FROM w GROUP BY ALL""")
def trailing_days(spark, sf):
    """Usage of each user in the 24 hours before every full hour."""
    day = lanes.trailing_day(usage_plans.events(spark, sf))
    return day.select("user_id", F.col("window.end").alias("until"), "events", F.round("cost", 4).alias("cost"))


@query("P24", """WITH p AS (SELECT p_partkey, p_retailprice / 12 AS raw FROM part), s AS (SELECT *, pow(10.0, floor(log10(raw))) AS power FROM p)
SELECT p_partkey, CASE WHEN raw / power <= 1 THEN 1 WHEN raw / power <= 2 THEN 2 WHEN raw / power <= 5 THEN 5 ELSE 10 END * power AS step FROM s""")
def chart_steps(spark, sf):
    return table(spark, sf, "part").select("p_partkey", reporting.nice_step(F.col("p_retailprice")).alias("step"))


@query("S17", """SELECT 'orders' AS name, o_orderkey AS key, o_orderstatus || '/' || o_orderpriority AS said FROM orders WHERE o_custkey = 7
UNION ALL SELECT 'customers', c_custkey, c_name || '/' || c_mktsegment FROM customer WHERE c_custkey = 7""")
def exported_rows(spark, sf):
    """The JSON of one user's export, read back: every row with its key and texts."""
    tables = {"orders": table(spark, sf, "orders").withColumnRenamed("o_custkey", "user_id"), "customers": table(spark, sf, "customer").withColumnRenamed("c_custkey", "user_id")}
    rows = readers.export_user(spark, 7, tables)
    kind = "array<struct<user_id:long,o_orderkey:long,o_orderstatus:string,o_orderpriority:string,c_name:string,c_mktsegment:string>>"
    read = rows.select("name", F.explode(F.from_json("json", kind)).alias("x")).select("name", "x.*")
    said = F.concat_ws("/", "o_orderstatus", "o_orderpriority", "c_name", "c_mktsegment")
    return read.select("name", F.coalesce("o_orderkey", "user_id").alias("key"), said.alias("said"))
