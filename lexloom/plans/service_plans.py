"""Queries of scoring, delivery, reporting, sources and streams."""

from __future__ import annotations

import datetime as dt
import functools
import itertools
import json
import uuid

from pyspark.sql import functions as F

from ..functions import parsers
from ..functions import text as t
from ..operators import accounts, documents, lifecycle, matching, profiles, queues, reporting, scoring, usage
from ..registry import query
from ..session import NOW, shared_folder, spread, table
from ..sources import readers, streams, versions
from ..streaming import lanes
from . import usage_plans, work_plans


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def _model(prompt: str) -> str:
    return f"Here you are: ```json\n{json.dumps({'total': int(prompt.split()[0]) % 101})}\n```"


@query("U6 K24 K25 W8 A20", work_plans._sql("SELECT id, CASE WHEN state = 'queued' AND nth <= 4 THEN 'scored' ELSE state END AS state, CASE WHEN state = 'queued' AND nth <= 4 THEN CAST(id % 101 AS DOUBLE) ELSE score END AS score FROM (SELECT *, row_number() OVER (PARTITION BY state, user_id ORDER BY coalesce(prescore, lexical) DESC NULLS LAST, matched_at, id) AS nth FROM m)"))
def score_pending(spark, sf):
    m = work_plans.matches(spark, sf)
    new, _ = scoring.score_pending(m, table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), _model, F.concat_ws(" ", F.col("id").cast("string"), "source"), NOW, 4, 2)
    return new.select("id", "state", "score")


@query("K16 X6", "SELECT p_partkey, p_partkey % 3 <> 0 AND (p_partkey % 4 <> 0 OR p_size <= 49) AS valid FROM part")
def score_contract(spark, sf):
    p = table(spark, sf, "part").withColumn("size", F.least("p_size", F.lit(100)))
    # the total is split over the dimensions; every third row is off by one
    left, parts = F.col("size"), {}
    for name, most in scoring.DIMENSIONS.items():
        parts[name] = F.least(left, F.lit(most))
        left = left - parts[name]
    hard = F.col("p_partkey") % 4 == 0
    total = F.col("size") + F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)
    return p.select("p_partkey", scoring.valid_score(total, parts, F.when(hard, 1).otherwise(0), hard).alias("valid"))


@query("X6 A19", "SELECT o_custkey AS batch, NOT bool_or(o_orderkey % 7 = 0) AS exact FROM orders GROUP BY 1")
def answer_cover(spark, sf):
    asked = table(spark, sf, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("id"))
    return scoring.covered(asked, asked.filter("id % 7 != 0"), "batch", "id")


@query("P23", "SELECT p_partkey, 'from ' || format('{:,}', CAST(round(p_retailprice * 1000) AS BIGINT)) || ' USD gross per year' AS line FROM part")
def salary_lines(spark, sf):
    value = F.struct((F.col("p_retailprice") * 1000).alias("from"), F.lit(None).cast("double").alias("to"), F.lit("USD").alias("currency"), F.lit(True).alias("gross"), F.lit("year").alias("period"))
    return table(spark, sf, "part").select("p_partkey", value.alias("s")).select("p_partkey", reporting.salary(F.col("s")).alias("line"))


@query("P23 K26", "SELECT event_id, CASE WHEN s < 60 THEN s || ' s' WHEN floor(s / 60.0 + 0.5) < 60 THEN CAST(floor(s / 60.0 + 0.5) AS BIGINT) || ' min' ELSE CAST(floor(floor(s / 60.0 + 0.5) / 60 + 0.5) AS BIGINT) || ' h' END AS spent FROM (SELECT event_id, event_id * 7 AS s FROM events)")
def durations(spark, sf):
    return table(spark, sf, "events").select("event_id", reporting.duration(F.col("event_id") * 7000).alias("spent"))


@query("P24 K26", f"WITH {usage_plans.U}, {usage_plans.HOURS}, s AS (SELECT hour, coalesce(sum(tokens), 0) AS n FROM h LEFT JOIN u ON ts >= hour AND ts < hour + INTERVAL 1 HOUR GROUP BY hour) SELECT string_agg(substr(' ▁▂▃▄▅▆▇█', CAST(least(8, floor(n / (SELECT max(n) FROM s) * 8 + 0.5)) AS INTEGER) + 1, 1), '' ORDER BY hour) AS bars FROM s")
def usage_chart(spark, sf):
    hours = usage.hourly(usage_plans.events(spark, sf), NOW)
    values = hours.agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "tokens"))), lambda x: x["tokens"]).alias("v"))
    return values.select(reporting.chart(F.col("v")).alias("bars"))


@query("K26", f"WITH {usage_plans.U} SELECT 'events' AS name, format('{{:,}}', count(*)) AS text FROM u UNION ALL SELECT 'users', format('{{:,}}', count(DISTINCT user_id)) FROM u")
def status_text(spark, sf):
    return reporting.status_lines(usage.totals(usage_plans.events(spark, sf), NOW).select("events", "users"))


@query("T2 T11 T12", None)
def clean_text_whole(spark, sf):
    """Letters that are left of each document without contact data; tests/test_text.py compares all of them with brute force."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(t.words(t.nfkc(t.relevance_text(F.col("text"))), r"\p{L}")).cast("long").alias("letters"))


@query("T2 T11 T12", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(p_type) || ' fix' WHEN 1 THEN 'see ' || lower(p_type) WHEN 2 THEN 'call ' || lower(p_type) ELSE '' END AS words FROM part")
def clean_text(spark, sf):
    """Plain words without contact lines, addresses, links and telephone numbers, in compatibility form."""
    kind = F.col("p_type")
    texts = [F.concat(F.lit("E-mail: me\n"), kind, F.lit(" ﬁx")), F.concat(F.lit("see https://x.org/a?b=c "), kind, F.lit(" a.b@c.org")), F.concat(F.lit("call +7 (999) 123-45-67 "), kind, F.lit("\r\nmy Telegram is here")), F.concat(F.lit("почта: "), kind)]
    words = t.plain_words(F.array(*texts)[(F.col("p_partkey") % 4).cast("int")])
    return table(spark, sf, "part").select("p_partkey", F.array_join(words, " ").alias("words"))


@query("O14", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey % 3, p_name, p_partkey) AS INTEGER) AS place FROM part")
def code_unit_order(spark, sf):
    """Code units put letters beyond the basic plane before its last ones; code points, as Spark sorts, do not."""
    first = F.array(F.lit("z"), F.lit("\U0001f600"), F.lit("｡"))[(F.col("p_partkey") % 3).cast("int")]
    rows = queues.numbered(table(spark, sf, "part").select("p_partkey", t.code_units(F.concat(first, "p_name")).alias("units")), "before", "units", "p_partkey")
    return rows.select("p_partkey", (F.col("before") + 1).cast("int").alias("place"))


_CLAIMS_SQL = """WITH p AS (SELECT *, p_partkey % 2 = 0 AS grew, p_partkey % 3 = 0 AS known, p_partkey % 5 = 0 AS mailed FROM part)
SELECT p_partkey, 1 AS place, 'new-number' AS kind, '40%' AS value FROM p WHERE grew
UNION ALL SELECT p_partkey, 2, 'unknown-contact', 'x@y.z' FROM p WHERE NOT mailed
UNION ALL SELECT p_partkey, 3, 'unknown-entry', 'Ghost ' || p_brand FROM p WHERE NOT known
UNION ALL SELECT p_partkey, 4, 'unsupported-skill', 'Cobol' FROM p"""


@query("P18 K21", _CLAIMS_SQL)
def evidence_claims(spark, sf):
    """Claims of tailored CVs that their sources do not bear out."""
    part = spread(table(spark, sf, "part").select("p_partkey", "p_brand")).withColumns({"grew": F.col("p_partkey") % 2 == 0, "known": F.col("p_partkey") % 3 == 0, "mailed": F.col("p_partkey") % 5 == 0})
    source = F.concat(F.lit("I write JavaScript since 2019, saved 1 000 hours for "), "p_brand", F.when(F.col("mailed"), ", reach me at X@Y.Z/").otherwise(""))
    entry = F.struct(F.lit("entry").alias("kind"), F.concat(F.when(F.col("known"), "").otherwise("Ghost "), "p_brand").alias("title"), F.array(F.when(F.col("grew"), "grew 40 % since 2019").otherwise("1,000 hours"), F.lit("K8s")).alias("bullets"))
    skills = F.struct(F.lit("facts").alias("kind"), F.array(F.struct(F.lit("Languages").alias("term"), F.lit("JS; Cobol | COBOL").alias("detail"))).alias("items"))
    blocks = F.concat(F.lit("["), F.to_json(entry), F.lit(","), F.to_json(skills), F.lit("]"))
    cv = F.concat(F.lit('{"cv":{"name":"N","contacts":[{"value":"x@y.z"}],"sections":[{"title":"Work","blocks":'), blocks, F.lit("}]}}"))
    rows = documents.evidence_issues(documents.repaired(part.select("p_partkey", cv.alias("cv"), source.alias("source")), "cv"), "cv", "source")
    order = F.array_position(t.strings(["new-number", "unknown-contact", "unknown-entry", "unsupported-skill"]), F.col("x.kind")).cast("int")
    return rows.select("p_partkey", F.explode("issues").alias("x")).select("p_partkey", order.alias("place"), "x.kind", "x.value")


@query("P15", None)
def structured_cvs(spark, sf):
    """Documents of enough letters read as CVs; tests/test_text.py has known readings and counts the documents read."""
    read = documents.with_cvs(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return read.select("doc_id", "cv.name", "cv.headline", F.size("cv.sections").alias("sections"), F.aggregate("cv.sections", F.lit(0), lambda n, s: n + F.size(s["blocks"])).alias("blocks"))


@query("P15 P16", "SELECT p_partkey, p_brand || ' ' || p_type AS name, 'WORK HISTORY,Skills' AS titles, 'entry,facts,text' AS kinds, p_name || ';since then' AS items, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS facts FROM (SELECT * REPLACE (replace(p_brand, '#', ' ') AS p_brand) FROM part)")
def cv_readings(spark, sf):
    """A text read as a CV, sent through a model's envelope, and repaired."""
    part = spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand")).withColumn("p_brand", F.replace("p_brand", F.lit("#"), F.lit(" ")))
    lines = [F.concat_ws(" ", "p_brand", "p_type"), F.lit(""), F.lit("WORK HISTORY"), F.lit("Acme Corporation of Everywhere 2019 – present"), F.concat(F.lit("* "), "p_name"), F.lit("• since then"), F.lit("Skills:"), F.lit("Known: SQL"), F.when(F.col("p_partkey") % 2 == 0, "Also: Spark").otherwise(""), F.lit("A long line of prose that follows after the facts and"), F.lit("goes on in the line below.")]
    cv = documents.read_cv(F.concat_ws("\n", *lines))
    read = documents.repaired(part.select("p_partkey", F.concat(F.lit('{"document":'), F.to_json(cv), F.lit("}")).alias("cv")), "cv")
    blocks = read.select("p_partkey", "cv.name", F.array_join(F.col("cv.sections.title"), ",").alias("titles"), F.flatten("cv.sections.blocks").alias("b"))
    return blocks.select("p_partkey", "name", "titles", F.array_join(F.col("b.kind"), ",").alias("kinds"), F.array_join(F.col("b")[0]["bullets"], ";").alias("items"), F.size(F.col("b")[1]["facts"]).alias("facts"))


_CANONICAL = "CASE l_partkey % 6 WHEN 0 THEN '1' || n WHEN 1 THEN '-' || (l_partkey % 1000) || '.5' WHEN 2 THEN (l_partkey % 1000) || '%' WHEN 3 THEN '1234' || n WHEN 4 THEN (l_partkey % 1000) || '.25k' ELSE '+0' END"


@query("P19", f"SELECT l_orderkey, l_linenumber, l_partkey, {_CANONICAL} AS canonical FROM (SELECT *, lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') AS n FROM lineitem)")
def canonical_numbers(spark, sf):
    n = F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0")
    written = F.array(F.concat(F.lit("1,"), n), F.concat(F.lit("-00"), n, F.lit(",5")), F.concat(F.lit("0"), n, F.lit(" %")), F.concat(F.lit("1.234."), n), F.concat(F.lit("0'0"), n, F.lit(".25K")), F.lit("+ 000"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", parsers.canonical_number(written[(F.col("l_partkey") % 6).cast("int")]).alias("canonical"))


@query("P9 K17", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'range' WHEN 1 THEN 'range' WHEN 2 THEN 'other' ELSE 'unspecified' END AS kind, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size + 0.5 END AS minimum_years, CASE WHEN p_partkey % 4 = 2 THEN p_name END AS label, CASE p_partkey % 5 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'on-site' WHEN 3 THEN 'other' ELSE 'unspecified' END AS form FROM part")
def company_labels(spark, sf):
    """Experience and work format as company pages label them."""
    years = F.array(F.concat(F.lit("от "), "p_size", F.lit(" лет")), F.concat(F.col("p_size").cast("string"), F.lit(",5 years or so, 99 years")), F.concat(F.lit(" "), "p_name", F.lit("\n")), F.lit(" "))[(F.col("p_partkey") % 4).cast("int")]
    form = F.array(F.lit("УДАЛЕННО, hybrid"), F.lit("Гибрид, office"), F.lit("On site"), F.lit("a tent"), F.lit(""))[(F.col("p_partkey") % 5).cast("int")]
    return table(spark, sf, "part").select("p_partkey", parsers.experience(years).alias("e"), parsers.work_format(form).alias("form")).select("p_partkey", "e.kind", "e.minimum_years", "e.label", "form")


@query("P2 P3", "SELECT p_partkey, p_name || ' ' || chr(1040 + p_size % 32) || 'é' || chr(128512 + p_size) || ' &lt; it''s & | x' AS text FROM part")
def character_references(spark, sf):
    """Numeric and named references in listing text, each decoded once."""
    n = F.col("p_size")
    html = F.concat(F.lit("<p>"), "p_name", F.lit("</p>&#"), (1040 + n % 32).cast("string"), F.lit(";&#xE9;&#X"), F.hex((128512 + n).cast("long")), F.lit("; &amp;lt; it&#39;s &amp; |&bogus;&#1114112;x"))
    return table(spark, sf, "part").select("p_partkey", t.html_text(html).alias("text"))


@query("T24 P1", "SELECT p_partkey, p_name || chr(10) || p_brand || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN 'experience ' || p_size || ' or more years' WHEN p_partkey % 3 = 1 THEN 'experience unspecified' ELSE 'experience ' || p_type END || chr(10) || 'remote' || chr(10) || 'fix it' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'SQL' || chr(10) || 'Go' ELSE '' END AS evidence FROM part")
def listing_evidence(spark, sf):
    """The semantic text of a listing: seven fields, description, skills."""
    label = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_size", F.lit(" years"))).when(F.col("p_partkey") % 3 == 1, "").otherwise(F.col("p_type"))
    skills = F.when(F.col("p_partkey") % 2 == 0, t.strings([" SQL", "", "Go"])).otherwise(F.array().cast("array<string>"))
    none = F.lit(None).cast("string")
    return table(spark, sf, "part").select("p_partkey", t.listing_evidence(F.concat(F.lit(" "), "p_name"), F.col("p_brand"), none, parsers.experience(label), F.lit(" "), none, F.lit("remote"), F.lit("ﬁx\n\u00a0it"), skills).alias("evidence"))


@query("P22 K23", "WITH RECURSIVE l AS (SELECT l_orderkey, list(l_returnflag || repeat('x', CAST(floor(l_quantity) AS INTEGER)) ORDER BY l_linenumber, l_partkey, l_returnflag || repeat('x', CAST(floor(l_quantity) AS INTEGER))) AS lines FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey, lines, 1 AS k, lines[1] AS last, CAST([] AS VARCHAR[]) AS done FROM l UNION ALL SELECT l_orderkey, lines, k + 1, CASE WHEN len(last) + 1 + len(lines[k + 1]) <= 80 THEN last || chr(10) || lines[k + 1] ELSE lines[k + 1] END, CASE WHEN len(last) + 1 + len(lines[k + 1]) <= 80 THEN done ELSE list_append(done, last) END FROM r WHERE k < len(lines)) SELECT l_orderkey, array_to_string(list_append(done, last), '|') AS messages FROM r WHERE k = len(lines)")
def message_split(spark, sf):
    line = F.struct("l_linenumber", "l_partkey", F.concat("l_returnflag", F.repeat(F.lit("x"), F.col("l_quantity").cast("int"))).alias("text"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]).alias("lines"))
    return lines.select("l_orderkey", F.array_join(documents.split_message(F.col("lines"), F.lit(80)), "|").alias("messages"))


@functools.lru_cache(maxsize=1)
def _stored(folder: str, brand: str) -> list[tuple]:
    """The parts of a brand, read once by the worker that follows its pages."""
    import pyarrow.parquet as pq

    found = pq.read_table(f"{folder}/part.parquet", columns=["p_partkey", "p_name"], filters=[("p_brand", "=", brand)]).sort_by("p_partkey")
    return list(zip(*(c.to_pylist() for c in found.columns), strict=True))


def _stored_page(folder: str, brand: str, cursor: str | None, size: int = 3) -> tuple[list[dict], str | None]:
    """The next parts of a brand from a cursor on."""
    begin, held = int(cursor or 0), _stored(folder, brand)
    rows = [{"id": k, "title": n, "url": f"https://example.org/{k}"} for k, n in held[begin : begin + size]]
    return rows, str(begin + size) if begin + size < len(held) else None


class _Parts:
    """Pages of the parts of each brand, read on from where the brand's last page ended; holds a batch of each."""

    def __init__(self, folder: str):
        self.folder, self.open = folder, {}

    def __getstate__(self):
        return {"folder": self.folder, "open": {}}

    def _rows(self, brand: str):
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.folder)
        found = files.get_file_info(fs.FileSelector(f"{root}/brand={brand.encode().hex().upper()}"))
        for path in sorted(x.path for x in found if x.base_name.endswith(".parquet")):
            with files.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(4096, columns=["p_partkey", "p_name"]):
                    yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def page(self, brand: str, cursor: str | None, size: int) -> tuple[list[dict], str | None]:
        begin = int(cursor or 0)
        at, held, rows = self.open.pop(brand, (None, None, None))
        if at != begin:
            held, rows = [], itertools.islice(self._rows(brand), begin, None)
        found = held + list(itertools.islice(rows, size + 1 - len(held)))  # one more tells whether a page follows
        if len(found) > size:
            self.open[brand] = begin + size, found[size:], rows
        return [{"id": k, "title": n, "url": f"https://example.org/{k}"} for k, n in found[:size]], str(begin + size) if len(found) > size else None


@query("S1 S3 S4 U2 R2", "SELECT p_brand AS search_name, count(*) AS found, count(DISTINCT p_partkey) AS listings FROM part GROUP BY 1")
def streamed_listing(spark, sf):
    """The same parts as a stream of pages: a budget of pages for each trigger, until no search has a page left."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    brands = [r[0] for r in part.select("p_brand").distinct().orderBy("p_brand").collect()]
    base = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}"
    # files of a brand, which hold its parts in the order of their keys
    part.withColumn("brand", F.hex("p_brand")).repartitionByRange("brand", "p_partkey").sortWithinPartitions("brand", "p_partkey").drop("p_brand").write.partitionBy("brand").parquet(f"{base}/parts")
    parts = _Parts(f"{base}/parts")
    source = readers.PageSource("parts", lambda search, cursor: parts.page(search.text, cursor, 500), lambda payload: payload, None, [readers.Search(b, b) for b in brands])
    name = f"lexloom_stream_{uuid.uuid4().hex[:12]}"
    spark.dataSource.register(streams.stream_source(name, source, f"{base}/landed", 2 * len(brands)))
    spark.createDataFrame([], readers.LISTING).write.parquet(f"{base}/out")
    # one run to the end: each start reads again what has landed
    run = spark.readStream.format(name).load().writeStream.format("parquet").option("checkpointLocation", f"{base}/check").option("path", f"{base}/out").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return spark.read.schema(readers.LISTING).parquet(f"{base}/out").groupBy("search_name").agg(F.count(F.lit(1)).alias("found"), F.count_distinct("source_id").alias("listings"))


@query("S1 S2 S3 U1 U2", "SELECT p_brand AS search_name, count(*) AS found FROM part GROUP BY 1")
def paged_listing(spark, sf):
    """Pages of a registered data source over all parts: one partition for each search, cursors followed inside it."""
    part = table(spark, sf, "part")
    brands = [r[0] for r in part.select("p_brand").distinct().orderBy("p_brand").collect()]  # the configured searches
    most = part.groupBy("p_brand").count().agg(F.max("count")).first()[0] or 0
    fetch = lambda search, cursor: _stored_page(sf, search.text, cursor)
    source = readers.PageSource("parts", fetch, lambda payload: payload, None, [readers.Search(b, b) for b in brands])
    registry = readers.Registry()
    registry.add(source, ["example.org"])
    spark.dataSource.register(readers.listing_source("lexloom_parts", source, max(10_000, most * len(brands))))
    return spark.read.format("lexloom_parts").load().groupBy("search_name").agg(F.count(F.lit(1)).alias("found"))


@query("K3 J1", "SELECT o_orderkey AS id, o_totalprice AS score FROM orders WHERE o_orderkey % 7 = 0 AND o_orderstatus = 'F'")
def scored_by_id(spark, sf):
    """Scored matches among the ids asked for."""
    asked = table(spark, sf, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id"))
    return work_plans.matches(spark, sf).join(asked, "id", "left_semi").filter("state = 'scored'").select("id", "score")


@query("K4", "SELECT c_custkey AS user_id, CAST(CASE WHEN c_custkey % 4 = 0 AND c_nationkey < 24 THEN c_nationkey WHEN c_custkey % 4 = 3 THEN NULL ELSE 9 END AS VARCHAR) AS hour FROM customer")
def delivery_settings(spark, sf):
    """Stored settings are replaced by those that can be read; malformed ones are none."""
    stored = F.when(F.col("c_custkey") % 4 == 3, '{"enabled":true,"digestHourUtc":99,"timezone":"UTC"}').otherwise('{"enabled":true,"digestHourUtc":9,"timezone":"UTC"}')
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), stored.alias("delivery_settings"), F.lit(None).cast("timestamp_ntz").alias("updated_at"), "c_nationkey")
    new = F.when(F.col("user_id") % 4 == 0, F.to_json(F.struct(F.lit(True).alias("enabled"), F.col("c_nationkey").alias("digestHourUtc"), F.lit("UTC").alias("timezone")))).otherwise("{broken")
    changes = users.filter("user_id % 4 < 2").select("user_id", new.alias("settings"))
    return accounts.save_settings(users, changes, NOW).select("user_id", accounts.read_settings(F.col("delivery_settings"))["digest_hour"].cast("string").alias("hour"))


@query("K10 S16 W12", "SELECT count(*) AS n, 2 AS version FROM part WHERE p_size > 25")
def versioned_replace(spark, sf):
    """A derived table is replaced twice; a third try that was not completed is not seen."""
    base = _folder(spark, "versions")
    for condition in ("p_size > 40", "p_size > 25"):
        number = versions.replace(table(spark, sf, "part").filter(condition), base)
    table(spark, sf, "part").limit(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{base}/v{number + 1}")
    found = versions.read(spark, base)
    return found.agg(F.count(F.lit(1)).alias("n"), F.lit(versions.versions(spark, base)[-1]).alias("version"))


@query("S18", "SELECT * FROM (VALUES ('absent_table', false), ('present_table', true)) AS v(name, ready)")
def store_ready(spark, sf):
    """Which tables of the store are there."""
    table(spark, sf, "region").createOrReplaceTempView("present_table")
    found = readers.ready(spark, ["absent_table", "present_table"])
    return spark.createDataFrame(sorted(found.items()), "name string, ready boolean")


@query("K23", "WITH a AS (SELECT o_custkey AS user_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders), b AS (SELECT *, min(CASE WHEN id % 5 = 0 THEN nth END) OVER (PARTITION BY user_id) AS stop FROM a WHERE nth <= 30) SELECT user_id, id, stop IS NULL OR nth < stop AS sent FROM b")
def alert_delivery(spark, sf):
    """Alerts of each user in order; a refusal defers the rest."""
    queue = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return scoring.delivered(queue, lambda row: row["id"] % 5 != 0, 30).select("user_id", "id", "sent")


@query("R10", "SELECT o_orderkey AS job, o_orderkey % 3 = 0 OR o_orderkey % 30 >= 24 AS due FROM orders")
def cadence_guards(spark, sf):
    """Daily jobs that are due: never run, or last run a day ago."""
    last = F.when(F.col("o_orderkey") % 3 != 0, F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 30).cast("int")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), lanes.is_due(last, NOW, dt.timedelta(days=1)).alias("due"))


@query("U4", "SELECT p_partkey, p_partkey % 5 <> 0 AND p_partkey % 3 <> 1 AS valid, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 <> 1 THEN p_name END AS first_query FROM part")
def search_profiles(spark, sf):
    """Stored search profiles against their schema: version, number of searches, and lengths of texts."""
    name = F.when(F.col("p_partkey") % 3 == 1, " x ").otherwise("track")
    search = F.struct(name.alias("name"), F.lit("direct evidence").alias("rationale"), F.concat(F.lit(" "), "p_name").alias("query"))
    many = F.when(F.col("p_partkey") % 10 == 0, F.array_repeat(search, 9)).otherwise(F.array(search))
    text = F.to_json(F.struct(F.when(F.col("p_partkey") % 10 == 5, 2).otherwise(1).alias("version"), many.alias("searches")))
    read = table(spark, sf, "part").select("p_partkey", profiles.read(text).alias("p"))
    return read.select("p_partkey", F.col("p").isNotNull().alias("valid"), F.get("p.searches", F.lit(0))["query"].alias("first_query"))


@query("F13", "SELECT page_id, NOT regexp_matches(url, '@') AS plain FROM pages")
def plain_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.parse_url("url", F.lit("USERINFO")).isNull().alias("plain"))


@query("F10 R8", "SELECT event_id FROM events WHERE event_id % 4 = 0 OR (ts >= TIMESTAMP '2024-01-11')")
def late_publications(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    known = e.filter("event_id % 4 = 0").select("event_id")
    return lanes.in_time(e, "ts", lambda c: c >= F.lit("2024-01-11").cast("timestamp_ntz"), known, "event_id").select("event_id")


@query("R1 R3 R4 R9", """WITH q(search_id, query) AS (VALUES (1, 'the of'), (2, 'des')), d AS (SELECT doc_id, lower(string_split(text, chr(10))[1]) AS title FROM documents),
m AS (SELECT doc_id, search_id, query FROM d, q WHERE len(list_filter(string_split(query, ' '), lambda w: NOT contains(title, w))) = 0)
SELECT doc_id AS posting_id, arg_min(query, search_id) AS named_by, count(*) AS recipients FROM m GROUP BY doc_id""")
def streaming_matches(spark, sf):
    """Listings as a drained stream matched against static profiles, each listing once."""
    schema = table(spark, sf, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/documents.parquet*")
    rows = stream.select(F.col("doc_id").alias("posting_id"), F.substring_index("text", "\n", 1).alias("title"), F.lit(NOW).cast("timestamp").alias("at"))
    searches = spark.createDataFrame([(1, "the of"), (2, "des")], "search_id int, query string")
    out = _folder(spark, "matches")

    def step(batch, number):
        # a batch that is run again after a loss takes the place of its first try
        lanes.match_new(batch, searches, matching.postings_for_searches).write.mode("overwrite").parquet(f"{out}/batch={number}")

    lanes.lane(lanes.once(rows, "posting_id"), step, _folder(spark, "lane"), f"matches_{uuid.uuid4().hex[:8]}").awaitTermination()
    return spark.read.parquet(out).drop("batch")


@query("W15", "SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def pending_imports(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.sha2("c_name", 256).alias("cv_hash"))
    pending = c.filter("user_id % 3 = 0 OR user_id % 5 = 0").withColumn("expires_at", F.when(F.col("user_id") % 3 == 0, F.lit(NOW + dt.timedelta(minutes=1))).otherwise(F.lit(NOW)).cast("timestamp_ntz"))
    uploads = c.filter("user_id % 2 = 0").withColumn("uploaded_at", F.lit(NOW).cast("timestamp_ntz"))
    return lifecycle.stage_cv(pending, uploads, NOW).select("user_id")
