"""Queries over texts: vocabularies, similarities, matching, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import demand, lifecycle, matching, pruned, search, vocabulary
from ..registry import query
from ..session import NOW, cut_lineage, stored, table


def _list(words) -> str:
    return "[" + ", ".join(f"'{x}'" for x in words) + "]"


def sql_words(x: str, pattern: str = t.PLAIN) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{pattern}')"


def sql_search_tokens(x: str) -> str:
    usable = "(len(t) > 1 OR contains(t, '+') OR contains(t, '#') OR starts_with(t, '.'))"
    informative = f"list_filter({sql_words(x, t.TOKEN)}, lambda t: {usable} AND NOT list_contains({_list(t.LOW_INFORMATION)}, t))"
    plain = f"list_filter({informative}, lambda t: NOT list_contains({_list(t.GRADES)}, t))"
    return f"list_distinct(CASE WHEN len({plain}) > 0 THEN {plain} ELSE {informative} END)"


def sql_ngrams(x: str) -> str:
    grams = lambda n, end: f"list_transform(range(1, {end}), lambda i: '{n}:' || substr('^' || t || '$', i, {n}))"
    return f"list_distinct(flatten(list_transform({x}, lambda t: list_concat({grams(3, 'len(t) + 1')}, {grams(4, 'greatest(len(t), 1)')}))))"


def sql_jaccard(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE CAST({common} AS DOUBLE) / nullif(len({a}) + len({b}) - {common}, 0) END)"


TITLE = "string_split(text, chr(10))[1]"


def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "source", F.substring_index("text", "\n", 1).alias("title"))


def items(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("user_id"), F.col("text").alias("cv"))


VOCABULARY_SQL = f"""
WITH n AS (SELECT count(*) AS n FROM documents),
d AS (SELECT token, count(*) AS df FROM (SELECT unnest({sql_search_tokens('text')}) AS token FROM documents) GROUP BY token HAVING count(*) > 1)
SELECT token, df, round(ln((n + 1) / (df + 0.5)), 6) AS idf, round(ln((n + 1) / 1.5), 6) AS unknown_idf FROM d, n
"""


@query("A15 T1 T3 T4 S15", VOCABULARY_SQL)
def idf_vocabulary(spark, sf):
    words = vocabulary.vocabulary(documents(spark, sf), t.search_tokens(F.col("text")))
    return words.select("token", "df", F.round("idf", 6).alias("idf"), F.round("unknown_idf", 6).alias("unknown_idf"))


@query("K9 K11 W12", "SELECT token FROM (SELECT CASE p_partkey % 7 WHEN 1 THEN 'T' || p_partkey WHEN 2 THEN ' t' || p_partkey ELSE 't' || p_partkey END AS token, p_partkey % 7 AS f FROM part) WHERE f IN (1, 2, 3, 4, 5) UNION ALL SELECT 't' || p_partkey FROM part WHERE p_partkey % 7 = 5")
def vocabulary_check(spark, sf):
    """Faults of a stored vocabulary: capitals, blanks, weights that are not positive or above the unknown one, tokens given twice."""
    part = table(spark, sf, "part").withColumn("f", F.col("p_partkey") % 7)
    token = F.concat(F.when(F.col("f") == 1, "T").when(F.col("f") == 2, " t").otherwise("t"), "p_partkey")
    weight = F.when(F.col("f") == 3, 0.0).when(F.col("f") == 4, 9.0).otherwise(2.0)
    words = part.select("f", token.alias("token"), weight.alias("idf"), F.lit(5.0).alias("unknown_idf"))
    return vocabulary.vocabulary_faults(words.union(words.filter("f = 5")).drop("f")).select("token")


@query("A14 T12", f"SELECT item_id AS id, token, count(*) AS n FROM (SELECT item_id, unnest({sql_words('text')}) AS token FROM benchmark) GROUP BY ALL")
def term_counts(spark, sf):
    return vocabulary.term_counts(items(spark, sf), "user_id", t.words(F.col("cv"), t.PLAIN))


def _terms_sql(weight: str, extra: str = "") -> str:
    return f"""
WITH {extra} a AS (SELECT id, token, {weight} AS w FROM (SELECT doc_id AS id, token, count(*) AS n FROM (SELECT doc_id, unnest({sql_words('text')}) AS token FROM documents) GROUP BY ALL) {'LEFT JOIN v USING (token)' if extra else ''}),
b AS (SELECT id, token, {weight} AS w FROM (SELECT item_id AS id, token, count(*) AS n FROM (SELECT item_id, unnest({sql_words('text')}) AS token FROM benchmark) GROUP BY ALL) {'LEFT JOIN v USING (token)' if extra else ''}),
s AS (SELECT b.id AS user_id, a.id AS doc_id, sum(a.w * b.w) AS dot FROM a JOIN b USING (token) GROUP BY ALL),
na AS (SELECT id, sum(w * w) AS q FROM a GROUP BY id), nb AS (SELECT id, sum(w * w) AS q FROM b GROUP BY id),
c AS (SELECT user_id, doc_id, round(dot / sqrt(na.q * nb.q), 6) AS cosine FROM s JOIN na ON na.id = doc_id JOIN nb ON nb.id = user_id)
SELECT user_id, CAST(rank AS INTEGER) AS rank, doc_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cosine DESC, doc_id) AS rank FROM c) WHERE rank <= 5
"""


def _top_cosine(spark, sf, words=None):
    docs = documents(spark, sf).select(F.col("doc_id").alias("id"), t.words(F.col("text"), t.PLAIN).alias("tokens"))
    profiles = items(spark, sf).select(F.col("user_id").alias("id"), t.words(F.col("cv"), t.PLAIN).alias("tokens"))
    top = pruned.top_cosine(docs, profiles, 5, words)
    return top.select(F.col("query_id").alias("user_id"), "rank", F.col("id").alias("doc_id"), "cosine")


@query("J13 J16 T13 O1", _terms_sql("CAST(n AS DOUBLE)"))
def lexical_cosine_topk(spark, sf):
    return _top_cosine(spark, sf)


@query("T14 U3", _terms_sql("n * coalesce(idf, (SELECT max(unknown) FROM v))", f"n AS (SELECT count(*) AS n FROM documents), v AS (SELECT token, ln((n + 1) / (count(*) + 0.5)) AS idf, ln((n + 1) / 1.5) AS unknown FROM (SELECT unnest({sql_search_tokens('text')}) AS token FROM documents), n GROUP BY token, n HAVING count(*) > 1),"))
def idf_cosine(spark, sf):
    # the body vocabulary holds search tokens but is looked up with plain words, as defined
    words = vocabulary.vocabulary(documents(spark, sf), t.search_tokens(F.col("text")))
    return _top_cosine(spark, sf, cut_lineage(words))  # asked for four times


@query(
    "T15 T20",
    f"""
WITH n AS (SELECT count(*) AS n FROM documents), tt AS (SELECT doc_id AS id, unnest({sql_search_tokens(TITLE)}) AS token FROM documents),
v AS (SELECT token, ln((n + 1) / (count(*) + 0.5)) AS idf FROM tt, n GROUP BY token, n HAVING count(*) > 1)
SELECT id, round(greatest(0, least(1, avg(coalesce(idf, ln((n + 1) / 1.5))) / max(ln((n + 1) / 1.5)))), 6) AS specificity FROM tt LEFT JOIN v USING (token), n GROUP BY id
""",
)
def title_specificity(spark, sf):
    docs = documents(spark, sf)
    tokens = t.search_tokens(F.col("title"))
    words = vocabulary.vocabulary(docs, tokens)
    return vocabulary.specificity(vocabulary.terms(docs, "doc_id", tokens), words).select("id", F.round("specificity", 6).alias("specificity"))


@query("T1 T3 T4 X4", f"SELECT doc_id, array_to_string(list_sort({sql_search_tokens(TITLE)}), ' ') AS tokens FROM documents")
def search_tokens(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(F.array_sort(t.search_tokens(F.col("title"))), " ").alias("tokens"))


@query("T5", f"SELECT p_partkey, array_to_string(list_sort({sql_ngrams('string_split(lower(p_name), chr(32))')}), ' ') AS grams FROM part")
def char_ngrams(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(t.ngrams(F.split(F.lower("p_name"), " "))), " ").alias("grams"))


_NAME, _TYPE = "string_split(lower(p_name), chr(32))", "string_split(lower(p_type || ' ' || p_brand || ' ' || p_name[1:5]), chr(32))"


def _name_and_type(spark, sf):
    part = table(spark, sf, "part")
    return part.select("p_partkey", F.split(F.lower("p_name"), " ").alias("a"), F.split(F.lower(F.concat_ws(" ", "p_type", "p_brand", F.substring("p_name", 1, 5))), " ").alias("b"))


@query("T6 T7 J14", f"SELECT p_partkey, round({sql_jaccard(sql_ngrams(_NAME), sql_ngrams(_TYPE))}, 6) AS likeness FROM part")
def ngram_similarity(spark, sf):
    return _name_and_type(spark, sf).select("p_partkey", F.round(t.ngram_similarity(F.col("a"), F.col("b")), 6).alias("likeness"))


@query("X1 T26", f"SELECT p_partkey, round({sql_jaccard(f'list_distinct({_NAME})', f'list_distinct({_TYPE})')}, 6) AS likeness FROM part")
def token_jaccard(spark, sf):
    return _name_and_type(spark, sf).select("p_partkey", F.round(t.jaccard(F.array_distinct("a"), F.array_distinct("b")), 6).alias("likeness"))


SKILLS = ["of the", "in that", "the", "les des", "und die", "c++", "de la"]
_LEX = f"list_filter(list_transform({sql_words('text', t.LEXICAL)}, lambda x: rtrim(x, '.')), lambda x: x <> '')"


@query(
    "T16 T17 T18",
    f"""WITH d AS (SELECT doc_id, chr(1) || array_to_string({_LEX}, chr(1)) || chr(1) AS w FROM documents)
SELECT doc_id, round(({' + '.join(f"CAST(contains(w, chr(1) || replace('{s}', ' ', chr(1)) || chr(1)) AS INTEGER)" for s in SKILLS)}) / {len(SKILLS)}.0, 6) AS coverage FROM d""",
)
def skill_coverage(spark, sf):
    skills = F.array(*[t.lexical_words(F.lit(s)) for s in SKILLS])
    return documents(spark, sf).select("doc_id", F.round(matching.skill_coverage(skills, t.lexical_words(F.col("text"))), 6).alias("coverage"))


_RANKED = ["junior", "middle", "senior", "lead", "chief", "plain"]


@query("T21", "SELECT p_partkey, CASE p_size % 6 WHEN 5 THEN NULL ELSE round(([1, 2, 3, 4, 5][p_size % 6 + 1] - 3) / 5.0, 6) END AS gap FROM part")
def seniority_gap(spark, sf):
    title = F.concat_ws(" ", t.strings(_RANKED)[F.col("p_size") % 6], F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", F.round(matching.seniority_gap(title, t.strings(["senior analyst", "analyst"])), 6).alias("gap"))


TRACKS = [(1, 1, ["thes onat", "the eran"], ["of the", "the"]), (1, 2, ["des ent"], ["les des", "de la"]), (2, 1, ["und verich"], ["und die", "in der"])]


def _profile_frame(spark):
    return spark.createDataFrame(TRACKS, "user_id long, track int, titles array<string>, skills array<string>")


def _prefilter_sql() -> str:
    rows = ", ".join(f"({u}, {k}, {_list(a)}, {_list(s)})" for u, k, a, s in TRACKS)
    title = f"list_max(list_transform(titles, lambda x: greatest({sql_jaccard(sql_search_tokens('x'), 'tt')}, {sql_jaccard(sql_ngrams(sql_search_tokens('x')), sql_ngrams('tt'))})))"
    skill = "CAST(len(list_filter(skills, lambda s: contains(w, chr(1) || replace(s, ' ', chr(1)) || chr(1)))) AS DOUBLE) / len(skills)"
    return f"""
WITH p(user_id, track, titles, skills) AS (VALUES {rows}),
d AS (SELECT doc_id, {sql_search_tokens(TITLE)} AS tt, chr(1) || array_to_string({_LEX.replace("coalesce(text, '')", f"{TITLE} || chr(10) || text")}, chr(1)) || chr(1) AS w FROM documents),
e AS (SELECT doc_id, user_id, track, {title} AS ts, {skill} AS sc FROM d, p),
r AS (SELECT *, CAST(round((ts * 0.75 + sc * 0.25) * 100) AS INTEGER) AS rs FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, user_id ORDER BY rs DESC, track) AS nth FROM r WHERE rs > 0)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(user_id AS BIGINT) AS user_id, CAST(track AS INTEGER) AS track, round(ts, 6) AS title_similarity, round(sc, 6) AS skill_coverage, rs AS regex_score FROM b WHERE nth = 1
"""


@query("A17 T19 T22 U3 J13", _prefilter_sql())
def prefilter_evidence(spark, sf):
    docs = documents(spark, sf).select(F.col("doc_id").alias("id"), "title", F.col("text").alias("body"), F.array().cast("array<string>").alias("key_skills"))
    scores = matching.track_scores(docs, _profile_frame(spark))
    return matching.best_track(scores).select(F.col("id").alias("doc_id"), "user_id", "track", F.round("title_similarity", 6).alias("title_similarity"), F.round("skill_coverage", 6).alias("skill_coverage"), "regex_score")


def _admission_sql() -> str:
    best = _prefilter_sql().strip()
    best = best[: best.index("SELECT CAST(doc_id AS BIGINT)")]
    skills = ", ".join(f"({u}, {w!r})" for u, _, _, asked in TRACKS for x in asked for w in x.split())
    evidence = "ts >= 0.35 OR (known AND sc >= 0.2)"
    return f"""{best},
pw(user_id, token) AS (VALUES {skills}), pc AS (SELECT user_id, token, count(*) AS n FROM pw GROUP BY ALL), pn AS (SELECT user_id, sum(n * n) AS q FROM pc GROUP BY 1),
dc AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({sql_words('text')}) AS token FROM documents) GROUP BY ALL), dn AS (SELECT doc_id, sum(n * n) AS q FROM dc GROUP BY 1),
c AS (SELECT doc_id, user_id, sum(dc.n * pc.n) / sqrt(CAST(any_value(dn.q) AS DOUBLE) * any_value(pn.q)) AS cosine FROM dc JOIN pc USING (token) JOIN dn USING (doc_id) JOIN pn USING (user_id) GROUP BY ALL),
j AS (SELECT coalesce(x.doc_id, c.doc_id) AS id, coalesce(x.user_id, c.user_id) AS user_id, track, coalesce(ts, 0) AS ts, coalesce(sc, 0) AS sc, coalesce(rs, 0) AS rs, coalesce(cosine, 0) AS cosine, rs IS NOT NULL AS known FROM (SELECT * FROM b WHERE nth = 1) x FULL JOIN c ON c.doc_id = x.doc_id AND c.user_id = x.user_id),
k AS (SELECT *, id % 40 AS age, CAST(round(rs * 0.75 + CAST(least(100, round(cosine * 300)) AS INTEGER) * 0.25) AS INTEGER) AS combined FROM j)
SELECT CAST(id AS BIGINT) AS id, CAST(user_id AS BIGINT) AS user_id, coalesce(track, -1) AS track, round(ts, 6) AS title_similarity, round(sc, 6) AS skill_coverage, rs AS regex_score, round(cosine, 6) AS cosine, combined, age >= 30 OR NOT ({evidence}) OR combined < 30 AS filtered,
array_to_string(list_filter(['recency:' || CASE WHEN age < 1 THEN 'today' WHEN age < 7 THEN 'week' WHEN age < 14 THEN 'fortnight' WHEN age < 30 THEN 'month' ELSE 'stale' END, CASE WHEN ts >= 0.35 THEN 'title-evidence' END, CASE WHEN known AND sc >= 0.2 THEN 'skill-evidence' END, CASE WHEN age >= 30 THEN 'expired' END, CASE WHEN NOT ({evidence}) THEN 'insufficient-role-or-skill-evidence' END, CASE WHEN combined < 30 THEN 'below-minimum-score' END], lambda x: x IS NOT NULL), ',') AS reasons FROM k"""


@query("F8 F9 N3 T23 J13", _admission_sql())
def prefilter_admission(spark, sf):
    docs = documents(spark, sf).select(F.col("doc_id").alias("id"), "title", F.col("text").alias("body"), F.array().cast("array<string>").alias("key_skills"))
    best = matching.best_track(matching.track_scores(docs, _profile_frame(spark)))
    listings = docs.select("id", t.words(F.col("body"), t.PLAIN).alias("tokens"))
    profiles = _profile_frame(spark).groupBy("user_id").agg(F.flatten(F.flatten(F.array_sort(F.collect_list(F.transform("skills", t.lexical_words))))).alias("tokens"))
    dated = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.expr(f"timestamp_ntz'{NOW}' - make_dt_interval(cast(doc_id % 40 as int))").alias("published_at"))
    out = matching.admission(best, matching.cosines(listings, profiles), dated, 30, 30, NOW)
    return _rounded(out)


def _rounded(admission):
    rounded = {c: F.round(c, 6) for c in ("title_similarity", "skill_coverage", "cosine")}
    return admission.withColumns(rounded | {"reasons": F.array_join("reasons", ","), "track": F.coalesce("track", F.lit(-1))})


@query("F9 J13 T13 T23", f"SELECT * FROM ({_admission_sql()}) WHERE NOT filtered")
def prefilter_admitted(spark, sf):
    """Admitted pairs alone: only pairs with evidence are compared by their words."""
    docs = documents(spark, sf).select(F.col("doc_id").alias("id"), "title", F.col("text").alias("body"), F.array().cast("array<string>").alias("key_skills"))
    best = matching.best_track(matching.track_scores(docs, _profile_frame(spark)))
    published = F.expr(f"timestamp_ntz'{NOW}' - make_dt_interval(cast(id % 40 as int))")
    listings = docs.select("id", t.words(F.col("body"), t.PLAIN).alias("tokens"), published.alias("published_at"))
    profiles = _profile_frame(spark).groupBy("user_id").agg(F.flatten(F.flatten(F.array_sort(F.collect_list(F.transform("skills", t.lexical_words))))).alias("tokens"))
    return _rounded(matching.admitted(best, listings, profiles, 30, 30, NOW))


@query(
    "F8 N3",
    f"""WITH a AS (SELECT event_id, greatest(0, date_diff('microsecond', ts, TIMESTAMP '{NOW}') / 86400000000.0) AS age FROM events)
SELECT event_id, CASE WHEN age < 1 THEN 'today' WHEN age < 7 THEN 'week' WHEN age < 14 THEN 'fortnight' WHEN age < 30 THEN 'month' ELSE 'stale' END AS band,
CAST(floor(age) AS INTEGER) AS days, CAST(CASE WHEN age < 7 THEN 1.0 WHEN age < 14 THEN 0.92 WHEN age < 30 THEN 0.8 ELSE 0.6 END AS DOUBLE) AS weight, age >= 21 AS expired FROM a""",
)
def recency_band(spark, sf):
    return table(spark, sf, "events").select("event_id", matching.recency(F.col("ts"), NOW, 21).alias("r")).select("event_id", "r.*")


@query(
    "J15 X1 T25 T26",
    f"""WITH d AS (SELECT doc_id, sha256('lexloom.fingerprint.v1 ' || trim(regexp_replace(lower({TITLE} || ' ' || lang), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS f, list_distinct({sql_words('text')}) AS w FROM documents),
p AS (SELECT a.doc_id AS candidate, b.doc_id AS known FROM d a JOIN d b ON a.f = b.f AND b.doc_id < a.doc_id WHERE {sql_jaccard('a.w', 'b.w')} >= 0.92)
SELECT candidate, min(known) AS duplicate_of FROM p GROUP BY candidate""",
)
def near_duplicate_block(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), t.fingerprint(F.substring_index("text", "\n", 1), F.col("lang")).alias("fingerprint"), t.words(F.col("text"), t.PLAIN).alias("tokens"))
    return lifecycle.duplicate_of(rows, rows)


@query("T25 H2", f"SELECT doc_id, sha256('lexloom.fingerprint.v1 ' || trim(regexp_replace(lower({TITLE} || ' ' || source), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS fingerprint FROM documents")
def fingerprint(spark, sf):
    return documents(spark, sf).select("doc_id", t.fingerprint(F.col("title"), F.col("source")).alias("fingerprint"))


@query("F4 F5 J17", f"""WITH q(search_id, query) AS (VALUES (1, 'the of'), (2, 'des'), (3, 'und'), (4, 'que la'))
, m AS (SELECT doc_id, search_id, query FROM documents, q WHERE len(list_filter(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}+#.]{{2,}}'), lambda w: NOT contains(lower({TITLE}), w))) = 0)
SELECT doc_id AS posting_id, arg_min(query, search_id) AS named_by, count(*) AS recipients FROM m GROUP BY doc_id""")
def title_match(spark, sf):
    searches = spark.createDataFrame([(1, "the of"), (2, "des"), (3, "und"), (4, "que la")], "search_id int, query string")
    return matching.postings_for_searches(documents(spark, sf).select(F.col("doc_id").alias("posting_id"), "title"), searches)


_FTS = '"of the" -that or und -der'


@query("F7 J10 O10", f"""WITH d AS (SELECT doc_id, source, {sql_words('text')} AS w FROM documents),
h AS (SELECT doc_id, source, len(list_filter(w, lambda x: x IN ('of', 'the', 'und'))) AS rank, chr(1) || array_to_string(w, chr(1)) || chr(1) AS j, w FROM d)
SELECT doc_id, CAST(rank AS BIGINT) AS rank FROM h WHERE (contains(j, chr(1) || 'of' || chr(1) || 'the' || chr(1)) AND NOT list_contains(w, 'that')) OR (list_contains(w, 'und') AND NOT list_contains(w, 'der'))
ORDER BY rank DESC, doc_id LIMIT 50""")
def full_text_match(spark, sf):
    docs = documents(spark, sf).select("doc_id", t.words(F.col("text"), t.PLAIN).alias("tokens"))
    return search.search(docs, _FTS, 50, "doc_id").select("doc_id", F.col("rank").cast("long").alias("rank"))


def _places_sql(word: str) -> str:
    return f"list_distinct(list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i] = '{word}'), lambda i: least(i, 16383)))"


def _single_rank_sql(words: list[str]) -> str:
    one = lambda w: f"coalesce(list_sum(list_transform(range(1, least(255, len({_places_sql(w)})) + 1), lambda i: 1.0::DOUBLE / (i * i))), 0) * 0.1::DOUBLE / 1.64493406685::DOUBLE"
    return f"({' + '.join(map(one, words))}) / {len(words)}"


def _ranked(spark, sf, asked):
    docs = documents(spark, sf).select(F.col("doc_id").alias("id"), t.words(F.col("text"), t.PLAIN).alias("tokens"))
    index = stored(search.positional_index(docs))  # a table of its own; queries read it by word
    # ranks of near words come close to 1 together, so they are rounded before the best are taken
    return search.ranked(index, docs.select("id"), asked, 50, "id", digits=9).select(F.col("id").alias("doc_id"), "rank")


@query("F7 J10 O10", f"""WITH d AS (SELECT doc_id, {sql_words('text')} AS w FROM documents), j AS (SELECT *, chr(1) || array_to_string(w, chr(1)) || chr(1) AS j FROM d)
SELECT doc_id, round({_single_rank_sql(['der', 'of', 'that', 'the', 'und'])}, 9) AS rank FROM j WHERE (contains(j, chr(1) || 'of' || chr(1) || 'the' || chr(1)) AND NOT list_contains(w, 'that')) OR (list_contains(w, 'und') AND NOT list_contains(w, 'der'))
ORDER BY rank DESC, doc_id LIMIT 50""")
def full_text_ranked(spark, sf):
    """Alternatives: every word of the query counts by its occurrences."""
    return _ranked(spark, sf, _FTS)


@query("F7 J10 O10", f"""WITH d AS (SELECT doc_id, {sql_words('text')} AS w FROM documents),
j AS (SELECT doc_id, w FROM d WHERE contains(chr(1) || array_to_string(w, chr(1)) || chr(1), chr(1) || 'of' || chr(1) || 'the' || chr(1)) AND list_contains(w, 'was')),
p AS (SELECT doc_id, unnest(list_sort({_places_sql('of')})[1:255]) AS at, 1 AS word FROM j UNION ALL SELECT doc_id, unnest(list_sort({_places_sql('the')})[1:255]), 2 FROM j UNION ALL SELECT doc_id, unnest(list_sort({_places_sql('was')})[1:255]), 3 FROM j),
x AS (SELECT doc_id, CAST(abs(a.at - b.at) AS DOUBLE) AS d FROM p a JOIN p b USING (doc_id) WHERE a.word < b.word AND a.at <> b.at)
SELECT doc_id, round(1 - product(1 - sqrt(0.01::DOUBLE * CASE WHEN d > 100 THEN 1e-30 ELSE 1.0::DOUBLE / (1.005::DOUBLE + 0.05::DOUBLE * exp(d / 1.5::DOUBLE - 2)) END)), 9) AS rank FROM x GROUP BY doc_id ORDER BY rank DESC, doc_id LIMIT 50""")
def full_text_near(spark, sf):
    """Words and a phrase that must all be there: near places count most."""
    return _ranked(spark, sf, 'was "of the"')


@query("P14 T9", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN 'ru' ELSE 'en' END AS language, CASE p_partkey % 3 WHEN 0 THEN 'latin' WHEN 1 THEN 'cyrillic' ELSE 'unknown' END AS script FROM part")
def document_language(spark, sf):
    """Few Cyrillic letters, enough of them, and enough among too many Latin ones."""
    which = (F.col("p_partkey") % 3).cast("int")
    cyrillic = F.repeat(F.lit("слово "), 5)
    texts = F.array(F.concat("p_name", F.lit(" слово")), F.concat(cyrillic, F.substring("p_name", 1, 20)), F.concat(cyrillic, F.repeat(F.lit("words "), 30)))
    tokens = F.array(F.substring(F.regexp_replace("p_name", "[^a-z]", ""), 1, 5), F.lit("слово"), F.lit("mixедword"))
    return table(spark, sf, "part").select("p_partkey", t.language(texts[which]).alias("language"), t.script(tokens[which]).alias("script"))


@query("P1", f"SELECT doc_id, sha256(array_to_string(list_filter([trim(regexp_replace({TITLE}, '\\s+', ' ', 'g')), source, lang, trim(regexp_replace(text, '\\s+', ' ', 'g'))], lambda x: x <> ''), chr(10))) AS evidence FROM documents")
def evidence_text(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.sha2(t.evidence_text(F.split("text", "\n")[0], F.col("source"), F.col("lang"), F.col("text")), 256).alias("evidence"))


@query("G2 T8", """WITH e AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 7 <> 0), n AS (SELECT k FROM e UNION SELECT k + 50 FROM e),
g AS (SELECT n.k, n.k % 50 AS r, sum(CASE WHEN e.k IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY n.k % 50 ORDER BY n.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM n LEFT JOIN e ON e.k = n.k - 50)
SELECT 't' || k AS token, min('t' || k) OVER (PARTITION BY r, c) AS representative FROM g""")
def role_components(spark, sf):
    """Every part linked to the part fifty keys on, but for one key in seven: chains over the whole table."""
    name = lambda c: F.concat(F.lit("t"), c.cast("string"))
    pairs = table(spark, sf, "part").filter("p_partkey % 7 <> 0").select(name(F.col("p_partkey")).alias("token_a"), name(F.col("p_partkey") + 50).alias("token_b"), F.lit(1).alias("support"))
    return demand.resolver(pairs, checkpoint=cut_lineage)


@query("G1 A16 T9 T10 K8", "SELECT 'developer' AS token_a, 'разработчик' AS token_b, CAST(count(*) FILTER (n_nationkey % 3 = 0) AS BIGINT) AS support FROM nation UNION ALL SELECT 'analyst', 'аналитик', count(*) FILTER (n_nationkey % 3 = 1) FROM nation")
def equivalence_mining(spark, sf):
    """Cross-script pairs between titles of a track; tracks of one script, of two words left over, or broken give none."""
    titles = [["Senior Backend Developer", "Backend разработчик", "Backend Developer"], ["Lead analyst", "Аналитик", "Аналитик"], ["Data engineer", "Data Scientist", "инженер данных"]]
    which = F.array(*[t.strings(x) for x in titles])[(F.col("n_nationkey") % 3).cast("int")]
    stored = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("a").alias("name"), which.alias("titles"))).alias("tracks")).alias("profile")))
    broken = F.when(F.col("n_nationkey") % 2 == 0, '{"profile":{"tracks":[7,{"titles":"none"},{"name":"b"}]}}').otherwise("{")
    rows = table(spark, sf, "nation")
    profiles = rows.select(F.col("n_nationkey").alias("user_id"), stored.alias("profile")).union(rows.select((F.col("n_nationkey") + 100).alias("user_id"), broken.alias("profile")))
    return demand.mine_equivalences(demand.role_titles(profiles))
