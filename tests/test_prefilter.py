"""Evidence of tracks and cosines: what is shuffled, and words at their places."""

from pyspark.sql import functions as F

from lexloom.functions import text as t
from lexloom.operators import matching


def test_lexical_words_lose_the_dots_at_their_ends(spark):
    for text, want in {"A.b. ... c++.. .Net": ["a.b", "c++", ".net"], "..x..y.#. .": ["..x..y.#"], ".": [], "": []}.items():
        assert spark.range(1).select(t.lexical_words(F.lit(text))).first()[0] == want


def test_skills_stand_together_in_text_or_in_one_key_skill(spark):
    rows = [(1, "x", "we use big data here", []), (2, "x", "big and data", []), (3, "x", "we use big", [["data"]]), (4, "x", "none", ["big data", "sql"]), (5, "x", "big ... data", []), (6, "x", None, ["big", "data"])]
    rows = [(k, a, b, [s if isinstance(s, str) else s[0] for s in c]) for k, a, b, c in rows]
    listings = spark.createDataFrame(rows, "id long, title string, body string, key_skills array<string>")
    tracks = spark.createDataFrame([(1, 1, ["zzz"], ["big data"])], "user_id long, track int, titles array<string>, skills array<string>")
    got = {r.id: r.skill_coverage for r in matching.track_scores(listings, tracks).collect()}
    assert {k for k, v in got.items() if v == 1.0} == {1, 4, 5}


def test_texts_are_not_shuffled_for_evidence_and_cosines(spark):
    """Only words that tracks name leave a listing's row: an exchange of all words took eighteen times the input."""
    docs = spark.range(50).select("id", F.lit("a title").alias("title"), F.lit("big data a a b").alias("body"), F.array().cast("array<string>").alias("key_skills"))
    tracks = spark.createDataFrame([(1, 1, ["title"], ["big data"])], "user_id long, track int, titles array<string>, skills array<string>")
    plan = matching.track_scores(docs, tracks)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "BroadcastHashJoin" in plan and exchanges
    listings = docs.select("id", t.words(F.col("body"), t.PLAIN).alias("tokens"))
    profiles = spark.createDataFrame([(1, ["a", "data", "x"])], "user_id long, tokens array<string>")
    got = matching.cosines(listings, profiles)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("BroadcastHashJoin") >= 0 and {round(r.cosine, 6) for r in got.collect()} == {round(3 / (7**0.5 * 3**0.5), 6)}
