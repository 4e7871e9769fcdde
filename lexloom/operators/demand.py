"""Equivalent roles and shared search demand."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import batched
from ..functions import text as t
from ..session import cut_lineage
from .queues import first, numbered

ANCHOR = 0.8


def _script(token: str) -> str:
    import unicodedata

    kinds = {unicodedata.name(x, "").split(" ")[0] for x in token if x.isalpha()}
    return {"LATIN": "latin", "CYRILLIC": "cyrillic"}.get(kinds.pop(), "unknown") if len(kinds) == 1 else "unknown"


def _grams(tokens) -> set[str]:
    out = set()
    for token in filter(None, tokens):
        framed = f"^{token}$"
        out |= {f"{n}:{framed[k : k + n]}" for n in (3, 4) for k in range(len(framed) - n + 1)}
    return out


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def leftover_pair(left: list[str], right: list[str]) -> tuple[str, str] | None:
    """The one token on each side that finds no partner, if all others do and there are some.

    Partners are equal, or of one script with similar letter n-grams; each right token is used
    once, in order.
    """
    free, alone = list(right), []
    for a in left:
        alike = (b for b in free if a == b or (_script(a) == _script(b) != "unknown" and _jaccard(_grams([a]), _grams([b])) >= ANCHOR))
        b = next(alike, None)
        if b is None:
            alone.append(a)
        else:
            free.remove(b)
    return (alone[0], free[0]) if len(left) > len(alone) == len(free) == 1 else None


def role_titles(profiles: DataFrame) -> DataFrame:
    """track, titles of stored profiles (user_id, JSON text), read through their envelope; broken profiles and tracks are passed over."""
    parsed = F.try_parse_json("profile")
    opened = F.coalesce(F.try_variant_get(parsed, "$.profile", "variant"), parsed)
    tracks = profiles.select("user_id", F.posexplode(F.try_variant_get(opened, "$.tracks", "array<variant>")).alias("place", "t"))
    titles = F.filter(F.try_variant_get("t", "$.titles", "array<string>"), lambda x: F.trim(x) != "")
    return tracks.select(F.concat_ws(":", "user_id", "place").alias("track"), titles.alias("titles")).filter(F.size("titles") > 0)


def mine_equivalences(tracks: DataFrame) -> DataFrame:
    """token_a < token_b and support (number of tracks): cross-script pairs left over between titles of one track.

    tracks: track, titles.  A track holds a bounded number of titles, so their pairs are few.
    """
    titles = tracks.select("track", F.posexplode("titles").alias("place", "title")).select("track", "place", t.search_tokens(F.col("title")).alias("tokens")).filter(F.size("tokens") > 0)
    a, b = titles.alias("a"), titles.alias("b")
    both = a.join(b, (F.col("a.track") == F.col("b.track")) & (F.col("a.place") < F.col("b.place"))).select(F.col("a.track").alias("track"), F.col("a.tokens").alias("x"), F.col("b.tokens").alias("y"))

    @batched("struct<p:string,q:string>")
    def pair(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for left, right in zip(x, y, strict=True):
            left, right = list(left), list(right)
            rows.append(((left[0], right[0]) if len(left) == len(right) == 1 else leftover_pair(left, right)) or (None, None))
        return pd.DataFrame(rows, columns=["p", "q"])

    found = both.select("track", pair("x", "y").alias("z")).filter("z.p IS NOT NULL AND z.p != z.q")
    found = found.filter(t.cross_script(F.col("z.p"), F.col("z.q"))).select("track", F.least("z.p", "z.q").alias("token_a"), F.greatest("z.p", "z.q").alias("token_b"))
    return found.groupBy("token_a", "token_b").agg(F.count_distinct("track").alias("support"))


def resolver(pairs: DataFrame, minimum_support: int = 1, checkpoint=lambda x: x.checkpoint()) -> DataFrame:
    """token, representative: the least token of each connected group of pairs.

    Each round every token joins its neighbour of the smallest hash and the pairs are contracted,
    so rounds grow with the logarithm of the size; each cuts its lineage in the shared folder.
    """
    known = pairs.filter((F.col("support") >= minimum_support) & (F.col("token_a") != F.col("token_b")))
    edges = known.select(F.col("token_a").alias("u"), F.col("token_b").alias("v"))
    edges = checkpoint(edges.union(edges.select("v", "u")).distinct())
    owner = checkpoint(edges.select(F.col("u").alias("token"), F.col("u").alias("at")).distinct())
    while edges.limit(1).count():
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("to"))
        least = edges.groupBy("u").agg(F.min(order("v")).alias("near"))
        to = checkpoint(least.select(F.col("u").alias("at"), F.least(order("u"), "near")["to"].alias("to")))
        owner = checkpoint(owner.join(to, "at", "left").select("token", F.coalesce("to", "at").alias("at")))
        ends = edges.join(to.select(F.col("at").alias("u"), F.col("to").alias("x")), "u").join(to.select(F.col("at").alias("v"), F.col("to").alias("y")), "v")
        edges = checkpoint(ends.filter("x != y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct())
    return owner.join(owner.groupBy("at").agg(F.min("token").alias("representative")), "at").select("token", "representative")


#: Distinct searches that are settled in the first step; each later step takes as many as all before.
FIRST_STEP = 1 << 16


def _keys(units: DataFrame, threshold: float) -> DataFrame:
    """platform, filters, unit_id, kind, n, word: features of which units that are alike enough share one.

    Both kinds of features are ordered by how few units of the group hold them; of two sets with a
    Jaccard similarity of the threshold or more, the first ones, as many as may be missing and one more, have a word in common.
    """
    sets = units.select("platform", "filters", "unit_id", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("resolved").alias("words")), F.struct(F.lit(1).alias("kind"), F.col("grams").alias("words")))).alias("x"))
    each = sets.select("platform", "filters", "unit_id", "x.kind", F.size("x.words").alias("n"), F.explode_outer("x.words").alias("word"))
    group = ["platform", "filters", "kind", "word"]
    seen = each.filter("word IS NOT NULL").groupBy(*group).count()
    rare = each.join(seen, group, "left").groupBy("platform", "filters", "unit_id", "kind", "n").agg(F.sort_array(F.collect_list(F.struct("count", "word"))).alias("words"))
    some = F.slice("words", 1, F.greatest(F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1))
    return rare.select("platform", "filters", "unit_id", "kind", "n", F.explode(F.transform(some, lambda x: F.coalesce(x["word"], F.lit("")))).alias("word"))


def _alike(left: DataFrame, right: DataFrame, units: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """a (of left), b (of right), likeness: pairs of different units of a group at or above the threshold; left, right: unit_id."""
    a = keys.join(left.select("unit_id"), "unit_id", "left_semi").withColumnsRenamed({"unit_id": "a", "n": "n_a"})
    b = keys.join(right.select("unit_id"), "unit_id", "left_semi").withColumnsRenamed({"unit_id": "b", "n": "n_b"})
    near = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9
    met = a.join(b, ["platform", "filters", "kind", "word"]).filter(near & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    of = lambda name: units.select(F.col("unit_id").alias(name), F.col("resolved").alias(f"resolved_{name}"), F.col("grams").alias(f"grams_{name}"))
    both = met.join(of("a"), "a").join(of("b"), "b")
    likeness = F.greatest(t.jaccard(F.col("resolved_a"), F.col("resolved_b")), t.jaccard(F.col("grams_a"), F.col("grams_b")))
    return both.select("a", "b", likeness.alias("likeness")).filter(F.col("likeness") >= threshold)


def _first_of_neighbours(units: DataFrame, edges: DataFrame) -> DataFrame:
    """The units that a fold in order would found: those without an earlier neighbour that was founded.

    units: unit_id; edges: a, b, the earlier one first.  All units that no undecided earlier neighbour can overrule
    are decided at once, and their neighbours with them; only what is left is looked at again.
    """
    undecided, edges, found = units.select("unit_id"), cut_lineage(edges.select("a", "b")), []
    while edges.limit(1).count():
        now = undecided.join(edges.select(F.col("b").alias("unit_id")), "unit_id", "left_anti")
        now = cut_lineage(now)
        gone = edges.join(now.select(F.col("unit_id").alias("a")), "a", "left_semi").select(F.col("b").alias("unit_id"))
        undecided = cut_lineage(undecided.join(now, "unit_id", "left_anti").join(gone, "unit_id", "left_anti"))
        is_left = lambda c: undecided.select(F.col("unit_id").alias(c))
        edges = cut_lineage(edges.join(is_left("a"), "a", "left_semi").join(is_left("b"), "b", "left_semi"))
        found.append(now)
    for rows in found:
        undecided = undecided.unionByName(rows)
    return undecided


def founders(units: DataFrame, threshold: float, first_step: int = FIRST_STEP) -> DataFrame:
    """unit_id, first_at of the units that a fold over all searches in order keeps; -1: there before.

    units: platform, filters, unit_id, first_at, resolved, grams.  A search that is like a unit founded before adopts
    it.  Steps take twice as many searches each: those that adopt a unit of an earlier step need no more than a
    join, and order matters only among the few that are left in a step.
    """
    keys = cut_lineage(_keys(units, threshold))
    kept = cut_lineage(units.filter("first_at < 0").select("unit_id", "first_at"))
    begin, end, last = 0, first_step, units.agg(F.max("first_at")).first()[0]
    while last is not None and begin <= last:
        asking = units.filter((F.col("first_at") >= begin) & (F.col("first_at") < end)).select("unit_id", "first_at")
        adopting = _alike(kept, asking, units, keys, threshold).select(F.col("b").alias("unit_id"))
        left = cut_lineage(asking.join(adopting, "unit_id", "left_anti"))
        pairs = _alike(left, left, units, keys, threshold)
        when = lambda c: left.select(F.col("unit_id").alias(c), F.col("first_at").alias(f"at_{c}"))
        earlier = pairs.join(when("a"), "a").join(when("b"), "b").filter("at_a < at_b")
        new = left.join(_first_of_neighbours(left, earlier), "unit_id", "left_semi")
        kept = cut_lineage(kept.unionByName(new))
        begin, end = end, end * 2
    return kept


def compile_demand(searches: DataFrame, threshold: float, existing: DataFrame | None = None, resolver: DataFrame | None = None, first_step: int = FIRST_STEP) -> tuple[DataFrame, DataFrame]:
    """Shared units and one subscription for each unit and user.

    searches: platform, user_id, filters (canonical), unit_id, tokens, name, wording, search (canonical).
    existing: platform, filters, unit_id, tokens, wording, search.  resolver: token, representative.  Each search
    joins the unit of its own identity, else the most similar one at or above the threshold (the smallest identity of equals),
    else it founds one that later searches may join.  Later means by user, identity and search; the result is that of
    a fold in this order, but no group of a platform and filters is one task: see ``founders``.
    """
    cols = ["platform", "filters", "unit_id", "tokens", "wording", "search"]
    user = dict(searches.dtypes)["user_id"]
    old = existing.select(*cols) if existing is not None else searches.select(*cols).limit(0)
    asked = numbered(searches.select(*cols, "user_id", "name").filter("user_id IS NOT NULL"), "at", "user_id", "unit_id", "search")
    told = searches.filter("user_id IS NULL").select(*cols).unionByName(old)
    rows = asked.unionByName(told.withColumns({"user_id": F.lit(None).cast(user), "name": F.lit(None).cast("string"), "at": F.lit(-1).cast("long")}))
    rows = cut_lineage(rows)
    firsts = rows.groupBy("platform", "filters", "unit_id").agg(F.min(F.struct("at", "tokens")).alias("x")).select("platform", "filters", "unit_id", F.col("x.at").alias("first_at"), F.col("x.tokens").alias("tokens"))
    if resolver is None:
        firsts = firsts.withColumn("resolved", F.array_distinct("tokens"))
    else:
        sets = firsts.select("tokens").distinct().withColumn("token", F.explode("tokens"))
        named = sets.join(resolver.select("token", "representative"), "token", "left").groupBy("tokens").agg(F.array_sort(F.collect_set(F.coalesce("representative", "token"))).alias("resolved"))
        firsts = firsts.join(named, "tokens", "left").withColumn("resolved", F.coalesce("resolved", F.array().cast("array<string>")))
    firsts = cut_lineage(firsts.withColumn("grams", t.ngrams(F.col("tokens"))))
    kept = founders(firsts, threshold, first_step)

    asked = rows.filter("at >= 0")
    exact = asked.join(kept.select("unit_id"), "unit_id", "left_semi").select("*", F.col("unit_id").alias("target"), F.lit(1.0).alias("likeness"), F.lit(0).alias("adopted"))
    others = firsts.join(kept, "unit_id", "left_anti").select("unit_id")
    near = _alike(others, kept, firsts, _keys(firsts, threshold), threshold).join(kept.select(F.col("unit_id").alias("b"), "first_at"), "b")
    # a search may adopt what was founded before it; the best by likeness, then by identity
    choice = asked.select("unit_id", "at").join(near.withColumnRenamed("a", "unit_id"), "unit_id").filter("first_at < at").groupBy("at").agg(F.min(F.struct((-F.col("likeness")).alias("far"), "b")).alias("x"))
    adopting = asked.join(choice, "at").select(*asked.columns, F.col("x.b").alias("target"), (-F.col("x.far")).alias("likeness"), F.lit(1).alias("adopted"))

    size = F.nullif(F.length("wording"), F.lit(0))
    # the shortest wording speaks for the unit, the first one of equals; a unit of the store speaks first
    speaking = rows.join(kept.select("unit_id"), "unit_id", "left_semi").groupBy("platform", "filters", "unit_id").agg(F.min(F.struct(size.isNull().alias("none"), size.alias("size"), "at", "search")).alias("x"))
    every = exact.unionByName(adopting)
    rank = F.struct("adopted", (-F.col("likeness")).alias("far"), F.coalesce(size, F.lit(1 << 30)).alias("size"), "search", "at", "name")
    subscriptions = every.groupBy(F.col("target").alias("unit_id"), "user_id").agg(F.min(rank).alias("x")).select("unit_id", "user_id", "x.name", "x.search")
    subscriptions = cut_lineage(subscriptions)
    units = speaking.join(subscriptions, "unit_id", "left_semi").join(firsts.select("unit_id", "tokens"), "unit_id").select("platform", "filters", "unit_id", "tokens", F.col("x.search").alias("query"))
    return units, subscriptions


def novelty(found: DataFrame, known: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """One collector run: distinct candidates, at most ``most`` new ones in order, and their number by search name.

    found: source, source_id, position, names.  Returns the new rows and name, discovered.
    """
    once = found.groupBy("source", "source_id").agg(F.min(F.struct("position", "names")).alias("x")).select("source", "source_id", "x.*")
    new = first(once.join(known.select("source", "source_id"), ["source", "source_id"], "left_anti"), most, "position", "source", "source_id")
    return new, new.select(F.explode(F.array_distinct("names")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("discovered"))
