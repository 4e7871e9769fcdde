"""Vacancies that are kept batch by batch, with an index of their words: who is a duplicate of whom.

A folder holds the vacancies, keyed by source and its identifier, and an index of normalized ones, keyed by fingerprint.
A batch has one row for each vacancy.  Its vacancies first leave the index; then each, in the order of identifiers,
is a duplicate of the least normalized one of its fingerprint that is alike, or is normalized itself.  Identifiers
rise with the batch and the place in it, and a known vacancy keeps its own.

That order is not walked row by row: equal texts are one set, sets like a vacancy from before are settled at once,
sets like the first one left of a fingerprint by one comparison each, and the others in rounds, all whose earlier
neighbours are settled at a time.  Work grows with the batch and the buckets that it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..session import scratch, stored
from ..sources import manifest
from .lifecycle import SAME_TEXT, alike_sets, common_words, hashed_words, with_parities

KEY = ["source", "source_id"]
SET = ["fingerprint", "set"]
#: Places of a batch below this number; identifiers of later batches lie above.
PLACES = 1 << 40


def vacancies(rows: DataFrame, source: Column, source_id: Column, position: Column, fingerprint: Column, tokens: Column, content: Column) -> DataFrame:
    """What a batch tells of a vacancy; position: its place in the batch, from 0, each once."""
    return rows.select(source.alias("source"), source_id.cast("string").alias("source_id"), position.cast("long").alias("position"), fingerprint.alias("fingerprint"), tokens.alias("tokens"), content.alias("content_hash"))


def _losers(edges: DataFrame, keep) -> DataFrame:
    """Sets that an earlier normalized set is like.  edges: fingerprint, set, other (an earlier set that is alike)."""
    lost, other = None, ["fingerprint", "other"]
    edges = keep(edges)
    while edges.limit(1).count():
        # sets that no earlier one can overrule any more
        free = edges.select(*other).distinct().join(edges.select("fingerprint", F.col("set").alias("other")), other, "left_anti")
        found = keep(edges.join(free, other, "left_semi").select(*SET).distinct())
        lost = found if lost is None else lost.union(found)
        edges = keep(edges.join(found, SET, "left_anti").join(found.withColumnRenamed("set", "other"), other, "left_anti"))
    return edges.select(*SET) if lost is None else lost


def decide(rows: DataFrame, known: DataFrame, mine: DataFrame, theirs: DataFrame, keep, threshold: float = SAME_TEXT) -> DataFrame:
    """id, duplicate_of of the rows that are duplicates.

    rows: id, place (of each row its own), fingerprint, set, in the order of id; known: id, fingerprint, set, normalized
    rows that stay as they are; mine: place, words; theirs: fingerprint, id, words; keep: writes a table and reads it
    again.  Words travel and are written once for each set that is not alone in its fingerprint.
    """
    sets = keep(rows.groupBy(*SET).agg(F.min("id").alias("lead"), F.min_by("place", "id").alias("place")))
    before = keep(known.join(rows.select("fingerprint").distinct(), "fingerprint", "left_semi").groupBy(*SET).agg(F.min("id").alias("oldest")))
    several = keep(sets.select(*SET).union(before.select(*SET)).distinct().groupBy("fingerprint").count().filter("count > 1").select("fingerprint"))
    wanted = lambda some: some.join(several, "fingerprint", "left_semi").hint("shuffle_hash")
    # places alone are small enough to go to every task, so that only words of these sets travel
    places = keep(sets.join(several, "fingerprint", "left_semi").select("place"))
    words = keep(with_parities(mine.join(places, "place", "left_semi").join(wanted(sets.select(*SET, "place")), "place")))
    common, some = common_words(words), before.limit(1).count()
    known_words = keep(with_parities(theirs.join(wanted(before.select(*SET, F.col("oldest").alias("id"))), ["fingerprint", "id"]))) if some else words.limit(0)
    age = before.select(*SET, F.col("oldest").alias("to"))
    named = lambda pairs, of: pairs.join(of.withColumnRenamed("set", "other"), ["fingerprint", "other"])
    worded = lambda some: words.join(some.select(*SET), SET, "left_semi")
    leads = sets.select(*SET, "lead")
    equal = leads.select(*SET).join(age, SET)
    alike = named(alike_sets(words, known_words, threshold, common, keep), age)
    fixed = keep(alike.select(*SET, "to").union(equal.select(*SET, "to")).groupBy(*SET).agg(F.min("to").alias("to")))
    free = leads.join(fixed, SET, "left_anti")
    # the first free set of a fingerprint is normalized, and sets like it go with one comparison each
    first = keep(free.groupBy("fingerprint").agg(F.min_by(F.struct("set", "lead"), "lead").alias("first")).select("fingerprint", "first.*"))
    others = free.join(first.select("fingerprint", F.col("set").alias("other"), F.col("lead").alias("to")), "fingerprint").filter("set != other")
    said = words.select(*SET, "words")
    met = named(others.join(said, SET), said.withColumnRenamed("words", "theirs"))
    met = keep(met.select(*SET, "lead", "to", (t.jaccard(F.col("words"), F.col("theirs")) >= threshold).alias("like")))
    rest = met.filter("NOT like").select(*SET, "lead")
    pairs = named(alike_sets(worded(rest), worded(rest), threshold, common, keep), rest.withColumnRenamed("lead", "to").select(*SET, "to"))
    pairs = keep(pairs.join(rest, SET).filter("to < lead").select(*SET, "other"))
    normal = keep(first.select(*SET, "lead").union(rest.join(_losers(pairs, keep), SET, "left_anti").select(*SET, "lead")))
    own = normal.select(*SET, F.col("lead").alias("to"))
    # sets that are like a vacancy from before may be like an earlier one of the batch as well
    both = named(alike_sets(worded(fixed), worded(normal), threshold, common, keep), own).select(*SET, "to") if some else own.limit(0)
    later = named(pairs, own).select(*SET, "to")
    targets = met.filter("like").select(*SET, "to").union(own).union(both).union(later).groupBy(*SET).agg(F.min("to").alias("inner"))
    out = rows.select("id", *SET).join(fixed.withColumnRenamed("to", "outer"), SET, "left").join(targets, SET, "left")
    return out.select("id", F.least("outer", F.when(F.col("inner") < F.col("id"), F.col("inner"))).alias("duplicate_of")).filter("duplicate_of IS NOT NULL")


def upsert_batch(batch_rows: DataFrame, folder: str, batch: int, buckets: int = 64, threshold: float = SAME_TEXT) -> DataFrame | None:
    """Take in a batch (from 0, rising) of ``vacancies`` rows; None if it is in already.

    Returns source, source_id, id, status, normalized_id, is_new, needs_score (a new or changed text that is no
    duplicate) and reset (a known one of these, whose undelivered matches begin anew: ``lifecycle.reset_changed``).
    A null fingerprint or identifier is a value like others.  A batch that broke off between the index and
    the vacancies is decided alike when it comes again, as its own rows are taken out of the index first.
    """
    kept, index = f"{folder}/vacancies", f"{folder}/index"
    _, held = manifest.current(kept)
    if held and held["batch"] is not None and batch <= held["batch"]:
        return None
    with scratch(batch_rows.sparkSession) as keep:
        return _upsert(batch_rows, kept, index, batch, buckets, threshold, keep)


def _upsert(batch_rows: DataFrame, kept: str, index: str, batch: int, buckets: int, threshold: float, keep) -> DataFrame:
    spark = batch_rows.sparkSession
    fields = "source string, source_id string, id long, fingerprint string, content_hash string, status string, normalized_id long"
    same = F.col("n.source").eqNullSafe(F.col("o.source")) & F.col("n.source_id").eqNullSafe(F.col("o.source_id"))
    with scratch(spark) as brief:  # words of the batch go before the index is written
        # words are worked out and written once; rows meet without them
        told = brief(batch_rows.withColumns({"fingerprint": F.coalesce("fingerprint", F.lit("")), "words": hashed_words(F.coalesce("tokens", F.array().cast("array<string>")))}).drop("tokens"))
        of_words = F.xxhash64("words", F.size("words")).alias("set")
        old = manifest.near(told.select(*KEY), kept) if manifest.current(kept)[1] else spark.createDataFrame([], fields)
        met = told.select(*KEY, F.col("position").alias("place"), "fingerprint", "content_hash", of_words).alias("n").join(old.alias("o"), same, "left")
        rows = keep(met.select("n.*", F.coalesce("o.id", F.lit(batch * PLACES) + F.col("n.place")).alias("id"), F.col("o.id").isNull().alias("is_new"), F.col("o.fingerprint").alias("was"), F.col("o.status").alias("status_was"), F.col("o.content_hash").alias("hash_was")))
        indexed = manifest.near(rows.select("fingerprint"), index) if manifest.current(index)[1] else spark.createDataFrame([], "fingerprint string, id long, words array<long>")
        there = keep(indexed.select("fingerprint", "id", of_words))
        mine = told.select(F.col("position").alias("place"), "words")
        with scratch(spark) as deciding:
            choice = decide(rows.select("id", "place", *SET), there.join(rows.select("id"), "id", "left_anti"), mine, indexed.select("fingerprint", "id", "words"), deciding, threshold)
            changed = F.col("is_new") | ~F.col("hash_was").eqNullSafe(F.col("content_hash"))
            alone = F.col("duplicate_of").isNull()
            done = rows.join(choice, "id", "left").select(*KEY, "id", "place", *SET, "content_hash", F.when(alone, "normalized").otherwise("duplicate").alias("status"), F.col("duplicate_of").alias("normalized_id"), "is_new", (alone & changed).alias("needs_score"), (alone & changed & ~F.col("is_new")).alias("reset"), "was", "status_was")
            done = stored(done)
        due = (manifest.current(index)[1] or {"batch": -1})["batch"] < batch
        if due:  # a row that the index has with the same words stays as it is
            normal = done.filter("status = 'normalized'").select("id", "place", *SET)
            leave = done.filter("status_was = 'normalized'").select(F.col("was").alias("fingerprint"), "id").join(normal, ["fingerprint", "id"], "left_anti")
            enter = mine.join(normal.join(there, ["fingerprint", "id", "set"], "left_anti").hint("shuffle_hash"), "place")
            moves = keep(leave.withColumn("words", F.lit(None).cast("array<long>")).union(enter.select("fingerprint", "id", "words")))
    if due:
        # buckets of the index are those of fingerprints, so that a batch finds all of one together
        manifest.merge(moves, index, ["fingerprint", "id"], drop=F.col("new").isNotNull() & F.col("new.words").isNull(), buckets=buckets, batch=batch, by=["fingerprint"], written=True)
    manifest.merge(done.select(*[c.split()[0] for c in fields.split(", ")]), kept, KEY, buckets=buckets, batch=batch)
    return done.drop("was", "status_was", "fingerprint", "content_hash", "place", "set")
