"""State changes as pure functions: (state, input) to a new state.

Plain tables have no row locks and no MERGE; a caller writes the returned table as a new
version and swaps it in.  Every change names the states it may start from, so a row that
has moved on meanwhile is left alone.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..session import at as instant
from ..session import scratch, stored
from . import queues

# The states a match may go to from each state.
TRANSITIONS = {
    "matched": ["queued", "expired"],
    "queued": ["scored", "matched", "expired"],
    "scored": ["alerted", "digested", "skipped", "expired"],
    "alerted": ["applying", "skipped"],
    "digested": ["applying", "skipped"],
    "skipped": ["applying"],
    "applying": ["applied", "alerted", "digested", "skipped"],
    "applied": [],
    "expired": [],
}
DELIVERED = ["alerted", "digested", "skipped", "applying", "applied"]
SAME_TEXT = 0.92
#: Longs that hold the parities of a set of words.
PARITIES = 8
#: Words that come last where sets meet on their first words.
COMMON = 256


def allowed(source: Column, target: Column) -> Column:
    edges = [f"{a}>{b}" for a, bs in TRANSITIONS.items() for b in bs]
    return F.concat(source, F.lit(">"), target).isin(edges)


def changed(condition: Column, **values: Column):
    """Set columns where the condition holds; everywhere else the old values stay."""

    def of(rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})

    return of


def transition(matches: DataFrame, moves: DataFrame, now: dt.datetime) -> DataFrame:
    """Apply moves (id, source, target); ``moved`` tells which were allowed and came first.

    A move counts if the match is in its source state and the step is allowed; the first
    delivery time stays for good.
    """
    one = moves.groupBy("id").agg(F.min(F.struct("source", "target")).alias("move"))
    out = matches.join(one, "id", "left").withColumn("moved", F.coalesce((F.col("state") == F.col("move.source")) & allowed(F.col("move.source"), F.col("move.target")), F.lit(False)))
    first = F.col("moved") & F.col("move.target").isin(DELIVERED) & F.col("delivered_at").isNull()
    out = out.withColumn("delivered_at", F.when(first, instant(now)).otherwise(F.col("delivered_at")))
    return out.withColumn("state", F.when(F.col("moved"), F.col("move.target")).otherwise(F.col("state"))).drop("move")


def add_new(state: DataFrame, incoming: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of unseen keys (one each); returns the new state and the added rows."""
    added = incoming.dropDuplicates([*key]).join(state.select(*key), [*key], "left_anti")
    return state.unionByName(added, allowMissingColumns=True), added


def upsert(state: DataFrame, incoming: DataFrame, key: list[str], update: list[str]) -> DataFrame:
    """Incoming rows (one for each key) overwrite ``update`` columns of known keys and add unknown ones."""
    new = incoming.select(*key, F.struct(*incoming.columns).alias("__new"))
    out = state.withColumn("__old", F.lit(True)).join(new, key, "full")
    fresh = F.col("__old").isNull()
    cols = []
    for c in state.columns:
        if c in key:
            cols.append(F.col(c))
        elif c in update:
            cols.append(F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c))
        elif c in incoming.columns:
            cols.append(F.when(fresh, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return out.select(*cols, fresh.alias("is_new"))


def upsert_listings(state: DataFrame, incoming: DataFrame, now: dt.datetime) -> DataFrame:
    """Discovered listings: a new one is queued, a known one gets fresh content; when it was first seen and its turn stay."""
    once = incoming.withColumn("nth", F.row_number().over(Window.partitionBy("source", "source_id").orderBy("position"))).filter("nth = 1")
    cols = once.select("source", "source_id", "url", "title", "summary", "listing_hash", F.lit("listed").alias("status"), F.lit(0).alias("attempts"), instant(now).alias("first_seen_at"), instant(now).alias("last_seen_at"), instant(now).alias("next_normalization_at"))
    return upsert(state, cols, ["source", "source_id"], ["url", "title", "summary", "listing_hash", "last_seen_at"])


def hashed_words(tokens: Column) -> Column:
    """Hashes of the distinct words in order; of hashes rather than words, as Spark has faster ways for arrays of longs."""
    return F.sort_array(F.array_distinct(F.transform(tokens, lambda x: F.xxhash64(x))))


def word_sets(rows: DataFrame) -> DataFrame:
    """id, fingerprint, words (hashes of the tokens in order), set (what rows of equal words share)."""
    return rows.select("id", "fingerprint", hashed_words(F.col("tokens")).alias("words")).withColumn("set", F.xxhash64("words", F.size("words")))


def common_words(sets: DataFrame) -> list[int]:
    """The words that most sets hold, ``COMMON`` at most."""
    counted = sets.select(F.explode("words").alias("word")).groupBy("word").count()
    return [r["word"] for r in counted.orderBy(F.desc("count"), "word").limit(COMMON).collect()]


def _first_words(sets: DataFrame, threshold: float, common: list[int], *others: str) -> DataFrame:
    """Short rows of the words of a set that any set alike shares one of: as many as may be missing and one more, in the order of words.

    Common words come last in this order, which is one for all sets: few sets that are not alike share a first word then.
    """
    n, last = F.size("words"), F.split(F.lit(",".join(map(str, common))), ",").cast("array<bigint>")
    words = F.concat(F.array_except("words", last), F.array_intersect("words", last)) if common else F.col("words")
    some = F.slice(words, 1, n - F.ceil(n * F.lit(threshold) - 1e-9).cast("int") + 1)
    return sets.select("short", "set", n.alias("n"), *others, F.explode(F.when(n > 0, some).otherwise(F.array(F.lit(0).cast("long")))).alias("word"))


def _short(sets: DataFrame) -> DataFrame:
    """With a hash of the fingerprint, on which pairs meet; fingerprints themselves are compared with the words."""
    return sets.withColumn("short", F.xxhash64("fingerprint"))


def _near(threshold: float) -> Column:
    return (F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9) & (F.col("set") != F.col("other"))


def _compared(met: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """The pairs (short, set, other, ...) of one fingerprint whose words are alike, with the fingerprint."""
    mine = left.select("short", "set", "fingerprint", F.col("words").alias("mine"))
    theirs = right.select("short", F.col("set").alias("other"), F.col("fingerprint").alias("theirs_of"), F.col("words").alias("theirs"))
    both = met.join(mine, ["short", "set"]).join(theirs, ["short", "other"])
    return both.filter((F.col("fingerprint") == F.col("theirs_of")) & (t.jaccard(F.col("mine"), F.col("theirs")) >= threshold)).drop("mine", "theirs", "theirs_of")


def with_parities(sets: DataFrame, *others: str) -> DataFrame:
    """fingerprint, set, words, other columns, and parities p0, p1, ...: for each of ``64 * PARITIES`` parts of all hashes, whether a set has an odd number of words there.

    Two sets differ in at least as many words as in parities, so most that are not alike are told apart without their words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = 64 * PARITIES
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                words, n = part.column(2), part.num_rows
                row = np.repeat(np.arange(n), np.asarray(words.value_lengths().fill_null(0), np.int64))
                place = np.asarray(words.flatten(), np.int64) & (bits - 1)
                odd = (np.bincount(row * bits + place, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
                longs = np.packbits(odd, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(longs[:, k]) for k in range(PARITIES))], names=names)

    told = sets.select("fingerprint", "set", "words", *others)
    names = [*told.columns, *parity("p")]
    return told.mapInArrow(run, ", ".join([*(f"{name} {kind}" for name, kind in told.dtypes), *(f"{p} long" for p in parity("p"))]))


def parity(name: str) -> list[str]:
    return [f"{name}{k}" for k in range(PARITIES)]


def _may_be_alike(threshold: float) -> Column:
    """Of a pair with n and m words: sets alike enough differ in few words, and so in few parities p and q."""
    differ = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(q))) for p, q in zip(parity("p"), parity("q"), strict=True)), F.lit(0))
    return _near(threshold) & (differ <= (1 - threshold) / (1 + threshold) * (F.col("n") + F.col("m")) + 1e-6)


def alike_sets(left: DataFrame, right: DataFrame, threshold: float = SAME_TEXT, common: list[int] | None = None, keep=lambda rows: rows) -> DataFrame:
    """fingerprint, set, other: different sets of one fingerprint that are alike.  Both: as ``with_parities`` has them; a set once.

    Two sets that are alike enough share one of their first words, as many as may be missing and one more, so
    sets meet on these words inside a fingerprint, and a common title is no task of all its pairs.  Where they meet, parities
    leave those pairs alone that may be alike, and keep writes these, so that words travel for few others.  common: ``common_words`` of the sets.
    """

    def first(sets: DataFrame) -> DataFrame:
        # sets meet on one hash of fingerprint and word; both are compared with the words
        return _first_words(_short(sets), threshold, common or [], *parity("p")).withColumn("word", F.xxhash64("short", "word"))

    a = first(left)
    b = first(right).select(F.col("set").alias("other"), F.col("n").alias("m"), *(F.col(p).alias(q) for p, q in zip(parity("p"), parity("q"), strict=True)), "word")
    met = keep(a.join(b, "word").filter(_may_be_alike(threshold)).select("short", "set", "other").distinct())
    mine, theirs = _short(left).select("short", "fingerprint", "set", F.col("words").alias("mine")), right.select("fingerprint", F.col("set").alias("other"), F.col("words").alias("theirs"))
    both = met.join(mine, ["short", "set"]).join(theirs, ["fingerprint", "other"])
    return both.filter(t.jaccard(F.col("mine"), F.col("theirs")) >= threshold).select("fingerprint", "set", "other")


def duplicate_of(candidates: DataFrame, known: DataFrame, threshold: float = SAME_TEXT) -> DataFrame:
    """The oldest known row of the same fingerprint and nearly the same description.

    Both: id, fingerprint, tokens.  Words are compared by 64-bit hashes, in the order of these.
    Rows of equal words are one set with its oldest row, so copies are never paired with each other.  Words travel only
    for fingerprints of several sets.  Where sets meet, parities leave those pairs alone that may be alike, and a set is
    compared with these from the oldest on, in steps that grow, until one is alike: families of near copies are not compared pair by pair.
    """
    key = ["fingerprint", "set"]
    with scratch(candidates.sparkSession) as keep:
        with scratch(candidates.sparkSession) as brief:  # words of all rows go before sets meet
            # read several times below, so the texts are cut into words once
            ours = brief(word_sets(candidates))
            theirs = ours if known is candidates else brief(word_sets(known))
            rows = stored(ours.select("id", *key))
            age = (rows if theirs is ours else stored(theirs.select("id", *key))).groupBy(*key).agg(F.min("id").alias("oldest")).filter("oldest IS NOT NULL")
            several = rows.select(*key).union(age.select(*key)).distinct().filter("fingerprint IS NOT NULL").groupBy("fingerprint").count().filter("count > 1")
            several = brief(_short(several).select("short").distinct())

            def worded(rows: DataFrame) -> DataFrame:
                """A row of each set that is not alone, with its oldest row; other words are left where they are."""
                return _short(rows).join(several, "short", "left_semi").groupBy("short", *key).agg(F.min("id").alias("oldest"), F.first("words").alias("words"))

            right = keep(with_parities(worded(theirs).filter("oldest IS NOT NULL"), "short", "oldest"))
            left = right if theirs is ours else keep(with_parities(worded(ours).drop("oldest").join(age, key, "left"), "short", "oldest"))
        common = common_words(right)
        b = _first_words(right, threshold, common, "oldest", *parity("p")).withColumnsRenamed({"set": "other", "n": "m"} | dict(zip(parity("p"), parity("q"), strict=True)))
        a = _first_words(left.withColumnRenamed("oldest", "bound"), threshold, common, "bound", *parity("p"))
        # only what is older than the set itself can change the outcome
        met = a.join(b, ["short", "word"]).filter(_may_be_alike(threshold) & (F.col("bound").isNull() | (F.col("oldest") < F.col("bound")))).select("short", "set", "other", "oldest").distinct()
        turn = F.row_number().over(Window.partitionBy("short", "set").orderBy("oldest", "other"))
        rest, alike, below = keep(met.withColumn("turn", turn)), age, 2
        while rest.limit(1).count():
            now = _compared(rest.filter(F.col("turn") < below), left, right, threshold)
            found = stored(now.groupBy("short", *key).agg(F.min("oldest").alias("oldest")))
            alike = alike.union(found.select(*key, "oldest"))
            rest, below = keep(rest.filter(F.col("turn") >= below).join(found, ["short", "set"], "left_anti")), 8 * below
    oldest = alike.groupBy(*key).agg(F.min("oldest").alias("duplicate_of"))
    return rows.withColumnRenamed("id", "candidate").join(oldest, key).filter("duplicate_of < candidate").select("candidate", "duplicate_of")


def reset_changed(matches: DataFrame, changes: DataFrame) -> DataFrame:
    """Undelivered matches of listings with new content go back to matched and lose their scores."""
    out = matches.join(changes.select("vacancy_id").distinct().withColumn("__changed", F.lit(True)), "vacancy_id", "left")
    again = F.coalesce("__changed", F.lit(False)) & F.col("state").isin("matched", "queued", "scored") & F.col("delivered_at").isNull()
    return changed(again, state=F.lit("matched"), prescore=F.lit(None), score=F.lit(None), scored_at=F.lit(None))(out).drop("__changed")


def fresh_publication(published: Column, known: Column, now: dt.datetime, max_age: int) -> Column:
    """Future dates are unknown; stale ones matter for new rows only.  struct(published_at, dropped)."""
    real = F.when(published <= instant(now), published)
    return F.struct(real.alias("published_at"), (~known & (real < instant(now - dt.timedelta(days=max_age)))).alias("dropped"))


def claim(rows: DataFrame, now: dt.datetime, per_source: int, k: int, lease: dt.timedelta = dt.timedelta(minutes=15)) -> DataFrame:
    """Give the next due rows a lease, fairly over sources; ``claimed`` marks them.  Expired leases are due again."""
    ready = ((F.col("status") == "listed") | ((F.col("status") == "normalizing") & (F.col("lease_until") <= instant(now)))) & (F.col("next_normalization_at") <= instant(now))
    chosen = queues.fair(rows.filter(ready), "source", per_source, k, "next_normalization_at", "id").select("id", F.lit(True).alias("claimed"))
    out = rows.join(F.broadcast(chosen), "id", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    return changed(F.col("claimed"), status=F.lit("normalizing"), attempts=F.col("attempts") + 1, lease_until=instant(now + lease))(out)


def finish(rows: DataFrame, outcomes: DataFrame, now: dt.datetime) -> DataFrame:
    """Outcomes (id, outcome, error) of claimed rows: normalized, closed, or failed with a later turn."""
    from .scheduling import backoff_minutes

    out = rows.join(outcomes, "id", "left")
    mine = (F.col("status") == "normalizing") & F.col("outcome").isNotNull()
    failed = mine & (F.col("outcome") == "failed")
    later = instant(now) + F.make_dt_interval(F.lit(0), F.lit(0), backoff_minutes(F.col("attempts")))
    out = out.withColumns({"next_normalization_at": F.when(failed, later).otherwise(F.col("next_normalization_at")), "last_error": F.when(failed, F.col("error")).when(mine, None).otherwise(F.col("last_error"))})
    status = F.when(failed, "listed").when(mine, F.col("outcome")).otherwise(F.col("status"))
    return out.withColumn("status", status).drop("outcome", "error")


def unprotected(rows: DataFrame, matches: DataFrame, digest_minimum: float, cutoff: dt.datetime, k: int) -> DataFrame:
    """The oldest rows not seen since the cutoff that no match protects (delivered, applied for, or scored high)."""
    protecting = matches.filter(F.col("delivered_at").isNotNull() | F.col("application").isNotNull() | (F.col("score") >= digest_minimum))
    old = rows.filter(F.col("last_seen_at") < instant(cutoff)).join(protecting.select(F.col("vacancy_id").alias("id")), "id", "left_anti")
    return queues.first(old, k, "last_seen_at", "id")


def expire_stale(matches: DataFrame, published: DataFrame, now: dt.datetime, max_age: int) -> DataFrame:
    """Matched and unscored rows whose listing is older than the limit expire."""
    out = matches.join(published, "vacancy_id", "left")
    stale = (F.col("state") == "matched") & F.col("score").isNull() & (F.col("published_at") < instant(now - dt.timedelta(days=max_age)))
    return out.withColumn("state", F.when(stale, "expired").otherwise(F.col("state"))).drop("published_at")


def save_scores(matches: DataFrame, scores: DataFrame, column: str, now: dt.datetime, target: str | None = None) -> DataFrame:
    """Scores (id, value) of queued matches; a full score also moves them on."""
    out = matches.join(scores.select("id", F.col("value").alias("__value")), "id", "left")
    mine = (F.col("state") == "queued") & F.col("__value").isNotNull()
    values = {column: F.col("__value")} | ({"state": F.lit(target), "scored_at": instant(now)} if target else {})
    return changed(mine, **values)(out).drop("__value")


def apply_demand(units: DataFrame, subscriptions: DataFrame, new_units: DataFrame, new_subscriptions: DataFrame, users: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Replace the users' subscriptions, add or revive units, and retire units nobody subscribes to."""
    kept = subscriptions.join(users.select("user_id"), "user_id", "left_anti").unionByName(new_subscriptions)
    merged = upsert(units, new_units, ["unit_id"], ["query"]).drop("is_new")
    wanted = kept.select("unit_id").distinct().withColumn("__wanted", F.lit(True))
    retired = F.when(F.col("__wanted"), F.lit(None)).otherwise(F.coalesce("retired_at", instant(now)))
    return merged.join(wanted, "unit_id", "left").withColumn("retired_at", retired).drop("__wanted"), kept


def lease(state: DataFrame, asks: DataFrame, now: dt.datetime, ttl: dt.timedelta) -> DataFrame:
    """Sessions by key: a free or expired one goes to the first asker, a holder renews its own."""
    one = asks.groupBy("user_id", "kind").agg(F.min(F.struct("asked_at", "token")).alias("ask"))
    out = state.join(one, ["user_id", "kind"], "full")
    free = F.col("token").isNull() | (F.col("expires_at") <= instant(now)) | (F.col("token") == F.col("ask.token"))
    wins = F.col("ask").isNotNull() & free
    changes = {"granted": wins, "expires_at": F.when(wins, instant(now + ttl)).otherwise(F.col("expires_at")), "token": F.when(wins, F.col("ask.token")).otherwise(F.col("token"))}
    return out.withColumns(changes).drop("ask")


def begin_updates(ledger: DataFrame, updates: DataFrame, now: dt.datetime, hold: dt.timedelta = dt.timedelta(minutes=5), keep: dt.timedelta = dt.timedelta(days=7)) -> DataFrame:
    """Which updates to work on: unseen ones, and those whose worker lost its hold.  Old finished rows are not looked at."""
    known = ledger.filter((F.col("status") != "done") | (F.col("updated_at") >= instant(now - keep)))
    out = updates.dropDuplicates(["update_id"]).join(known, "update_id", "left")
    return out.filter(F.col("status").isNull() | ((F.col("status") == "working") & (F.col("lease_until") <= instant(now)))).select("update_id", F.lit("working").alias("status"), instant(now + hold).alias("lease_until"))


def decodable(source: Column, source_id: Column, url: Column, content_hash: Column) -> Column:
    """Whether a stored row can be read back; a null anywhere means no."""
    ok = content_hash.rlike("^[0-9a-f]{64}$") & url.rlike("^https?://") & source.rlike("^[a-z][a-z0-9-]*$")
    ok = ok & (source_id == F.btrim(source_id)) & (F.length(source_id) <= 512) & (source_id != "") & ~source_id.rlike(r"[\p{Cntrl}]")
    return F.coalesce(ok, F.lit(False))


def _asked(matches: DataFrame, asked: DataFrame, *values: str) -> DataFrame:
    ask = asked.groupBy("id").agg(F.min(F.struct(F.lit(True).alias("asked"), *values)).alias("__ask"))
    return matches.join(ask, "id", "left")


def claim_matches(matches: DataFrame, asked: DataFrame, now: dt.datetime) -> DataFrame:
    """Matched rows that are asked for (id) are queued; ``claimed`` marks them, so of two claimers one loses."""
    out = _asked(matches, asked)
    out = out.withColumn("claimed", F.col("__ask").isNotNull() & (F.col("state") == "matched")).drop("__ask")
    return changed(F.col("claimed"), state=F.lit("queued"), queued_at=instant(now), updated_at=instant(now))(out)


def release_matches(matches: DataFrame, asked: DataFrame, now: dt.datetime) -> DataFrame:
    """Queued rows without a score go back."""
    out = _asked(matches, asked)
    mine = F.col("__ask").isNotNull() & (F.col("state") == "queued") & F.col("score").isNull()
    return changed(mine, state=F.lit("matched"), updated_at=instant(now))(out).drop("__ask")


#: What an alert shows, and is not kept when it has gone out; the full explanation is.
SHORT = ["primary_track", "short_summary", "short_reasons", "short_gaps"]


def alert(matches: DataFrame, asked: DataFrame, now: dt.datetime) -> DataFrame:
    """Scored rows that no one was told of yet: alerted, without the short texts."""
    out = _asked(matches, asked)
    mine = F.col("__ask").isNotNull() & (F.col("state") == "scored") & F.col("delivered_at").isNull()
    return changed(mine, state=F.lit("alerted"), delivered_at=instant(now), updated_at=instant(now), **{c: F.lit(None) for c in SHORT if c in matches.columns})(out).drop("__ask")


def skip(matches: DataFrame, asked: DataFrame, now: dt.datetime) -> DataFrame:
    out = _asked(matches, asked)
    mine = F.col("__ask").isNotNull() & F.col("state").isin("scored", "alerted", "digested")
    return changed(mine, state=F.lit("skipped"), delivered_at=F.coalesce("delivered_at", instant(now)), updated_at=instant(now))(out).drop("__ask")


def send_digests(matches: DataFrame, users: DataFrame, digests: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Digests (user_id, ids in order): their scored rows are digested, the users remember the ids."""
    sent = digests.select("user_id", F.explode("ids").alias("id")).withColumn("__sent", F.lit(True))
    out = matches.join(sent, ["user_id", "id"], "left")
    mine = F.col("__sent") & (F.col("state") == "scored")
    told = changed(F.coalesce(mine, F.lit(False)), state=F.lit("digested"), delivered_at=F.coalesce("delivered_at", instant(now)), updated_at=instant(now))(out).drop("__sent")
    kept = users.join(digests.select("user_id", "ids"), "user_id", "left")
    return told, changed(F.col("ids").isNotNull(), digest_snapshot=F.col("ids"), last_digest_at=instant(now))(kept).drop("ids")


#: The agent that a delivered artifact is booked under.
AGENTS = {"cv": "tailor-application", "letter": "tailor-cover-letter"}
ARTIFACTS = "map<string,struct<cv_hash:string,text:string,delivered_at:timestamp_ntz>>"


def set_application(matches: DataFrame, events: DataFrame, now: dt.datetime) -> DataFrame:
    """Application events on matches (id, event: begin, ready, failed, delivered; artifact, cv_hash, error).

    begin needs a delivered state without an application, and an artifact that is not there for this CV already;
    a failure returns the match to alerted if it was delivered, else to skipped, and leaves the application failed; only a
    ready one is delivered.  matches: application, artifacts (a map, null: none), application_error.
    """
    out = _asked(matches, events, "event", "artifact", "cv_hash", "error")
    event, none = F.col("__ask.event"), F.lit(None)
    cached = F.col("artifacts")[F.col("__ask.artifact")]["cv_hash"].eqNullSafe(F.col("__ask.cv_hash")) & F.col("__ask.cv_hash").isNotNull()
    begin = (event == "begin") & F.col("state").isin("alerted", "digested", "skipped", "applied") & F.col("application").isNull() & ~cached
    preparing = (F.col("state") == "applying") & (F.col("application") == "preparing")
    ready, failed = preparing & (event == "ready"), preparing & (event == "failed")
    done = (event == "delivered") & (F.col("state") == "applying") & (F.col("application") == "ready")
    state = F.when(begin, "applying").when(done, "applied").when(failed, F.when(F.col("delivered_at").isNotNull(), "alerted").otherwise("skipped")).otherwise(F.col("state"))
    status = F.when(begin, "preparing").when(ready, "ready").when(failed, "failed").when(done, none).otherwise(F.col("application"))
    error = F.when(begin, none).when(failed, F.substring("__ask.error", 1, 500)).otherwise(F.col("application_error"))
    told = F.when(done, F.coalesce("delivered_at", instant(now))).otherwise(F.col("delivered_at"))
    return out.withColumns({"application": status, "state": state, "application_error": error, "delivered_at": told}).drop("__ask")


def application_usage(before: DataFrame, after: DataFrame, events: DataFrame, now: dt.datetime) -> DataFrame:
    """One usage row (user_id, kind, agent, at) for each application that the events delivered."""
    done = after.filter("state = 'applied'").select("id").join(before.filter("state = 'applying'").select("id", "user_id"), "id")
    agent = F.create_map(*[F.lit(x) for pair in AGENTS.items() for x in pair])[F.col("artifact")]
    told = events.filter("event = 'delivered'").select("id", "artifact").distinct()
    return done.join(told, "id").select("user_id", F.lit("application").alias("kind"), agent.alias("agent"), instant(now).alias("at"))


def save_artifacts(matches: DataFrame, saved: DataFrame, now: dt.datetime) -> DataFrame:
    """Artifacts (id, artifact, cv_hash, text) of matches; one of the same kind takes the place of the older."""
    out = _asked(matches, saved, "artifact", "cv_hash", "text")
    value = F.struct(F.col("__ask.cv_hash").alias("cv_hash"), F.col("__ask.text").alias("text"), instant(now).alias("delivered_at"))
    old = F.map_filter(F.coalesce("artifacts", F.create_map().cast(ARTIFACTS)), lambda k, _: k != F.col("__ask.artifact"))
    return changed(F.col("__ask").isNotNull(), artifacts=F.map_concat(old, F.create_map(F.col("__ask.artifact"), value)))(out).drop("__ask")


def set_users(users: DataFrame, changes: DataFrame, now: dt.datetime) -> DataFrame:
    """Status changes of users; an owner stays approved."""
    out = users.join(changes.select("user_id", F.col("status").alias("__status")), "user_id", "left")
    move = F.col("__status").isNotNull() & ~F.col("is_owner")
    return changed(move, status=F.col("__status"))(out).drop("__status")


def stage_cv(pending: DataFrame, uploads: DataFrame, now: dt.datetime, ttl: dt.timedelta = dt.timedelta(minutes=15)) -> DataFrame:
    """The latest upload of each user, valid for a while; older unexpired ones of other users stay."""
    new = uploads.groupBy("user_id").agg(F.max_by("cv_hash", F.struct("uploaded_at", "cv_hash")).alias("cv_hash")).withColumn("expires_at", instant(now + ttl))
    return pending.filter(F.col("expires_at") > instant(now)).join(new, "user_id", "left_anti").unionByName(new)
