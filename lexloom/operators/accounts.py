"""Users, their CVs, sessions and updates as pure functions: (state, input) to a new state.

As in ``lifecycle``, a caller writes the returned table as a new version; every change names the
states it may start from, and equal keys of one input count once.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import at as instant
from .lifecycle import changed

IDENTITY = ["username", "first_name", "last_name"]


def _marked(rows: DataFrame, asked: DataFrame, key: list[str], *values: str) -> DataFrame:
    """``rows`` with what was asked of each as struct ``__ask``; null where nothing was."""
    ask = asked.groupBy(*key).agg(F.min(F.struct(F.lit(True).alias("asked"), *values)).alias("__ask"))
    return rows.join(ask, key, "left")


def touch(users: DataFrame, seen: DataFrame, now: dt.datetime) -> DataFrame:
    """Users who were seen (user_id, username, first_name, last_name, locale): new ones are added, a chosen locale stays."""
    ask = seen.groupBy("user_id").agg(F.min(F.struct(*IDENTITY, "locale")).alias("__new"))
    out = users.withColumn("__old", F.lit(True)).join(ask, "user_id", "full")
    new, mine = F.col("__new"), F.col("__new").isNotNull()
    locale = F.when(mine & ~F.coalesce("locale_selected", F.lit(False)), F.coalesce(new["locale"], F.col("locale"))).otherwise(F.col("locale"))
    values = {c: F.when(mine, new[c]).otherwise(F.col(c)) for c in IDENTITY} | {"locale": locale, "updated_at": F.when(mine, instant(now)).otherwise(F.col("updated_at"))}
    first = {"locale_selected": F.lit(False), "status": F.lit("new"), "is_owner": F.lit(False)}
    values |= {c: F.coalesce(F.col(c), v) for c, v in first.items()}
    return out.withColumns(values).select(*users.columns)


def choose_locale(users: DataFrame, choices: DataFrame, now: dt.datetime) -> DataFrame:
    """choices: user_id, locale."""
    out = _marked(users, choices.select("user_id", F.col("locale").alias("__locale")), ["user_id"], "__locale")
    mine = F.col("__ask").isNotNull()
    return changed(mine, locale=F.col("__ask.__locale"), locale_selected=F.lit(True), updated_at=instant(now))(out).drop("__ask")


def request_access(users: DataFrame, asks: DataFrame, now: dt.datetime, cooldown: dt.timedelta) -> DataFrame:
    """Users who ask (user_id) become pending, but not those who are approved, pending, the owner, or turned away a short while ago.

    Adds notify_owner and retry_after_seconds.
    """
    out = _marked(users, asks, ["user_id"])
    mine = F.col("__ask").isNotNull() & ~F.col("is_owner") & ~F.col("status").isin("approved", "pending")
    gone = (F.unix_micros(instant(now).cast("timestamp")) - F.unix_micros(F.col("status_changed_at").cast("timestamp"))) / 1_000_000
    wait = F.when(mine & F.col("status").isin("rejected", "revoked"), F.greatest(F.lit(0.0), F.lit(cooldown.total_seconds()) - gone)).otherwise(0.0)
    out = out.withColumns({"retry_after_seconds": F.ceil(wait).cast("int"), "notify_owner": mine & (wait <= 0)})
    return changed(F.col("notify_owner"), status=F.lit("pending"), access_requested_at=instant(now), status_changed_at=instant(now), updated_at=instant(now))(out).drop("__ask")


def delete_user_data(tables: dict[str, DataFrame], users: DataFrame, units: DataFrame, gone: DataFrame, now: dt.datetime) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """All rows of the users ``gone`` (user_id) leave the tables; their settings are cleared; units nobody subscribes to retire.

    tables: by name, each with user_id; ``subscriptions`` (unit_id) among them.
    """
    left = {name: rows.join(gone.select("user_id"), "user_id", "left_anti") for name, rows in tables.items()}
    out = _marked(users, gone, ["user_id"])
    cleared = changed(F.col("__ask").isNotNull(), locale=F.lit(None), locale_selected=F.lit(False), delivery_settings=F.lit("{}"), digest_snapshot=F.array().cast("array<long>"), last_digest_at=F.lit(None), updated_at=instant(now))(out).drop("__ask")
    wanted = left["subscriptions"].select("unit_id").distinct().withColumn("__wanted", F.lit(True))
    kept = units.join(wanted, "unit_id", "left").withColumn("retired_at", F.when(F.col("__wanted"), F.col("retired_at")).otherwise(F.coalesce("retired_at", instant(now)))).drop("__wanted")
    return left, cleared, kept


CV = ["cv_hash", "cv_text"]


def save_cvs(documents: DataFrame, matches: DataFrame, uploads: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """New CVs (user_id, cv_hash, cv_text) replace the old ones and drop the profiles made of them; undelivered matches begin anew."""
    ask = uploads.groupBy("user_id").agg(F.min(F.struct(*CV)).alias("__new"))
    out = documents.join(ask, "user_id", "full")
    mine = F.col("__new").isNotNull()
    values = {c: F.when(mine, F.col(f"__new.{c}")).otherwise(F.col(c)) for c in CV}
    values |= {"search_profiles": F.when(mine, "{}").otherwise(F.col("search_profiles")), "career_profile": F.when(~mine, F.col("career_profile")), "updated_at": F.when(mine, instant(now)).otherwise(F.col("updated_at"))}
    again = _marked(matches, uploads, ["user_id"])
    open_ = F.col("__ask").isNotNull() & F.col("state").isin("matched", "queued", "scored") & F.col("delivered_at").isNull()
    fresh = changed(open_, state=F.lit("matched"), prescore=F.lit(None), score=F.lit(None), scored_at=F.lit(None), queued_at=F.lit(None), updated_at=instant(now))(again).drop("__ask")
    return out.withColumns(values).select(*documents.columns), fresh


def confirm_cvs(pending: DataFrame, documents: DataFrame, matches: DataFrame, confirmed: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged CVs of the users who confirm (user_id) are saved, unless they expired.  New pending, documents, matches."""
    mine = pending.join(confirmed.select("user_id").distinct(), "user_id", "left_semi").filter(F.col("expires_at") > instant(now))
    saved, fresh = save_cvs(documents, matches, mine.select("user_id", *CV), now)
    return pending.join(mine.select("user_id"), "user_id", "left_anti"), saved, fresh


def discard_cvs(pending: DataFrame, users: DataFrame) -> DataFrame:
    return pending.join(users.select("user_id"), "user_id", "left_anti")


def profile_for(documents: DataFrame, profiles: DataFrame, template: int) -> DataFrame:
    """Stored profiles that may be used: made for the user's present CV and with the present template.

    documents: user_id, cv_hash; profiles: user_id, made_for, template, and the profile itself.
    """
    same = profiles.join(documents.select("user_id", "cv_hash"), "user_id")
    return same.filter((F.col("made_for") == F.col("cv_hash")) & (F.col("template") == template)).drop("cv_hash")


def without_profile(users: DataFrame, usable: DataFrame, valid: Column | None = None) -> DataFrame:
    """Users with no stored profile that may be used; ``valid`` is a condition on a stored profile."""
    kept = usable if valid is None else usable.filter(F.coalesce(valid, F.lit(False)))
    return users.join(kept.select("user_id"), "user_id", "left_anti")


def live_sessions(state: DataFrame, now: dt.datetime) -> DataFrame:
    return state.filter(F.col("expires_at") > instant(now))


def release_sessions(state: DataFrame, releases: DataFrame) -> DataFrame:
    """Sessions leave the table whose holder (user_id, kind, token) lets go; without a token whoever holds them."""
    keys = ["user_id", "kind"]
    ask = releases.select(*keys, F.col("token").alias("__token")).distinct()
    hit = state.join(ask, keys).filter(F.col("__token").isNull() | (F.col("__token") == F.col("token"))).select(*keys).distinct()
    return state.join(hit, keys, "left_anti")


def finish_updates(ledger: DataFrame, outcomes: DataFrame, now: dt.datetime) -> DataFrame:
    """Outcomes (update_id, error) of updates in work: done without an error, else failed with its first 120 letters."""
    out = _marked(ledger, outcomes, ["update_id"], "error")
    mine = F.col("__ask").isNotNull() & (F.col("status") == "working")
    failed = F.col("__ask.error").isNotNull()
    return changed(mine, status=F.when(failed, "failed").otherwise("done"), lease_until=F.lit(None), error=F.substring("__ask.error", 1, 120), updated_at=instant(now))(out).drop("__ask")


def forget_updates(ledger: DataFrame, now: dt.datetime, keep: dt.timedelta = dt.timedelta(days=7)) -> DataFrame:
    return ledger.filter(F.col("received_at") >= instant(now - keep))


def save_settings(users: DataFrame, settings: DataFrame, now: dt.datetime) -> DataFrame:
    """Delivery settings (user_id, settings as JSON text) are stored where they can be read."""
    out = _marked(users, settings.select("user_id", F.col("settings").alias("__settings")), ["user_id"], "__settings")
    ok = F.col("__ask").isNotNull() & read_settings(F.col("__ask.__settings")).isNotNull()
    return changed(ok, delivery_settings=F.col("__ask.__settings"), updated_at=instant(now))(out).drop("__ask")


def read_settings(text: Column) -> Column:
    """struct(enabled, digest_hour, timezone) of stored delivery settings; null where they are malformed."""
    s = F.from_json(text, "enabled boolean, digestHourUtc int, timezone string")
    ok = s["enabled"].isNotNull() & s["digestHourUtc"].between(0, 23) & (F.coalesce(s["timezone"], F.lit("")) != "")
    return F.when(ok, F.struct(s["enabled"].alias("enabled"), s["digestHourUtc"].alias("digest_hour"), s["timezone"].alias("timezone")))
