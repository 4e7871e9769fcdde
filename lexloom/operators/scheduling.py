"""Cadences, wake-ups, budgets and the choice of due units."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import at as instant
from ..session import cut_lineage
from .queues import batches


def next_cadence(current: Column, novelty: Column, floor: int, ceiling: int) -> Column:
    """Half the clamped cadence after news, half as much again without, inside the bounds."""
    clamped = F.least(F.lit(ceiling), F.greatest(F.lit(floor), current))
    return F.when(novelty, F.greatest(F.lit(floor), F.round(clamped / 2))).otherwise(F.least(F.lit(ceiling), F.round(clamped * 1.5))).cast("int")


def wake_after_ms(units: DataFrame, now: dt.datetime, low: int = 15_000, high: int = 300_000) -> DataFrame:
    """Milliseconds until the next unit is due, between the bounds; the upper one where there is none."""
    wait = F.unix_millis(F.min("next_run_at").cast("timestamp")) - F.unix_millis(instant(now).cast("timestamp"))
    # least and greatest pass over nulls, so the empty case is told first
    return units.agg(F.when(F.count("next_run_at") == 0, high).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), wait))).cast("long").alias("wake_ms"))


def backoff_minutes(attempts: Column, most: int = 1440) -> Column:
    return F.least(F.lit(most), F.pow(F.lit(2), F.least(F.lit(30), F.greatest(F.lit(0), attempts - 1)))).cast("int")


def pace(spent: Column, daily: float, now: dt.datetime, floor: float = 1 / 12) -> Column:
    """drained or skipped: whether a user's spend is still below the part of the budget that the day allows."""
    fraction = (now - now.replace(hour=0, minute=0, second=0, microsecond=0)) / dt.timedelta(days=1)
    ceiling = daily * max(floor, min(1.0, fraction))
    if ceiling == 0:
        return F.lit("skipped")
    return F.when(F.coalesce(spent, F.lit(0.0)) >= ceiling, "skipped").otherwise("drained")


def workers(load: Column, low: int, high: int, jobs: int = 5) -> Column:
    """All jobs up to ``low``, then one worker more for every ``jobs`` jobs, at most ``high``."""
    return F.when(load <= low, load).otherwise(F.least(load, F.lit(high), low + F.floor((load - low) / jobs))).cast("int")


def cooldown_seconds(last: Column, now: dt.datetime, wait: int) -> Column:
    gone = (F.unix_micros(instant(now).cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 1e6
    return F.ceil(F.greatest(F.lit(0.0), wait - gone)).cast("int")


def due_units(units: DataFrame, subscriptions: DataFrame, users: DataFrame, now: dt.datetime) -> DataFrame:
    """Due units that approved users subscribe to, each with its recipients in order."""
    due = units.filter((F.col("next_run_at") <= instant(now)) & F.col("retired_at").isNull())
    live = subscriptions.join(users.select("user_id"), "user_id", "left_semi").join(due.select("unit_id", "platform", "next_run_at"), "unit_id")
    return live.groupBy("unit_id", "platform", "next_run_at").agg(F.sort_array(F.collect_set(F.struct("user_id", "search_name"))).alias("recipients"))


def pick_due(units: DataFrame, budget: int, now: dt.datetime) -> DataFrame:
    """Up to ``budget`` due units of each platform: those that reach the most users not yet reached, then by schedule.

    units: platform, unit_id, next_run_at, subscribers.  The greedy choice runs in rounds over all platforms
    at once, and a platform of any size is many tasks: gains are counts that only the newly reached users change.
    A round takes the leading units up to the first one that shares a user with a unit before it: gains only fall, so up to there the
    choice one by one would be the same.
    """
    due = units.filter((F.col("next_run_at") <= instant(now)) & (F.size("subscribers") > 0))
    due = cut_lineage(due.select("platform", "unit_id", "next_run_at", F.array_distinct("subscribers").alias("subscribers")))
    crowded = due.groupBy("platform").count().filter(F.col("count") > budget).select("platform")
    easy = due.join(crowded, "platform", "left_anti")
    hard = cut_lineage(due.join(crowded, "platform", "left_semi"))
    reach = hard.select("platform", "unit_id", F.explode("subscribers").alias("user"))
    gains = hard.select("platform", "unit_id", "next_run_at", F.size("subscribers").alias("gain"), F.lit(budget).alias("left"))
    order = Window.partitionBy("platform").orderBy(F.desc("gain"), "next_run_at", "unit_id")
    taken = hard.select("platform", "unit_id", F.lit(0).alias("picked")).limit(0)
    while True:
        top = cut_lineage(gains.filter("gain > 0").withColumn("place", F.row_number().over(order)).filter((F.col("place") <= budget) & (F.col("place") <= F.col("left"))).select("platform", "unit_id", "left", "place"))
        if not top.limit(1).count():
            break
        theirs = reach.join(top.select("platform", "unit_id", "place"), ["platform", "unit_id"])
        nearest = theirs.groupBy("platform", "user").agg(F.min("place").alias("one"), F.sort_array(F.collect_set("place")).alias("places"))  # at most a budget of places
        overlap = nearest.filter(F.size("places") > 1).groupBy("platform").agg(F.min(F.col("places")[1]).alias("stop"))
        chosen = cut_lineage(top.join(overlap, "platform", "left").filter(F.col("place") < F.coalesce("stop", F.lit(budget + 1))))
        taken = taken.unionByName(chosen.select("platform", "unit_id", (F.lit(budget) - F.col("left") + F.col("place")).cast("int").alias("picked")))
        reached = reach.join(chosen.select("platform", "unit_id"), ["platform", "unit_id"], "left_semi").select("platform", "user").distinct()
        fell = reach.join(reached, ["platform", "user"], "left_semi").groupBy("platform", "unit_id").agg(F.count(F.lit(1)).alias("fell"))
        used = chosen.groupBy("platform").agg(F.count(F.lit(1)).alias("used"))
        gains = gains.join(fell, ["platform", "unit_id"], "left").join(used, "platform", "left")
        gains = cut_lineage(gains.select("platform", "unit_id", "next_run_at", (F.col("gain") - F.coalesce("fell", F.lit(0))).cast("int").alias("gain"), (F.col("left") - F.coalesce("used", F.lit(0))).cast("int").alias("left")))
        reach = cut_lineage(reach.join(reached, ["platform", "user"], "left_anti"))
    # what is left of a budget goes by schedule
    rest = gains.join(taken.select("platform", "unit_id"), ["platform", "unit_id"], "left_anti")
    by_time = Window.partitionBy("platform").orderBy("next_run_at", "unit_id")
    rest = rest.withColumn("nth", F.row_number().over(by_time)).filter((F.col("nth") <= budget) & (F.col("nth") <= F.col("left")))
    chosen = taken.unionByName(rest.select("platform", "unit_id", (F.lit(budget) - F.col("left") + F.col("nth")).cast("int").alias("picked")))
    return chosen.unionByName(batches(easy, 1, "platform", "next_run_at", "unit_id").select("platform", "unit_id", (F.col("batch") + 1).alias("picked")))


def tick(units: DataFrame, results: DataFrame, now: dt.datetime, floor: int, ceiling: int) -> DataFrame:
    """Units after a run: found news halves the cadence; failed units stay due."""
    ran = results.select("unit_id", F.col("novelty").alias("__novelty"), F.col("failed").alias("__failed"))
    out = units.join(ran, "unit_id", "left")
    done = F.col("__novelty").isNotNull() & ~F.coalesce("__failed", F.lit(False))
    cadence = F.when(done, next_cadence(F.col("cadence_minutes"), F.col("__novelty") > 0, floor, ceiling)).otherwise(F.col("cadence_minutes"))
    out = out.withColumn("cadence_minutes", cadence)
    next_run = F.when(done, instant(now) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("cadence_minutes"))).otherwise(F.col("next_run_at"))
    return out.withColumn("next_run_at", next_run).drop("__novelty", "__failed")


def run_report(results: DataFrame) -> DataFrame:
    """Selected, run, discovered and failed units of each platform."""
    failed = F.coalesce("failed", F.lit(False))
    return results.groupBy("platform").agg(
        F.count(F.lit(1)).alias("selected"), F.count(F.when(~failed, 1)).alias("run"), F.coalesce(F.sum(F.when(~failed, F.col("novelty"))), F.lit(0)).alias("discovered"), F.count(F.when(failed, 1)).alias("failed")
    )
