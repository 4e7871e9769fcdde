"""Work queues, top-k reads and pages.  Every order ends in a unique key."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import at as instant
from ..session import cut_lineage


def first(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """Top k (planned as a per-partition top k and one merge)."""
    return rows.orderBy(*order).limit(k)


def scoring_queue(matches: DataFrame, users: DataFrame, k: int, now: dt.datetime, wait: dt.timedelta = dt.timedelta(hours=6)) -> DataFrame:
    """Matched rows of the users, best evidence first; touched rows only after a while."""
    ready = (F.col("updated_at") == F.col("matched_at")) | (F.col("updated_at") <= instant(now - wait))
    mine = matches.filter((F.col("state") == "matched") & ready).join(users.select("user_id"), "user_id", "left_semi")
    return first(mine.withColumn("evidence", F.coalesce("prescore", "lexical")), k, F.desc_nulls_last("evidence"), "matched_at", "id")


def prescoring_queue(matches: DataFrame, k: int) -> DataFrame:
    return first(matches.filter((F.col("state") == "matched") & F.col("prescore").isNull()), k, F.desc_nulls_last("lexical"), "matched_at", "id")


def alert_queue(matches: DataFrame, minimum: float, k: int = 30) -> DataFrame:
    return first(matches.filter((F.col("score") >= minimum) & F.col("delivered_at").isNull()), k, F.desc_nulls_last("score"), "id")


def digest_window(matches: DataFrame, low: float, high: float, since: dt.datetime | None, until: dt.datetime) -> DataFrame:
    """Scores in [low, high) that appeared in (since, until]; no ``since`` means from the beginning."""
    inside = (F.col("score") >= low) & (F.col("score") < high) & (F.col("scored_at") <= instant(until))
    if since is not None:
        inside = inside & (F.col("scored_at") > instant(since))
    return matches.filter(inside)


def page_of(total: Column, asked: Column, size: int) -> Column:
    """Page number clamped to what exists, with the number of pages (one at least) and what lies around."""
    pages = F.greatest(F.lit(1), F.ceil(total / size).cast("int"))
    page = F.least(F.greatest(asked, F.lit(0)), pages - 1)
    return F.struct(page.alias("page"), pages.alias("pages"), (page > 0).alias("has_previous"), (page < pages - 1).alias("has_next"))


def snapshot_page(snapshot: DataFrame, items: DataFrame, page: int, size: int) -> DataFrame:
    """Items of one page of a stored list of ids, in the list's order.  snapshot: one row with ``ids``."""
    places = snapshot.select(F.posexplode(F.slice("ids", page * size + 1, size)).alias("place", "id"))
    return items.join(F.broadcast(places), "id").withColumn("place", F.col("place") + F.lit(page * size))


def users_page(users: DataFrame, ranks: dict[str, int], offset: int, limit: int) -> DataFrame:
    """Owner first, then by status, age and identifier."""
    rank = F.lit(len(ranks))
    for status, k in ranks.items():
        rank = F.when(F.col("status") == status, k).otherwise(rank)
    return users.orderBy(F.desc("is_owner"), rank, "created_at", "user_id").offset(offset).limit(min(limit, 100))


def fair(rows: DataFrame, source: str, per_source: int, k: int, *order: Column | str) -> DataFrame:
    """At most ``per_source`` rows of a source, then the first k overall; groups are limited before the shuffle."""
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy(source).orderBy(*order)))
    return first(ranked.filter(F.col("nth") <= per_source), k, *order)


def batches(rows: DataFrame, size: int, key: str, *order: Column | str) -> DataFrame:
    """Batch number of each row among those of its key."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size).cast("int"))


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Rows numbered from 0 in order, without one task for all: sorted by ranges, and numbered inside each range.

    The counts of the ranges, one row each, are all that is summed in one place.  The lineage is cut, so that the
    ranges do not change when a later stage is run again.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id())
    dealt = cut_lineage(dealt).withColumn("__range", F.shiftright("__row", 33))
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("first"))
    before = F.sum("n").over(Window.orderBy("__range")) - F.col("n")
    begins = counts.select("__range", (before - F.col("first")).alias("__offset"))
    return dealt.join(begins, "__range").withColumn(name, F.col("__row") + F.col("__offset")).drop("__row", "__range", "__offset")


def prefix_matches(codes: DataFrame, column: str, prefix: str, limit: int = 2) -> DataFrame:
    """Up to ``limit`` codes with a prefix; two of them mean it is ambiguous."""
    return codes.filter(F.col(column).startswith(prefix)).orderBy(column).limit(limit)


def shortest_prefixes(codes: DataFrame, column: str) -> DataFrame:
    """The shortest prefix of each code that no other code has; the whole code where there is none."""
    each = codes.select(F.col(column).alias("code"), F.explode(F.sequence(F.lit(1), F.length(column))).alias("size"))
    each = each.select("code", "size", F.col("code").substr(F.lit(1), F.col("size")).alias("prefix"))
    alone = each.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("code"), F.min("size").alias("size")).filter("n = 1")
    best = alone.groupBy("code").agg(F.min("size").alias("size"))
    return codes.select(F.col(column).alias("code")).join(best, "code", "left").select("code", F.coalesce(F.col("code").substr(F.lit(1), F.col("size")), "code").alias("prefix"))


def code_or_null(text: Column) -> Column:
    """A typed code: trimmed, lower case, one to six letters, else null."""
    code = F.lower(F.trim(text))
    return F.when(code.rlike("^[a-z]{1,6}$"), code)


def letters_code(number: Column, size: int = 6) -> Column:
    """A code of ``size`` letters for a number, without collisions below 26 ** size."""
    letter = lambda k: F.char(F.lit(97) + F.pmod(F.floor(number / F.lit(26**k)), F.lit(26)).cast("int"))
    return F.concat(*[letter(k) for k in reversed(range(size))])
