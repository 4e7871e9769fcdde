"""Streaming forms of the work lanes: the batch operators under Structured Streaming."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..session import at as instant


def once(updates: DataFrame, key: str = "update_id", time: str = "at", horizon: str = "7 days") -> DataFrame:
    """Each update once within the horizon; state older than that is dropped."""
    return updates.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tokens and cost of tumbling hours; an hour is final when the watermark has passed it."""
    sums = events.withWatermark("at", late).groupBy(F.window("at", "1 hour")).agg(F.count(F.lit(1)).alias("events"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    return sums.select(F.col("window.start").alias("hour"), "events", "tokens", "cost")


def trailing_day(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Usage of the 24 hours before every full hour."""
    return events.withWatermark("at", late).groupBy(F.window("at", "24 hours", "1 hour"), "user_id").agg(F.count(F.lit(1)).alias("events"), F.sum("cost").alias("cost"))


def match_new(listings: DataFrame, profiles: DataFrame, match: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Matches of listings as they come in against a static registry of profiles."""
    return match(listings, profiles)


def in_time(listings: DataFrame, published: str, cutoff: Callable, known: DataFrame, *key: str) -> DataFrame:
    """Drop stale publications of listings not known yet.  An event-time filter, not a watermark."""
    marked = listings.join(known.select(*key).withColumn("__known", F.lit(True)), [*key], "left")
    return marked.filter(F.col("__known") | F.col(published).isNull() | cutoff(F.col(published))).drop("__known")


def lane(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, name: str, every: str | None = None) -> StreamingQuery:
    """One lane: ``step`` on every micro-batch, with its own checkpoint; without ``every`` it drains what there is and ends."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Leases(StatefulProcessor):
    """One lease for each key: granted to the first token, renewed by its holder, free again after its time.

    Input: key, token, at.  Output: key, token, at, granted.  Keys are handled one after another,
    so two askers never hold the same key.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "token string, until timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        asks = pd.concat(list(rows)).sort_values(["at", "token"], kind="stable")
        token, until = self.held.get() if self.held.exists() else (None, None)
        granted = []
        for ask in asks.itertuples():
            mine = token is None or token == ask.token or pd.Timestamp(until) <= ask.at
            if mine:
                token, until = ask.token, ask.at + dt.timedelta(seconds=self.seconds)
            granted.append(mine)
        if token is not None:
            self.held.update((token, pd.Timestamp(until).to_pydatetime()))
        yield pd.DataFrame({"key": [key[0]] * len(asks), "token": asks["token"].tolist(), "at": asks["at"].tolist(), "granted": granted})

    def close(self) -> None:
        pass


def leases(asks: DataFrame, seconds: int) -> DataFrame:
    """Needs a RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    return asks.groupBy("key").transformWithStateInPandas(Leases(seconds), "key string, token string, at timestamp, granted boolean", "append", "None")


def is_due(last: Column, now: dt.datetime, every: dt.timedelta) -> Column:
    """The same of a column of last runs."""
    return last.isNull() | (last <= instant(now - every))


def due(last: dt.datetime | None, now: dt.datetime, every: dt.timedelta) -> bool:
    """Whether a periodic job (a daily rebuild, an hourly cleanup) is due."""
    return last is None or now - last >= every
