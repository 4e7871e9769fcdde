"""Budgeted scoring by an injected model: batches, validated answers, saved results, delivery."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as j
from . import lifecycle, queues

# The largest score of each dimension; they add up to 100.
DIMENSIONS = {"skills": 40, "seniority": 20, "responsibilities": 15, "domain": 10, "locationWorkFormat": 10, "compensation": 5}
HARD_LIMIT = 49


def explored(score: Column, threshold: int, probability: float, key: Column) -> Column:
    """Whether a score below the threshold is let through: a draw that depends on the key alone, so it never changes."""
    draw = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("double") / (1 << 32)
    return (score < threshold) & (draw < probability)


def valid_score(total: Column, dimensions: dict[str, Column], blockers: Column, hard: Column) -> Column:
    """Dimensions in their ranges that add up to the total, and blockers exactly when a low total is a hard rejection."""
    ok = total.between(0, 100)
    added = F.lit(0)
    for name, most in DIMENSIONS.items():
        ok = ok & dimensions[name].between(0, most)
        added = added + dimensions[name]
    rejection = F.when(hard, (total <= HARD_LIMIT) & (blockers > 0)).otherwise(blockers == 0)
    return F.coalesce(ok & (added == total) & rejection, F.lit(False))


def covered(asked: DataFrame, answered: DataFrame, batch: str, key: str) -> DataFrame:
    """batch, exact: whether a batch's answers are one for each asked key, without others."""
    both = asked.select(batch, key).withColumn("a", F.lit(1)).unionByName(answered.select(batch, key).withColumn("a", F.lit(0)))
    each = both.groupBy(batch, key).agg(F.sum("a").alias("asked"), F.sum(1 - F.col("a")).alias("answered"))
    return each.groupBy(batch).agg(F.every((F.col("asked") == 1) & (F.col("answered") == 1)).alias("exact"))


def scored(requests: DataFrame, model: Callable[[str], str | None], attempts: int = 3, check: Callable[[str], bool] = lambda x: True) -> DataFrame:
    """Ask a model for each row's prompt: id, answer (JSON text), tries.

    The model is a plain function, so tests and queries inject one without randomness.  A
    wrong answer is asked again with a note; after the last try the answer is null.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, prompt in zip(frame["id"], frame["prompt"], strict=True):
                answer, tries = None, 0
                while answer is None and tries < attempts:
                    found = j.find_json(model(prompt if not tries else f"{prompt}\nThe last answer was not valid."))
                    answer = found if found is not None and check(found) else None
                    tries += 1
                rows.append((key, answer, tries))
            yield pd.DataFrame(rows, columns=["id", "answer", "tries"])

    return requests.select("id", "prompt").mapInPandas(run, f"id {dict(requests.dtypes)['id']}, answer string, tries int")


def score_pending(matches: DataFrame, users: DataFrame, model: Callable[[str], str | None], prompt: Column, now: dt.datetime, per_user: int, size: int) -> tuple[DataFrame, DataFrame]:
    """One pass: the best queued rows of each user, in batches, scored and saved.  Returns new matches and the batch report."""
    mine = matches.filter("state = 'queued'").join(users.select("user_id"), "user_id", "left_semi")
    order = (F.desc_nulls_last(F.coalesce("prescore", "lexical")), "matched_at", "id")
    chosen = queues.batches(mine, 1, "user_id", *order).filter(F.col("batch") < per_user).withColumn("batch", F.floor(F.col("batch") / size))
    answers = scored(chosen.select("id", prompt.alias("prompt")), model).withColumn("value", F.get_json_object("answer", "$.total").cast("double"))
    done = answers.filter("value IS NOT NULL")
    report = chosen.join(answers.select("id", "value"), "id", "left").groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("asked"), F.count("value").alias("scored"))
    return lifecycle.save_scores(matches, done.select("id", "value"), "score", now, "scored"), report


def delivered(queue: DataFrame, send: Callable[[dict], bool], most: int = 30) -> DataFrame:
    """The first rows of each user's queue (user_id, id, score) with ``sent``: in order until a refusal, which defers the rest.

    Users are dealt over tasks and a user's rows go out one after another.  A task that is run again sends again, so
    a sender has to know an alert by its id, as transports with idempotency keys do.
    """
    chosen = queues.batches(queue, 1, "user_id", F.desc("score"), "id").filter(F.col("batch") < most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, open_, begun = None, True, False
        for batch in batches:
            sent = []
            for row in batch.to_pylist():
                if not begun or row["user_id"] != user:
                    user, open_, begun = row["user_id"], True, True
                open_ = open_ and bool(send(row))
                sent.append(open_)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sent, pa.bool_())], names=["user_id", "id", "sent"])

    kinds = dict(queue.dtypes)
    rows = chosen.select("user_id", "id", "score", "batch").repartition("user_id").sortWithinPartitions("user_id", "batch")
    return rows.mapInArrow(run, f"user_id {kinds['user_id']}, id {kinds['id']}, sent boolean")
