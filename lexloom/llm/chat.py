"""Chat formatting by event-sourced reconstruction.

A log row is an event of a conversation: ``message`` opens a message with a role and a first
text, ``delta`` appends streamed text to a message, ``edit`` replaces its text, and
``regenerate`` empties it and drops the messages that were opened after it and before the
event.  Events are folded in the order of their sequence numbers.  The fold is associative
(a piece of the log either replaces or extends what came before), so it runs over bounded
runs of events first and then over the results; a long message or conversation is never
folded event by event in one task.

The template marks turns with control strings.  Control strings inside roles and texts (also
those of other common templates) are escaped by replacing their first letter, and ``&`` before
the name of an escape is escaped too, so the text comes back unchanged.

Defined results: null texts and roles count as empty; a null kind is a message; events that
name no opened message are ignored; events of equal sequence number go by kind, role and
text; null sequence numbers come first; a null conv_id is a conversation of its own; an empty
log gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of common chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<|eot_id|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>"]
ESCAPES = {"&": "&amp;", "<": "&lt;", "[": "&lsqb;", "\n": "&#10;"}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Events or turns that are put together in one step.
RUN = 256

_TO_ESCAPE = re.compile("&(?=(?:" + "|".join(re.escape(x[1:]) for x in ESCAPES.values()) + "))|" + "|".join(f"{re.escape(x[0])}(?={re.escape(x[1:])})" for x in CONTROL))
_ESCAPED = re.compile("|".join(map(re.escape, ESCAPES.values())))
_PLAIN = {v: k for k, v in ESCAPES.items()}
_TURN = re.compile(re.escape(OPEN) + "([^\n]*)\n(.*?)" + re.escape(CLOSE), re.DOTALL)


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[0]], text)


def as_events(turns: DataFrame) -> DataFrame:
    """A log in which every row (conv_id, turn, role, text) opens a message of its own."""
    message = F.monotonically_increasing_id()
    return turns.select("conv_id", F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), message.alias("message"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, seq (of the opening event), message, role, text.

    events: conv_id, seq, kind, message (the number of the message it opens or changes), role, text.
    """
    kind = F.coalesce("kind", F.lit("message"))
    log = events.select(
        "conv_id",
        "message",
        F.col("seq").cast("long").alias("seq"),
        kind.alias("kind"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.when(kind == "regenerate", F.lit("")).otherwise(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )
    # within a sequence number a message opens first, then what replaces its text, then what extends it
    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "delta", 2).otherwise(1)
    event = F.struct("seq", rank.alias("rank"), "kind", "role", "text", (F.col("kind") != "delta").alias("replaces"))
    part = F.floor(F.coalesce("seq", F.lit(-1)) / RUN).alias("part")

    def folded(column):
        """(replaces, text) of a sorted list of such pairs; texts are joined once, from the last replacing one on."""
        last = F.aggregate(F.sequence(F.lit(0), F.size(column) - 1), F.lit(0), lambda at, k: F.when(column[k]["replaces"], k).otherwise(at))
        return F.struct(
            F.exists(column, lambda x: x["replaces"]).alias("replaces"),
            F.array_join(F.transform(F.slice(column, last + 1, F.size(column)), lambda x: x["text"]), "").alias("text"),
        )

    opened = F.col("kind") == "message"
    runs = log.groupBy("conv_id", "message", part).agg(
        F.sort_array(F.collect_list(event)).alias("events"),
        F.min(F.when(opened, F.struct("seq", "role"))).alias("opened"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
    )
    runs = runs.withColumn("piece", folded(F.col("events"))).drop("events")
    whole = runs.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(F.struct("part", F.col("piece.replaces").alias("replaces"), F.col("piece.text").alias("text")))).alias("pieces"),
        F.min("opened").alias("opened"),
        F.max("again").alias("again"),
    )
    messages = whole.filter("opened IS NOT NULL").select(
        "conv_id", F.col("opened.seq").alias("seq"), "message", F.col("opened.role").alias("role"), folded(F.col("pieces"))["text"].alias("text"), "again"
    )
    # a message goes when one opened before it was regenerated after it: running maxima, over runs and then inside them
    run = F.floor(F.coalesce("seq", F.lit(-1)) / RUN)
    placed = messages.withColumn("run", run)
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    all_runs = placed.groupBy("conv_id", "run").agg(F.max("again").alias("again"))
    earlier = all_runs.withColumn("earlier", F.max("again").over(before)).filter("earlier IS NOT NULL").select(F.col("conv_id").alias("c"), F.col("run").alias("r"), "earlier")
    inside = Window.partitionBy("conv_id", "run").orderBy(F.coalesce("seq", F.lit(-1))).rangeBetween(Window.unboundedPreceding, -1)
    seen = placed.withColumn("near", F.max("again").over(inside)).join(earlier, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")), "left")
    gone = F.greatest("near", "earlier") > F.coalesce("seq", F.lit(-1))
    return seen.filter(~F.coalesce(gone, F.lit(False))).select("conv_id", "seq", "message", "role", "text")


FORMATTED = "conv_id long, formatted string, loss_spans array<struct<start:long,length:long>>"


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans: the text of each conversation and the spans (in code points) learnt from."""
    turn = F.struct("seq", "role", "text", "message")
    part = F.floor(F.coalesce("seq", F.lit(-1)) / RUN).alias("part")
    runs = messages.groupBy("conv_id", part).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "turns"))).alias("runs"))
    whole = whole.select(F.col("conv_id").cast("long").alias("conv_id"), F.flatten(F.transform("runs", lambda x: F.transform(x["turns"], lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                texts, spans = [], []
                for turns in part.column(1).to_pylist():
                    out, mine, at = [], [], 0
                    for turn in turns:
                        body = escape(turn["text"])
                        head = f"{OPEN}{escape(turn['role']).replace('\n', ESCAPES['\n'])}\n"
                        if turn["role"] in learn:
                            mine.append({"start": at + len(head), "length": len(body)})
                        out += [head, body, CLOSE]
                        at += len(head) + len(body) + len(CLOSE)
                    texts.append("".join(out))
                    spans.append(mine)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], names=["conv_id", "formatted", "loss_spans"])

    return whole.mapInArrow(run, FORMATTED)


def format_chats(events: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Fold a log and render each conversation."""
    return render(fold(events), learn)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                learnt = "".join(unescape(text[x["start"] : x["start"] + x["length"]]) for x in spans)
                out.append((len(turns), sha("".join(f"{role}\n{said}\n" for role, said in turns)), len(learnt), sha(learnt), len(text)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _extra() -> str:
    """SQL for the letters that escaping adds to ``text``."""
    each = {x: len(ESCAPES[x[0]]) - 1 for x in CONTROL} | {x: len(ESCAPES["&"]) - 1 for x in ESCAPES.values()}
    return " + ".join(f"{n} * (len(text) - len(replace(text, '{x}', ''))) // {len(x)}" for x, n in each.items())


ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (SELECT *, {len(OPEN) + 1 + len(CLOSE)} + len(role) + len(text) + {_extra()} AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
