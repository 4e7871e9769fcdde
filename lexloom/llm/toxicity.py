"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models spell the words of a text, one learnt from texts marked
toxic and one from ordinary texts.  Each word's letters follow up to ``ORDER - 1`` earlier
letters of the word.  Contexts of up to ``SHARED`` letters are counted over both classes
together, so rare and unseen expressions fall back on the same shared counts and leave the
comparison unmoved, while frequent stems of one class keep their own continuations.

A text's margin is the difference of the two log-likelihoods divided by its number of
words.  A logistic curve over the margin and the length, fitted on labelled rows the models
have not seen, turns it into a score.

Bounds: at most ``rows_for_each_label`` rows of a label train the models and as many fit the
curve (those with the smallest hash of the identifier); each row that fits the curve stands
for its share of all such rows of its label, so the curve sees the same proportion of toxic
rows whether or not the bound is met.  Whole texts are used, very long ones too, and every row is scored.

Defined results: a null or empty text, or one without words, has margin 0; label rows with a null label or
identifier are not used; of repeated label rows the largest label counts; of document rows that repeat an
identifier with other texts the model learns from the one with the smallest hash, and all are scored one by one;
without rows of both labels every score is 0; an empty table gives an empty result; other columns are kept as
they are, but one named like the score is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, remembers, slices

ORDER = 5
SHARED = 1
ROWS_FOR_EACH_LABEL = 2000
WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words with a mark before and after each, and the place of each letter in its word."""
    joined = "\x02" + "\x03\x02".join(words) + "\x03"
    letters = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    begin = np.flatnonzero(letters == 2)
    sizes = np.diff(np.append(begin, len(letters)))
    return letters, np.arange(len(letters)) - np.repeat(begin, sizes)


def _contexts(letters: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The letters that have ``size`` letters before them in their word, and the hashes of those."""
    at = np.flatnonzero(place >= size) if size else np.flatnonzero(place >= 1)
    key = np.full(len(at), size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size, 0, -1):
            key = (key ^ letters[at - k]) * _MIX
            key ^= key >> np.uint64(29)
    return at, key


def _follow(key: np.ndarray, letters: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = (key ^ (letters + np.uint64(0x10FFFF))) * _MIX
        return out ^ (out >> np.uint64(31))


def _find(keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places in the sorted ``keys``; the last place (that of no key) where there is none."""
    at = np.searchsorted(keys, key)
    at[at == len(keys)] = 0
    return np.where(keys[at] == key, at, len(keys)) if len(keys) else np.zeros(len(key), np.int64)


def _level(letters, place, weight, size: int, top: bool) -> dict:
    """Kneser-Ney counts of one context size: occurrences at the top, distinct letters before it below."""
    at, context = _contexts(letters, place, size)
    gram = _follow(context, letters[at])
    if top:
        w = weight[at]
    else:  # continuation counts: each longer gram counts once; a gram that begins its word has nothing before it
        longer, key = _contexts(letters, place, size + 1)
        first = np.zeros(len(letters), np.int64)
        whole = _follow(key, letters[longer])
        _, one = np.unique(whole, return_index=True)
        first[longer[one]] = 1
        starts = at[place[at] == size]
        first[starts] = weight[starts]
        w = first[at]
    grams, back = np.unique(gram, return_inverse=True)
    counts = np.bincount(back, w, len(grams))
    contexts, which = np.unique(context, return_inverse=True)
    totals = np.bincount(which, w, len(contexts))
    owner = np.zeros(len(grams), np.int64)
    owner[back] = which
    n1, n2 = (counts == 1).sum(), (counts == 2).sum()
    discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
    kept = np.maximum(counts - discount, 0)
    spared = np.bincount(owner, counts - kept, len(contexts))
    good = np.maximum(totals, 1e-9)
    # the last entry is that of an unknown gram or context: nothing kept, all mass to the shorter context
    return {
        "grams": grams,
        "p": np.append(kept / good[owner], 0.0),
        "contexts": contexts,
        "back": np.append(np.where(totals > 0, spared / good, 1.0), 1.0),
    }


class Spelling:
    """An interpolated Kneser-Ney model of words by their letters for each class, over shared low orders."""

    def __init__(self, counts: list[Counter], order: int = ORDER, shared: int = SHARED):
        both = sum(counts, Counter())
        self.order, self.letters = order, max(2, len(set("".join(both))) + 2)
        self.classes = []
        levels = [self._learn(both, range(shared + 1), order)]
        for c in counts:
            self.classes.append(levels[0] + self._learn(c, range(shared + 1, order), order))

    @staticmethod
    def _learn(words: Counter, sizes: range, order: int) -> list[dict]:
        names = sorted(words)
        letters, place = _spelled(names)
        weight = np.repeat(np.array([words[x] for x in names], np.int64), [len(x) + 2 for x in names]) if names else np.zeros(len(letters), np.int64)
        return [_level(letters, place, weight, k, k == order - 1) for k in sizes]

    def log_odds(self, words: list[str]) -> np.ndarray:
        """log p(word | class 1) - log p(word | class 0) for each word."""
        if not words:
            return np.zeros(0)
        letters, place = _spelled(words)
        real = place >= 1
        total = np.zeros(len(letters))
        for sign, levels in ((1, self.classes[1]), (-1, self.classes[0])):
            p = np.full(len(letters), 1.0 / (self.letters + 1))
            for size, level in enumerate(levels):
                at, context = _contexts(letters, place, size)
                gram = _find(level["grams"], _follow(context, letters[at]))
                p[at] = level["p"][gram] + level["back"][_find(level["contexts"], context)] * p[at]
            total[real] += sign * np.log(p[real])
        return np.add.reduceat(total, np.flatnonzero(place == 0))


class Model:
    """The two models and the curve."""

    def __init__(self, spelling: Spelling | None):
        self.spelling = spelling
        self.curve = np.array([-30.0, 0.0, 0.0])
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Margin for each word, and the number of words, of each text."""
        split = [WORD.findall(x.lower()) if x else [] for x in texts]
        n = np.array([len(x) for x in split], np.int64)
        if self.spelling is None:
            return np.zeros(len(texts)), n
        remembers("toxicity", self.known.clear)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list({w for ws in split for w in ws}.difference(known))
        known.update(zip(new, self.spelling.log_odds(new).tolist(), strict=True))
        get = known.__getitem__
        total = np.array([sum(map(get, ws)) for ws in split])
        return total / np.maximum(n, 1), n

    def scores(self, texts: list[str | None]) -> np.ndarray:
        margin, n = self.margins(texts)
        z = features(margin, n) @ self.curve
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(margin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the curve sees: the margin for each word, and the same in units of its spread at that length."""
    return np.stack([np.ones(len(n)), margin, margin * np.sqrt(np.maximum(n, 1))], 1)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps, with a slight ridge.  weight: how many rows each row stands for."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = weight * p * (1 - p) + 1e-9
        step = np.linalg.solve((x * w[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - ridge * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """One row (id, label 0 or 1) for each labelled identifier."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    return known.groupBy("id").agg(F.max((F.col("label") > 0).cast("int")).alias("label"))


def bucket(id_col) -> F.Column:
    """crc32 of the identifier as text; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def train(
    docs: DataFrame,
    labels: DataFrame,
    use: F.Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows_for_each_label: int = ROWS_FOR_EACH_LABEL,
) -> Model:
    """Fit on labelled rows.  use: a condition on column ``id`` of the label rows that may be learnt from."""
    rows = labelled(labels, id_col, label_col)
    rows = (rows if use is None else rows.filter(use)).withColumn("tune", F.floor(bucket(F.col("id")) / 5) % 5 == 0)
    parts = [
        rows.filter((F.col("label") == label) & (F.col("tune") == tune)).orderBy(F.xxhash64("id"), "id").limit(rows_for_each_label)
        for label in (0, 1)
        for tune in (False, True)
    ]
    chosen = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    # at most 4 * rows_for_each_label identifiers, so small enough to send to every task
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = materialize(texts.join(F.broadcast(chosen), "id").groupBy("id", "label", "tune").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")).select("text", "label", "tune"), "labelled")
    counts = [Counter(), Counter()]
    for batch in _word_counts(found.filter(~F.col("tune"))).toArrow().to_batches():
        for label, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[label][word] = n
    if not counts[0] or not counts[1]:
        return Model(None)
    model = Model(Spelling(counts))
    del counts
    tune = _margins(found.filter("tune"), model).toArrow()
    margin, n, y = (tune[c].to_numpy() for c in ("margin", "n", "label"))
    order = np.lexsort((y, n, margin))  # rows in an order of their own, so that sums round alike each time
    if len(set(y.tolist())) == 2:
        known = {r["label"]: r["count"] for r in rows.filter("tune").groupBy("label").count().collect()}
        weight = np.array([known[label] / min(known[label], rows_for_each_label) for label in (0, 1)])
        model.curve = fit_curve(features(margin[order], n[order]), y[order], weight[y[order]])
    return model


def _word_counts(rows: DataFrame) -> DataFrame:
    """label, word, n of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(label, Counter()).update(WORD.findall((text or "").lower()))
        for label, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(c), pa.int32()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["label", "word", "n"])

    return rows.select("text", "label").mapInArrow(run, "label int, word string, n long").groupBy("label", "word").agg(F.sum("n").alias("n"))


def _margins(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin, n = shared.value.margins(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(margin), pa.array(n)], names=["label", "margin", "n"])

    return rows.select("text", "label").mapInArrow(run, "label int, margin double, n long")


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """Adds ``toxicity`` (0 to 1) to every row; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            at = batch.schema.names.index(text_col)
            for begin, end in slices(batch.column(at)):
                part = batch.slice(begin, end - begin)
                cols = {n: part.column(k) for k, n in enumerate(part.schema.names) if n != score_col}
                cols[score_col] = pa.array(model.scores(part.column(at).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    fields = [f for f in docs.schema.fields if f.name != score_col]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(score_col, T.DoubleType())]))
