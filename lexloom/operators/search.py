"""Full-text search over token arrays with the usual web syntax: words, "phrases", or, -not."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

_PART = re.compile(r'(-)?(?:"([^"]*)"|(\S+))')
_WORD = re.compile(r"[^\W_]+")


def parse(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of conjunctions of (negated, words that stand together)."""
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for m in _PART.finditer(query.lower()):
        if m[3] == "or" and not m[1]:
            if out[-1]:
                out.append([])
            continue
        found = _WORD.findall(m[2] if m[2] is not None else m[3])
        if found:
            out[-1].append((bool(m[1]), found))
    return [x for x in out if x]


def matches(tokens: Column, query: str) -> Column:
    """Whether a document's words answer the query; an empty query answers nothing."""
    any_of = F.lit(False)
    for terms in parse(query):
        all_of = F.lit(True)
        for negated, found in terms:
            here = F.array_contains(tokens, found[0]) if len(found) == 1 else t.contains_sequence(tokens, t.strings(found))
            all_of = all_of & (~here if negated else here)
        any_of = any_of | all_of
    return any_of


def frequency(tokens: Column, query: str) -> Column:
    """How many words of the document the query names: our rank, as none is prescribed."""
    wanted = sorted({w for terms in parse(query) for negated, found in terms if not negated for w in found})
    return F.size(F.filter(tokens, lambda x: x.isin(wanted) if wanted else F.lit(False)))


def search(docs: DataFrame, query: str, k: int, *order: Column | str) -> DataFrame:
    """The k best documents by frequency, then ``order`` (which ends in a unique key).  docs: tokens, ..."""
    hits = docs.filter(matches(F.col("tokens"), query)).withColumn("rank", frequency(F.col("tokens"), query))
    return hits.orderBy(F.desc("rank"), *order).limit(k)


# --- ranked search over a positional index

#: Fixed values of the usual rank: weight of an unlabelled word, the limit of the sum of 1 / n ** 2, positions of a word that count, and the last place that is told.
WEIGHT, LIMIT, POSITIONS, LAST_PLACE = 0.1, 1.64493406685, 255, 16383


def positional_index(docs: DataFrame) -> DataFrame:
    """token, id, places (from 1, rising): one row for each word of each document.  docs: id, tokens.

    Words are gathered inside the rows of documents, so none travels.  Sorted by token inside its partitions, so that a table of it is read for the words of a query alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = np.asarray(part.column(1).value_lengths().fill_null(0), np.int64)
                coded = part.column(1).flatten().dictionary_encode()
                code = np.asarray(coded.indices.fill_null(-1), np.int64)
                row = np.repeat(np.arange(len(counts)), counts)
                place = np.arange(len(code)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
                order = np.lexsort((place, row, code))
                order = order[code[order] >= 0]
                row, code = row[order], code[order]
                first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])), part.column(0).take(pa.array(row[first])), places], names=["token", "id", "places"])

    return docs.select("id", "tokens").mapInArrow(run, f"token string, id {dict(docs.dtypes)['id']}, places array<int>").sortWithinPartitions("token")


def _told(places: Column) -> Column:
    """The places that a rank looks at."""
    return F.slice(F.array_distinct(F.transform(places, lambda p: F.least(p, F.lit(LAST_PLACE)))), 1, POSITIONS)


def _phrase(places: dict[str, Column], found: list[str]) -> Column:
    """Whether the words stand one after another somewhere."""
    here = F.lit(True)
    for word in dict.fromkeys(found):
        here = here & (F.size(places[word]) > 0)
    if len(found) > 1:
        follows = lambda p: F.forall(F.array(*[F.array_contains(places[w], p + k) for k, w in enumerate(found)]), lambda x: x)
        here = here & F.exists(places[found[0]], follows)
    return here


def _single_rank(places: dict[str, Column]) -> Column:
    """Each word adds its weight times the sum of 1 / n ** 2 over its occurrences; the mean over all words of the query."""
    total = F.lit(0.0)
    for x in places.values():
        n = F.size(_told(x))
        squares = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda sum_, k: sum_ + 1.0 / (k * k))
        total = total + F.when(n > 0, squares * WEIGHT / LIMIT).otherwise(0.0)
    return total / len(places)


def _pair_rank(places: dict[str, Column]) -> Column:
    """One less the product of what each pair of places of two words leaves: near pairs leave little; a hair above 0 without a pair."""
    words = list(places)
    near = lambda d: F.when(d > 100, 1e-30).otherwise(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
    left, pairs = F.lit(1.0), F.lit(False)
    for k, a in enumerate(words):
        for b in words[:k]:
            x, y = _told(places[a]), _told(places[b])
            one = lambda p, other: F.aggregate(other, F.lit(1.0), lambda rest, q: rest * F.when(p != q, 1.0 - F.sqrt(WEIGHT * WEIGHT * near(F.abs(p - q)))).otherwise(1.0))
            left = left * _over(x, y, one)
            pairs = pairs | ((F.size(x) > 0) & (F.size(y) > 0))
    return F.when(pairs, 1.0 - left).otherwise(1e-20)


def _over(x: Column, y: Column, one) -> Column:
    return F.aggregate(x, F.lit(1.0), lambda rest, p: rest * one(p, y))


def rank(places: dict[str, Column], query: str) -> Column:
    """The rank of a document; places: of every word that the query names, those it excludes too."""
    alternatives = parse(query)
    joined = len(alternatives) == 1 and (len(alternatives[0]) > 1 or len(alternatives[0][0][1]) > 1)
    return _pair_rank(places) if joined and len(places) > 1 else _single_rank(places)


def ranked(index: DataFrame, ids: DataFrame, query: str, k: int, *order: Column | str, digits: int | None = None) -> DataFrame:
    """The k best of ``ids`` (id, ...) by rank, then ``order``, which ends in a unique key.

    Ranks that agree in ``digits`` decimals are equal ranks, and ``order`` decides between them.

    The index is read for the words of the query only; documents without any of them are looked at only
    where an alternative of the query excludes words and asks for none.
    """
    alternatives = parse(query)
    words = sorted({w for terms in alternatives for _, found in terms for w in found})
    if not words:
        return ids.withColumn("rank", F.lit(0.0)).limit(0)
    # rows of one identifier are one document
    each = index.filter(F.col("token").isin(words)).repartition("id").groupBy("token", "id").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    hits = each.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", "places"))).alias("__places"))
    bare = any(all(negated for negated, _ in terms) for terms in alternatives)
    rows = ids.join(hits, "id", "left" if bare else "inner")
    none = F.array().cast("array<int>")
    places = {w: F.coalesce(F.col("__places")[w], none) for w in words}
    any_of = F.lit(False)
    for terms in alternatives:
        all_of = F.lit(True)
        for negated, found in terms:
            all_of = all_of & (~_phrase(places, found) if negated else _phrase(places, found))
        any_of = any_of | all_of
    score = rank(places, query)
    return rows.filter(any_of).withColumn("rank", score if digits is None else F.round(score, digits)).drop("__places").orderBy(F.desc("rank"), *order).limit(k)
