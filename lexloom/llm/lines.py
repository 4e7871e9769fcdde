"""Removal of repeated lines and passages by winnowing over line hashes.

Lines come in two kinds.  The lines of a text, as its breaks end them, are hashed each: a window of
one line, so that every line that repeats an earlier one is found, short ones too.  Breaks fall
differently in copies of a passage, so there are moving lines as well: the ``LINE`` words that begin
at a word.  Of every ``RUN - LINE + 1`` neighbouring moving lines the smallest hash (the rightmost of
equals) is a fingerprint, so each passage of ``RUN`` words or more holds one in all its copies.

Equal texts are settled first, and the others numbered by doc_id.  Hashes of both kinds are joined with their earliest
position over all documents.  A line that repeats one is deleted; a moving line is extended
word by word both ways, and a run of ``RUN`` words or more is deleted from the later place.  A copy may
share more with another place than with the earliest.  Both then leave the earliest place at the same
distance from the line and with the same word, so each end of a run is a key, which carries the hashes of
the ``RUN``-word windows around the line that stick out there; where a key repeats, the windows are joined
with their earliest places in turn.  So no place is compared with all others, and just those words go that lie in
a line met before, or in a window of ``RUN`` words met before.

Hashes and sources that hold a large share of all rows (at most ``HOT`` of them can) are joined apart:
the few hot hashes are broadcast, the texts of hot sources are dealt to several tasks.

Defined results: words are what ASCII white space separates, compared as they are (by 64-bit
hashes); a line is what line feeds and carriage returns separate, compared by its words, and one without
words is never deleted; null texts count as empty; texts without a repeated line or run come back
unchanged (null as empty); rows that repeat identifier and text are one document and are cut alike; a
null identifier counts as the latest; what repeats inside one document is cut as well, overlapping
passages too; very long texts are read whole, each by one task; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

RUN = 50
LINE = 24
LATEST = (1 << 63) - 1
#: A key with more than one in so many rows is hot, so that there are no more than so many of them.
HOT = 1000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_FACTOR = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the factor and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_FACTOR, pow(_FACTOR, -1, 1 << 64))):
            x = np.full(max(n, 1 << 20), base, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.cumprod(x)
    return _POWERS


def _spans(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, one after another, begins and ends of all words there, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(coded), np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begins, ends = edges[::2], edges[1::2]
    return data, begins, ends, np.diff(np.searchsorted(begins, np.cumsum([len(x) + 1 for x in coded])), prepend=0)


def hashed_words(texts: list[str], lines: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Hashes of all words of the texts, the number of words of each text, and (if asked for) the words that begin a line.

    A word's hash is that of its bytes as a polynomial, read off prefix sums over all texts at once.
    """
    data, begins, ends, counts = _spans([x.encode() for x in texts])
    hashes = _polynomials(data, begins, ends) if len(begins) else np.zeros(0, np.uint64)
    if not lines:
        return hashes, counts, None
    # the first word of all, and the first one after each break; breaks are far fewer than words
    first = np.searchsorted(begins, np.append(0, np.flatnonzero((data == 10) | (data == 13))))
    return hashes, counts, first[(np.diff(first, prepend=-1) != 0) & (first < len(begins))]


def _polynomials(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range of values, which depends on its length too."""
    powers, inverse = _powers(len(values))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)  # worked out in place, as tables of all bytes are large
        np.add(values, _U(1), out=sums[1:], dtype=np.uint64)
        sums[1:] *= powers[: len(values)]
        np.cumsum(sums, out=sums)
        return _mix((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    return hashed_words([text])[0]


def line_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that begin at each word which has so many: a polynomial, by doubling."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, covered, part, span, power = np.zeros(n, np.uint64), 0, words, 1, _FACTOR
    bits, mask = size, (1 << 64) - 1
    with np.errstate(over="ignore"):
        while bits:
            if bits & 1:
                out = out * _U(power) + part[covered : covered + n]
                covered += span
            bits >>= 1
            if bits:
                part = part[:-span] * _U(power) + part[span:]
                span, power = span * 2, power * power & mask
    return _mix(out)


def fingerprints(hashes: np.ndarray, window: int, limit: np.ndarray) -> np.ndarray:
    """Places of the smallest hash of every window; limit: for each place, the end of its text's places."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    place = np.arange(n)
    low = (1 << 20) - 1
    key = (hashes & _U(~low & (1 << 64) - 1)) | (low - (place & low)).astype(np.uint64)
    none = _U((1 << 64) - 1)
    # smallest key of the next 1, 2, 4, ... places of the same text; windows at a text's end are shorter
    best, span = key.copy(), 1

    def ahead(x, by):
        out = np.append(x[by:], np.full(min(by, n), none))
        return np.where(place + by < limit, out, none)

    while span * 2 <= window:
        best = np.minimum(best, ahead(best, span))
        span *= 2
    best = np.minimum(best, ahead(best, window - span))
    # a window's smallest key names its place: the same low bits, at or after the window's begin
    at = place + ((low - (best & _U(low)).astype(np.int64) - place) & low)
    return at[np.diff(at, prepend=-1) != 0]  # places only rise


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LATEST)).alias("doc"), F.xxhash64(text).alias("text_hash"), F.crc32(text.cast("binary")).alias("check"), text.alias("text"))


#: A place, the words of its line (0: a moving one) and whether its hash is new in the document, in one number.
PLACE_BITS = 31


def _fingerprints(read: DataFrame, run_words: int, line: int) -> DataFrame:
    """One row for each document: doc, text_hash, check, number of words, hashes, and their packed places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in slices(batch.column(3)):
                part = batch.slice(first, end - first)
                words, counts, starts = hashed_words(part.column(3).to_pylist(), lines=True)
                ends = np.cumsum(counts)
                begins = ends - counts
                text = np.repeat(np.arange(len(counts)), counts)
                # the lines of the texts
                stops = np.append(starts[1:], len(words))[: len(starts)]
                whole = ~_polynomials(words, starts, stops) if len(starts) else words
                # moving lines: places whose line fits into the text; a text of fewer words than a run holds none
                hashes = line_hashes(words, line)
                last = np.where(counts >= run_words, ends - line + 1, begins)[text[: len(hashes)]]
                good = np.flatnonzero(np.arange(len(hashes)) < last)
                limit = np.cumsum(np.bincount(text[good], minlength=len(counts)))[text[good]]
                at = fingerprints(hashes[good], run_words - line + 1, limit)
                place = np.concatenate([good[at], starts])
                order = np.argsort(place, kind="stable")  # so by text, and by place inside it
                place, found = place[order], np.concatenate([hashes[good][at], whole])[order]
                size = np.concatenate([np.zeros(len(at), np.int64), stops - starts])[order]
                own = text[place] if len(place) else place
                _, one = np.unique(_mix(found + own.astype(np.uint64) * _U(_FACTOR)), return_index=True)
                new = np.zeros(len(place), np.int64)
                new[one] = 1
                offsets = pa.array(np.searchsorted(own, np.arange(len(counts) + 1)).astype(np.int32))
                packed = (size << PLACE_BITS | (place - begins[own])) << 1 | new
                cols = [*(part.column(k) for k in range(3)), pa.array(counts), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (found.astype(np.int64), packed))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc", "text_hash", "check", "words", "hashes", "places"])

    return read.mapInArrow(run, "doc long, text_hash long, check long, words long, hashes array<long>, places array<long>")


def matching_run(a: np.ndarray, b: np.ndarray, p: int, q: int) -> tuple[int, int]:
    """Begin and end in ``a`` of the longest run around a[p] == b[q]."""

    def steps(x: np.ndarray, y: np.ndarray) -> int:
        done, size = 0, 64
        n = min(len(x), len(y))
        while done < n:
            same = x[done : min(n, done + size)] == y[done : min(n, done + size)]
            if not same.all():
                return done + int(np.argmin(same))
            done, size = done + len(same), size * 4
        return n

    return p - steps(a[:p][::-1], b[:q][::-1]), p + steps(a[p:], b[q:])


def matching_runs(a: np.ndarray, b: np.ndarray, places: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end in ``a`` of the longest run around each a[place] == b[other]."""
    begins, ends = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
    shift = places - others
    for d in np.unique(shift).tolist():
        mine = np.flatnonzero(shift == d)
        if len(mine) < 3:
            for k in mine.tolist():
                begins[k], ends[k] = matching_run(a, b, int(places[k]), int(others[k]))
            continue
        low, high = max(0, d), min(len(a), len(b) + d)
        breaks = np.flatnonzero(a[low:high] != b[low - d : high - d]) + low
        breaks = np.concatenate([[low - 1], breaks, [high]])
        after = np.searchsorted(breaks, places[mine])
        begins[mine], ends[mine] = breaks[after - 1] + 1, breaks[after]
    return begins, ends


def merged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as ranges that do not touch."""
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], begins[1:] > reach[:-1]])) if len(begins) else np.zeros(0, np.int64)
    return begins[new], reach[np.append(new[1:] - 1, len(reach) - 1)] if len(new) else reach


def _dealt(pairs: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs and source texts with a column ``deal``: a hot source's text comes several times, its pairs are spread over them."""
    each = pairs.groupBy("source").count()
    limit = max((each.agg(F.sum("count")).first()[0] or 0) / HOT, 1)
    deals = F.broadcast(each.filter(F.col("count") > limit).select("source", F.ceil(F.col("count") / F.lit(limit)).cast("int").alias("deals")))
    spread = F.pmod(F.xxhash64("num"), F.coalesce("deals", F.lit(1)))
    pairs = pairs.join(deals, "source", "left").withColumn("deal", spread.cast("int")).drop("deals")
    theirs = texts.select(F.col("num").alias("source"), F.col("text").alias("theirs")).join(deals, "source", "left")
    return pairs, theirs.withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))).drop("deals")


def _ragged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after another, and where each range begins and ends there."""
    sizes = np.maximum(high - low, 0)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(edges[-1]) + np.repeat(low - edges[:-1], sizes), edges


def sticking_out(words: np.ndarray, ends: np.ndarray, places: np.ndarray, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, floor: np.ndarray, run_words: int, line: int):
    """Windows around the lines at ``places`` that are not inside [begin, end): for each end of a run its key and its windows' begins.

    words: of several texts one after another; floor, ends: begin and end of each place's text there.  Returns
    (numbers of the places, keys, begins, edges of each key's begins).
    """
    first, last = np.maximum(floor, places - (run_words - line)), np.minimum(places, ends - run_words)
    rows, keys, low, high = [], [], [], []
    for side, edge, a, b, word in ((1, places - begin, first, np.minimum(last, begin - 1), begin - 1), (2, end - places, np.maximum(np.maximum(first, begin), end - run_words + 1), last, end)):
        some = np.flatnonzero((a <= b) & (word >= floor) & (word < ends))
        with np.errstate(over="ignore"):
            key = _mix(hashes[some].astype(np.uint64) * _U(_FACTOR) + edge[some].astype(np.uint64) * _U(4) + _U(side)) + words[word[some]]
        rows.append(some)
        keys.append(_mix(key))
        low.append(a[some])
        high.append(b[some] + 1)
    starts, edges = _ragged(np.concatenate(low), np.concatenate(high))
    return np.concatenate(rows), np.concatenate(keys), starts, edges


def _extended(pairs: DataFrame, texts: DataFrame, run_words: int, line: int) -> DataFrame:
    """Rows of two kinds: a run that repeats (begin, end), and an end of a run with its key and the windows (begins, hashes) that stick out there.

    A source's text stands before the rows that are compared with it, and is sent to a task once.
    """
    pairs, theirs = _dealt(pairs, texts)
    mine = pairs.join(texts.hint("shuffle_hash"), "num").select("source", "deal", "num", "places", "text")
    ahead = theirs.select("source", "deal", F.lit(None).cast("long").alias("num"), F.lit(None).cast(dict(mine.dtypes)["places"]).alias("places"), F.col("theirs").alias("text"))
    both = mine.union(ahead).repartition("source", "deal").sortWithinPartitions("source", "deal", F.col("num").isNotNull()).select("num", "places", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = np.zeros(0, np.uint64)
        for batch in batches:
            for a, b in slices(batch.column(2)):
                part = batch.slice(a, b - a)
                inner = part.column(1).flatten()
                places, others, hashes = (np.asarray(inner.field(k)).astype(np.int64) for k in range(3))
                counts = np.asarray(pc.fill_null(part.column(1).value_lengths(), 0)).astype(np.int64)
                edges = np.concatenate([[0], np.cumsum(counts)])
                words, sizes, _ = hashed_words(part.column(2).to_pylist())
                ends = np.cumsum(sizes)
                floor = ends - sizes
                known = np.asarray(part.column(0).is_valid())
                begin, end = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
                rows, begins, stops = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for k in range(part.num_rows):
                    text = words[floor[k] : ends[k]]
                    if not known[k]:
                        source = text.copy()
                        continue
                    at = slice(edges[k], edges[k + 1])
                    begin[at], end[at] = matching_runs(text, source, places[at], others[at])
                    long = end[at] - begin[at] >= run_words
                    x, y = merged(begin[at][long], end[at][long])
                    rows.append(np.full(len(x), k))
                    begins.append(x)
                    stops.append(y)
                base, of = np.repeat(floor, counts), np.repeat(np.arange(len(counts)), counts)
                which, keys, starts, cuts = sticking_out(words, base + np.repeat(sizes, counts), places + base, hashes, begin + base, end + base, base, run_words, line)
                # windows are hashed where they stick out, not at all words
                found = _polynomials(words, starts, starts + run_words).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
                starts = starts - np.repeat(base[which], np.diff(cuts))
                row = np.concatenate([*rows, of[which]])
                if not len(row):
                    continue
                runs = len(row) - len(which)
                is_key = np.arange(len(row)) >= runs
                fill = lambda x, kind, back, n=len(row) - runs, m=runs: np.concatenate([x, np.zeros(n)] if back else [np.zeros(m), x]).astype(kind)
                offsets = pa.array(np.concatenate([np.zeros(runs, np.int64), cuts]).astype(np.int32))
                key = np.concatenate([np.zeros(runs, np.int64), keys.astype(np.int64)])
                cols = [part.column(0).take(pa.array(row)), pa.array(fill(np.concatenate(begins), np.int32, True), mask=is_key), pa.array(fill(np.concatenate(stops), np.int32, True), mask=is_key), pa.array(key, mask=~is_key)]
                cols += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (starts.astype(np.int32), found)]
                yield pa.RecordBatch.from_arrays(cols, names=["num", "begin", "end", "key", "places", "hashes"])

    return both.mapInArrow(run, "num long, begin int, end int, key long, places array<int>, hashes array<long>")


def _where_met(rows: DataFrame, repeated: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with the keys that repeat (n: how often).

    Hot keys, a bounded number, are known to every task: their rows are dealt to several tasks, and the key comes to each of these.
    """
    limit = max((repeated.agg(F.sum("n")).first()[0] or 0) / HOT, 1)
    deals = F.broadcast(repeated.filter(F.col("n") > limit).select(key, F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("deals")))
    dealt = rows.join(deals, key, "left").withColumn("deal", F.pmod(F.xxhash64("num"), F.coalesce("deals", F.lit(1))).cast("int")).drop("deals")
    copies = F.when(F.col("n") > limit, F.ceil(F.col("n") / F.lit(limit))).otherwise(1).cast("int")
    return dealt.join(repeated.withColumn("deal", F.explode(F.sequence(F.lit(0), copies - 1))).drop("n"), [key, "deal"]).drop("deal")


def _later(each: DataFrame, source: Column, place: Column, tag: str) -> DataFrame:
    """All places of a hash but its earliest, which they name: source, source_place (aggregates).  each: num, hash, place, ..."""
    repeated = materialize(each.groupBy("hash").agg(source.alias("source"), place.alias("source_place"), F.count(F.lit(1)).alias("n")).filter("n > 1"), tag)
    return _where_met(each, repeated, "hash").filter("num != source OR place != source_place")


def repeated_runs(docs: DataFrame, run_words: int = RUN, line: int = LINE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, text_hash and the runs of words (array of begin, end) that repeat an earlier line or passage."""
    read = _read(docs, id_col, text_col)
    prints = materialize(_fingerprints(read, run_words, line), "fingerprints")
    # equal texts are settled first: the earliest stands for all, the others repeat it as a whole
    equal = ["text_hash", "check", "words"]
    keys = prints.filter("words > 0").select("doc", *equal)
    first = keys.groupBy(*equal).agg(F.min("doc").alias("doc"))
    # numbers rise with doc_id: ranges are sorted, and so are the rows of each
    first = materialize(first.orderBy("doc", *equal).withColumn("num", F.monotonically_increasing_id()), "numbers")
    copies = keys.join(first, [*equal, "doc"], "left_anti").select("doc", "text_hash", F.lit(0).alias("begin"), F.col("words").cast("int").alias("end"))
    held = prints.join(first.hint("shuffle_hash"), [*equal, "doc"]).select("num", "hashes", "places")
    repeated_rows = bool(prints.groupBy("doc", "text_hash").count().filter("count > 1").limit(1).count())
    if repeated_rows:
        held = held.dropDuplicates(["num"])
    x = F.col("x")
    exploded = held.select("num", F.explode(F.arrays_zip("hashes", "places")).alias("x"))
    packed = F.shiftrightunsigned(x["places"], 1)
    each = exploded.select("num", x["hashes"].alias("hash"), packed.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("place"), F.shiftrightunsigned(packed, PLACE_BITS).cast("int").alias("size"), F.when(x["places"].bitwiseAND(F.lit(1)) == 1, F.col("num")).alias("order"))
    later = materialize(_later(each, F.min("order"), F.min_by("place", "order"), "repeated").drop("order"), "later")
    whole = later.filter("size > 0").select("num", F.col("place").alias("begin"), (F.col("place") + F.col("size")).alias("end"))
    moving = later.filter("size = 0")
    pairs = moving.groupBy("num", "source").agg(F.collect_list(F.struct("place", "source_place", "hash")).alias("places"))
    needed = moving.select("num").union(moving.select("source")).distinct().join(first, "num").select("num", "doc", "text_hash")
    # the keys are hashed, so that whole texts are not sorted; only repeated rows make a key come twice
    texts = read.join(needed.hint("shuffle_hash"), ["doc", "text_hash"]).select("num", "text")
    texts = materialize(texts.dropDuplicates(["num"]) if repeated_rows else texts, "texts")
    runs = materialize(_extended(materialize(pairs, "pairs"), texts, run_words, line), "runs")
    ends = runs.filter("key IS NOT NULL").select("num", "key", "places", "hashes")
    ends = _where_met(ends, materialize(ends.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "ends"), "key")
    windows = ends.select("num", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select("num", x["hashes"].alias("hash"), x["places"].alias("place")).distinct()
    earliest = F.min(F.struct("num", "place"))
    windows = _later(materialize(windows, "windows"), earliest["num"], earliest["place"], "repeated").select("num", F.col("place").alias("begin"), (F.col("place") + run_words).alias("end"))
    found = runs.filter("key IS NULL").select("num", "begin", "end").union(whole).union(windows)
    found = found.join(first, "num").select("doc", "text_hash", "begin", "end").union(copies)
    return found.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("runs"))


def cut(texts: list[str], edges: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[tuple[str, int, int]]:
    """Each text without the words of its runs (those from edges[k] to edges[k + 1]), the number of these words, and that of the runs."""
    coded = [x.encode() for x in texts]
    _, first, last, counts = _spans(coded)
    offset = np.cumsum([0, *(len(x) + 1 for x in coded)]).tolist()
    word = np.cumsum([0, *counts.tolist()]).tolist()
    out = []
    for k, data in enumerate(coded):
        a, b = merged(begins[edges[k] : edges[k + 1]], ends[edges[k] : edges[k + 1]])
        w, n = word[k], word[k + 1] - word[k]
        if len(a) == 1 and a[0] == 0 and b[0] == n:  # all of it
            out.append((data[: int(first[w]) - offset[k]].decode().rstrip() if n else texts[k], n, 1))
            continue
        parts, at = [], 0
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            begin = int(first[w + x]) - offset[k]
            parts.append(data[at:begin])
            at = int(first[w + y]) - offset[k] if y < n else len(data)
            # a line that the run ended stays ended
            if x and b"\n" in data[int(last[w + y - 1]) - offset[k] : at] and b"\n" not in data[int(last[w + x - 1]) - offset[k] : begin]:
                parts.append(b"\n")
        parts.append(data[at:])
        left = b"".join(parts).decode()
        out.append((left.rstrip() if len(b) and b[-1] == n else left, int((b - a).sum()), len(a)))
    return out


def drop_repeated_lines(docs: DataFrame, run_words: int = RUN, line: int = LINE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (without later repeats), removed_words, removed_runs of every document."""
    runs = materialize(repeated_runs(docs, run_words, line, id_col, text_col), "cuts")
    joined = _read(docs, id_col, text_col).join(runs.hint("shuffle_hash"), ["doc", "text_hash"], "left").select("doc", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in slices(batch.column(1)):
                part = batch.slice(first, end - first)
                edges = np.concatenate([[0], np.cumsum(np.asarray(part.column(2).value_lengths()))])
                begins, ends = (np.asarray(part.column(2).flatten().field(k)).astype(np.int64) for k in (0, 1))
                done = cut(part.column(1).to_pylist(), edges, begins, ends)
                texts, words, number = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(words, pa.int64()), pa.array(number, pa.int64())], names=["doc", "text", "removed_words", "removed_runs"])

    whole = joined.filter("runs IS NULL").select("doc", "text", F.lit(0).cast("long").alias("removed_words"), F.lit(0).cast("long").alias("removed_runs"))
    less = joined.filter("runs IS NOT NULL").mapInArrow(run, "doc long, text string, removed_words long, removed_runs long")
    return whole.union(less).select(F.when(F.col("doc") != LATEST, F.col("doc")).alias("doc_id"), "text", "removed_words", "removed_runs")
