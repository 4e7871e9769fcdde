"""Quality rules by compression bands.

A text is compressed as a whole, and in fixed chunks, with zstandard.  The ratio of compressed to
plain bytes is low for text that repeats itself or draws on few words, and high for random text; it
also falls with length.  So limits are specific to bands of length, an octave of bytes each: inside a band
the ratio is fitted as a line over the logarithm of the length, and what is left is counted in bins over
all different texts that pass the plain rules.  The lower limit lies ``LOW`` times the distance
from the median to the lower fifth below the median, the upper one ``HIGH`` times the distance to the upper fifth above it; both keep
a least distance that narrows with the root of the length, as the noise of ratios does.  Chunks, whole ones of
``CHUNK`` bytes only, are judged by their median ratio under limits of their own.  Outside ``EXTREMES`` a
text of ``SHORTEST`` bytes or more is rejected in any corpus.

The statistics are counts of bins in a bounded number of bands: sums that tasks make before the
exchange, alike at every size, and exact.  Copies count once, so that a text that a third of all rows repeat
moves no limit.

Defined results: words are what ASCII white space separates; null texts count as empty, and fail the plain rules like all
texts of fewer than ``WORDS`` words; a band of one length or one text has the least distances around what it
holds; rows that repeat an identifier are judged each; very long texts are read whole, each by one
task; an empty table gives an empty result; other columns are kept by ``keep_good`` and not read by ``assess``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, remembers, slices

WORDS, REPEATED = 50, 50
CHUNK = 2048
LEVEL = 3
LOW, HIGH = 2.5, 5.0
#: Least distance of a limit from the median: these, over the root of the band's least length in bytes.
NEAR, FAR = 0.4, 2.0
EXTREMES = (0.08, 0.97)
SHORTEST = 512
#: Octaves of length that have limits of their own; shorter and longer texts belong to the outer ones.
BANDS = (8, 15)
#: Width of a bin of the ratio.
BIN = 0.0005
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def repeated_words(numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, its words in a window of three that stands in it twice or more; numbers: the words of all texts, one after another."""
    n = len(counts)
    text = np.repeat(np.arange(n), counts)
    ends = np.cumsum(counts)[text] if len(text) else text
    begins = np.flatnonzero(np.arange(len(text)) + 2 < ends)
    if not len(begins):
        return np.zeros(n, np.int64)
    width = int(numbers.max()) + 1
    # numbered step by step, so that no two different windows of a text share a number
    first = np.unique(text[begins] * width + numbers[begins], return_inverse=True)[1]
    second = np.unique(first * width + numbers[begins + 1], return_inverse=True)[1]
    _, window, held = np.unique(second * width + numbers[begins + 2], return_inverse=True, return_counts=True)
    again = begins[held[window] > 1]
    inside = np.zeros(len(text), bool)
    for step in range(3):
        inside[again + step] = True
    return np.bincount(text[inside], minlength=n)


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


_COMPRESSORS: dict[int, zstandard.ZstdCompressor] = {}


def ratio(data: bytes, level: int = LEVEL) -> float:
    if level not in _COMPRESSORS:
        _COMPRESSORS[level] = zstandard.ZstdCompressor(level=level)
    return len(_COMPRESSORS[level].compress(data)) / len(data) if data else 1.0


def chunk_ratio(data: bytes, chunk: int = CHUNK, level: int = LEVEL) -> float | None:
    """Median ratio of the whole chunks of a text; none if it holds none."""
    found = [ratio(data[k : k + chunk], level) for k in range(0, len(data) - chunk + 1, chunk)]
    return float(np.median(found)) if found else None


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, level: int = LEVEL) -> DataFrame:
    """One row for each document: doc_id, the plain counts, digest of the text, bytes, ratio, chunk_ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembers("quality", _COMPRESSORS.clear)
        for batch in batches:
            for begin, end in slices(batch.column(2)):
                part = batch.slice(begin, end - begin)
                texts = part.column(2).to_pylist()
                numbers, found = _Numbers(), []
                rows = {x: [] for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_bytes", "ratio", "chunk_ratio")}
                for text in texts:
                    words, data = WORD.findall(text), text.encode()
                    found.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                    row = len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), _dup_lines(text), len(data), ratio(data, level), chunk_ratio(data, chunk, level)
                    for held, x in zip(rows.values(), row, strict=True):
                        held.append(x)
                repeats = repeated_words(np.concatenate(found), np.array(rows["n_words"], np.int64))
                cols = [part.column(0), part.column(1), *(pa.array(x, pa.float64() if "ratio" in name else pa.int64()) for name, x in rows.items()), pa.array(repeats, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "digest", *rows, "n_repeat_words"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    out = read.mapInArrow(run, f"doc_id {kind}, digest long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_bytes long, ratio double, chunk_ratio double, n_repeat_words long")
    failed = (F.col("n_words") < WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def band() -> Column:
    """The octave of a text's length."""
    return F.greatest(F.lit(BANDS[0]), F.least(F.lit(BANDS[1]), F.floor(F.log2(F.greatest(F.col("n_bytes"), F.lit(1)))).cast("int")))


@dataclass(frozen=True)
class Limits:
    """For a measure and a band: the line over log2 of the length, and how far below and above it a ratio may lie."""

    slope: float
    base: float
    low: float
    high: float


def _fits(measured: DataFrame, name: str) -> dict[int, tuple[float, float]]:
    """Slope and base of each band's line; a band of one length has a level one."""
    x, y = F.log2("n_bytes"), F.col(name)
    rows = measured.groupBy("band").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("base"), F.avg(y).alias("level")).collect()
    return {r["band"]: (r["slope"], r["base"]) if r["slope"] is not None and np.isfinite(r["slope"]) else (0.0, r["level"]) for r in rows}


def _residual(name: str, lines: dict[int, tuple[float, float]]) -> Column:
    """What a band's line leaves of a measure; at most as many branches as there are bands."""
    out = F.lit(None).cast("double")
    for b, (slope, base) in sorted(lines.items()):
        out = F.when(F.col("band") == b, F.col(name) - F.lit(slope) * F.log2("n_bytes") - F.lit(base)).otherwise(out)
    return out


def limits_of(bins: list[tuple[int, int]], least_bytes: int, low: float = LOW, high: float = HIGH) -> tuple[float, float]:
    """Lower and upper limit of what the line leaves, from counts by bin."""
    bins = sorted(bins)
    sums = np.cumsum([n for _, n in bins])
    fifth, middle, last_fifth = (bins[int(np.searchsorted(sums, q * sums[-1]))][0] * BIN for q in (0.2, 0.5, 0.8))
    root = least_bytes**0.5
    return middle - max(low * (middle - fifth), NEAR / root), middle + max(high * (last_fifth - middle), FAR / root)


def learn(measured: DataFrame, low: float = LOW, high: float = HIGH) -> dict[str, dict[int, Limits]]:
    """Limits of both measures by band, from all different texts that pass the plain rules.

    What comes to the driver are counts of bins: bands times bins at most, whatever the input.
    """
    good = measured.filter(~F.col("base_failed")).withColumn("band", band()).groupBy("digest", "n_bytes", "band").agg(F.first("ratio").alias("ratio"), F.first("chunk_ratio").alias("chunk_ratio"))
    good, out = materialize(good, "different"), {}
    for name in ("ratio", "chunk_ratio"):
        some = good.filter(F.col(name).isNotNull())
        lines = _fits(some, name)
        counted = some.groupBy("band", F.floor(_residual(name, lines) / BIN).cast("long").alias("bin")).count().collect()
        bins: dict[int, list[tuple[int, int]]] = {}
        for r in counted:
            bins.setdefault(r["band"], []).append((r["bin"], r["count"]))
        out[name] = {b: Limits(*lines[b], *limits_of(x, 1 << b, low, high)) for b, x in bins.items()}
    return out


def within(limits: dict[str, dict[int, Limits]]) -> Column:
    """Whether a measured text lies inside all limits of its band; a band that nothing was learnt of has only the extremes."""
    size = F.greatest(F.col("n_bytes"), F.lit(1))
    ok = (F.col("n_bytes") < SHORTEST) | F.col("ratio").between(*EXTREMES)
    for name, of in limits.items():
        for b, x in sorted(of.items()):
            left = F.col(name) - F.lit(x.slope) * F.log2(size) - F.lit(x.base)
            ok &= (band() != b) | F.coalesce(left.between(x.low, x.high), F.lit(True))
    return ok


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH, chunk: int = CHUNK, level: int = LEVEL) -> DataFrame:
    """doc_id, the plain counts, base_failed, kept, and the measures, of every row."""
    measured = materialize(measure(docs, id_col, text_col, chunk, level), "measured")
    kept = ~F.col("base_failed") & within(learn(measured, low, high))
    return measured.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "n_bytes", "ratio", "chunk_ratio")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    measured = materialize(measure(docs, id_col, text_col), "measured")
    kept = measured.filter(~F.col("base_failed") & within(learn(measured, **options))).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("n_bytes").alias("__bytes"))
    same = F.col("__id").eqNullSafe(docs[id_col]) & (F.col("__digest") == F.xxhash64(text)) & (F.col("__bytes") == F.octet_length(text))
    return docs.join(kept, same, "left_semi")
