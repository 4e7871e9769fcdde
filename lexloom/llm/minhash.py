"""Near-duplicate detection by BagMinHash signatures of weighted word shingles.

A text is the multiset of its shingles of five words (lower case, split at white space).
Every shingle carries Poisson processes over time on the weight axis: one for each dyadic
interval [0,1), [1,2), [2,4), ..., of a rate equal to the interval's length, whose points
fall by halving on its unit cells; a point counts for a text when its cell lies below the
shingle's weight there.  Each point belongs to one signature component, and a component is
the earliest point that counts.  Two texts agree in a component with a probability equal
to their weighted Jaccard similarity.  Points are made in order of time and only up to a
time by which all components are filled (later for the few texts where they are not), so
the work for a text is its length plus a constant.

Signatures are cut into bands; texts that agree in a band are candidates, and every link is
verified by the exact multiset overlap of whole texts.  Texts with equal words are one node.
A bucket's lead is the node that shares most buckets.  First each node is compared with the best
lead it meets, then with the lead of each of its buckets, last with the members of other classes
in its buckets that bounds on the overlap leave a chance; so groups of many copies cost a
comparison or a few for each member and no pair that could join two classes is left out.
Classes are the connected components of the verified links.

Defined results: null texts count as empty; texts without words are classes of their own;
texts of one to four words are one shingle; repeated rows belong to one class; a null
identifier is kept, and loses as representative against any other; empty tables give empty
results; columns other than identifier and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remembers, slices
from .graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 6
#: Words that a worker remembers with their hashes.
REMEMBERED = 300_000
#: Least share of equal components for two texts to be compared in the last step: a pair of similarity
#: 0.8 falls below it with a probability under 0.0005.
ALIKE = 0.7
_U = np.uint64
_BITS = 44


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the public splitmix64 step)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def weighted_shingles(split: list[list[str]], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle hash (44 bits) and weight of every distinct shingle of every text."""
    remembers("minhash", _HASHES.clear)
    get = _HASHES.__getitem__
    counts = np.array([len(x) for x in split], np.int64)
    hashes = np.array([get(w) for ws in split for w in ws], np.uint64)
    n = len(hashes)
    text = np.repeat(np.arange(len(split)), counts)
    with np.errstate(over="ignore"):
        value = np.zeros(n, np.uint64)
        left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words from here to the end of the text
        for k in range(size):
            part = _mix(np.append(hashes[k:], np.zeros(min(k, n), np.uint64)) + _U(k + 1))
            value = value * _U(0x9E3779B97F4A7C15) + np.where(left > k, part, _U(0))
    first = np.arange(n) == np.repeat(np.cumsum(counts) - counts, counts)
    good = (left >= size) | (first & (np.repeat(counts, counts) < size))
    key = np.sort((text[good].astype(np.uint64) << _U(_BITS)) | (_mix(value[good]) >> _U(64 - _BITS)))
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(begin, len(key)))
    key = key[begin]
    return (key >> _U(_BITS)).astype(np.int64), key & _U((1 << _BITS) - 1), weight


def bag_minhash(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """Signatures (n_texts x size, uint64) of weighted sets; rows of texts without shingles are 0."""
    out = np.zeros(n_texts * size, np.uint64)
    total = np.bincount(text, weight, n_texts)
    until = (math.log(size) + 5) / np.maximum(total, 1)
    # one process for each dyadic interval that begins below the weight: [0,1), [1,2), [2,4), ...
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    row = np.repeat(np.arange(len(text)), levels)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    length = np.maximum(low, 1)
    text, weight = text[row], weight[row]
    seed = _mix(shingle[row] * _U(64) + level.astype(np.uint64))
    todo = total > 0
    while todo.any():
        mine = np.flatnonzero(todo[text])
        best = np.full(n_texts * size, np.inf)
        t, s, k = np.zeros(len(mine)), seed[mine], 0
        while len(mine):
            k += 1
            with np.errstate(over="ignore"):
                s = s + _U(0x9E3779B97F4A7C15)
            draw = _mix(s)
            t = t - np.log1p(-((draw >> _U(11)).astype(np.float64) * 2.0**-53)) / (size * length[mine])
            live = t <= until[text[mine]]
            mine, t, s, draw = mine[live], t[live], s[live], draw[live]
            place = _mix(draw ^ _U(0xD6E8FEB86659FD93))
            component = ((place >> _U(32)) * _U(size) >> _U(32)).astype(np.int64)
            # the cell, reached by halving the interval as often as it has bits
            cell = low[mine] + ((place & _U(0xFFFFFFFF)).astype(np.int64) & (length[mine] - 1))
            counts = cell < weight[mine]
            slot, time, who = (text[mine] * size + component)[counts], t[counts], draw[counts]
            np.minimum.at(best, slot, time)
            won = best[slot] == time
            out[slot[won]] = who[won]
        filled = np.isfinite(best).reshape(n_texts, size).all(1)
        todo &= ~filled
        until = until * 2
    return out.reshape(n_texts, size)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One signed 64-bit key for each band."""
    rows = signature.shape[1] // bands
    key = np.zeros((len(signature), bands), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = _mix(key + signature[:, k::rows][:, :bands] + _U(k + 1))
    return key.astype(np.int64)


SIGNED = "doc_id long, text_hash long, digest binary, weight long, bands array<long>, sketch array<tinyint>"


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, digest of the words (null without words), number of shingles, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                part = batch.slice(a, b - a)
                split = [words(x) for x in part.column(2).to_pylist()]
                text, key, weight = weighted_shingles(split, shingle)
                signature = bag_minhash(text, key, weight, len(split), bands * rows)
                digest = [xxhash.xxh3_128_digest(" ".join(x)) if x else None for x in split]
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.arange(len(split) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                    for x in (band_keys(signature, bands), (signature >> _U(40)).astype(np.uint8).view(np.int8))
                ]
                cols = [part.column(0), part.column(1), pa.array(digest, pa.binary()), pa.array(np.bincount(text, weight, len(split)).astype(np.int64)), *lists]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "digest", "weight", "bands", "sketch"])

    return _read(docs, id_col, text_col).mapInArrow(run, SIGNED)


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Identifier, hash of the text and text; the first two name a row's text wherever it is read."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Multiset Jaccard of (sorted hashes, weights)."""
    (ha, wa), (hb, wb) = a, b
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    same = hb[at] == ha if len(hb) else np.zeros(len(ha), bool)
    shared = int(np.minimum(wa[same], wb[at[same]]).sum())
    total = int(wa.sum() + wb.sum()) - shared
    return shared / total if total else 0.0


def _bags(texts: list[str], shingle: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for at in range(0, len(texts), 200):
        split = [words(x) for x in texts[at : at + 200]]
        text, key, weight = weighted_shingles(split, shingle)
        cut = np.searchsorted(text, np.arange(len(split) + 1))
        out += [(key[a:b], weight[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts are similar enough.  texts: node, text."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                texts = [part.column(k).to_pylist() for k in (2, 3)]
                number = {x: k for k, x in enumerate(dict.fromkeys([*texts[0], *texts[1]]))}
                bags = _bags(list(number), shingle)
                good = [similarity(bags[number[x]], bags[number[y]]) >= threshold for x, y in zip(*texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _own(rows: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """node, own: the weight of its shingles that no other of the nodes in ``rows`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                text, key, weight = weighted_shingles([words(x) for x in part.column(1).to_pylist()], shingle)
                # the second copy of a shingle is a thing of its own, and so on
                copies = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                thing = _mix(np.repeat(key, weight) * _U(1 << 16) + copies.astype(np.uint64)).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(text, weight, part.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(thing))], names=["node", "things"])

    chosen = texts.join(rows.select("node").distinct(), "node", "left_semi").select("node", "text")
    things = chosen.mapInArrow(run, "node long, things array<long>").select("node", F.explode("things").alias("thing"))
    single = things.groupBy("thing").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    return single.groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def _chances(met: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """Pairs of different classes in a bucket that can still be similar enough.

    A text shares no more than its weight without what only it has; a link needs a share of
    threshold / (1 + threshold) of both weights; and the signatures must be nearly as alike.  A
    pair is looked at in the first bucket it shares only.
    """
    mixed = met.groupBy("band", "key").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x < y").select("band", "key")
    rest = materialize(met.join(mixed, ["band", "key"]).select("band", "key", "node", "weight", "class"), "mixed")
    own = _own(rest, texts, shingle)
    full = rest.join(own, "node", "left").join(nodes.select("node", "bands", "sketch"), "node")
    full = materialize(full.withColumn("room", F.col("weight") - F.coalesce("own", F.lit(0))).drop("own"), "mixed")
    other = full.select(*[F.col(c).alias(f"other_{c}") for c in ("band", "key", "node", "weight", "class", "room", "bands", "sketch")])
    need = threshold / (1 + threshold) * (F.col("weight") + F.col("other_weight"))
    equal = lambda x, y: F.zip_with(x, y, lambda a, b: a == b)
    chance = (
        (F.col("node") < F.col("other_node"))
        & (F.col("class") != F.col("other_class"))
        & (F.least("weight", "other_weight") >= threshold * F.greatest("weight", "other_weight"))
        & (F.least("room", "other_room") >= need)
        & (F.array_position(equal("bands", "other_bands"), True) == F.col("band") + 1)
        & (F.size(F.filter(equal("sketch", "other_sketch"), lambda x: x)) >= ALIKE * F.size("sketch"))
    )
    return full.join(other, (F.col("band") == F.col("other_band")) & (F.col("key") == F.col("other_key")) & chance).select(F.col("node").alias("a"), F.col("other_node").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    threshold: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    shingle: int = SHINGLE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each document: doc_id, class_id (smallest doc_id of the class), class_size, kept.

    One row of each class is kept: the one with the smallest doc_id.  The result also has
    text_hash, the hash that tells rows of one doc_id apart.
    """
    signed = materialize(signatures(docs, bands, rows, shingle, id_col, text_col), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    groups = signed.filter("digest IS NOT NULL").groupBy("digest").agg(first, *[F.any_value(c).alias(c) for c in ("weight", "bands", "sketch")])
    nodes = materialize(groups.select(F.monotonically_increasing_id().alias("node"), "digest", "first", "weight", "bands", "sketch"), "nodes")
    places = nodes.select("node", "weight", F.posexplode("bands").alias("band", "key"))
    crowded = places.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = materialize(places.join(crowded, ["band", "key"]), "buckets")
    # a bucket's lead is its node with the most company: the one most like a common original
    company = met.groupBy("node").agg((-F.sum("n")).alias("company"))
    ranked = met.drop("n").join(company, "node")
    leads = ranked.groupBy("band", "key").agg(F.min(F.struct("company", "node")).alias("lead"))
    met = materialize(ranked.drop("company").join(leads, ["band", "key"]), "led")

    needed = met.select("node").distinct().join(nodes, "node").select("node", "first.doc_id", "first.text_hash")
    source = _read(docs, id_col, text_col)
    same = source["doc_id"].eqNullSafe(needed["doc_id"]) & (source["text_hash"] == needed["text_hash"])
    texts = source.join(needed, same).select(needed["node"], source["text"])
    texts = materialize(texts.groupBy("node").agg(F.any_value("text").alias("text")), "texts")

    def paired(rows: DataFrame, x: str, y: str) -> DataFrame:
        return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()

    # first the best lead that a node meets in any bucket
    best = met.filter("lead.node != node").groupBy("node").agg(F.min("lead").alias("lead"))
    known = materialize(paired(best, "node", "lead.node"), "pairs")
    links = materialize(verified(known, texts, threshold, shingle), "links")

    # then the lead of every bucket, where it is of another class yet
    def with_class(rows: DataFrame, node: str, label: str, classes: DataFrame) -> DataFrame:
        named = classes.select(F.col("node").alias("__node"), F.col("component").alias(label))
        return rows.join(named, rows[node] == F.col("__node"), "left").drop("__node").withColumn(label, F.coalesce(label, node))

    classes = components(links)
    here = with_class(with_class(met.select("node", F.col("lead.node").alias("lead")).distinct(), "node", "class", classes), "lead", "lead_class", classes)
    new = materialize(paired(here.filter("class != lead_class"), "node", "lead").join(known, ["a", "b"], "left_anti"), "pairs")
    known = known.union(new)
    links = links.union(materialize(verified(new, texts, threshold, shingle), "links"))

    # last the members of other classes in each bucket, as far as bounds leave them a chance
    new = materialize(_chances(with_class(met, "node", "class", components(links)), nodes, texts, threshold, shingle).join(known, ["a", "b"], "left_anti"), "pairs")
    links = links.union(materialize(verified(new, texts, threshold, shingle), "links"))
    classes = components(links)
    named = nodes.join(classes, "node", "left").select("digest", "first", F.coalesce("component", "node").alias("class"))
    heads = named.groupBy("class").agg(F.min("first").alias("head"))
    owner = materialize(named.join(heads, "class").select("digest", "class", "head"), "owners")
    # copies are counted by digest first, so a class of any size is summed from few rows
    sizes = signed.groupBy("digest").count().join(owner, "digest").groupBy("class").agg(F.sum("count").alias("class_size"))
    owner = owner.join(sizes, "class").select("digest", "head", "class_size")
    placed = signed.drop("bands", "sketch").join(owner, "digest", "left")
    own = F.col("head").isNull()
    return placed.select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        (own | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash")))).alias("kept"),
        "text_hash",
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; repeated rows that are kept stay once."""
    kept = materialize(near_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter("kept"), "kept")
    text_hash = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keys = kept.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    out = docs.withColumn("__text_hash", text_hash)
    out = out.join(keys, out[id_col].eqNullSafe(keys["__id"]) & (out["__text_hash"] == keys["__hash"]), "left_semi")
    if kept.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count():
        out = out.dropDuplicates([id_col, "__text_hash"])
    return out.drop("__text_hash")
