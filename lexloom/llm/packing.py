"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are encoded and cut into pieces of at most ``capacity`` tokens (only longer ones
are cut; their first piece takes the rest, all others are full).  Full pieces are sequences
of their own.  The others are dealt at random into blocks of about ``block_items``, and each
block is packed by several islands.  An island holds a small population of packings; a
crossover injects well-filled bins of one parent whole into a copy of another, removes the
bins that hold a second copy of an injected piece, and puts the displaced pieces back: first one or two
of them change places with one or two of a bin that they fill better, which leaves smaller pieces over, then
best fit places the rest, longest first.  Between epochs each island sends its best packing to the next one
of its block.  A packing with as few bins as the sum of lengths allows ends the search.

Rows of work are island states, so memory is bounded by the block size and all blocks run
apart.  Seeds are fixed, so results depend on the rows and on how these are partitioned: pieces are
numbered as they are read, and the numbers deal them into blocks.

Defined results: a null text counts as empty and is the end token alone; a null identifier
is kept; rows that repeat an identifier are packed each on its own; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import Table, materialize, slices

CAPACITY = 2048
BLOCK_ITEMS = 8192
ISLANDS = 3
EPOCHS = 2
POPULATION = 4
GENERATIONS = 12
#: Displaced items whose pairs are tried too, and bins that a crossover tries to fill better.
PAIRED, LOOKED_AT = 48, 400
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe.tokenizer_text(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = bpe.loaded(shared.value)
        for batch in batches:
            for a, b in slices(batch.column(1), bpe.SLICE):
                part = batch.slice(a, b - a)
                ids, counts = encoder.encode(part.column(1).to_pylist())
                ends = np.cumsum(counts)
                whole = np.insert(ids.astype("<i4"), ends, end_id)  # the end token after each document
                counts = counts + 1
                cuts = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), cuts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                short = counts - (cuts - 1) * capacity
                start = np.where(piece == 0, 0, short[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, short[doc], capacity)
                begin = (np.cumsum(counts) - counts)[doc] + start
                data = memoryview(whole.tobytes())
                crc = [zlib.crc32(data[4 * x : 4 * (x + n)]) for x, n in zip(begin.tolist(), length.tolist(), strict=True)]
                cols = [part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    offsets = np.append(begin, len(whole)).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole, pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


class BestFit:
    """Bins of a fixed capacity; the fullest one with room for an item is found through a bit for each slack."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_slack: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def add(self, number: int, slack: int) -> None:
        if slack > 0:
            self.by_slack[slack].append(number)
            self.open |= 1 << slack

    def place(self, length: int) -> tuple[int, int]:
        """The bin (-1: none has room) and its slack before the item."""
        above = self.open >> length
        if not above:
            return -1, 0
        slack = length + (above & -above).bit_length() - 1
        numbers = self.by_slack[slack]
        number = numbers.pop()
        if not numbers:
            self.open &= ~(1 << slack)
        return number, slack


def best_fit(lengths: list[int], items: list[int], assigned: np.ndarray, fill: list[int], capacity: int) -> np.ndarray:
    """Put ``items`` in the given order into the bins with ``fill``, opening new ones as needed; returns the new fill."""
    bins = BestFit(capacity)
    for k, x in enumerate(fill):
        bins.add(k, capacity - x)
    fill = list(fill)
    for i in items:
        n = lengths[i]
        k, slack = bins.place(n)
        if k < 0:
            k, slack = len(fill), capacity
            fill.append(0)
        fill[k] += n
        assigned[i] = k
        bins.add(k, slack - n)
    return np.array(fill, np.int64)


class Packing:
    """A way to pack a block: the bin of each item, and the fill of each bin."""

    def __init__(self, assigned: np.ndarray, lengths: np.ndarray, capacity: int):
        self.assigned = assigned
        self.fill = np.bincount(assigned, lengths, int(assigned.max()) + 1 if len(assigned) else 0).astype(np.int64)
        # fewer bins first, then bins as unevenly filled as can be
        self.fitness = (-len(self.fill), float(((self.fill / capacity) ** 2).sum()))


def first_packings(lengths: np.ndarray, capacity: int, n: int, rng: np.random.Generator) -> list[Packing]:
    """Best fit over the items by falling length, then by lengths blurred at random."""
    out, plain = [], lengths.tolist()
    for k in range(n):
        order = np.argsort(-lengths * (1 + 0.15 * rng.random(len(lengths)) * (k > 0)), kind="stable")
        assigned = np.zeros(len(lengths), np.int32)
        best_fit(plain, order.tolist(), assigned, [], capacity)
        out.append(Packing(assigned, lengths, capacity))
    return out


def exchange(bins: dict[int, list[int]], fill: list[int], displaced: list[int], lengths: list[int], assigned: np.ndarray, capacity: int) -> list[int]:
    """Displaced items change places with one or two items of a bin where that fills it better; returns those left over.

    Of all such changes of a bin the one that leaves least room is made; bins are looked at once each.
    """
    left = sorted(displaced, key=lengths.__getitem__)
    sizes = [lengths[i] for i in left]
    pairs = sorted((sizes[a] + sizes[b], a, b) for a in range(len(left)) for b in range(a)) if len(left) <= PAIRED else []
    sums = [x[0] for x in pairs]
    for number, items in bins.items():
        room = capacity - fill[number]
        if not room or not left:
            continue
        best, change = 0, None
        for out in itertools.chain(((i,) for i in items), itertools.combinations(items, 2)):
            gone = sum(lengths[i] for i in out)
            at = bisect.bisect_right(sizes, gone + room) - 1
            if at >= 0 and sizes[at] - gone > best:
                best, change = sizes[at] - gone, (out, (at,))
            at = bisect.bisect_right(sums, gone + room) - 1
            if at >= 0 and sums[at] - gone > best:
                best, change = sums[at] - gone, (out, pairs[at][1:])
            if best == room:
                break
        if change:
            out, places = change
            come = [left[k] for k in places]
            left = sorted([*(i for k, i in enumerate(left) if k not in places), *out], key=lengths.__getitem__)
            sizes = [lengths[i] for i in left]
            pairs = sorted((sizes[a] + sizes[b], a, b) for a in range(len(left)) for b in range(a)) if len(left) <= PAIRED else []
            sums = [x[0] for x in pairs]
            for i in come:
                assigned[i] = number
            fill[number] += best
    return left


def crossover(into: Packing, of: Packing, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """Inject well-filled bins of one packing into the other; displaced items go back by best fit."""
    full = np.argsort(-of.fill, kind="stable")[: max(1, len(of.fill) // 2)]
    chosen = np.zeros(len(of.fill), bool)
    # many bins mix the parents, few leave so few items over that exchanges can place them
    chosen[rng.choice(full, max(1, int(len(full) * rng.uniform(0.02, 0.5) ** 2)), replace=False)] = True
    injected = chosen[of.assigned]
    gone = np.zeros(len(into.fill), bool)
    gone[into.assigned[injected]] = True
    # as a mutation, some of the emptiest bins are opened too
    emptiest = np.argsort(into.fill, kind="stable")[: max(2, len(into.fill) // 50)]
    gone[rng.choice(emptiest, min(len(emptiest), 1 + int(rng.integers(3))), replace=False)] = True
    displaced = np.flatnonzero(gone[into.assigned] & ~injected)
    kept = np.flatnonzero(~gone)
    number = np.full(len(into.fill), -1)
    number[kept] = np.arange(len(kept))
    assigned = number[into.assigned].astype(np.int32)
    taken = np.flatnonzero(chosen)
    number = np.full(len(of.fill), -1)
    number[taken] = len(kept) + np.arange(len(taken))
    assigned[injected] = number[of.assigned[injected]]
    fill = np.concatenate([into.fill[kept], of.fill[taken]]).tolist()
    sizes, bins = lengths.tolist(), {}
    open_ = np.flatnonzero(np.array(fill) < capacity)
    open_ = rng.choice(open_, min(len(open_), LOOKED_AT), replace=False) if len(open_) else open_
    of = np.where(np.isin(assigned, open_) & ~np.isin(np.arange(len(assigned)), displaced), assigned, -1)
    for i in np.flatnonzero(of >= 0).tolist():
        bins.setdefault(int(of[i]), []).append(i)
    left = exchange(bins, fill, displaced.tolist(), sizes, assigned, capacity)
    best_fit(sizes, left[::-1], assigned, fill, capacity)
    return Packing(assigned, lengths, capacity)


def evolve(population: list[Packing], lengths: np.ndarray, capacity: int, generations: int, rng: np.random.Generator) -> list[Packing]:
    """Generations of crossovers; each child takes the place of the worst packing it beats."""
    least = -(-int(lengths.sum()) // capacity)
    for _ in range(generations):
        population.sort(key=lambda x: x.fitness, reverse=True)
        if len(population[0].fill) <= least or len(population) < 2:
            break
        a, b = rng.choice(len(population), 2, replace=False)
        child = crossover(population[min(a, b)], population[max(a, b)], lengths, capacity, rng)
        if child.fitness > population[-1].fitness and all(child.fitness != x.fitness for x in population):
            population[-1] = child
    population.sort(key=lambda x: x.fitness, reverse=True)
    return population


STATE = "block int, island int, lengths binary, items binary, packings array<binary>"


def _islands(blocks: DataFrame, capacity: int, population: int, generations: int, epoch: int) -> DataFrame:
    """One epoch of every island state; ``guest`` is the packing that came from the island before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
                rng = np.random.default_rng([row["block"], row["island"], epoch])
                states = [Packing(np.frombuffer(x, np.int32), lengths, capacity) for x in [*(row["packings"] or []), *([row["guest"]] if row["guest"] else [])]]
                # the first island begins with plain best fit, the others with blurred orders
                states = states or first_packings(lengths, capacity, population + (row["island"] > 0), rng)[row["island"] > 0 :]
                states = evolve(states, lengths, capacity, generations, rng)[:population]
                out.append(row | {"packings": [x.assigned.astype(np.int32).tobytes() for x in states]})
            names = ["block", "island", "lengths", "items", "packings"]
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, types, strict=True)], names=names)

    return blocks.mapInArrow(run, STATE)


def _packed(best: DataFrame, capacity: int) -> DataFrame:
    """item, block, bin, offset of the packings in ``best``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, items = np.frombuffer(row["lengths"], np.int32).astype(np.int64), np.frombuffer(row["items"], np.int64)
                bins = np.frombuffer(row["best"], np.int32).astype(np.int64)
                order = np.lexsort((items, bins))
                n, b = lengths[order], bins[order]
                before = np.cumsum(n) - n
                first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                offset = before - np.repeat(before[first], np.diff(np.append(first, len(b))))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (items[order], np.full(len(b), row["block"]), b, offset)], names=["item", "block", "bin", "offset"])

    return best.mapInArrow(run, "item long, block long, bin long, offset long")


def _blocks(short: DataFrame, n_blocks: int, islands: int) -> DataFrame:
    """One row for each block and island: lengths and items by falling length."""

    def run(key, table):
        lengths, items = table["length"].to_numpy().astype(np.int32), table["item"].to_numpy()
        order = np.lexsort((items, -lengths))
        n = islands
        return pa.table({"block": pa.array([key[0].as_py()] * n, pa.int32()), "island": pa.array(range(n), pa.int32()), "lengths": pa.array([lengths[order].tobytes()] * n, pa.binary()), "items": pa.array([items[order].tobytes()] * n, pa.binary()), "packings": pa.array([None] * n, pa.list_(pa.binary()))})

    dealt = short.select(F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int").alias("block"), "item", "length")
    return dealt.groupBy("block").applyInArrow(run, STATE)


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    block_items: int = BLOCK_ITEMS,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    population: int = POPULATION,
    generations: int = GENERATIONS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of every document with their sequence and the place there.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    cut = materialize(pieces(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("item", F.monotonically_increasing_id()), "pieces")
    short = cut.filter(F.col("length") < capacity)
    n_blocks = max(1, -(-short.count() // block_items))
    # island states are few and heavy: one partition for every two of them
    tasks = max(1, min(n_blocks * islands // 2, 100_000))
    spread = lambda df: df.repartition(tasks, "block", "island")
    state = Table(_blocks(short, n_blocks, islands), "islands")
    guest = None
    for epoch in range(epochs):
        old = state.df()
        if guest is None:
            old = old.withColumn("guest", F.lit(None).cast("binary"))
        else:
            old = old.join(guest, ["block", "island"], "left")
        new = Table(_islands(spread(old), capacity, population, generations, epoch), "islands")
        state.drop()
        state = new
        # the best packing of each island goes to the next one of its block
        guest = new.df().select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("packings")[0].alias("guest"))
    best = (
        state.df()
        .withColumn("best", F.col("packings")[0])
        .withColumn("bins", _bins("best"))
        .groupBy("block")
        .agg(F.min_by(F.struct("lengths", "items", "best"), F.struct("bins", "island")).alias("x"))
        .select("block", "x.*")
    )
    placed = _packed(best, capacity)
    out = cut.join(placed, "item", "left")
    sequence = F.when(F.col("bin").isNull(), -1 - F.col("item")).otherwise(F.col("block") * F.lit(1 << 24) + F.col("bin"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), F.coalesce("offset", F.lit(0).cast("long")).alias("offset"))


def _bins(column: str) -> F.Column:
    """The number of bins of a packing."""

    @F.pandas_udf("int")
    def count(packings):
        return packings.map(lambda x: int(np.frombuffer(x, np.int32).max()) + 1 if len(x) else 0)

    return count(F.col(column))
