"""Language-model scoring with a hierarchical Pitman-Yor model of words.

Each word is drawn from the restaurant of its context, the whole word before it (a text's begin
has one too).  All context restaurants share one parent: their tables are the customers of the
root restaurant, whose own parent is uniform over the vocabulary and one unknown word.  Contexts
are told apart by 40 bits of a hash of the word, words by themselves.

Seating is sampled.  Customers arrive one after another; then, in every round of a Gibbs sweep,
one customer of each dish, chosen at random, leaves its table and is seated again given all
others: at a table of its dish with a weight (customers there - discount), or at a new one with a
weight (strength + discount * tables of the restaurant) * parent probability.  A table that opens
or empties adds or takes a customer of the root, where the same moves follow.  Rounds are the same
for dishes of any size; a dish of one customer can only sit as it does.  After burn-in, predictive
probabilities are averaged over sweeps, each with the restaurant totals of its own seating, and a
text's score is the sum of the log10 of the averages.

Distribution.  A block is a run of documents: it sends each word bucket its distinct words
and (context, word) pairs with their training counts.  A bucket (by hash of the word) has all
dishes of its words and their root dishes, so a table and the customer it sends up are in one
place.  A context's dishes are spread over buckets: its totals are added up in context groups
(by hash), which every bucket sends its contexts' tables after each sweep and which answer with
the sums; within a sweep a bucket sees its own changes and the others' last totals.  Only sums
over everything reach the driver.  Each bucket answers the blocks' pairs, and blocks add them up.
A row is packed arrays of one block, bucket or group, all of bounded size but for one thing: a
bucket holds one entry for each distinct context of a word, however often the two meet.

Tokens: words between ASCII white space, A-Z in lower case, then one end.  Defined results:
a null text counts as empty (its end is its one token); a null identifier counts as empty
text for the split and is returned as null; repeated rows are trained on and scored one by
one; without training rows nothing is known and the base is uniform; an empty table gives
an empty result; other columns are not read; very long texts are blocks of their own.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table

#: Tokens of a block.
BLOCK_TOKENS = 2_500_000
#: Bytes of text for each bucket of words.
BUCKET_BYTES = 20 << 20
SWEEPS, SAMPLES, ROUNDS = 2, 3, 4
STRENGTH = 1.0
SMOOTHING = 0.1
BITS = 40  # of a context's hash
BEGIN = 0  # the context of a text's first word
END = b"\n"
#: Log10 probabilities are exchanged in units of 1 / FINE.
FINE = 1 << 21

ROW = "kind int, a long, bucket int, data array<binary>, sums array<long>"
#: Kinds of rows.  a: the block, block, sweep, group, group, and group.
DOCUMENTS, ASKED, STATE, CONTEXTS, TABLES, TOTALS = range(6)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers of 0 and more, in as few bytes each as the largest needs, compressed byte by byte of all numbers."""
    most = int(x.max()) if len(x) else 0
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    parts = x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T
    return bytes([size]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(parts).tobytes())


def unpack(x: bytes) -> np.ndarray:
    size = x[0]
    parts = np.frombuffer(zstandard.ZstdDecompressor().decompress(x[1:]), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(parts.T).view(f"<u{size}").ravel().astype(np.int64)


def rising(x: np.ndarray) -> np.ndarray:
    """Differences of an array that never falls."""
    return np.diff(x, prepend=0)


def context_of(word: bytes) -> int:
    return max(xxhash.xxh64_intdigest(word) >> (64 - BITS), BEGIN + 1)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in ROW.split(", ")])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


class _Words(dict):
    """Words by number, in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _blocks(docs: DataFrame, buckets: int, id_col: str, text_col: str, train_on) -> DataFrame:
    """Rows ASKED: a block's words and pairs of a bucket; DOCUMENTS: what its documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        words, sizes, trains, idents = _Words(), [], [], []
        seq = total = 0

        def flush():
            nonlocal words, held, sizes, trains, idents, seq, total
            number = task << 24 | seq
            codes = np.concatenate(held)
            names = list(words)
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in names), np.int64, len(names))
            order = np.argsort(bucket, kind="stable")  # words in the order of their buckets
            rank = np.empty(len(names), np.int64)
            rank[order] = np.arange(len(names))
            size = np.array(sizes, np.int64)
            first = np.cumsum(size) - size
            before = np.append(0, codes[:-1] + 1)
            before[first] = 0
            pairs, back = np.unique(rank[codes] * (len(names) + 1) + before, return_inverse=True)
            counts = np.bincount(back, np.repeat(np.array(trains, np.int64), size), len(pairs)).astype(np.int64)
            pair_word, before = pairs // (len(names) + 1), pairs % (len(names) + 1)
            context = np.fromiter((BEGIN, *map(context_of, names)), np.int64, len(names) + 1)[before]
            names = [names[k] for k in order.tolist()]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            pair_edges = np.searchsorted(pair_word, edges)
            rows = []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                w0, w1, p0, p1 = edges[b], edges[b + 1], pair_edges[b], pair_edges[b + 1]
                text = zstandard.ZstdCompressor(level=1).compress(b" ".join(names[w0:w1]))
                contexts, at = np.unique(context[p0:p1], return_inverse=True)
                rows.append((ASKED, number, b, [text, pack(rising(pair_word[p0:p1] - w0)), pack(rising(contexts)), pack(at), pack(counts[p0:p1])], None))
            ids = pa.array(idents, pa.int64())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64())])) as writer:
                writer.write_batch(pa.RecordBatch.from_arrays([ids], names=["id"]))
            # each document's pairs in order, as differences that begin anew
            key = np.sort(np.repeat(np.arange(len(size)) * len(pairs), size) + back) % len(pairs)
            jump = np.diff(key, prepend=0)
            jump[first] = key[first]
            rows.append((DOCUMENTS, number, -1, [pack(rising(pair_word)), pack(size), pack(np.array(trains, np.int64)), pack(jump), sink.getvalue().to_pybytes()], None))
            words, held, sizes, trains, idents = _Words(), [], [], [], []
            seq, total = seq + 1, 0
            return _batch(rows)

        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                for ident, text, train in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    tokens = (text or "").encode().lower().split()
                    tokens.append(END)
                    held.append(np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens)))
                    sizes.append(len(tokens))
                    trains.append(bool(train))
                    idents.append(ident)
                    total += len(tokens)
                    if total >= BLOCK_TOKENS:
                        yield flush()
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train_on, F.lit(False)).alias("train")).mapInArrow(run, ROW)


class Pairs:
    """The distinct pairs of a bucket over all its messages; the same on every reading, as messages are read by block."""

    def __init__(self, messages: list[dict]):
        messages = sorted(messages, key=lambda m: m["a"])
        words = _Words()
        keys, counts, self.codes = [], [], []
        for m in messages:
            names, pair_word, contexts, at, count = m["data"]
            names = zstandard.ZstdDecompressor().decompress(names).split(b" ")
            code = np.fromiter(map(words.__getitem__, names), np.int64, len(names))
            self.codes.append(code)
            keys.append(code[np.cumsum(unpack(pair_word))] << BITS | np.cumsum(unpack(contexts))[unpack(at)])
            counts.append(unpack(count))
        if len(words) >= 1 << (63 - BITS):
            raise ValueError("a bucket holds too many words: lower bucket_bytes")
        self.blocks = [m["a"] for m in messages]
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        self.back = np.split(back, np.cumsum([len(k) for k in keys])[:-1])
        self.words = words
        self.word, self.count = key >> BITS, np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
        #: all contexts, rising, and the place of each pair's there
        self.contexts, self.at = np.unique(key & ((1 << BITS) - 1), return_inverse=True)
        self.known = np.bincount(self.word, self.count, len(words)).astype(np.int64)


class Seating:
    """Customers at tables; tables stand in the order of their dishes."""

    def __init__(self, tables: np.ndarray, customers: np.ndarray):
        """tables: of each dish; customers: of each table."""
        self.dishes, self.n = len(tables), customers
        self.of = np.repeat(np.arange(len(tables)), tables)

    @property
    def tables(self) -> np.ndarray:
        return np.bincount(self.of, minlength=self.dishes)

    @property
    def customers(self) -> np.ndarray:
        return np.bincount(self.of, self.n, self.dishes).astype(np.int64)

    def arrive(self, more: np.ndarray, opening, discount: float, rng: np.random.Generator) -> np.ndarray:
        """Seat new customers of the dishes; opening(dishes, tables opened) gives the weight of a new table.

        The wait for the next new table has probabilities n/(n+a) * (n+1)/(n+1+a) * ...; it is drawn
        at once, by its smooth form.  Those who came meanwhile share the dish's tables.  Only a begin
        for the moves: these set the seating right.  Returns the tables opened for each dish.
        """
        seated, tables, left = self.customers, self.tables, more.copy()
        opened = np.zeros(self.dishes, np.int64)
        who = np.flatnonzero(left > 0)
        while len(who):
            a = np.maximum(opening(who, opened[who]), 1e-300)
            joining = np.maximum(seated[who] - discount * tables[who], 0)
            with np.errstate(over="ignore"):
                wait = (joining + a / 2) * np.expm1(np.minimum(-np.log1p(-rng.random(len(who))) / a, 700.0))
            wait = np.where(tables[who] == 0, 0, np.minimum(wait, left[who])).astype(np.int64)
            opens = wait < left[who]
            came = wait + opens
            seated[who] += came
            left[who] -= came
            tables[who] += opens
            opened[who] += opens
            who = who[opens & (left[who] > 0)]
        self._insert(np.repeat(np.arange(self.dishes), opened))
        joined = more - opened
        if joined.any():
            weight = rng.standard_gamma(np.maximum(self.n - discount, 1e-3)) + 1e-3
            upto = np.cumsum(weight)
            first, last = self._edges()
            base = np.where(first > 0, upto[first - 1], 0.0)
            some = last >= first
            whole = np.ones(self.dishes)
            whole[some] = (upto[np.maximum(last, 0)] - base)[some]
            part = np.rint(np.clip((upto - base[self.of]) / whole[self.of], 0, 1) * joined[self.of]).astype(np.int64)
            part[last[some]] = joined[some]
            self.n = self.n + np.where(np.arange(len(part)) == first[self.of], part, np.diff(part, prepend=0))
        return opened

    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last table of each dish; last < first where it has none."""
        last = np.cumsum(self.tables) - 1
        return np.append(0, last[:-1] + 1) if len(last) else last, last

    def _insert(self, dishes: np.ndarray) -> None:
        """A new table of one customer for each of the dishes, after their others."""
        if len(dishes):
            place = np.searchsorted(self.of, dishes, "right")
            self.n, self.of = np.insert(self.n, place, 1), np.insert(self.of, place, dishes)

    def leave(self, less: np.ndarray, rng: np.random.Generator) -> None:
        """That many customers of each dish, chosen at random, go."""
        if not less.any():
            return
        customers = self.customers
        begin = np.cumsum(customers) - customers
        gone, missing = np.zeros(0, np.int64), less
        while missing.any():  # numbers drawn twice are drawn again
            who = np.repeat(np.arange(self.dishes), missing)
            drawn = begin[who] + (rng.random(len(who)) * customers[who]).astype(np.int64)
            gone = np.unique(np.append(gone, drawn))
            missing = less - np.diff(np.searchsorted(gone, np.append(begin, begin[-1] + customers[-1])))
        self.n = self.n - np.bincount(np.searchsorted(np.cumsum(self.n), gone, "right"), minlength=len(self.n))
        self._drop_empty()

    def _drop_empty(self) -> None:
        some = self.n > 0
        if not some.all():
            self.n, self.of = self.n[some], self.of[some]

    def move(self, opening, discount: float, rng: np.random.Generator) -> np.ndarray:
        """One customer of each dish of two or more leaves and is seated again given all others.

        opening(dishes, tables emptied): the weight of a new table then.  Returns the change of tables.
        """
        n = self.n
        change = np.zeros(self.dishes, np.int64)
        customers, tables = self.customers, self.tables
        who = np.flatnonzero(customers > 1)
        if not len(who):
            return change
        upto = np.cumsum(n)
        left = np.searchsorted(upto, (np.cumsum(customers) - customers)[who] + (rng.random(len(who)) * customers[who]).astype(np.int64), "right")
        n[left] -= 1
        empty = n[left] == 0
        joining = customers[who] - 1 - discount * (tables[who] - empty)
        new = rng.random(len(who)) * (joining + (a := opening(who, empty))) < a
        first, last = self._edges()
        share = np.cumsum(np.where(n > 0, n - discount, 0.0))
        old = who[~new]
        base = np.where(first[old] > 0, share[first[old] - 1], 0.0)
        joined = np.searchsorted(share, base + rng.random(len(old)) * joining[~new], "right")
        n[np.clip(joined, first[old], last[old])] += 1
        n[left[new & empty]] += 1
        self._insert(who[new & ~empty])
        self._drop_empty()
        change[who] = new.astype(np.int64) - empty
        return change


class Sums:
    """What is added up over all buckets, and what follows from it."""

    FIELDS = ("tokens", "vocabulary", "ones", "twos", "customers", "tables", "root_ones", "root_twos")

    def __init__(self, values: list[int]):
        for name, value in zip(self.FIELDS, values, strict=True):
            setattr(self, name, value or 0)
        self.uniform = 1.0 / (self.vocabulary + 1)
        self.discount, self.root_discount = (float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a else 0.5 for a, b in ((self.ones, self.twos), (self.root_ones, self.root_twos)))


class Bucket:
    """The seating of a bucket's words: pairs of two customers and more, the single ones' constant tables, and the root's dishes.

    contexts: how many the bucket has; word, at, count: of each pair seated; alone: pairs of one
    customer of each word; tables_alone: those of each context.
    """

    def __init__(self, contexts: int, word, at, count, alone, tables_alone, leaf: Seating, root: Seating):
        self.contexts, self.word, self.at, self.count, self.alone, self.tables_alone, self.leaf, self.root = contexts, word, at, count, alone, tables_alone, leaf, root

    @classmethod
    def begun(cls, p: Pairs) -> Bucket:
        """The first customer of each pair sits, at the root one for each word."""
        more, one = p.count > 1, p.count == 1
        alone = np.bincount(p.word[one], minlength=len(p.words))
        pairs = alone + np.bincount(p.word[more], minlength=len(p.words))
        n = int(more.sum())
        leaf = Seating(np.ones(n, np.int64), np.ones(n, np.int64))
        root = Seating((pairs > 0).astype(np.int64), np.ones(int((pairs > 0).sum()), np.int64))
        return cls(len(p.contexts), p.word[more], p.at[more], p.count[more], alone, np.bincount(p.at[one], minlength=len(p.contexts)), leaf, root)

    @classmethod
    def read(cls, data: list[bytes]) -> Bucket:
        word, at, count, alone, tables_alone, *seats = map(unpack, data)
        return cls(len(tables_alone), np.cumsum(word), at, count, alone, tables_alone, Seating(*seats[:2]), Seating(*seats[2:]))

    def written(self) -> list[bytes]:
        return [pack(x) for x in (rising(self.word), self.at, self.count, self.alone, self.tables_alone, self.leaf.tables, self.leaf.n, self.root.tables, self.root.n)]

    def own_tables(self) -> np.ndarray:
        """Tables of each context in this bucket."""
        return self.tables_alone + np.bincount(self.at, self.leaf.tables, self.contexts).astype(np.int64)

    def customers_due(self) -> np.ndarray:
        """Customers that the leaves' tables send each root dish."""
        return self.alone + np.bincount(self.word, self.leaf.tables, len(self.alone)).astype(np.int64)

    def root_probability(self, s: Sums, customers: float, tables: float) -> np.ndarray:
        return (self.root.customers - s.root_discount * self.root.tables + (STRENGTH + s.root_discount * tables) * s.uniform) / (STRENGTH + customers)

    def sweep(self, s: Sums, totals: np.ndarray, rounds: int, rng: np.random.Generator) -> None:
        """Seat those who have not come yet, then rounds of moves; totals: tables of each context in all buckets."""
        totals = totals.astype(np.float64)
        customers, tables = float(s.customers), float(s.tables)

        def follow(change: np.ndarray) -> None:
            """The root after a change of the leaves' tables."""
            nonlocal totals, customers, tables
            totals += np.bincount(self.at, change, self.contexts)
            move = self.customers_due() - self.root.customers
            self.root.leave(np.maximum(-move, 0), rng)
            opened = self.root.arrive(np.maximum(move, 0), at_root, s.root_discount, rng)
            customers += move.sum()
            tables = max(0.0, tables + opened.sum() + self.root.move(at_root, s.root_discount, rng).sum())

        def at_root(dishes, _):
            return np.full(len(dishes), (STRENGTH + s.root_discount * tables) * s.uniform)

        def at_leaf(sign: int):
            above = self.root_probability(s, customers, tables)
            return lambda dishes, k: (STRENGTH + s.discount * (totals[self.at[dishes]] + sign * k)) * above[self.word[dishes]]

        due = self.count - self.leaf.customers
        follow(self.leaf.arrive(due, at_leaf(1), s.discount, rng) if due.any() else np.zeros(len(due), np.int64))
        for _ in range(rounds):
            follow(self.leaf.move(at_leaf(-1), s.discount, rng))

    def sums(self, known: np.ndarray | None) -> list[int]:
        """As in Sums; the first four follow from the counts alone and are given once."""
        c = self.root.customers
        fixed = [0] * 4 if known is None else [known.sum(), (known > 0).sum(), self.alone.sum(), (self.count == 2).sum()]
        return [int(x) for x in (*fixed, c.sum(), len(self.root.n), (c == 1).sum(), (c == 2).sum())]

    def predicted(self, p: Pairs, s: Sums, tables: np.ndarray, customers: np.ndarray) -> np.ndarray:
        """Probabilities of all pairs; tables, customers: of the bucket's contexts, in all buckets."""
        kept = np.where(p.count == 1, 1 - s.discount, 0.0)
        kept[p.count > 1] = self.count - s.discount * self.leaf.tables
        above = self.root_probability(s, s.customers, s.tables)
        return (kept + (STRENGTH + s.discount * tables[p.at]) * above[p.word]) / (STRENGTH + customers[p.at])


def _groups_of(contexts: np.ndarray, groups: int) -> np.ndarray:
    """Where each group's contexts begin in a rising array of them, and its end."""
    return np.searchsorted(contexts, [-(-(g << BITS) // groups) for g in range(groups + 1)])


def _table_rows(bucket: int, own: np.ndarray, edges: np.ndarray) -> list[tuple]:
    return [(TABLES, g, bucket, [pack(own[edges[g] : edges[g + 1]])], None) for g in np.flatnonzero(np.diff(edges)).tolist()]


def _begin(asked: DataFrame, groups: int) -> DataFrame:
    """Every bucket's first STATE, its CONTEXTS for the groups, and their TABLES."""

    def run(key, table):
        p = Pairs(table.select(["a", "data"]).to_pylist())
        bucket = Bucket.begun(p)
        edges = _groups_of(p.contexts, groups)
        customers = np.bincount(p.at, p.count, len(p.contexts)).astype(np.int64)
        number = key[0].as_py()
        rows = [(STATE, 0, number, [*bucket.written(), pack(edges)], bucket.sums(p.known))]
        rows += [(CONTEXTS, g, number, [pack(rising(p.contexts[a:b])), pack(customers[a:b])], None) for g, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]
        return _table([*rows, *_table_rows(number, bucket.own_tables(), edges)])

    return asked.groupBy("bucket").applyInArrow(run, ROW)


def _totals(contexts: DataFrame, tables: DataFrame, groups: int, sweep: int) -> DataFrame:
    """TOTALS: for each bucket and group, tables and customers of the bucket's contexts over all buckets."""

    def run(key, table):
        rows = sorted(table.select(["kind", "bucket", "data"]).to_pylist(), key=lambda r: (r["bucket"], r["kind"]))
        lists = [(np.cumsum(unpack(r["data"][0])), unpack(r["data"][1])) for r in rows if r["kind"] == CONTEXTS]
        own = [unpack(r["data"][0]) for r in rows if r["kind"] == TABLES]
        _, back = np.unique(np.concatenate([x for x, _ in lists]), return_inverse=True)
        t, c = (np.bincount(back, np.concatenate(x)).astype(np.int64)[back] for x in (own, [c for _, c in lists]))
        edges = np.cumsum([0] + [len(x) for x in own])
        numbers = [r["bucket"] for r in rows if r["kind"] == TABLES]
        return _table([(TOTALS, key[0].as_py(), b, [pack(t[i:j]), pack(c[i:j])], [sweep]) for b, i, j in zip(numbers, edges, edges[1:], strict=False)])

    return contexts.union(tables).repartition(groups, "a").groupBy("a").applyInArrow(run, ROW)


def _joined(totals: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Tables and customers of all contexts of a bucket."""
    rows = sorted(totals, key=lambda r: r["a"])
    return tuple(np.concatenate([unpack(r["data"][k]) for r in rows]) for k in (0, 1))


def _swept(state: DataFrame, totals: DataFrame, buckets: int, s: Sums, sweep: int, rounds: int, seed: int) -> DataFrame:
    """Every bucket's STATE after one more sweep, and its TABLES for the groups."""

    def run(key, table):
        rows = table.to_pylist()
        data = next(r["data"] for r in rows if r["kind"] == STATE)
        bucket, edges, number = Bucket.read(data[:-1]), unpack(data[-1]), key[0].as_py()
        tables, _ = _joined([r for r in rows if r["kind"] == TOTALS])
        bucket.sweep(s, tables, rounds, np.random.default_rng([seed, sweep, number]))
        return _table([(STATE, sweep, number, [*bucket.written(), data[-1]], bucket.sums(None)), *_table_rows(number, bucket.own_tables(), edges)])

    return state.union(totals).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, ROW)


def _answers(asked: DataFrame, states: DataFrame, totals: DataFrame, buckets: int, sums: dict[int, Sums]) -> DataFrame:
    """For each block's message: -log10 of the averaged probabilities of its pairs, and its words' training counts."""

    def run(key, table):
        rows = table.to_pylist()
        p = Pairs([r for r in rows if r["kind"] == ASKED])
        mean = np.zeros(len(p.word))
        for r in rows:
            if r["kind"] == STATE:
                of_sweep = [x for x in rows if x["kind"] == TOTALS and x["sums"][0] == r["a"]]
                mean += Bucket.read(r["data"][:-1]).predicted(p, sums[r["a"]], *_joined(of_sweep)) / len(sums)
        fine = np.rint(-np.log10(mean) * FINE).astype(np.int64)
        return _table([(ASKED, block, key[0].as_py(), [pack(fine[back]), pack(p.known[code])], None) for block, back, code in zip(p.blocks, p.back, p.codes, strict=True)])

    return asked.union(states).union(totals).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, ROW)


SCORES = "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _added_up(documents: DataFrame, answers: DataFrame, s: Sums) -> DataFrame:
    def run(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        pair_word, size, train, jump = (unpack(x) for x in rows[0]["data"][:4])
        log10 = np.concatenate([unpack(r["data"][0]) for r in rows[1:]]) / -FINE
        known = np.concatenate([unpack(r["data"][1]) for r in rows[1:]])
        first = np.cumsum(size) - size
        total = np.cumsum(jump)  # differences begin anew with each document
        pair = total - np.repeat(total[first] - jump[first], size)
        count = known[np.cumsum(pair_word)[pair]]
        base = np.log10((count + SMOOTHING) / (s.tokens + SMOOTHING * (s.vocabulary + 1)))
        ids = pa.ipc.open_stream(rows[0]["data"][4]).read_all()["id"]
        cols = [ids.combine_chunks(), pa.array(train.astype(bool)), pa.array(size), pa.array(np.add.reduceat((count > 0).astype(np.int64), first)), pa.array(np.full(len(size), s.tokens, np.int64))]
        cols += [pa.array(np.add.reduceat(v, first)) for v in (base, log10[pair])]
        return pa.table(dict(zip([c.split()[0] for c in SCORES.split(", ")], cols, strict=True)))

    return documents.union(answers).groupBy("a").applyInArrow(run, SCORES)


class Model:
    """What training leaves: the blocks' table, the states and totals of the sampled sweeps, and the sums of each."""

    def __init__(self, docs: DataFrame, train_on, id_col: str, text_col: str, sweeps: int, samples: int, rounds: int, bucket_bytes: int, seed: int):
        size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
        self.buckets = max(6, -(-size // bucket_bytes))
        self.blocks = Table(_blocks(docs, self.buckets, id_col, text_col, train_on), "blocks", by="kind")
        last = begin = Table(_begin(self.of(self.blocks, ASKED).repartition(self.buckets, "bucket"), self.buckets), "restaurants", by="kind")
        fixed = self._sums(begin)[:4]
        self.sums: dict[int, Sums] = {}
        self.kept: list[tuple[Table, Table]] = []
        totals, self.last = self._totals_after(begin, begin, 0), Sums(self._sums(begin))
        for k in range(1, sweeps + samples + 1):
            new = Table(_swept(self.of(last, STATE), totals.df(), self.buckets, self.last, k, rounds, seed), "restaurants", by="kind")
            for table in (last, totals) if k - 1 <= sweeps else ():
                table.drop(f"kind={STATE}" if table is begin else "")
            last, totals, self.last = new, self._totals_after(begin, new, k), Sums(fixed + self._sums(new)[4:])
            if k > sweeps:
                self.kept.append((new, totals))
                self.sums[k] = self.last
        begin.drop()

    @staticmethod
    def of(table: Table, kind: int) -> DataFrame:
        return table.df().filter(F.col("kind") == kind)

    def _totals_after(self, begin: Table, sweep: Table, k: int) -> Table:
        return Table(_totals(self.of(begin, CONTEXTS), self.of(sweep, TABLES), self.buckets, k), "totals")

    @classmethod
    def _sums(cls, table: Table) -> list[int]:
        return list(cls.of(table, STATE).agg(*[F.sum(F.col("sums")[k]) for k in range(len(Sums.FIELDS))]).first())

    def states(self) -> DataFrame:
        return functools.reduce(DataFrame.union, [self.of(state, STATE) for state, _ in self.kept])

    def answers(self) -> DataFrame:
        totals = functools.reduce(DataFrame.union, [table.df() for _, table in self.kept])
        return _answers(self.of(self.blocks, ASKED), self.states(), totals, self.buckets, self.sums)

    def scores(self) -> DataFrame:
        """What led to the answers is dropped once they are written."""
        answers = Table(self.answers(), "answers")
        self.blocks.drop(f"kind={ASKED}")
        for table in itertools.chain(*self.kept):
            table.drop()
        return _added_up(self.of(self.blocks, DOCUMENTS), answers.df(), self.last)


def score(docs: DataFrame, train_on, id_col: str = "doc_id", text_col: str = "text", sweeps: int = SWEEPS, samples: int = SAMPLES, rounds: int = ROUNDS, bucket_bytes: int = BUCKET_BYTES, seed: int = 7) -> DataFrame:
    """One row for each document; train_on: the condition (a column) under which a row is learnt from.

    doc_id, trained, n_tokens, n_known (tokens seen in training), train_tokens, base_score (log10 of
    the smoothed unigram probability), score (the model's log10 probability).
    """
    return Model(docs, train_on, id_col, text_col, sweeps, samples, rounds, bucket_bytes, seed).scores()
