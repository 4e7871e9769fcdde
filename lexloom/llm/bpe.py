"""Byte-pair encoding and decoding by speculation and verification.

A greedy longest match (one automaton pass over all new words of a batch) proposes the
tokens of each word.  Encoding by merges is the only segmentation in which every adjacent
pair of tokens is stable, that is, in which undoing the merges of the two tokens from the
latest to the earliest never meets an earlier merge across their border.  So all adjacent
pairs are tested at once with numpy, and only words with an unstable pair go through exact
merging.  Words are remembered with their ids, and whole texts are put together by gathers.

Defined results: a null text counts as empty and has no ids; strings of added special
tokens inside a text become those tokens, as the tokenizer file says; other columns of the
input are passed through, except ones named like an output column, which are replaced.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remembers, slices

#: The public pattern that splits text into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern's engine has it (Unicode White_Space).
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
#: Words and chunks that a worker remembers before it starts anew (bounds its memory).
REMEMBERED = 500_000
#: Bytes of text handled at once.
SLICE = 8 << 20
_NONE = np.iinfo(np.int64).max
_SIGNS = tuple(",.;:!?")
#: Before a chunk that had no space before it.
_WHOLE = "\0"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """The tables of one tokenizer file."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        of_letter = {x: b for b, x in enumerate(byte_letters())}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ids = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        n = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * n
        for k, v in ids.items():
            self.bytes[v] = bytes(of_letter[x] for x in k)
        for k, v in self.special.items():
            self.bytes[v] = k.encode()
        # The merge that makes a token: its place in the order (from 1; 0 for single bytes) and its halves.
        self.order = np.zeros(n, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        merges = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for k, (a, b) in enumerate(merges, 1):
            made = ids[a + b]
            self.merges.setdefault((ids[a], ids[b]), (k, made))
            if not self.order[made]:
                self.order[made], self.left[made], self.right[made] = k, ids[a], ids[b]
        pairs = sorted((a * n + b, k, made) for (a, b), (k, made) in self.merges.items()) or [(-1, 0, 0)]
        self.pair_keys, self.pair_order, self.pair_made = np.array(pairs).T.copy()
        self.n = n
        self.of_byte = np.zeros(256, np.int64)
        automaton = ahocorasick.Automaton()
        for v in ids.values():
            automaton.add_word(self.bytes[v].decode("latin-1"), v)
            if len(self.bytes[v]) == 1:
                self.of_byte[self.bytes[v][0]] = v
        automaton.make_automaton()
        self.automaton = automaton
        sizes = np.array([len(x) for x in self.bytes])
        self.byte_start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.byte_size = sizes
        self.all_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.special_pattern = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether exact merging can leave token ``b`` right after token ``a``, for all pairs at once.

        The later of the two merges is undone first (at equal order the left one, which was made
        first, is undone last).  A merge across the border wins over the undone one when it
        comes earlier in the order; at equal order the one further left wins.
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), _NONE)  # twice the order of the last undone merge, plus 1 if it stood right
        while len(at):
            # a left merge of equal order was made before the one across, a right one after it
            across = self._lookup(a, b)[0]
            bad = np.where(across == _NONE, across, 2 * across) < limit
            good[at[bad]] = False
            oa, ob = self.order[a], self.order[b]
            undo_left = oa > ob
            more = ~bad & (np.maximum(oa, ob) > 0)
            limit = np.where(undo_left, 2 * oa, 2 * ob + 1)[more]
            a, b = np.where(undo_left, self.right[a], a)[more], np.where(undo_left, b, self.left[b])[more]
            at = at[more]
        return good

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once: in each step every word makes its earliest merge, the leftmost first.

        Returns the ids of all words in one array and the number for each word.
        """
        sizes = np.array([len(x) for x in words], np.int64)
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        order, made = self._across(ids, word)
        done_ids, done_words = [], []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(order, starts)
            runs = np.diff(np.append(starts, len(ids)))
            over = least == _NONE
            if over.any():
                out = np.repeat(over, runs)
                done_ids.append(ids[out])
                done_words.append(word[out])
                ids, word, order, made = ids[~out], word[~out], order[~out], made[~out]
                least, runs = least[~over], runs[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(order == np.repeat(least, runs))
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            ids[at] = made[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            ids, word, order, made = ids[keep], word[keep], order[keep], made[keep]
            near = np.concatenate([at, at[at > 0] - 1])
            nxt = np.minimum(near + 1, len(ids) - 1)
            found, result = self._lookup(ids[near], ids[nxt])
            found[(nxt == near) | (word[near] != word[nxt])] = _NONE
            order[near], made[near] = found, result
        word = np.concatenate(done_words)
        by = np.argsort(word, kind="stable")
        return np.concatenate(done_ids)[by], np.bincount(word, minlength=len(words))

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place in the order of the merge of each pair (_NONE: there is none) and the token it makes."""
        key = a * self.n + b
        where = np.searchsorted(self.pair_keys, key)
        where[where == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[where] == key, self.pair_order[where], _NONE), self.pair_made[where]

    def _across(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, made = self._lookup(ids, np.append(ids[1:], 0))
        order[np.append(word[1:] != word[:-1], True)] = _NONE
        return order, made

    def merge_long(self, word: bytes) -> list[int]:
        """The same for a very long word, with a heap over a linked list."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (found := self.merges.get((ids[i], ids[after[i]]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[after[i]], found[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            if ids[i] != a or after[i] >= n or ids[after[i]] != b:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of all words in one array, the number for each word, and how many needed exact merging."""
        sizes = np.array([len(x) for x in words], np.int64)
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        # no UTF-8 text has a byte 0xFF, so it can stand between words; it is a token of its own
        ids = np.fromiter(map(itemgetter(1), self.automaton.iter_long(b"\xff".join(words).decode("latin-1"))), np.int64)
        word = np.cumsum(ids == self.of_byte[0xFF])
        real = ids != self.of_byte[0xFF]
        ids, word = ids[real], word[real]
        same = word[1:] == word[:-1]
        a, b = ids[:-1][same], ids[1:][same]
        pairs, back = np.unique(a * self.n + b, return_inverse=True)
        bad = ~self.stable(pairs // self.n, pairs % self.n)[back]
        wrong = np.unique(word[1:][same][bad])
        counts = np.bincount(word, minlength=len(words))
        if len(wrong):
            # very long words one by one, with a heap; all others in common steps
            far = wrong[sizes[wrong] > 64]
            near = wrong[sizes[wrong] <= 64]
            new_counts = counts.copy()
            near_ids, new_counts[near] = self.merge([words[k] for k in near]) if len(near) else (ids[:0], counts[:0])
            fixed = [self.merge_long(words[k]) for k in far]
            new_counts[far] = [len(x) for x in fixed]
            new_starts = np.cumsum(new_counts) - new_counts
            out = np.empty(int(new_counts.sum()), np.int64)
            kind = np.zeros(len(words), np.int8)
            kind[near], kind[far] = 1, 2
            kind = np.repeat(kind, new_counts)
            right = np.ones(len(words), bool)
            right[wrong] = False
            out[kind == 0] = ids[right[word]]
            out[kind == 1] = near_ids
            for k, x in zip(far, fixed, strict=True):
                out[new_starts[k] : new_starts[k] + len(x)] = x
            ids, counts = out, new_counts
        return ids, counts, len(wrong)


class _Memory(dict):
    """Codes of texts in order of first sight; ``new`` holds those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = code = len(self)
        self.new.append(key)
        return code


class _Store:
    """Id lists of the codes given out by a _Memory."""

    def __init__(self):
        self.memory = _Memory()
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.used = np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.size = np.concatenate([self.size, counts])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.used = np.concatenate([self.used, np.zeros(len(counts), np.int64)])
        self.memory.new = []

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.size[codes]
        self.used += np.bincount(codes, minlength=len(self.used))
        return take_runs(self.flat, self.start[codes], sizes), sizes

    def shrink(self, most: int) -> None:
        """Keep the entries used most often, at most ``most`` and none used once only."""
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > most:
            keep = np.sort(keep[np.argsort(-self.used[keep], kind="stable")[:most]])
        names = list(self.memory)
        flat, sizes = take_runs(self.flat, self.start[keep], self.size[keep]), self.size[keep]
        memory = _Memory()
        memory.update((names[k], n) for n, k in enumerate(keep.tolist()))
        self.memory, self.flat, self.size = memory, flat, sizes
        self.start, self.used = np.cumsum(sizes) - sizes, self.used[keep] // 2


def take_runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after another."""
    total = int(sizes.sum())
    shift = starts - (np.cumsum(sizes) - sizes)
    return flat[np.repeat(shift, sizes) + np.arange(total)]


class Encoder:
    """Encodes texts; remembers words and the chunks between single spaces."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words = regex.compile(WORDS.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]").replace(rf"[^[{SPACE}]", f"[^{SPACE}"))
        # A single space before other than white space always begins a word: only then is a split there right.
        self.odd = regex.compile(rf" (?:[{SPACE}]|\Z)")
        self.exact = self.seen = 0
        self._anew()

    def _anew(self) -> None:
        self.chunk_store, self.word_store = _Store(), _Store()

    def _learn(self) -> None:
        """Encode the chunks seen for the first time, all their new words together."""
        chunks = self.chunk_store.memory.new
        if not chunks:
            return
        # letters alone are one word, with one sign behind them two; the pattern is for the rest
        find = self.words.findall
        alone = np.fromiter(map(str.isalpha, chunks), bool, len(chunks))
        mixed = [x for x, one in zip(chunks, alone.tolist(), strict=True) if not one]
        split = [(" " + x[:-1], x[-1]) if x[-1:] in _SIGNS and x[:-1].isalpha() else find(x[1:] if x[:1] == _WHOLE else " " + x) for x in mixed]
        code = self.word_store.memory.__getitem__
        codes = np.fromiter(map(code, chain.from_iterable(split)), np.int64)
        new = self.word_store.memory.new
        single = [b" " + x.encode() for x, one in zip(chunks, alone.tolist(), strict=True) if one]
        ids, counts, exact = self.v.encode_words(single + [x.encode() for x in new])
        self.exact += exact
        self.seen += len(counts)
        cut = int(counts[: len(single)].sum())
        self.word_store.add(ids[cut:], counts[len(single) :])
        # put the two kinds back in their order
        parts, sizes = self.word_store.gather(codes)
        number = np.fromiter(map(len, split), np.int64, len(split))
        last = np.cumsum(number)
        total = np.concatenate([[0], np.cumsum(sizes)])
        size = np.empty(len(chunks), np.int64)
        size[alone], size[~alone] = counts[: len(single)], total[last] - total[last - number]
        kind = np.repeat(alone, size)
        flat = np.empty(len(kind), np.int64)
        flat[kind], flat[~kind] = ids[:cut], parts
        self.chunk_store.add(flat, size)

    def _chunks(self, text: str) -> list[str]:
        """Parts that can be encoded apart; one without the mark had a space before it."""
        if not text:
            return []
        if _WHOLE in text or self.odd.search(text):
            return [_WHOLE + x for x in ([text] if len(text) < 4096 else self.words.findall(text))]
        out = text.split(" ")
        out[0] = _WHOLE + out[0]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one int32 array, and the number for each text."""
        if len(self.chunk_store.memory) + len(self.word_store.memory) > REMEMBERED:
            self.chunk_store.shrink(REMEMBERED // 4)
            self.word_store.shrink(REMEMBERED // 4)
        special = self.v.special_pattern
        codes, number, marked = array("q"), [], False
        code = self.chunk_store.memory.__getitem__
        for text in texts:
            before = len(codes)
            if text and any(x in text for x in self.v.special):
                marked, at = True, 0
                for m in special.finditer(text):
                    codes.extend(map(code, self._chunks(text[at : m.start()])))
                    codes.append(-1 - self.v.special[m[0]])
                    at = m.end()
                codes.extend(map(code, self._chunks(text[at:])))
            elif text:
                codes.extend(map(code, self._chunks(text)))
            number.append(len(codes) - before)
        self._learn()
        codes = np.frombuffer(codes, np.int64) if codes else np.zeros(0, np.int64)
        number = np.array(number, np.int64)
        if marked:
            return self._with_special(codes, number)
        ids, sizes = self.chunk_store.gather(codes)
        total, last = np.concatenate([[0], np.cumsum(sizes)]), np.cumsum(number)
        return ids, total[last] - total[last - number]

    def _with_special(self, codes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = codes < 0
        store = self.chunk_store
        sizes = np.where(mark, 1, store.size[np.where(mark, 0, codes)] if len(store.size) else 1)
        starts = np.where(mark, len(store.flat) - 1 - codes, store.start[np.where(mark, 0, codes)] if len(store.start) else 0)
        flat = np.concatenate([store.flat, np.arange(self.v.n, dtype=np.int32)])
        ids = take_runs(flat, starts, sizes)
        total, last = np.concatenate([[0], np.cumsum(sizes)]), np.cumsum(number)
        return ids, total[last] - total[last - number]


def decode(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of all id lists; bytes that are no UTF-8 become U+FFFD."""
    sizes = v.byte_size[ids]
    data = take_runs(v.all_bytes, v.byte_start[ids], sizes).tobytes()
    total, last = np.concatenate([[0], np.cumsum(sizes)]), np.cumsum(counts)
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(total[last - counts].tolist(), total[last].tolist(), strict=True)]


_LOADED: dict[int, tuple[Vocabulary, Encoder]] = {}


def loaded(file_text: str) -> tuple[Vocabulary, Encoder]:
    """One vocabulary and encoder for each worker process and tokenizer file."""
    remembers("bpe", _LOADED.clear)
    key = hash(file_text)
    if key not in _LOADED:
        _LOADED.clear()
        v = Vocabulary(file_text)
        _LOADED[key] = v, Encoder(v)
    return _LOADED[key]


def tokenizer_text(path: str) -> str:
    """The tokenizer file (about 1.5 MB); the driver reads it and broadcasts it."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _replace(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names) if n not in new} | new
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _schema(df: DataFrame, new: list[T.StructField]) -> T.StructType:
    names = {f.name for f in new}
    return T.StructType([*(f for f in df.schema.fields if f.name not in names), *new])


def bpe_encode(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ``ids``, the token ids of each whole text.  tokenizer: the path of the tokenizer file on the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = loaded(shared.value)
        for batch in batches:
            at = batch.schema.names.index(text_col)
            for a, b in slices(batch.column(at), SLICE):
                part = batch.slice(a, b - a)
                ids, counts = encoder.encode(part.column(at).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield _replace(part, {ids_col: pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))})

    return docs.mapInArrow(run, _schema(docs, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def bpe_decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds ``decoded``, the text of each id list (null: empty), special tokens included."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, _ = loaded(shared.value)
        for batch in batches:
            ids = batch.column(batch.schema.names.index(ids_col))
            counts = np.asarray(pc.fill_null(pc.list_value_length(ids), 0), np.int64)
            texts = decode(v, np.asarray(ids.flatten(), np.int64), counts)
            yield _replace(batch, {text_col: pa.array(texts, pa.string())})

    return encoded.mapInArrow(run, _schema(encoded, [T.StructField(text_col, T.StringType())]))


def bpe_round_trip(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Adds ``ids`` and ``decoded`` in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, encoder = loaded(shared.value)
        for batch in batches:
            at = batch.schema.names.index(text_col)
            for a, b in slices(batch.column(at), SLICE):
                part = batch.slice(a, b - a)
                ids, counts = encoder.encode(part.column(at).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                texts = decode(v, ids, counts)
                yield _replace(part, {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())), "decoded": pa.array(texts, pa.string())})

    new = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return docs.mapInArrow(run, _schema(docs, new))


def digests(round_trip: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the result of bpe_round_trip."""
    return round_trip.select(
        F.col(id_col).alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
