"""Quality rules against a plain reading of their definition, and against labels."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import zstandard
from pyspark.sql import functions as F

from lexloom.llm import quality, queries

DIR = "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\x0c\r"


def plain(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed by definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    repeated = {k + step for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for step in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(x not in WHITE for x in line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def verdicts(texts: list[str]) -> list[bool]:
    """Whether each text that passes the plain rules lies inside the limits, worked out in one place."""
    z = zstandard.ZstdCompressor(level=3)
    rows = {}
    for t in set(texts):
        data = t.encode()
        if plain(t)[-1]:
            continue
        chunks = [len(z.compress(data[k : k + 2048])) / 2048 for k in range(0, len(data) - 2047, 2048)]
        band = min(15, max(8, len(data).bit_length() - 1))
        rows[t] = band, len(data), len(z.compress(data)) / len(data), float(np.median(chunks)) if chunks else None
    good = {t: r[1] < 512 or 0.08 <= r[2] <= 0.97 for t, r in rows.items()}
    for measure in (2, 3):
        bands = defaultdict(list)
        for t, r in rows.items():
            if r[measure] is not None:
                bands[r[0]].append((t, np.log2(r[1]), r[measure]))
        for band, held in bands.items():
            x, y = np.array([h[1] for h in held]), np.array([h[2] for h in held])
            spread = ((x - x.mean()) ** 2).sum()
            slope = ((x - x.mean()) * (y - y.mean())).sum() / spread if spread > 0 else 0.0
            left = y - slope * x - (y.mean() - slope * x.mean())
            bins = np.sort(np.floor(left / 0.0005))
            at = lambda q, b=bins: b[int(np.ceil(q * len(b) - 1e-9)) - 1] * 0.0005
            root = 2.0 ** (band / 2)
            low, high = at(0.5) - max(2.5 * (at(0.5) - at(0.2)), 0.4 / root), at(0.5) + max(5.0 * (at(0.8) - at(0.5)), 2.0 / root)
            for (t, _, _), v in zip(held, left, strict=True):
                good[t] &= bool(low <= v <= high)
    return [good.get(t, False) for t in texts]


def odd_texts() -> list[str | None]:
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 3000))) for _ in range(120)]
    noise = ["".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGH+/ ") for _ in range(4000)) for _ in range(3)]
    few = [" ".join(rng.choice(words[:6]) + rng.choice("#$%") for _ in range(2000)) for _ in range(3)]
    lines = "a b c\n\n \na b c\nd e\na b c \n\r\n\r\n"
    return [None, "", " \t\n", "one", "a b c a b c a b c", "x y " * 40, lines, "é ü|\x1cx <b>", *prose, *noise, *few, *[prose[0]] * 80, "word " * 60_000]


def test_counts_and_verdicts_equal_their_definition(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(None, "null id", "x"), (3, "one", "y")], "doc_id long, text string, ratio string")
    got = quality.assess(docs).collect()
    assert len(got) == len(texts) + 2
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 3)}
    kept = verdicts([t or "" for t in texts])
    for k, t in enumerate(texts):
        if k != 3:
            r = by[k]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), k
            assert r.kept == kept[k], (k, r)
    noise_and_few = [by[k].kept for k in range(128, 134)]
    assert not any(noise_and_few)
    assert np.mean([by[k].kept for k in range(8, 128)]) > 0.9
    # copies do not move limits: all of them are judged like the first
    assert len({by[k].kept for k in range(134, 214)} | {by[8].kept}) == 1
    stay = quality.keep_good(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(k for k, good in enumerate(kept) if good)


def test_query_equals_definition_and_tells_junk(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op11_quality(spark, DIR).collect()}
    assert len(got) == len(docs)
    kept = dict(zip((d.doc_id for d in docs), verdicts([d.text or "" for d in docs]), strict=True))
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(d.text)
        assert r.kept == kept[d.doc_id]
    labels = spark.read.parquet(f"{DIR}/labels.parquet").filter(F.col("quality").isNotNull()).collect()
    good = [got[x.doc_id].kept for x in labels if x.quality == 1 and not got[x.doc_id].base_failed]
    junk = [got[x.doc_id].kept for x in labels if x.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(junk) < 0.15


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.assess(none).count() == 0 and quality.keep_good(none).count() == 0


def test_limits_from_bins():
    # 100 texts in bins 0 .. 99: fifth 19, middle 49, last fifth 79
    low, high = quality.limits_of([(k, 1) for k in range(100)], 1 << 20)
    assert np.isclose(low, (49 - 2.5 * 30) * quality.BIN) and np.isclose(high, (49 + 5 * 30) * quality.BIN)
    # one bin: the least distances
    low, high = quality.limits_of([(10, 5)], 256)
    assert np.isclose(low, 10 * quality.BIN - 0.4 / 16) and np.isclose(high, 10 * quality.BIN + 2.0 / 16)
