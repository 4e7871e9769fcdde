"""Pruned top-k cosine against brute force, and how many documents it reads."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from lexloom.operators import pruned, vocabulary


def expected(docs, queries, k, weight=lambda x: 1.0):
    bags = lambda rows: [(i, {t: n * weight(t) for t, n in Counter(x or []).items()}) for i, x in rows if i is not None]
    length = lambda bag: math.sqrt(sum(w * w for w in bag.values()))
    out = []
    for q, asked in bags(queries):
        found = []
        for i, held in bags(docs):
            if shared := asked.keys() & held.keys():
                found.append((-round(sum(asked[t] * held[t] for t in shared) / (length(asked) * length(held)), 6), i))
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def made(rng, n, words, least=1, most=60):
    # few words are common and many rare, like in texts
    weights = [1 / (k + 1) for k in range(len(words))]
    return [(k, rng.choices(words, weights, k=rng.randint(least, most))) for k in range(n)]


def got(df):
    return sorted((r.query_id, r.rank, r.id, r.cosine) for r in df.collect())


@pytest.mark.parametrize(("shard", "at_once"), [(1 << 20, 2048), (300, 7)])
def test_equals_brute_force(spark, shard, at_once):
    rng = random.Random(shard)
    words = [f"w{k}" for k in range(400)]
    docs = [*made(rng, 500, words), (1000, None), (1001, []), (None, ["w1"]), *[(2000 + k, ["w3", "w9"]) for k in range(40)], (3000, ["w0"] * 50_000)]
    queries = [*made(rng, 25, words, 3, 20), (50, []), (51, None), (52, ["nowhere"]), (53, ["w3", "w9"]), (54, ["w0", "nowhere"])]
    schema = "id long, tokens array<string>"
    d, q = spark.createDataFrame(docs, schema).repartition(3), spark.createDataFrame(queries, schema)
    assert got(pruned.top_cosine(d, q, 5, None, shard, at_once)) == expected(docs, queries, 5)


def test_with_vocabulary(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    docs, queries = made(rng, 120, words), made(rng, 10, [*words, "unheard"], 3, 20)
    schema = "id long, tokens array<string>"
    d, q = spark.createDataFrame(docs, schema), spark.createDataFrame(queries, schema)
    known = vocabulary.vocabulary(d, d["tokens"])
    idf = {r.token: r.idf for r in known.collect()}
    unknown = known.first().unknown_idf
    assert got(pruned.top_cosine(d, q, 5, known, 500)) == expected(docs, queries, 5, lambda x: idf.get(x, unknown))


def test_empty(spark):
    none = spark.createDataFrame([], "id long, tokens array<string>")
    some = spark.createDataFrame([(1, ["a"])], "id long, tokens array<string>")
    assert got(pruned.top_cosine(none, some, 3)) == got(pruned.top_cosine(some, none, 3)) == []


def test_reads_few_documents(spark):
    """Of all pairs, which all share common words, a small part is read whole; the result is the same."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    docs, queries = made(rng, 4000, words, 20, 60), made(rng, 20, words, 20, 40)
    df = spark.createDataFrame(docs, "id long, tokens array<string>").coalesce(1)
    made_shards = [pruned.Shard(r.terms, np.ones(len(r.terms)), [bytes(x) for x in r.packed]) for r in pruned.shards(df, 20_000).orderBy("shard").collect()]
    assert len(made_shards) > 4
    want = expected(docs, queries, 5)
    out = []
    for q, tokens in queries:
        counts = Counter(tokens)
        size = math.sqrt(sum(n * n for n in counts.values()))
        best = pruned.Best(5)
        for s in made_shards:
            s.best([(t, n / size) for t, n in counts.items()], best)
        out += [(q, rank + 1, int(i), round(float(x), 6)) for rank, (i, x) in enumerate(zip(best.ids, best.scores, strict=True))]
    assert sorted(out) == want
    asked = {q: set(tokens) for q, tokens in queries}
    postings = sum(len(set(tokens) & words) for _, tokens in docs for words in asked.values())
    print(sum(s.read for s in made_shards), len(docs) * len(queries), sum(s.scanned for s in made_shards), postings)
    assert sum(s.read for s in made_shards) < len(docs) * len(queries) / 20
    assert sum(s.scanned for s in made_shards) < postings
