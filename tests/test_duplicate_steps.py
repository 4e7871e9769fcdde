"""Families of near copies under one title: each set is compared with the oldest ones first, not with all of them."""

import random

from pyspark.sql import functions as F

from lexloom.operators import lifecycle


def test_families_are_not_compared_pair_by_pair(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    family = [[w for i, w in enumerate(words) if i != k] for k in range(40)]  # any two are alike
    others = [[f"x{k}{w}" for w in words] for k in range(5)] + [words[:30], [], []]
    texts = family + others
    rows = spark.createDataFrame([(k, "f", x) for k, x in enumerate(texts)] + [(99, "g", family[0])], "id long, fingerprint string, tokens array<string>")
    compared, counted = lifecycle._compared, []

    def counting(met, *rest):
        counted.append(met.count())
        return compared(met, *rest)

    monkeypatch.setattr(lifecycle, "_compared", counting)
    got = {r.candidate: r.duplicate_of for r in lifecycle.duplicate_of(rows, rows).collect()}
    like = lambda a, b: a == b or len(set(a) & set(b)) >= 0.92 * len(set(a) | set(b))
    want = {k: next((j for j in range(k) if like(texts[j], x)), None) for k, x in enumerate(texts)}
    assert got == {k: j for k, j in want.items() if j is not None}
    assert sum(counted) <= 2 * len(texts)


def test_words_of_lone_rows_do_not_travel(spark):
    rows = spark.range(50).select("id", F.concat(F.lit("f"), "id").alias("fingerprint"), F.array(F.lit("a"), F.lit("b")).alias("tokens"))
    assert lifecycle.duplicate_of(rows, rows).count() == 0


def test_unlike_texts_of_a_title_are_told_apart_where_they_meet(spark, monkeypatch):
    """Long texts of common words share some of their first words; a row for each such pair grows with the square of a title's texts."""
    some = random.Random(1)
    texts = [[f"w{i}" for i in sorted(some.sample(range(120), 90))] for _ in range(40)]
    texts.append([*texts[3], "one"])
    rows = spark.createDataFrame([(k, "f", x) for k, x in enumerate(texts)] + [(99, None, texts[0]), (None, "f", texts[1])], "id long, fingerprint string, tokens array<string>")
    compared, counted = lifecycle._compared, []

    def counting(met, *rest):
        counted.append(met.count())
        return compared(met, *rest)

    monkeypatch.setattr(lifecycle, "_compared", counting)
    got = {r.candidate: r.duplicate_of for r in lifecycle.duplicate_of(rows, rows).collect()}
    like = lambda a, b: a == b or len(set(a) & set(b)) >= 0.92 * len(set(a) | set(b))
    want = {k: next((j for j in range(k) if like(texts[j], x)), None) for k, x in enumerate(texts)}
    assert got == {k: j for k, j in want.items() if j is not None} and got[40] == 3
    assert sum(counted) <= 2 * len(texts)


def test_known_rows_apart_from_the_candidates(spark):
    words = [f"w{k}" for k in range(60)]
    known = spark.createDataFrame([(1, "f", words[:59]), (2, "f", words), (3, "g", words), (None, "f", words[1:])], "id long, fingerprint string, tokens array<string>")
    asked = spark.createDataFrame([(10, "f", words), (11, "f", words[1:]), (12, "h", words), (13, "g", words[:30])], "id long, fingerprint string, tokens array<string>")
    assert {r.candidate: r.duplicate_of for r in lifecycle.duplicate_of(asked, known).collect()} == {10: 1, 11: 1}


def test_sets_do_not_meet_on_common_words(spark, monkeypatch):
    """Texts of one title that share their common words and nothing else: pairs that meet grow with the square of a word's sets."""
    texts = [[f"common{i}" for i in range(20)] + [f"own{k}-{i}" for i in range(20)] for k in range(60)]
    texts.append([*texts[5][1:], "new"])
    rows = spark.createDataFrame([(k, "f", x) for k, x in enumerate(texts)], "id long, fingerprint string, tokens array<string>")
    monkeypatch.setattr(lifecycle, "COMMON", 20, raising=False)
    first, most = lifecycle._first_words, []

    def counting(*args):
        out = first(*args)
        most.append(out.groupBy("word").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(lifecycle, "_first_words", counting)
    assert [tuple(r) for r in lifecycle.duplicate_of(rows, rows).collect()] == [(60, 5)]
    assert most and max(most) <= 2
