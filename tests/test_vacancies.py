"""Vacancies by batches against a replay of their order, row by row."""

import contextlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from lexloom import registry
from lexloom.functions import text as t
from lexloom.operators import lifecycle, vacancies
from lexloom.plans.store_plans import later_text
from lexloom.session import shared_folder
from lexloom.sources import manifest

DIR = "/root/testdata/sf0.001"
FIELDS = "source string, source_id string, position long, fingerprint string, tokens array<string>, content_hash string"


def alike(a, b, threshold):
    return not (a or b) or len(a & b) / len(a | b) >= threshold


def replay(state, batch, number, threshold):
    """state: key -> id, fingerprint, words, hash, status, target; a batch: key -> position, fingerprint, words, hash."""
    out = {}
    going = {k: (state[k][0] if k in state else number * vacancies.PLACES + row[0], *row[1:]) for k, row in batch.items()}
    after = {k: v for k, v in state.items() if k not in batch}
    for k, (i, fp, words, digest) in sorted(going.items(), key=lambda x: x[1][0]):
        likes = [v[0] for v in after.values() if v[4] == "normalized" and v[1] == fp and alike(words, v[2], threshold)]
        after[k] = (i, fp, words, digest, "duplicate" if likes else "normalized", min(likes, default=None))
        changed = k not in state or state[k][3] != digest
        out[k] = (i, after[k][4], after[k][5], k not in state, not likes and changed, not likes and changed and k in state)
    return after, out


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_the_replay(spark, folder, seed, monkeypatch):
    """Chains of texts each like the next, copies, empty texts, changed fingerprints, a batch that broke off and is repeated."""
    rng, state, threshold = random.Random(seed), {}, 0.6
    for number in range(3):
        batch = {}
        for position in rng.sample(range(100), 40):
            start = rng.randrange(9)
            words = {f"w{x}" for x in range(start, start + rng.choice([0, 4, 5]))}
            batch[rng.choice("ab"), str(rng.randrange(30))] = (position, rng.choice("xxy"), words, rng.choice("pq"))
        rows = spark.createDataFrame([(*k, p, fp, sorted(w), h) for k, (p, fp, w, h) in batch.items()], FIELDS)
        state, want = replay(state, batch, number, threshold)
        if number == 1:
            real = manifest.merge
            with monkeypatch.context() as m, pytest.raises(OSError):
                m.setattr(manifest, "merge", lambda c, f, *a, **k: real(c, f, *a, **k) if f.endswith("index") else (_ for _ in ()).throw(OSError()))
                vacancies.upsert_batch(rows, folder, number, 4, threshold)
        got = vacancies.upsert_batch(rows, folder, number, 4, threshold).collect()
        assert {(r["source"], r["source_id"]): (r["id"], r["status"], r["normalized_id"], r["is_new"], r["needs_score"], r["reset"]) for r in got} == want
        kept = {(r["source"], r["source_id"]): (r["id"], r["fingerprint"], r["status"], r["normalized_id"]) for r in manifest.read(spark, f"{folder}/vacancies").collect()}
        assert kept == {k: (v[0], v[1], v[4], v[5]) for k, v in state.items()}
        index = {(r["fingerprint"], r["id"]) for r in manifest.read(spark, f"{folder}/index").collect()}
        assert index == {(v[1], v[0]) for v in state.values() if v[4] == "normalized"}
    assert vacancies.upsert_batch(rows, folder, 2) is None
    assert {v[4] for v in state.values()} == {"normalized", "duplicate"}


def test_null_and_empty(spark, folder):
    none = spark.createDataFrame([], FIELDS)
    assert vacancies.upsert_batch(none, folder, 0).collect() == []
    rows = spark.createDataFrame([(None, None, 0, None, None, None), ("s", None, 1, None, [], None)], FIELDS)
    assert sorted((r["id"] % vacancies.PLACES, r["status"]) for r in vacancies.upsert_batch(rows, folder, 1).collect()) == [(0, "normalized"), (1, "duplicate")]


def test_vacancy_upserts(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    state = {}
    for number, text in enumerate([F.col("text"), later_text()]):
        text = F.coalesce(text, F.lit(""))
        rows = docs.select("source", "doc_id", t.fingerprint(F.split(text, "\n")[0], F.col("lang")), t.words(text, t.PLAIN), F.sha2(text, 256)).collect()
        state, _ = replay(state, {(r[0], str(r[1])): (r[1], r[2], set(r[3]), r[4]) for r in rows}, number, 0.92)
    got = {(r["source"], r["source_id"]): (r["id"], r["status"], r["normalized_id"]) for r in registry.QUERIES["vacancy_upserts"](spark, DIR).collect()}
    assert got == {k: (v[0], v[4], v[5]) for k, v in state.items()}
    assert {x[1] for x in got.values()} == {"normalized", "duplicate"}


def test_words_of_lone_vacancies_are_kept_once(spark, folder, monkeypatch):
    """A vacancy alone in its fingerprint is compared with none, and one that comes again as it was stays in the index."""
    rows = spark.range(50).select(F.lit("s").alias("source"), "id", F.col("id").alias("position"), F.concat(F.lit("f"), "id").alias("fingerprint"), F.array(F.lit("a"), F.lit("b")).alias("tokens"), F.lit("h").alias("content_hash")).withColumnRenamed("id", "source_id")
    vacancies.upsert_batch(rows, folder, 0, 4)
    held, real = [], vacancies.scratch

    @contextlib.contextmanager
    def counting(session):
        with real(session) as keep:

            def kept(df):
                out = keep(df)
                held.append(out.count() if "words" in out.columns else 0)
                return out

            yield kept

    monkeypatch.setattr(vacancies, "scratch", counting)
    assert {r["status"] for r in vacancies.upsert_batch(rows, folder, 1, 4).collect()} == {"normalized"}
    assert sum(held) == 50
    assert manifest.read(spark, f"{folder}/index").count() == 50


def test_parities_pass_over_no_sets_that_are_alike(spark):
    rng = random.Random(3)
    base = [rng.sample(range(10**6), n) for n in (0, 1, 30, 400, 1500)]
    sets = [set(b[rng.randrange(1 + len(b) // 12) :]) | set(rng.sample(range(10**6), rng.randrange(1 + len(b) // 12))) for b in base for _ in range(6)]
    told = spark.createDataFrame([("f", k, sorted(x)) for k, x in enumerate(sets)], "fingerprint string, set long, words array<long>")
    hashed = told.withColumn("words", F.array_sort(F.transform("words", lambda x: F.xxhash64(x))))
    got = lifecycle.alike_sets(lifecycle.with_parities(hashed), lifecycle.with_parities(hashed))
    want = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if a != b and alike(x, y, lifecycle.SAME_TEXT)}
    assert {(r["set"], r["other"]) for r in got.collect()} == want
    assert 60 < len(want)
