"""Demand adoption and greedy coverage against the folds that define them, on random inputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import demand, queues, scheduling

NOW = dt.datetime(2024, 6, 1)


def fold(searches, threshold, existing=()):
    """Units in order of search, one by one; searches: platform, user, filters, unit, tokens, name, wording, search."""
    like = lambda a, b: max(demand._jaccard(set(a), set(b)), demand._jaccard(demand._grams(a), demand._grams(b)))
    units, best = {}, {}
    for p, f, unit, tokens, wording, search in existing:
        units.setdefault((p, f), {})[unit] = [tokens, wording, search]
    for p, user, f, unit, tokens, name, wording, search in sorted(searches, key=lambda r: (r[1], r[3], r[7])):
        held = units.setdefault((p, f), {})
        target, likeness, exact = unit, 1.0, True
        if unit in held:
            if wording and (not held[unit][1] or len(wording) < len(held[unit][1])):
                held[unit][1:] = [wording, search]
        elif near := sorted((-like(tokens, x[0]), u) for u, x in held.items() if like(tokens, x[0]) >= threshold):
            (likeness, target), exact = (-near[0][0], near[0][1]), False
        else:
            held[unit] = [tokens, wording, search]
        rank = (not exact, -likeness, len(wording) if wording else 1 << 30, search)
        best[target, user] = min(best.get((target, user), (rank, name, search)), (rank, name, search))
    speaks = {u: x[2] for held in units.values() for u, x in held.items()}
    return {(u, user, name, search) for (u, user), (_, name, search) in best.items()}, {(u, speaks[u]) for u, _ in best}


def made(seed, n):
    rng = random.Random(seed)
    words = ["java", "python", "go", "golang", "backend", "developer", "developers", "engineer", "data", "ml", "ops", "qa"]
    out = []
    for k in range(n):
        p = "web" if rng.random() < 0.8 else "api"
        tokens = sorted(set(rng.choices(words, k=rng.randint(1, 5))))
        unit = f"{p}:{' '.join(tokens)}"
        out.append((p, rng.randrange(12), "{}", unit, tokens, f"n{k}", rng.choice(["", None, "x" * rng.randint(1, 6)]), f"s{k:04}"))
    return out


SEARCHES = "platform string, user_id int, filters string, unit_id string, tokens array<string>, name string, wording string, search string"
EXISTING = "platform string, filters string, unit_id string, tokens array<string>, wording string, search string"


@pytest.mark.parametrize(("seed", "threshold", "step"), [(1, 0.5, 8), (2, 0.6, 1 << 16), (3, 0.3, 20)])
def test_demand_equals_the_fold(spark, seed, threshold, step):
    searches = made(seed, 160)
    existing = [("web", "{}", "web:go python", ["go", "python"], "go", "old1"), ("api", "{}", "api:qa", ["qa"], None, "old2")]
    units, subscriptions = demand.compile_demand(spark.createDataFrame(searches, SEARCHES), threshold, spark.createDataFrame(existing, EXISTING), first_step=step)
    want, speaking = fold(searches, threshold, existing)
    assert {tuple(r) for r in subscriptions.select("unit_id", "user_id", "name", "search").collect()} == want
    assert {(r.unit_id, r["query"]) for r in units.collect()} == speaking


def test_demand_of_nothing(spark):
    units, subscriptions = demand.compile_demand(spark.createDataFrame([], SEARCHES), 0.5)
    assert units.count() == subscriptions.count() == 0


def test_one_large_group_is_several_tasks(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(900)]
    searches = [("web", k % 50, "{}", f"u{k:05}", sorted(rng.sample(words, 4)), "n", "w", f"s{k}") for k in range(3000)]
    rows = spark.createDataFrame(searches, SEARCHES)
    keys = demand._keys(rows.withColumn("resolved", F.col("tokens")).withColumn("grams", F.col("tokens")), 0.5)
    per_word = keys.groupBy("platform", "filters", "kind", "word").count().agg(F.max("count")).first()[0]
    assert per_word < 3000 / 20  # what meets in one place is a small part of the group


def greedy(units, budget):
    """(platform, unit, picked) by counting every unit anew for each choice."""
    out = set()
    for platform in {u[0] for u in units}:
        mine = sorted((when, unit, set(users)) for p, unit, when, users in units if p == platform and when <= NOW and users)
        left, taken = set().union(*(u for *_, u in mine)) if len(mine) > budget else set(), []
        while len(taken) < budget and left:
            gain, at = max(((len(users & left), -n) for n, (_, unit, users) in enumerate(mine) if unit not in taken), default=(0, 0))
            if not gain:
                break
            taken.append(mine[-at][1])
            left -= mine[-at][2]
        taken = (taken + [u for _, u, _ in mine if u not in taken])[:budget]
        out |= {(platform, u, k + 1) for k, u in enumerate(taken)}
    return out


@pytest.mark.parametrize(("seed", "budget", "users"), [(1, 5, 30), (2, 9, 400), (3, 3, 6)])
def test_coverage_equals_the_choice_one_by_one(spark, seed, budget, users):
    rng = random.Random(seed)
    units = [(rng.choice(["web", "web", "web", "api"]), f"u{k:03}", dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(200)), [f"p{rng.randrange(users)}" for _ in range(rng.randrange(0, 12))]) for k in range(120)]
    units.append(("tiny", "t1", dt.datetime(2024, 1, 1), ["p1", "p1"]))
    got = scheduling.pick_due(spark.createDataFrame(units, "platform string, unit_id string, next_run_at timestamp_ntz, subscribers array<string>"), budget, NOW)
    assert {tuple(r) for r in got.select("platform", "unit_id", "picked").collect()} == greedy(units, budget)


def test_numbered(spark):
    rows = spark.createDataFrame([(x,) for x in [5, 3, 3, None, 9, 1, 7] * 30], "x int")
    got = [(r.n, r.x) for r in queues.numbered(rows, "n", "x").collect()]
    assert sorted(n for n, _ in got) == list(range(210))
    assert [x for _, x in sorted(got, key=lambda r: r[0])] == [None] * 30 + sorted(x for x in [5, 3, 3, 9, 1, 7] * 30)
    assert queues.numbered(rows.limit(0), "n", "x").count() == 0
