"""The flow against a brute-force optimum, and mixes of overlapping sources end to end."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from waymark.llm import mixing


def feasible(flow, members, quota):
    """Whether the patterns' words fit into the quotas: by Hall's condition, over every set of sources."""
    names = list(quota)
    for n in range(1, len(names) + 1):
        for some in itertools.combinations(names, n):
            if sum(w for p, w in flow.items() if set(members[p]) <= set(some)) > sum(quota[s] for s in some):
                return False
    return True


def cost(flow, capacity):
    """The r-th time that a word is taken costs r - 1."""
    total = 0
    for p, w in flow.items():
        level = 0
        while w > 0:
            total += level * min(w, capacity[p])
            w -= capacity[p]
            level += 1
    return total


@pytest.mark.parametrize("seed", range(30))
def test_flow_is_the_cheapest_of_the_largest(seed):
    rng = random.Random(seed)
    sources = ["a", "b", "c"][: rng.randrange(1, 4)]
    sets = [c for n in range(1, len(sources) + 1) for c in itertools.combinations(sources, n)]
    members = {"".join(c): list(c) for c in rng.sample(sets, rng.randrange(1, min(3, len(sets)) + 1))}
    capacity = {p: rng.randrange(0, 4) for p in members}
    quota = {s: rng.randrange(0, 9) for s in sources}
    got = mixing.min_cost_flow(capacity, members, quota, 3)
    options = [dict(zip(members, w, strict=True)) for w in itertools.product(*(range(3 * capacity[p] + 1) for p in members)) ]
    options = [o for o in options if feasible(o, members, quota)]
    most = max(sum(o.values()) for o in options)
    assert feasible(got, members, quota) and sum(got.values()) == most
    assert all(w <= 3 * capacity[p] for p, w in got.items())
    assert cost(got, capacity) == min(cost(o, capacity) for o in options if sum(o.values()) == most)


def test_many_patterns_are_solved_quickly():
    rng = random.Random(1)
    sources = [f"s{i}" for i in range(40)]
    members = {f"p{i}": rng.sample(sources, rng.randrange(1, 5)) for i in range(20_000)}
    capacity = {p: rng.randrange(1, 1000) for p in members}
    total = sum(capacity.values())
    quota = {s: total // 40 for s in sources}
    began = time.perf_counter()
    got = mixing.min_cost_flow(capacity, members, quota, 3)
    assert time.perf_counter() - began < 60
    assert sum(got.values()) == sum(quota.values())


def test_overlapping_sources_end_to_end(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        of = rng.choice([["web"], ["web", "books"], ["books"], ["code", "web"], ["code"], [None]])
        rows.append((i, " ".join(["w"] * rng.randrange(0, 40)), of))
    df = spark.createDataFrame(rows, "doc_id long, text string, of array<string>")
    found = mixing.mix(df, F.col("of"))
    got = {r.doc_id: r for r in found.rows.collect()}
    assert len(got) == len(rows)
    capacity = {}
    for r in got.values():
        capacity[r.pattern] = capacity.get(r.pattern, 0) + r.size
    flow = mixing.min_cost_flow(capacity, found.members, {s: int(t) for s, (_, t) in found.sources.items()}, 3)
    taken = {}
    for i, text, _ in rows:
        r = got[i]
        assert r.size == len(text.split()) and r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.pattern] = taken.get(r.pattern, 0) + r.taken
    for p, words in flow.items():
        assert abs(taken[p] - words) < 40  # less than a document
    # first passes are used up before second ones
    for p in capacity:
        copies = {r.copies for r in got.values() if r.pattern == p and r.size}
        assert max(copies) - min(copies) <= 1
    again = {r.doc_id: r.copies for r in mixing.mix(df.repartition(7), F.col("of")).rows.collect()}
    assert again == {i: r.copies for i, r in got.items()}


def test_carried_rows_take_the_same(spark):
    df = spark.createDataFrame([(i % 50, "a b c " * (i % 9), f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    plain = mixing.mix(df, F.array("source")).rows.groupBy("doc_id", "size", "pattern").agg(F.sum("copies").alias("n")).collect()
    carried = mixing.mix(df, F.array("source"), carry=("doc_id", "text", "source")).rows
    assert carried.where("carried.doc_id <> doc_id").count() == 0
    assert sorted(map(tuple, plain)) == sorted(map(tuple, carried.groupBy("doc_id", "size", "pattern").agg(F.sum("copies").alias("n")).collect()))
