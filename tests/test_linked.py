"""Connected components: hubs, long chains in any order of ids, odd tables, against a plain union-find."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import linked


def plain(nodes, edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            up[max(root(a), root(b))] = min(root(a), root(b))
    met = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    return sorted((n, root(n), n not in met) for n in set(nodes) if n is not None)


@pytest.mark.parametrize("text", [False, True])
def test_random_graphs_against_union_find(spark, text, monkeypatch):
    monkeypatch.setattr(linked, "CHUNK", 7)
    monkeypatch.setattr(linked, "SALTS", 3)
    rng = random.Random(4)
    name = (lambda i: f"n{i}é") if text else (lambda i: i - 20)
    kind = "string" if text else "long"
    for n, m in ((80, 70),):
        nodes = [name(rng.randrange(n)) for _ in range(n)] + [None]
        edges = [(name(rng.randrange(n)), name(rng.randrange(n))) for _ in range(m)] + [(name(1), None), (None, None), (name(2), name(2))]
        edges += edges[:5]
        got = linked.components(spark.createDataFrame([(x,) for x in nodes], f"node {kind}"), spark.createDataFrame(edges, f"a {kind}, b {kind}"))
        assert sorted(map(tuple, got.collect())) == plain(nodes, edges)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert linked.components(spark.createDataFrame([], "node long"), none).collect() == []
    assert [tuple(r) for r in linked.components(spark.range(1).withColumnRenamed("id", "node"), none).collect()] == [(0, 0, True)]


def test_the_leaves_of_a_hub_are_dealt_to_many_parts(spark):
    n = 300_000
    leaves = spark.range(n).select(F.lit(n).alias("a"), F.col("id").alias("b"))  # the hub has the greatest id, so every leaf must move
    rounds = []
    got = linked.components(spark.range(n + 1).withColumnRenamed("id", "node"), leaves, rounds=rounds)
    assert got.where("component <> 0 OR isolated").isEmpty() and got.count() == n + 1 and len(rounds) <= 4
    rows = leaves.select(F.col("a").alias("u"), F.col("b").alias("v"))
    told = linked._with_least(rows)
    parts = rows.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(linked.SALTS))).groupBy("u", "s").count()
    assert parts.agg(F.max("count")).first()[0] < 2 * n / linked.SALTS and told.where("m <> 0").isEmpty()


def test_a_long_chain_in_the_order_of_its_files(spark):
    n, rounds = 300_000, []
    pairs = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = linked.components(spark.range(n).withColumnRenamed("id", "node"), pairs, rounds=rounds)
    assert got.where("component <> 0 OR isolated").isEmpty() and got.count() == n and len(rounds) <= 5  # eight tasks' stars are linked


@pytest.mark.parametrize("shuffled", [False, True])
def test_rounds_of_a_chain_grow_with_its_logarithm(spark, shuffled):
    n, rounds = 5000, []
    ids = np.random.default_rng(1).permutation(n) if shuffled else np.arange(n)
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids[:-1], ids[1:], strict=True)], "a long, b long").repartition(64)
    got = linked.components(spark.range(n).withColumnRenamed("id", "node"), pairs, rounds=rounds)
    assert got.where("component <> 0 OR isolated").isEmpty() and got.count() == n
    assert len(rounds) <= np.log2(n) + 2 and max(rounds) <= 3 * n
