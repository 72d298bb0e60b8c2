"""Shard numbers against plain prefix sums, and many rows that are alike."""

import random
import zlib

import pytest

from waymark.llm import sharding


def brute(rows, n_shards):
    """(id, size, checksum, shard, slot) in the order of ids, sizes and checksums; a row goes where its middle lies."""
    keyed = [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows]
    keyed.sort(key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    total, before, out, slots = sum(r[1] for r in keyed), 0, [], {}
    for d, size, crc in keyed:
        shard = min(n_shards - 1, (2 * before + size) * n_shards // (2 * total))
        out.append((d, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return out


def key(r):
    return tuple((x is not None, x or 0) for x in r)


@pytest.mark.parametrize("seed,shards", [(1, 24), (2, 3), (3, 7)])
def test_one_partition_equals_plain_sums(spark, seed, shards):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "é" * rng.randrange(30), "x" * rng.randrange(300)])) for _ in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.balanced_shards(df, n_shards=shards, rows_per_partition=10_000).select("doc_id", "size", "text_crc32", "shard", "slot")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, shards), key=key)


def test_many_alike_rows_are_all_placed(spark):
    df = spark.range(20_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'the same text' AS text").unionAll(spark.range(10_000).selectExpr("id", "repeat('y', CAST(id % 50 AS INT))"))
    rows = sharding.balanced_shards(df, n_shards=8, rows_per_partition=1000).collect()
    assert len(rows) == 30_000
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    total = sum(r.size for r in rows)
    for shard in by.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
        assert abs(sum(r.size for r in shard) - total / 8) <= 60
