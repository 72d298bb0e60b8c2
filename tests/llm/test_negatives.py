import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import negatives

LONG = 2**63 - 1


def brute(rows, positives=5, k=10, low=30, high=90):
    """All pairs, with Python's integers; a row is (id, label, vector)."""
    sound = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    whole = [(i, lab, [math.floor(256 * x) if abs(x) < 2**60 else int(x) * 256 for x in v]) for i, lab, v in sound]
    score = lambda a, b: max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(a[2], b[2], strict=True))))
    out = []
    for n, a in enumerate(whole):
        if a[0] is None or a[0] % 100:
            continue
        all_scored = [(score(a, b), b) for m, b in enumerate(whole) if m != n and len(b[2]) == len(a[2])]
        ranked = sorted(all_scored, key=lambda s: (-s[0], s[1][0] is None, s[1][0] or 0))
        for ps, p in [s for s in ranked if s[1][1] == a[1]][:positives]:
            fit = [s for s in ranked if s[1][1] != a[1] and low * ps <= 100 * s[0] <= high * ps][:k]
            out += [(a[0], p[0], r, b[0], ps, s) for r, (s, b) in enumerate(fit, 1)]
    return sorted(out, key=str)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, row string")
    found = negatives.mine(df, anchor=F.col("vec_id") % 100 == 0)
    return sorted((tuple(r) for r in found.drop("positive_rank").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


@pytest.mark.parametrize("spread", [1.0, 300.0, 1e7, 1e30])
def test_packed_products_are_exact(spread):
    rng = np.random.default_rng(4)
    for dim in (1, 3, 64):
        a, b = (negatives.integers(rng.normal(size=(n, dim)) * spread, 256) for n in (7, 101))
        got = negatives.Anchors(a).scores(b)
        for i in range(7):
            for j in range(101):
                exact = sum(int(x) * int(y) for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True))
                assert got[i, j] == max(-LONG - 1, min(LONG, exact))


def test_mining_equals_brute_force_with_ties_nulls_repeats_and_lengths(spark):
    rng = random.Random(8)
    rows = []
    for i in range(700):
        near = [rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)] if i % 3 else [0.5, 0.5, 0.5, 0.5]
        rows.append((i if i % 50 else i // 2, rng.choice([0, 1, 1, 2]), near))
    rows += [(None, 1, [1.0, 1.0, 1.0, 1.0]), (None, 2, [1.0, 1.0, 1.0, 1.0]), (800, None, [1.0] * 4), (900, 1, None), (1000, 1, [1.0, None, 1.0, 1.0])]
    rows += [(1100, 1, [float("nan"), 1.0, 1.0, 1.0]), (1200, 1, [float("inf"), 1.0, 1.0, 1.0]), (1300, 1, []), (1301, 1, []), (1302, 2, []), (1400, 2, [1.0]), (1401, 2, [1.0]), (1402, 1, [0.5])]
    assert mined(spark, rows) == brute(rows)


def test_large_components_and_many_cells(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 64)
    monkeypatch.setattr(negatives, "CELL_PRODUCTS", 100)
    rng = random.Random(9)
    rows = [(i, rng.randrange(2), [rng.choice([1e25, -3.0, 7.5, 0.0, 1e9]) for _ in range(3)]) for i in range(0, 800, 10)]
    assert mined(spark, rows) == brute(rows)


def test_empty_tables_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 0, [1.0]), (2, 1, [1.0])]) == []
    assert mined(spark, [(0, 0, [1.0]), (2, 1, [1.0])]) == []
