import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from waymark.llm import periodic
from waymark.llm.queries import with_planted_period


def plain_runs(words, min_words, min_repeats):
    """Each stretch of words that agree at a distance, tried one by one."""
    n, least = len(words), {}
    for q in range(1, n // min_repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_words, min_repeats * q):
                least.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def made(rng, letters):
    words = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(0, 120))]
    for _ in range(rng.randint(0, 3)):
        unit = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(1, 40))]
        words = (words + unit * rng.randint(2, 9))[: -rng.randint(1, 9)]
    return words


def test_every_difference_of_places_occurs_in_the_cover():
    differences = {(a - b) % periodic.MODULUS for a in periodic.COVER for b in periodic.COVER}
    assert differences == set(range(periodic.MODULUS))


def test_extensions_equal_plain_counting():
    rng = random.Random(3)
    for letters in (1, 2, 40):
        x = np.array([rng.randrange(letters) for _ in range(300)] + [letters])
        extend = periodic.Extensions(x)
        pairs = [(i, j) for i in range(0, 300, 7) for j in range(i + 1, 301, 11)]
        wanted = []
        for i, j in pairs:
            n = 0
            while j + n <= 300 and x[i + n] == x[j + n]:
                n += 1
            wanted.append(n)
        a, b = (np.array(c) for c in zip(*pairs, strict=True))
        assert extend(a, b).tolist() == wanted


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(150):
        texts = [made(rng, rng.choice([1, 2, 3, 5, 30])) for _ in range(rng.randint(1, 6))]
        for limits in ((24, 3), (6, 2), (10, 4)):
            wanted = [(d, *r) for d, words in enumerate(texts) for r in plain_runs(words, *limits)]
            assert [tuple(r) for r in periodic.find_in(texts, *limits).tolist()] == wanted


def test_one_long_text_of_one_word_and_one_with_a_long_period():
    words = [b"a"] * 60_000
    assert periodic.find_in([words]).tolist() == [[0, 0, 60_000, 1]]
    words = [b"%d" % i for i in range(50_000)] + [b"%d" % (i % 4_999) for i in range(40_000)]
    assert [0, 49_999 + 1, 40_000, 4_999] in periodic.find_in([words]).tolist()


def test_odd_rows_and_clashing_columns(spark):
    repeated = "x y z " * 10
    rows = [(1, None, 7, "c"), (1, "", 7, "c"), (None, "\t \n", 7, None), (2, repeated, 7, "c"), (2, repeated, 7, "c"), (3, "a " * 24 + "É é", None, "c"), (4, "a " * 23, 7, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Runs int, collapsed string")
    out = periodic.find_runs(df)
    assert out.columns == ["doc_id", "text", "n_words", "runs", "collapsed", "collapsed_sha256"]
    got = sorted(((r["doc_id"] or 0), r["text"] or "", r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect())
    assert got == [
        (0, "\t \n", 0, [], ""), (1, "", 0, [], ""), (1, "", 0, [], ""), (2, repeated, 30, [(0, 30, 3)], "x y z"), (2, repeated, 30, [(0, 30, 3)], "x y z"),
        (3, "a " * 24 + "É é", 26, [(0, 24, 1)], "a É é"), (4, "a " * 23, 23, [], " ".join("a" * 23)),
    ]
    assert all(r["collapsed_sha256"] == hashlib.sha256(r["collapsed"].encode()).hexdigest() for r in out.collect())
    assert periodic.find_runs(df.limit(0)).count() == 0


def test_planted_periods_follow_the_rule(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 37))) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, "a b"), (5, None)], "doc_id long, text string")
    got = df.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"), with_planted_period(F.col("text"), F.col("doc_id")).alias("new")).collect()
    changed = 0
    for r in got:
        words = (r["text"] or "").split()
        if r["h"] is not None and r["h"] % 10 == 0 and words:
            g, n = r["h"] // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        assert (r["new"] or "").split() == words
    assert changed > 20
