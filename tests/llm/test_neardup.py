import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import neardup, queries, shingles

SF = "/root/testdata/sf0.01"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(docs, k, percent=80):
    sets = {d: brute_set(t, k) for d, t in docs.items()}
    by_word, label = {}, {d: d for d in docs}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for d, s in sets.items():
        for g in s:
            by_word.setdefault(g, []).append(d)
    for d in sorted(docs):
        common = {}
        for g in sets[d]:
            for o in by_word[g]:
                if o > d:
                    common[o] = common.get(o, 0) + 1
        for o, c in common.items():
            if 100 * c >= percent * (len(sets[d]) + len(sets[o]) - c):
                a, b = sorted((find(d), find(o)))
                label[b] = a
    return {d: (len(sets[d]), find(d), find(d) == d) for d in docs}


def check(rows, docs, k):
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute(docs, k)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_sets_equal_brute_force(k):
    rng = random.Random(k)
    texts = ["", None, " ", "a", "A b", "one Two\tthree\x0bfour  five", "É é", "\x1f x"] + ["".join(rng.choice("aB c\n") for _ in range(rng.randrange(80))) for _ in range(300)]
    got = shingles.shingle_sets(pa.array(texts, pa.string()), k)
    want = [brute_set(t, k) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    for i in range(0, 300, 7):
        for j in range(0, 300, 11):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])
    sliced = shingles.shingle_sets(pa.array(texts, pa.string()).slice(5), k)
    assert all((a == b).all() for a, b in zip(sliced, got[5:], strict=True))


@pytest.mark.parametrize("size", [1, 2, 5, 40, 400])
def test_sketch_fills_and_estimates(size):
    rng = np.random.default_rng(size)
    base = rng.integers(1, 2**63, size=(50, size), dtype=np.uint64)
    cut = max(1, size * 8 // 10)
    other = [np.concatenate((b[:cut], rng.integers(1, 2**63, size=size - cut, dtype=np.uint64))) for b in base]
    s = neardup.sketches([*base, *other], 128)
    assert (s != 0).all()
    agree = (s[:50] == s[50:]).mean()
    assert abs(agree - cut / (2 * size - cut)) < 0.04


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(queries.op1_near_duplicates(spark, SF).collect(), docs, 2)


def test_chains_groups_and_odd_rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    docs, at = {0: "", 1: None, 2: "  \n", 3: "lone", 4: "LONE", 5: "two words", 6: "Two  Words"}, 10
    for _ in range(12):  # chains, each link near the threshold
        words = [word() for _ in range(40)]
        for step in range(10):
            docs[at] = " ".join(words)
            words[(step * 9) % 40] = word()
            at += 1
    base = [word() for _ in range(60)]
    for _ in range(200):  # one large group of near copies
        w = list(base)
        w[rng.randrange(60)] = word()
        w[rng.randrange(60)] = word()
        docs[at] = " ".join(w)
        at += 1
    passage = [word() for _ in range(30)]
    for _ in range(60):  # a passage that many share without being near
        docs[at] = " ".join(passage + [word() for _ in range(rng.randrange(2, 30))])
        at += 1
    for _ in range(30):
        docs[at] = "exact copy of one text"
        at += 1
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("*", "1 as a", "2 as n", "3 as component")
    for k in (2, 5):
        check(neardup.near_duplicates(df, k=k).collect(), docs, k)


def test_rows_without_an_id_and_empty_tables(spark):
    rows = [(None, "a b c"), (None, "a b c"), (7, "a b c"), (9, "a b c"), (9, "a b c"), (None, "x y"), (None, ""), (8, None), (9, "p q r")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df, k=2).collect()), key=str)
    want = [(None, 7, False)] * 2 + [(7, 7, True)] + [(9, 7, False)] * 2 + [(None, None, True)] * 2 + [(8, 8, True), (9, 9, True)]
    assert got == sorted(want, key=str)
    assert neardup.near_duplicates(df.where("false"), k=2).count() == 0
    assert neardup.without_near_duplicates(df.where("false"), k=2).count() == 0


def test_one_row_of_each_group_stays(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join(["other", *base[1:]])
    rows = [
        (5, " ".join(base), "a"), (3, near, "b"), (3, near, "b"), (3, "quite another text here now", "c"), (None, near.upper(), "d"),
        (None, "no id but text", "e"), (None, "no id but text", "f"), (4, "", "g"), (4, None, "h"), (None, None, "i"), (6, "quite another text here now", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, _best string").withColumn("text_key", F.lit(1)).withColumn("component", F.lit("x"))
    out = neardup.without_near_duplicates(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text, r["_best"]) for r in out.collect()), key=str)
    one_of = [r for r in got if r[1] == "no id but text"]
    assert len(one_of) == 1
    rest = [r for r in got if r[1] != "no id but text"]
    assert rest == sorted([(3, near, "b"), (3, "quite another text here now", "c"), (4, "", "g"), (4, None, "h"), (None, None, "i")], key=str)


def slow_sketch(s, t):
    """The definition, one coordinate and shingle after another."""
    mix = lambda v: int(shingles.mix(np.array([v & (1 << 64) - 1], np.uint64))[0])
    out = [None] * t
    for i in range(2 * t):
        x = [mix(int(v) + (i + 1) * 0x9E3779B97F4A7C15) for v in s]
        if i < t:
            fresh = {}
            for h in x:
                b = (h >> 32) * t >> 32
                fresh[b] = min(fresh.get(b, 1 << 64), mix(h))
            for b, v in fresh.items():
                if out[b] is None:
                    out[b] = v + i & (1 << 64) - 1
        elif out[i - t] is None:
            out[i - t] = min(x) + i & (1 << 64) - 1
    return out


@pytest.mark.parametrize("size", [1, 2, 7, 60])
def test_sketch_equals_its_definition(size):
    rng = np.random.default_rng(size)
    sets = [np.sort(rng.integers(1, 2**63, size=size, dtype=np.uint64)) for _ in range(3)]
    assert neardup.sketches([*sets, sets[0][:1]], 16).tolist() == [slow_sketch(s, 16) for s in [*sets, sets[0][:1]]]


def test_large_group_of_near_copies_equals_brute_force(spark):
    """1,500 copies of one text with changes that lie about the threshold, sub-families with a shared change, and shortened copies."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, docs = [word() for _ in range(80)], {}
    families = [[(rng.randrange(80), word()) for _ in range(6)] for _ in range(5)]
    for d in range(1500):
        w = list(base)
        if d % 3 == 0:
            for at, new in families[d % 5]:
                w[at] = new
        for _ in range(rng.randrange(2, 8)):
            w[rng.randrange(80)] = word()
        if d % 7 == 0:
            w = w[: rng.randrange(60, 80)]
        docs[d] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    check(neardup.near_duplicates(df, k=2).collect(), docs, 2)


def test_very_long_text():
    text = "word " * 3_000_000 + "x" * 3_000_000 + " tail"
    got = shingles.shingle_sets(pa.array([text, "a b", text.upper()]), 2)
    assert [len(s) for s in got] == [3, 1, 3]
    assert (got[0] == got[2]).all()


def sections(rng, n, n_sections, common=200, shared=60, own=60):
    """Texts with one text in common, one for each section, and one of their own, whose lengths vary a little."""
    base, parts = [f"c{i}" for i in range(common)], [[f"s{s}x{i}" for i in range(shared)] for s in range(n_sections)]
    return {i: " ".join(base + parts[i % n_sections] + [f"o{i}x{j}" for j in range(own + rng.randrange(-9, 10))]) for i in range(n)}


def test_pages_of_sections_do_not_meet_at_their_sections_text(spark, monkeypatch):
    met, pairs = [], neardup.met_pairs
    monkeypatch.setattr(neardup, "met_pairs", lambda *a: met.append(out := neardup.written(pairs(*a), "met")) or out)
    rows = {}
    for n in (500, 2000):
        docs = sections(random.Random(n), n, 20)
        found = neardup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), k=2).collect()
        assert all(r.kept for r in found)  # no two are linked
        rows[n] = sum(m.count() for m in met)
        met.clear()
    assert rows[2000] <= 4 * rows[500] + 2000  # in proportion to the texts, not to their square


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_near_the_limit_inside_sections_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = sections(rng, 150, 3, 60, 20, 8)
    for i in range(150, 420):  # changed copies of them, of which about half are still linked
        words = docs[rng.randrange(150)].split()
        for _ in range(rng.randrange(0, 14)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(3)] = [f"n{rng.randrange(40)}" for _ in range(rng.randrange(3))]
        docs[i] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    check(neardup.near_duplicates(df, k=1, bands=64, rows=2).collect(), docs, 1)
    check(neardup.near_duplicates(df, k=2, bands=64, rows=2).collect(), docs, 2)
