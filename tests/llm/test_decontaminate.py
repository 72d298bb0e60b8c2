import random

import numpy as np
import pytest

from waymark.llm import decontaminate as d
from waymark.llm import queries

SF = "/root/testdata/sf0.01"


def least_edits(passage, text):
    """Fewest edits of the passage against any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(passage):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def norm(text):
    return "".join(map(chr, d.normalised(text)))


def codes(text):
    return np.array([ord(x) for x in text], np.uint32)


def edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice("abcxyz")
        elif kind == 1:
            del text[at]
        else:
            text.insert(at, rng.choice("abcxyz"))
    return "".join(text)


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 8))) for _ in range(words))


@pytest.mark.parametrize("seed", range(25))
def test_occurrences_equal_the_full_table(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice([1, 2, 5, 12, 30]))) for i in range(6)] + [(6, "?!"), (7, "")]
    text = prose(rng, 30)
    for i, t in items[:4]:
        text += " " + edited(rng, t, rng.randrange(1 + int(0.16 * len(t)))) + " " + prose(rng, rng.randrange(6))
    passages = d.Passages(items, 0.1)
    got = {i: e for i, e, _ in d.occurrences(passages, text)}
    want = {}
    for i, t in items:
        p = norm(t)
        if p and (e := least_edits(p, norm(text))) <= int(0.1 * len(p)):
            want[i] = e
    assert got == want


def test_alignment_at_the_ends():
    a = codes("abcdef")
    assert d.aligned(a, codes("abcdef"), 0, 0, 1)[0] == 0
    assert d.aligned(a, codes("bcdefzz"), -1, 0, 2)[0] == 1
    assert d.aligned(a, codes("zzzz"), 0, 0, 2) is None
    assert d.aligned(a, np.zeros(0, np.uint32), 0, 0, 1) is None


def test_query_finds_every_planted_passage(spark):
    docs = {r.doc_id: norm(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.edits for r in queries.op10_decontaminate(spark, SF).collect()}
    exact = {(a, b) for a, t in docs.items() for b, p in items.items() if p in t}
    assert exact and exact == {k for k, e in got.items() if e == 0}
    for (a, b), e in got.items():
        if e:
            assert least_edits(items[b], docs[a]) == e


def test_odd_tables_and_blocks(spark):
    docs = spark.createDataFrame([(1, "xx The quick, brown fox jumps over it."), (2, None), (3, ""), (None, "the quick brown fox jumps")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "The quick brown fox jumps"), (2, None), (3, "..."), (4, "an absent passage of words")], "item_id long, text string")
    want = {(1, 1), (None, 1)}
    for size in (1 << 20, 20):
        assert {(r.doc_id, r.item_id) for r in d.find_passages(docs, bench, block_bytes=size).collect()} == want
    assert d.find_passages(docs.where("false"), bench).count() == 0
    assert d.find_passages(docs, bench.where("false")).count() == 0


def test_segments_of_long_and_repetitive_texts_change_nothing(monkeypatch):
    rng = random.Random(5)
    items = [("p", prose(rng, 12)), ("q", "ab " * 40), ("r", prose(rng, 3))]
    passages = d.Passages(items, 0.1)
    text = prose(rng, 400)
    for _ in range(12):
        text += " " + edited(rng, items[rng.randrange(3)][1], 2) + " " + prose(rng, 60)
    text += " " + "ab " * 300
    whole = d.occurrences(passages, text)
    monkeypatch.setattr(d, "SEGMENT", 300)
    assert d.occurrences(passages, text) == whole
    assert {i for i, e, _ in whole if e == 0} >= {"q"}
    monkeypatch.undo()
    assert d.occurrences(passages, "ab " * 200_000)[0][:2] == ("q", 0)


def test_repeated_passages_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "see the quick brown fox jumps", 7), (1, "see the quick brown fox jumps", 7), (2, "other words", 8)], "doc_id long, text string, item_id long")
    docs = docs.selectExpr("*", "1 AS passage", "2 AS edits")
    bench = spark.createDataFrame([(1, "The quick brown fox jumps"), (1, "The quick brown fox jumps"), (5, "The quick brown fox jumps"), (None, "The quick brown fox jumps")], "item_id long, text string")
    for size in (1 << 20, 10):
        got = sorted(((r.doc_id, r.item_id) for r in d.find_passages(docs, bench, block_bytes=size).collect()), key=str)
        assert got == sorted([(1, 1)] * 4 + [(1, 5)] * 2 + [(1, None)] * 2, key=str)
        left = d.without_passages(docs, bench, block_bytes=size)
        assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [2]


def test_many_blocks_and_rounds_of_passages(spark, monkeypatch):
    rng = random.Random(12)
    items = [(i, prose(rng, 8)) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [prose(rng, 20) + (" " + edited(rng, items[i % 60][1], 1) + " " + prose(rng, 5) if i % 3 == 0 else "") for i in range(200)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts * 2)], "doc_id long, text string, passage string")
    size = sum(len(t) for _, t in items)
    monkeypatch.setattr(d, "TEXT_BYTES", 4000)
    want = d.find_passages(docs, bench)
    hits, left = sorted(map(tuple, want.collect())), None
    assert len(hits) >= 134
    for options in ({"block_bytes": size // 20}, {"block_bytes": size // 20, "round_bytes": size // 3}):
        found = d.find_passages(docs, bench, **options)
        if "round_bytes" not in options:  # twenty blocks, and the rows are read once
            assert found._jdf.queryExecution().toString().split("Physical Plan")[1].count("MapInArrow") == 1
        assert sorted(map(tuple, found.collect())) == hits
        kept = sorted(map(tuple, d.without_passages(docs, bench, **options).collect()))
        assert left is None or kept == left
        left = kept
    assert {r[0] for r in left} == set(range(len(texts) * 2)) - {h[0] for h in hits}
