import math
import random
import re

import pytest
from pyspark.sql import functions as F

from waymark.llm import toxicity
from waymark.llm.queries import op12_toxicity
from waymark.llm.toxicity import Lexicon, Matcher, fold


@pytest.mark.parametrize(
    ("text", "folded"),
    [
        (None, " "), ("", " "), ("12 34 -- !", " "), ("Idiot!", " idiot "), ("1D10T, 1d10t", " idiot idiot "), ("ідіот", " idiot ".replace("d", "д")), ("ѕсum", " scum "), ("st­up​id", " stupid "),
        ("ÉCLAIR ﬁne", " eciair fine "), ("$tup1d tr@sh", " stupid trash "), ("tel 555-0147 x2", " tei xz "), ("Lies! lies", " iies iies "), ("а‍", " a "), ("漢字 trash", " 漢字 trash "), ("Ⓘⓓⓘⓞⓣ", " idiot "),
    ],
)
def test_folding(text, folded):
    assert fold(text) == folded


def brute(lexicon, folded):
    """All terms and exceptions tried at all places."""
    hits, shields = {}, []
    for t, w in lexicon.weights.items():
        for m in re.finditer(f"(?={re.escape(t)})", folded):
            best = hits.get(m.start(), (0, 0.0))
            hits[m.start()] = max(best, (m.start() + len(t), w), key=lambda h: (h[1], h[0]))
    for t in lexicon.exceptions:
        shields += [(m.start(), m.start() + len(t)) for m in re.finditer(f"(?={re.escape(t)})", folded)]
    return sorted((s, e, w) for s, (e, w) in hits.items() if not any(a <= s and e <= b for a, b in shields))


def test_matching_equals_brute_force():
    rng = random.Random(2)
    words = ["ab", "abc", "abcd", "b", "can", "x"]
    for _ in range(200):
        entries = {rng.choice(words) + rng.choice(["", "*", " can"]): rng.randint(1, 9) / 2 for _ in range(4)}
        lexicon = Lexicon.of(entries, [f"{rng.choice(words)} {rng.choice(words)}" for _ in range(3)])
        text = fold(" ".join(rng.choice(words) for _ in range(30)))
        assert sorted(Matcher(lexicon).matches(text)) == brute(lexicon, text)


def test_exceptions_and_length(spark):
    lexicon = Lexicon.of({"trash": 4.0, "scum*": 5.0}, ["trash can"], slope=2.0, intercept=-2.0)
    rows = [(1, "The trash can.", 5), (2, "you TR4SH", 5), (3, "scumbags " + "word " * 399, 5), (None, None, 5), (4, "", 5), (2, "you TR4SH", 5), (5, "a " * 200_000 + "trash", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Score int")
    out = toxicity.score(df, lexicon)
    assert out.columns == ["doc_id", "text", "score", "predicted", "evidence", "n_matches"]
    got = sorted((r["doc_id"] or 0, round(r["score"], 6), r["predicted"], r["n_matches"]) for r in out.collect())
    p = lambda x: round(1 / (1 + math.exp(2 - 2 * x)), 6)
    assert got == [(0, p(0), 0, 0), (1, p(0), 0, 0), (2, p(4 / 2**0.5), 1, 1), (2, p(4 / 2**0.5), 1, 1), (3, p(5 / 20), 0, 1), (4, p(0), 0, 0), (5, p(4 / 200_001**0.5), 0, 1)]
    assert toxicity.score(df.limit(0), lexicon).count() == 0
    assert [r["score"] for r in toxicity.score(df, Lexicon({})).collect()] == [0.0] * len(rows)


def test_learns_words_beginnings_and_exceptions(spark):
    rng = random.Random(6)
    plain = [f"{a}{b}{c}" for a in "bdfgkm" for b in "aeou" for c in ("ra", "ne", "to")]
    docs, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if toxic:
            words += rng.sample(["vermin", "verm1n", "sludge" + rng.choice(plain), "ѕludge" + rng.choice(plain)], 2)
        elif i % 3 == 0:
            words += ["vermin", "control"]
        rng.shuffle(words) if toxic else None
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (0, None), (5000, 1), (1, 0)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    lexicon = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert toxicity.term("vermin control") in lexicon.exceptions
    assert len(lexicon.exceptions) < 4
    fresh = [(1, "bara VERMIN fane"), (2, "bara vermin control fane"), (3, "sIudgebara dora"), (4, "bara fane dora"), (5, "v3rmin")]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(spark.createDataFrame(fresh, "doc_id long, text string"), lexicon).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0, 5: 1}


def test_training_without_one_class_or_any_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 0), (2, 0)], [(1, 1)], [(None, 1), (1, None)], [(1, 1), (2, 0)]):
        lexicon = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert not lexicon.weights
        assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, lexicon).collect())
    assert toxicity.train(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).weights == {}


def test_held_out_labels_are_predicted(spark):
    path = "/root/testdata/sf0.1"
    out = op12_toxicity(spark, path)
    rows = out.join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    toxic, clean = ([r for r in rows if r["toxic"] == c] for c in (1, 0))
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    wins = sum((a["score"] > b["score"]) + (a["score"] == b["score"]) / 2 for a in toxic for b in clean)
    assert wins >= 0.95 * len(toxic) * len(clean)
    assert out.where(F.col("score").isNull() | F.col("predicted").isNull()).count() == 0
