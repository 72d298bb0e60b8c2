import random
from collections import Counter
from pathlib import Path

from waymark.llm import queries, tokens


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    return [" ".join(rng.choices(words, [1 / (i + 1) for i in range(2000)], k=rng.randrange(40))) for _ in range(n)] + [None, "", "  ", "▁a ▁b", "x" * 500]


def test_a_task_keeps_what_is_frequent_in_a_bounded_table(monkeypatch):
    texts = made(1, 400)
    plain = Counter(p for t in texts if t for p in tokens._PRE_TOKEN.findall(" " + t))
    assert dict(tokens.counted_in_task(iter([texts]))) == {p: n for p, n in plain.items() if len(p) <= tokens.CACHE_CHARS}
    monkeypatch.setattr(tokens, "COUNTED", 300)
    monkeypatch.setattr(tokens, "SHARE", 200)
    found = dict(tokens.counted_in_task(iter([texts[i : i + 10] for i in range(0, len(texts), 10)])))
    often = {p for p, n in plain.items() if n * 100 >= sum(plain.values())}
    assert often <= set(found) and len(found) <= 200
    assert all(found[p] == plain[p] for p in often)


def test_counts_are_exact_with_any_table(spark, monkeypatch):
    texts = made(2, 300)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sp = tokens._processor(Path(queries.piece_model()).read_bytes())
    want = {i: len(sp.encode(t)) if t else 0 for i, t in enumerate(texts)}
    for size in (1, 50, tokens.FREQUENT):
        monkeypatch.setattr(tokens, "FREQUENT", size)
        assert {r.doc_id: r.n_tokens for r in tokens.with_token_counts(df, queries.piece_model()).collect()} == want
    model = Path(queries.piece_model()).read_bytes()
    best = Counter(p for t in texts if t for p in tokens._PRE_TOKEN.findall(" " + t)).most_common(20)
    found = tokens.frequent_lengths(df, "text", model)
    assert {p for p, _ in best} <= set(found)
    assert tokens.frequent_lengths(df.limit(0), "text", model) == {}
    assert tokens.with_token_counts(df.limit(0), queries.piece_model()).count() == 0
