import hashlib
import re

import corpus_pipeline as p
from tests.llm.test_neardup import brute
from waymark.llm import decontaminate, language

SF = "/root/testdata/sf0.01"


def mixed(docs, seed):
    """How often each document of one source is taken: whole passes over the source and, in seeded order, as much as is left."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in docs.items()}
    names = sorted({r.source for r in docs.values()}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d] for d, r in docs.items() if r.source == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(total.values())
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * total[s]]:
        for s in over:
            target[s] = 3 * total[s]
        free -= set(over)
        left = sum(total.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    out = {}
    for s in names:
        own = [d for d, r in docs.items() if r.source == s]
        own.sort(key=lambda d: (int(hashlib.md5(f"{seed}:{d}:{size[d]}".encode()).hexdigest()[:15], 16), d))
        passes, rest = divmod(int(target[s]), total[s]) if total[s] else (0, 0)
        before = 0
        for d in own:
            n = (passes + (2 * before + size[d] <= 2 * rest)) if size[d] else 0
            before += size[d]
            if n:
                out[d] = n
    return out


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    one = p.identify_language(spark, docs, SF).cache()
    kept = {r.doc_id: r for r in one.collect()}
    classifier = language.Classifier(model := language.train(docs))
    want = {d for d, r in before.items() if (x := classifier.classify(r.text))[0] != "und" and x[1] >= model.min_margin}
    assert set(kept) == want and len(want) > 0.97 * len(before)

    two = p.drop_near_duplicates(spark, one, SF).cache()
    groups = brute({d: r.text for d, r in kept.items()}, 5)
    assert {r.doc_id for r in two.collect()} == {d for d, x in groups.items() if x[2]}

    three = p.drop_benchmark_passages(spark, two, SF).cache()
    items = decontaminate.Passages([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], decontaminate.MAX_ERROR)
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect() if not decontaminate.occurrences(items, r.text)}

    four = p.mix_sources(spark, three, SF).cache()
    rows = four.collect()
    times = {}
    for r in rows:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3 and set(times) <= {r.doc_id for r in three.collect()}
    assert times == mixed({r.doc_id: r for r in three.collect()}, p.SEED)
    assert four.columns == p.COLUMNS

    five = p.shard(spark, four, SF).collect()
    assert sorted(r.doc_id for r in five) == sorted(r.doc_id for r in rows)
    assert len({(r.shard, r.slot) for r in five}) == len(five)


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, copies int"
    for rows in ([], [(1, None, None, None, None, 0, 0), (2, "", None, None, 0, 0, 0), (None, "the of and that", "en", "a", 3, 0, 0), (3, "der die das und", "de", None, 3, 0, 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in p.STAGES:
            docs = stage(spark, docs, SF)
            docs.count()
