from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline as p
from waymark.llm import decontaminate, mixing, sharding
from waymark.llm.common import shared_root

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_contaminated_rows_go_by_row_and_not_by_id(spark):
    passages = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(2).collect()]
    clean = [(None, "a clean text of its own"), (7, "another clean text"), (7, None), (8, ""), (None, None)]
    bad = [(None, f"before {passages[0]} after"), (7, f"x {passages[1]}"), (9, passages[0])]
    rows = [(d, t, "en", "s", None if i % 2 else i) for i, (d, t) in enumerate(clean + bad)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = Counter(rows[: len(clean)])
    assert Counter(map(tuple, p.drop_benchmark_passages(spark, docs, SF).collect())) == want
    bench = spark.createDataFrame([(1, passages[0]), (2, passages[1]), (3, "an absent passage of words")], "item_id long, text string")
    assert Counter(map(tuple, decontaminate.without_passages(docs, bench, block_bytes=20).collect())) == want
    assert decontaminate.without_passages(docs, bench.where("false")).count() == len(rows)


def test_mix_repeats_rows_and_not_ids(spark):
    rows = [(None if i % 2 else i % 5, " ".join([f"w{i}"] * (1 + i % 9)), "en", "abc"[i % 3] if i < 400 else "d", i) for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = Counter(map(tuple, p.mix_sources(spark, docs, SF).collect()))
    assert set(got) <= set(rows) and max(got.values()) <= 3
    mixed = mixing.mix(docs, F.array("source"), seed=p.SEED)
    words = Counter()
    for r, n in got.items():
        words[r[3]] += n * len(r[1].split())
    assert len(mixed.sources) == 4 and min(words.values()) > 0
    for source, (_, target) in mixed.sources.items():
        assert abs(words[source] - target) <= 10


def files(spark):
    root = Path(shared_root(spark).removeprefix("file:")) / "waymark"
    return {p.name for p in root.iterdir()} if root.exists() else set()


def test_training_shards_hold_the_mixed_texts_and_nothing_else_stays(spark, tmp_path):
    before = files(spark)
    path = str(tmp_path / "shards")
    shards = p.write_training_shards(spark, SF, path)
    assert files(spark) == before  # what the stages wrote on their way is gone
    placed = p.run(spark, SF)
    kept = files(spark) - before
    assert len(kept) == 1 and next(iter(kept)).startswith("stage-sharding")
    places = Counter((r.doc_id, r.size, r.shard) for r in placed.collect())
    rows = shards.collect()
    assert Counter((r.doc_id, len((r.text or "").encode()) + 8, r.shard) for r in rows) == places
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(texts[r.doc_id] == r.text for r in rows)
    for shard in range(p.SHARDS):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
        read = [s for f in sorted(Path(path, f"shard={shard}").glob("*.parquet")) for s in pq.read_table(f, columns=["slot"])["slot"].to_pylist()]
        assert read == slots  # the files hold the rows in order


def test_shards_of_odd_rows_with_clashing_columns(spark, tmp_path):
    rows = [(None, None, 1, "a"), (None, None, 2, "b"), (1, "x" * 300_000, 3, None), (1, "", 4, "d"), (2, "same", 5, "e"), (2, "same", 5, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int, row string")
    out = sharding.write_shards(docs, str(tmp_path / "odd"), n_shards=3)
    assert sorted(map(str, ((r.doc_id, r.text, r.row) for r in out.collect()))) == sorted(str((d, t, x)) for d, t, _, x in rows)
    assert sharding.write_shards(docs.limit(0), str(tmp_path / "none")).count() == 0
