import random
import zlib

import pytest

from waymark.llm import language, queries, sharding, tokens

SF = "/root/testdata/sf0.01"
ODD = ["", " ", "  ", "a", " a", "a ", "a  b\n\n c\t d ", "▁x▁▁", "<s></s><unk>", "\x00b", "ﬁ１ ❤️", "x" * 3000, " " * 40 + "end", "日本 語　テ", "\r\n \r\n"]


def test_counts_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab ▁éß\n<>s/日0") for _ in range(rng.randrange(60))) for _ in range(400)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.with_token_counts(df, queries.piece_model()).collect()}
    assert got == {i: 0 if t is None else len(sp.encode(t)) for i, t in enumerate(texts)}


def test_whole_table_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op9_token_counts(spark, SF).collect():
        n = len(sp.encode(docs[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(docs[r.doc_id].encode()), n > 4096)


def test_language_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op8_language(spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_odd_rows(spark):
    df = spark.createDataFrame([(1, "der die das und", "de"), (2, "the of and", "en"), (3, None, "en"), (4, "12 ++", None), (5, "", "de")], "doc_id long, text string, lang string")
    model = language.train(df)
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in language.identify(df, model).collect()}
    assert got[3] == got[4] == got[5] == ("und", True)
    assert got[1][0] == "de" and got[2][0] == "en"
    empty = language.train(df.where("false"))
    assert {r.lang_pred for r in language.identify(df, empty).collect()} == {"und"}


def test_shards_are_whole_balanced_and_contiguous(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_byte_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by = {}
    for r in rows:
        body = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(body) + 8, zlib.crc32(body))
        by.setdefault(r.shard, []).append(r)
    total, longest = sum(r.size for r in rows), max(r.size for r in rows)
    assert sorted(by) == list(range(24))
    for shard in by.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
        assert abs(sum(r.size for r in shard) - total / 24) <= longest


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "a")] * 5 + [(None, "b"), (None, "b"), (2, "")]])
def test_shards_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as shard")
    got = sharding.balanced_shards(df, n_shards=3, rows_per_partition=2).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
