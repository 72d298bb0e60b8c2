"""The language query against the rule in plain Python, and odd tables."""

import random
import re
import zlib

import pytest
import zstandard as zstd
from pyspark.sql import functions as F

from waymark.llm import language, queries

SF = "/root/testdata/sf0.001"


def letters(text):
    kept = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    return f" {kept} ".encode() if any(c.isalpha() for c in kept) else b""


def smallest(dictionaries, text):
    """(language, margin) by compressing the whole text once per dictionary, a part after another."""
    data = letters(text or "")
    if not data:
        return "und", 0.0
    while len(data) < 192:
        data += data[: len(letters(text))]
    params = zstd.ZstdCompressionParameters(strategy=zstd.STRATEGY_GREEDY, min_match=4, search_log=3, window_log=17, hash_log=15, chain_log=15, target_length=16, write_content_size=False, write_checksum=False, write_dict_id=False)
    sizes = []
    for _, content in dictionaries:
        held = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=params)
        c = zstd.ZstdCompressor(compression_params=params, dict_data=held)
        sizes.append(sum(len(c.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)))
    order = sorted(sizes)
    return dictionaries[sizes.index(order[0])][0], 1 - order[0] / order[1]


def test_query_equals_the_rule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("h", F.xxhash64("text")).collect()
    train = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None and r.text is not None]
    counts = {}
    for r in train:
        counts[r.lang] = counts.get(r.lang, 0) + 1
    dictionaries = []
    for lang in sorted(counts, key=lambda k: (-counts[k], k)):
        content = b""
        for _, t in sorted({(r.h, r.text) for r in train if r.lang == lang}):  # fewer than the sample: all are taken
            if len(content) < 32768:
                content += letters(t)
        dictionaries.append((lang, content[:32768]))
    got = {r.doc_id: r for r in queries.op8_language(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        want, margin = smallest(dictionaries, r.text)
        g = got[r.doc_id]
        assert (g.lang_pred, g.held_out) == (want, zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert g.score == pytest.approx(margin, abs=2e-6) and g.rejected == (want == "und" or margin < 0.01)


def words(rng, letters_, n):
    """Words of a small vocabulary that the letters determine."""
    own = random.Random(letters_)
    known = ["".join(own.choice(letters_) for _ in range(own.randrange(3, 8))) for _ in range(50)]
    return " ".join(rng.choice(known) for _ in range(n))


def test_copies_ids_and_order_do_not_change_the_model(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, "abcde", 40), "x") for i in range(60)] + [(i, words(rng, "vwxyz", 40), "y") for i in range(60)]
    hot = [(7, "only this text again and again", "z")] * 3000
    df = spark.createDataFrame(rows + hot, "doc_id long, text string, lang string")
    model = language.train(df, sample_docs=16)
    again = language.train(df.orderBy(F.rand(3)).withColumn("doc_id", F.rand(4)), sample_docs=16)
    assert model == again
    assert [k for k, _ in model.dictionaries] == ["z", "x", "y"]  # no label is lost to copies


def test_odd_rows_and_clashing_names(spark):
    rng = random.Random(3)
    train = spark.createDataFrame([(words(rng, s, 60), s[0]) for s in ("abcde", "vwxyz") for _ in range(30)] + [(None, "a"), ("text", None)], "text string, lang string")
    model = language.train(train)
    df = spark.createDataFrame([(1, None), (1, ""), (2, "12 !?"), (3, words(rng, "abcde", 30)), (3, words(rng, "abcde", 30)), (None, words(rng, "vwxyz", 200_000))], "id long, text string")
    df = df.selectExpr("*", "1 AS _language", "2 AS language", "'old' AS LANG_PRED", "3 AS margin")
    out = language.identify(df, model)
    assert out.columns == ["id", "text", "_language", "language", "margin", "lang_pred", "score", "rejected"]
    got = sorted(((r.id, r.lang_pred, r.rejected, r._language, r.margin) for r in out.collect()), key=str)
    assert got == sorted([(1, "und", True, 1, 3)] * 2 + [(2, "und", True, 1, 3)] + [(3, "a", False, 1, 3)] * 2 + [(None, "v", False, 1, 3)], key=str)
    none = language.train(train.where("false"))
    assert {r.lang_pred for r in language.identify(df, none).collect()} == {"und"}
    same = language.LanguageModel((("b", model.dictionaries[0][1]), ("a", model.dictionaries[0][1])))
    told = language.identify(df.where("id = 3"), same).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in told} == {("b", 0.0, True)}  # a tie goes to the first, and is rejected
