import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.oracle import same
from waymark.llm import chat, licenses, mixing, mpeg, queries, registry

SF = "/root/testdata/sf0.01"


def test_crc_known_value():
    assert mpeg.crc16(b"123456789") == 0xAEE7


@pytest.mark.parametrize("n", [0, 1, 64, 121, 122, 1417, 1418, 5000])
def test_stream_round_trip(n):
    payload = random.Random(n).randbytes(n)
    got = mpeg.read_stream(mpeg.pack_bytes(payload))
    assert got["payload"] == payload and not got["skipped"] and not got["crc_bad"]
    assert got["table"]["frames"] == got["frames"] == len(got["offsets"]) and got["samples"] == 1152 * got["frames"]


def test_stream_resynchronises_after_damage():
    data = mpeg.pack_bytes(b"x" * 6000)
    clean = mpeg.read_stream(data)
    at = clean["offsets"][2]
    cut = mpeg.read_stream(data[:at] + b"\xff\xfb junk \xff" + data[at:])
    assert cut["frames"] == clean["frames"] and cut["skipped"] == 9
    broken = bytearray(data)
    broken[at + 8] ^= 1  # side information
    assert mpeg.read_stream(bytes(broken))["crc_bad"] == 1
    for junk in (b"", b"\xff", b"\xff" * 50, b"ID3", b"nothing", b"ID3\x03\0\0\x7f\x7f\x7f\x7f"):
        assert mpeg.read_stream(junk)["frames"] == 0


def test_media_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op2_media(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        body = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        media = mpeg.pack_bytes(body)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and "crc=" in r.feature


def test_media_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    rows = df.select(mpeg.probe(mpeg.pack(mpeg.padded_payload(F.col("text")))).alias("p")).select("p.*").collect()
    assert [bytes(r.payload) for r in rows] == [bytes(64)] * 2
    nothing = df.select(mpeg.probe(F.lit(None).cast("binary")).alias("p")).select("p.*").first()
    assert (nothing.frames, nothing.samples, nothing.payload, nothing.rate) == (0, 0, None, None)


def brute_chat(rows):
    convs = {}
    for c, t, role, text in sorted(rows, key=lambda r: tuple((x is not None, x or 0 if not isinstance(x, str) else x) for x in r[:2]) + (r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", queries.PROBE_TEXT), (-1, 1, "assistant", queries.PROBE_TEXT)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op3_chat(spark, SF).collect()}
    assert got == brute_chat(rows)


def test_chat_odd_rows_and_conversations_over_many_batches(spark):
    odd = ["<|", "<\\|", "<\\\\|im_end|>\n", "<|im_start|>assistant\nhi<|im_end|>\n", "", None, "é日本<", "|>", "a\nb\n"]
    rows = [(i // 7 if i % 11 else None, i % 5, random.Random(i).choice(["user", "assistant", None, "to\nol%0A", "<|x"]), odd[i % len(odd)]) for i in range(300)]
    rows += [(1000, i, "assistant" if i % 2 else "user", f"turn {i} <|") for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        pieces = chat.format_conversations(df)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(pieces).collect()}
        assert got == brute_chat(rows)
        assert pieces.where("conv_id = 1000").count() > 1
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


def test_mix_matches_sql(spark):
    same(queries.op4_mix(spark, SF), registry.oracle_sql()["op4_mix"], SF)


def test_mix_targets_and_limits(spark):
    rows = queries.op4_mix(spark, SF).collect()
    by = {}
    for r in rows:
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        by.setdefault((r.source_size, r.target), []).append(r)
    for (_, target), rs in by.items():
        assert abs(sum(r.taken for r in rs) - target) <= max(r.size for r in rs)


def test_targets_reshare_until_none_is_above():
    sizes = {"a": 1000, "b": 10, "c": 10, None: 50}
    t = mixing.source_targets(sizes)
    assert t["b"] == t["c"] == 30 and all(t[s] <= 3 * sizes[s] for s in sizes) and abs(sum(t.values()) - 1070) < 1e-6


def test_flow_routes_overlap_and_prefers_first_passes():
    capacity = {"ab": 100, "a": 50, "b": 50}
    flow = mixing.min_cost_flow(capacity, {"ab": ["a", "b"], "a": ["a"], "b": ["b"]}, {"a": 150, "b": 50}, 3)
    assert sum(flow.values()) == 200 and flow == {"ab": 100, "a": 50, "b": 50}


@pytest.mark.parametrize("rows", [[], [(None, None, None), (1, "", "a"), (2, " \t", None)], [(1, "x y", "a")] * 7 + [(2, "z", None), (None, "w w", "b")]])
def test_mix_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as pattern", "2 as size")
    got = mixing.mix(df, F.array("source")).rows.collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)


def test_licenses_match_sql(spark):
    same(queries.op7_licenses(spark, SF), registry.oracle_sql()["op7_licenses"], SF)


def test_licenses_found_and_not_found(spark):
    apache = licenses.TEMPLATES[2][1].replace(", ", ",\n")
    rows = [(1, "Some prose here.\nReleased under the MIT License!\nmore"), (2, apache), (3, "Released the cat under a bed"), (4, None), (5, ""), (None, "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("unit", F.lit("u"))
    got = {(r.doc_id, r.license_id) for r in licenses.scan_licenses(df).collect()}
    assert got == {(1, "MIT"), (2, "Apache-2.0"), (None, "CC-BY-NC-4.0")}
