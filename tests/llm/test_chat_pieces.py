"""Conversations in pieces: slices of a batch, pieces read back in any order, and turns that are too long."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import chat


def batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=["conv_id", "role", "text"])


def test_slices_hold_every_turn_once(monkeypatch):
    rows = [(i // 3, "user", "x" * (i % 50)) for i in range(200)] + [(99, "assistant", "y" * 5000), (99, "user", "")]
    monkeypatch.setattr(chat, "SLICE_BYTES", 300)
    parts = list(chat.slices(batch(rows)))
    assert [tuple(r.values()) for p in parts for r in p.to_pylist()] == rows
    assert all(p.num_rows == 1 or sum(len(r["role"]) + len(r["text"]) for r in p.to_pylist()) <= 300 for p in parts)
    assert list(chat.slices(batch([]))) == []
    monkeypatch.setattr(chat, "TURN_BYTES", 1000)
    with pytest.raises(ValueError):
        list(chat.slices(batch(rows)))


def test_pieces_are_hashed_in_order_after_a_reread(spark, tmp_path):
    rows = [(7 if i % 3 else None, i, "assistant" if i % 2 else "user", f"<|im_end|> {i} " * (i % 40)) for i in range(25_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(turns)
    formatted.repartition(9, "formatted").write.parquet(str(tmp_path / "f"))
    again = spark.read.parquet(str(tmp_path / "f"))
    assert again.where("conv_id = 7").count() > 1  # more turns than a batch holds
    got = {r.conv_id: r for r in chat.read_back(again).collect()}
    for conv in (7, None):
        own = sorted((t, r, x) for c, t, r, x in rows if c == conv)
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), digest)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_a_hot_conversation_is_assembled_by_several_tasks(spark):
    rows = [(1 if i % 3 else i, i if i % 5 else 5, "assistant" if i % 2 else "user", f"text {i % 700}") for i in range(6000)]
    rows += [(2, 0, "user", "alike")] * 3000  # rows that can't be told apart
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    formatted = chat.format_conversations(turns).cache()
    tasks = {c: {r.piece >> 32 for r in formatted.where(F.col("conv_id") == c).select("piece").collect()} for c in (1, 2)}
    assert len(tasks[1]) >= 3 and len(tasks[2]) >= 2
    whole = "".join(r.formatted for r in formatted.where("conv_id = 1").orderBy("piece").collect())
    own = sorted((t, r, x) for c, t, r, x in rows if c == 1)
    assert list(chat.parse_turns(whole)) == [(r, x) for _, r, x in own]
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert len(got) == len({r[0] for r in rows}) and got[2].n_turns == 3000
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
