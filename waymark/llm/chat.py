"""Chat formatting by columnar byte assembly.

Turns become ``<|im_start|>role`` newline ``text<|im_end|>`` newline. Whole
Arrow batches are assembled at once: segment lengths and their cumulative
offsets give scatter indices, by which headers, contents and closings are
copied from their Arrow buffers into one preallocated buffer, whose
offsets at conversation boundaries are the result column. The byte spans
of assistant texts are the loss mask.

Control strings inside texts are escaped reversibly: ``<|`` gets a
backslash between its two characters, one more for each that is there
already. In roles, ``%`` and line breaks are percent-encoded as well.

Batches above ``SLICE_BYTES`` are assembled in slices of turns, so that
offsets stay within 32 bits; a turn of more than ``TURN_BYTES`` is refused,
as its formatted form need not fit in Spark's own strings.

Rows are ordered by (turn, role, text); nulls first. Null texts and roles
are empty, a null conversation id is a conversation of its own, repeated
turns are kept. Rows are dealt by ranges of that order, so a conversation
that holds much of the table is assembled by many tasks, and one that
exceeds a batch continues in further pieces: no conversation has to fit in
memory or in a task. ``piece`` grows along a conversation, with gaps where
it goes on in another task; concatenating the pieces in that order gives
the whole. Only the digest of a conversation, which is one hash over all its
texts, is taken in one task, from bytes that the others have prepared.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import small_batches

#: Text bytes assembled at once, and the most that a turn may have.
SLICE_BYTES, TURN_BYTES = 128 << 20, 1 << 30
START, END = "<|im_start|>", "<|im_end|>"
FORMATTED = "conv_id long, piece long, n_turns int, formatted string, loss_starts array<long>, loss_ends array<long>"
_CLOSED = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "<\\" in text else text


def escaped_roles(roles: pa.Array) -> pa.Array:
    for raw, safe in (("%", "%25"), ("\n", "%0A")):
        roles = pc.replace_substring(roles, raw, safe)
    return escaped(roles)


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copies segment i of ``data`` to ``out`` from ``at[i]`` on."""
    lengths = np.diff(offsets)
    shift = np.repeat(at - offsets[:-1], lengths)
    out[np.arange(offsets[0], offsets[-1]) + shift] = data[offsets[0] : offsets[-1]]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, start of each turn and the end, start and end of each content) of turns without nulls."""
    headers = pc.binary_join_element_wise(pa.scalar(START), escaped_roles(roles), pa.scalar("\n"), "")
    closings = pa.array([END + "\n"] * len(roles), pa.string())
    parts = [_bytes_of(x) for x in (headers, escaped(texts), closings)]
    lengths = np.stack([np.diff(offsets) for _, offsets in parts])
    ends = np.cumsum(lengths.T.ravel()).reshape(-1, 3).T
    begins = ends - lengths
    total = int(ends[-1, -1]) if len(roles) else 0
    buffer = np.empty(total, np.uint8)
    for (data, offsets), at in zip(parts, begins, strict=True):
        _scatter(buffer, at, data, offsets)
    return buffer, np.append(begins[0], total), begins[1], ends[1]


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """(conv_id, piece, n_turns, formatted, loss_starts, loss_ends), spans in bytes of ``formatted``."""
    spark = turns.sparkSession
    slim = turns.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    # the last part of the range deals rows that are alike; their order is all the same
    order = ("conv_id", "turn", "role", "text")
    dealt = slim.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order, F.monotonically_increasing_id())
    ordered = dealt.sortWithinPartitions(*order).select("conv_id", "role", "text")
    small_batches(spark)

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_piece = TaskContext.get().partitionId() << 32
        last, piece = object(), base_piece
        for batch in (part for whole in batches for part in slices(whole)):
            ids = batch.column(0)
            keys, known = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
            changed = np.flatnonzero((keys[1:] != keys[:-1]) | (known[1:] != known[:-1])) + 1
            first = np.concatenate(([0], changed))
            stop = np.append(changed, len(keys))
            buffer, at, content, content_end = assemble(batch.column(1), batch.column(2))
            lost = np.flatnonzero(pc.equal(batch.column(1), loss_role).to_numpy(zero_copy_only=False))
            base = np.repeat(at[first], stop - first)
            spans = pa.array(np.searchsorted(lost, np.append(first, len(keys))), pa.int32())
            pieces = np.full(len(first), base_piece, np.int64)
            head = (int(keys[0]), bool(known[0]))
            pieces[0] = piece + 1 if head == last else base_piece
            last, piece = (int(keys[-1]), bool(known[-1])), int(pieces[-1])
            offsets = pa.py_buffer(np.append(at[first], at[-1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(first)),
                    pa.array(pieces),
                    pa.array((stop - first).astype(np.int32)),
                    pa.StringArray.from_buffers(len(first), offsets, pa.py_buffer(buffer)),
                    pa.ListArray.from_arrays(spans, pa.array((content - base)[lost])),
                    pa.ListArray.from_arrays(spans, pa.array((content_end - base)[lost])),
                ],
                names=["conv_id", "piece", "n_turns", "formatted", "loss_starts", "loss_ends"],
            )

    return ordered.mapInArrow(assembled, FORMATTED)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The turns (conv_id, role, text) of a batch in slices of about ``SLICE_BYTES``, or of one turn."""
    sizes = (pc.binary_length(batch.column(1)).cast(pa.int64()).to_numpy() + pc.binary_length(batch.column(2)).cast(pa.int64()).to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
    if len(sizes) and sizes.max() > TURN_BYTES:
        raise ValueError(f"a turn has {sizes.max()} bytes; at most {TURN_BYTES} are formatted")
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, before + SLICE_BYTES, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) of each turn of a formatted piece."""
    for m in _CLOSED.finditer(formatted):
        yield unescape_role(m[1]), unescape(m[2])


_PARSED = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("n_turns", pa.int64()), ("told", pa.binary()), ("loss_chars", pa.int64()), ("lost", pa.binary()), ("chars", pa.int64())])
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation as read from the output of ``format_conversations``; see ``DIGESTS``.

    Each piece is parsed and unescaped where it lies. The bytes to be hashed are then brought together by conversation, in
    the order of its pieces, and hashed one after another.
    """
    small_batches(formatted.sparkSession)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                turns = list(parse_turns(r["formatted"]))
                data = r["formatted"].encode()
                lost = "".join(unescape(data[a:b].decode()) for a, b in zip(r["loss_starts"], r["loss_ends"], strict=True))
                told = "".join(f"{role}\n{text}\n" for role, text in turns).encode()
                row = ([r["conv_id"]], [r["piece"]], [len(turns)], [told], [len(lost)], [lost.encode()], [len(r["formatted"])])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _PARSED, strict=True)], schema=_PARSED)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, state = object(), None
        close = lambda: (open_id, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["conv_id"] != open_id:
                    if state:
                        done.append(close())
                    open_id, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += r["n_turns"]
                state[1].update(r["told"])
                state[2] += r["loss_chars"]
                state[3].update(r["lost"])
                state[4] += r["chars"]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _DIGESTS, strict=True)], schema=_DIGESTS)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(close(), _DIGESTS, strict=True)], schema=_DIGESTS)

    pieces = formatted.mapInArrow(parsed, "conv_id long, piece long, n_turns long, told binary, loss_chars long, lost binary, chars long")
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(digested, DIGESTS)
