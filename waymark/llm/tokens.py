"""Token counts by a two-tier lookup of pre-tokens.

A SentencePiece BPE model whose pieces hold the word mark only at their
start never merges across a word boundary, so a text's token count is the
sum over its pre-tokens (a run of word marks with what follows up to the
next one). Tier one is a compact table, broadcast once, with the lengths
of the pre-tokens that are frequent in the texts themselves. To find them
every task counts the pre-tokens of its texts in a bounded table, from
which the rarest go when it is full, and hands on those that make up a
share of at least 1 / ``SHARE``; these summaries are added up, and the
``FREQUENT`` most frequent are encoded. Tier two encodes misses in the
worker, behind a bounded cache. Pre-tokens themselves are never shuffled,
and counts are exact whichever tier gives them. Models without that
property are encoded whole.

Null texts count as empty (0 tokens). Texts are never cut. Rows keep their
order, ties and repeated rows are counted each on its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import small_batches

MARK = "▁"
#: A model file above this is refused, as it is broadcast whole.
MAX_MODEL_BYTES = 64 << 20
#: Pre-tokens in the broadcast table, at most; a task's table, and the share of its pre-tokens from which on it hands one on.
FREQUENT, COUNTED, SHARE = 32_768, 200_000, 1 << 17
#: Bounds of the worker's cache of misses; a longer pre-token is encoded each time.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 64
_PRE_TOKEN = re.compile(f"[ {MARK}]+[^ {MARK}]*")


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def splits_at_marks(model: bytes) -> bool:
    """Whether counts are sums over pre-tokens: plain BPE, no text normalisation, marks only at starts of pieces."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(model)
    spec = m.normalizer_spec
    return (
        m.trainer_spec.model_type == m.trainer_spec.BPE
        and spec.add_dummy_prefix
        and not spec.remove_extra_whitespaces
        and spec.escape_whitespaces
        and not spec.precompiled_charsmap
        and not m.trainer_spec.treat_whitespace_as_suffix
        and all(p.type != p.USER_DEFINED and MARK not in p.piece.lstrip(MARK) for p in m.pieces)
    )


class PreTokenLengths:
    """Lengths of pre-tokens: the shared table first, then a bounded cache in front of the encoder."""

    def __init__(self, model: bytes, shared: dict[str, int] | None):
        self.sp = _processor(model)
        self.shared = shared
        self.own: dict[str, int] = {}
        mark = self.sp.piece_to_id(MARK)
        self.lone = 1 if mark != self.sp.unk_id() else len(MARK.encode())

    def encode(self, pre: str) -> int:
        # the encoder puts a mark in front of any text, which stands for the first of the pre-token
        return len(self.sp.encode(pre[1:], num_threads=1)) if len(pre) > 1 else self.lone

    def miss(self, pre: str) -> int:
        n = self.own.get(pre)
        if n is None:
            n = self.encode(pre)
            if len(pre) <= CACHE_CHARS:
                if len(self.own) >= CACHE_ENTRIES:
                    self.own.clear()
                self.own[pre] = n
        return n

    def count(self, text: str) -> int:
        if self.shared is None:
            return len(self.sp.encode(text, num_threads=1))
        get, miss, total = self.shared.get, self.miss, 0
        for pre in _PRE_TOKEN.findall(" " + text) if text else ():
            n = get(pre)
            total += miss(pre) if n is None else n
        return total


def counted_in_task(batches: Iterator[list[str | None]]) -> list[tuple[str, int]]:
    """The pre-tokens that make up a share of at least 1 / ``SHARE`` of a task's, with their counts.

    When the table is full the rarer half goes, so counts may be too low, but never for one that is frequent all along.
    """
    table: Counter[str] = Counter()
    total = 0
    for texts in batches:
        for t in texts:
            if t:
                found = _PRE_TOKEN.findall(" " + t)
                total += len(found)
                table.update(p for p in found if len(p) <= CACHE_CHARS)
        if len(table) > COUNTED:
            table = Counter(dict(table.most_common(COUNTED // 2)))
    return [(p, n) for p, n in table.items() if n * SHARE >= total]


def frequent_lengths(texts: DataFrame, text: str, model: bytes) -> dict[str, int]:
    """The lengths of the at most ``FREQUENT`` pre-tokens that are most frequent in ``texts``, from bounded summaries of its tasks."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = counted_in_task(b.column(0).to_pylist() for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["pre", "n"])

    summaries = texts.select(F.col(text).alias("text")).mapInArrow(summed, "pre string, n long")
    best = summaries.groupBy("pre").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pre").limit(FREQUENT).collect()
    lengths = PreTokenLengths(model, {})
    return {r["pre"]: lengths.encode(r["pre"]) for r in best}


def token_count(spark: SparkSession, text: Column, model: bytes, frequent: dict[str, int] | None) -> Column:
    """The number of tokens of ``text`` under the model, without begin, end or added special tokens.

    ``frequent`` has the lengths of some pre-tokens, or is None for a model that is not counted by pre-tokens.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model, frequent))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = PreTokenLengths(*shared.value)
        for texts in batches:
            yield pd.Series([0 if t is None else lengths.count(t) for t in texts], dtype="int64")

    return counted(text)


def with_token_counts(
    df: DataFrame, model_path: str, limit: int = 4096, text: str = "text", n_tokens: str = "n_tokens", over: str = "over_limit"
) -> DataFrame:
    """``df`` with its token count and whether that exceeds ``limit``; columns of those names are replaced.

    The texts are read twice, once for the frequent pre-tokens and once to be counted.
    """
    model = Path(model_path).read_bytes()
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"{model_path} has {len(model)} bytes; at most {MAX_MODEL_BYTES} are broadcast")
    small_batches(df.sparkSession)
    frequent = frequent_lengths(df, text, model) if splits_at_marks(model) else None
    counted = df.withColumn(n_tokens, token_count(df.sparkSession, F.col(text), model, frequent))
    return counted.withColumn(over, F.col(n_tokens) > F.lit(limit))
