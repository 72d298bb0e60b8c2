"""Benchmark decontamination by q-gram lemma filtering.

A passage of m characters occurs in a text with at most k edits only if
the two share at least ``m + 1 - q - k * q`` q-grams whose diagonals
(place in the text less place in the passage) lie within k of each other.
Texts and passages are normalised (lower case, every run of characters
that are neither letters nor digits one space). The hashes of a text's
q-grams are looked up among those of the passages; passages with too few
hits fall out; the hits of the others are counted in overlapping diagonal
bands of k + 1, one from each hit on, and joined bands that hold enough
different q-grams of the passage are verified by banded alignment. The filter loses nothing: any
occurrence within the budget is reported.

k is ``max_error`` times the passage's length. Short passages use a
smaller q, so that the bound stays positive; passages without a letter or
digit are never found. Null and empty texts have no match. Whole texts
are searched. Repeated passages and rows are reported each on its own.

The passages are the stated query set: they are sent out in rounds of
bounded bytes, and the rows are read once a round. Inside a round they
are indexed in blocks, one after another for the texts at hand, which
bounds a worker's memory. Extra columns are ignored, whatever their names,
and kept by ``without_passages``.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import discard, free_name, small_batches, written

MAX_Q, MAX_ERROR = 8, 0.1
#: Bytes of passages that are indexed and that are sent out at once, and characters of a text that are searched at once.
BLOCK_BYTES, ROUND_BYTES, SEGMENT = 4 << 20, 64 << 20, 1 << 14
#: Bytes of rows that are searched for one block after another.
TEXT_BYTES = 32 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SIEVE_BITS = 22
_ITEM = 1 << 40  # more than any place in a text


@functools.cache
def _letters_and_digits() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x110000)])


def normalised(text: str) -> np.ndarray:
    """The code points of the text in lower case, every run of other characters than letters and digits one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    word = _letters_and_digits()[c]
    kept = word.copy()
    kept[1:] |= word[:-1]
    c = np.where(word, c, np.uint32(32))[kept]
    return c[:-1] if len(c) and c[-1] == 32 else c


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each run of ``q`` codes."""
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = c.astype(np.uint64)
    h = wide[:n].copy()
    for i in range(1, q):
        h *= _MULTIPLIER
        h += wide[i : i + n]
    h ^= h >> np.uint64(32)
    return h * _MULTIPLIER


def gram_length(m: int, k: int) -> int:
    """The largest q up to ``MAX_Q`` that leaves a positive bound."""
    return next(q for q in range(min(MAX_Q, m), 0, -1) if m + 1 - q - k * q > 0)


class Passages:
    """The q-gram index of a block of passages, one table for each q in use."""

    def __init__(self, items: list[tuple[str, str]], max_error: float):
        self.items = [(i, t, int(max_error * len(t))) for i, raw in items if len(t := normalised(raw))]
        self.tables = []
        by_q: dict[int, list[int]] = {}
        for n, (_, t, k) in enumerate(self.items):
            by_q.setdefault(gram_length(len(t), k), []).append(n)
        for q, members in sorted(by_q.items()):
            hashes = [gram_hashes(self.items[n][1], q) for n in members]
            owner = np.repeat(np.array(members), [len(h) for h in hashes])
            place = np.concatenate([np.arange(len(h)) for h in hashes])
            flat = np.concatenate(hashes)
            order = np.argsort(flat, kind="stable")
            keys, first, many = np.unique(flat[order], return_index=True, return_counts=True)
            sieve = np.zeros(1 << _SIEVE_BITS, bool)
            sieve[keys >> np.uint64(64 - _SIEVE_BITS)] = True
            bound, edits = np.zeros((2, len(self.items)), np.int64)
            for n in members:
                m, k = len(self.items[n][1]), self.items[n][2]
                bound[n], edits[n] = m + 1 - q - k * q, k
            self.tables.append((q, sieve, keys, first, many, owner[order], place[order], bound, edits))

    def regions(self, c: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) where the hits on the text ``c`` meet an item's bound."""
        for q, sieve, keys, first, many, owner, place, bound, edits in self.tables:
            h = gram_hashes(c, q)
            at = np.flatnonzero(sieve[h >> np.uint64(64 - _SIEVE_BITS)])
            slot = np.searchsorted(keys, h[at])
            slot[slot == len(keys)] = 0
            real = keys[slot] == h[at]
            at, slot = at[real], slot[real]
            n = many[slot]
            entry = np.repeat(first[slot] - np.cumsum(n) + n, n) + np.arange(n.sum())
            item, at = owner[entry], np.repeat(at, n)
            enough = (np.bincount(item, minlength=len(bound)) >= bound)[item]
            item, at, spot = item[enough], at[enough], place[entry[enough]]
            # items one after another, in each the hits by diagonal
            key = item * _ITEM + (_ITEM >> 1) + at - spot
            order = np.argsort(key)
            key, item, spot = key[order], item[order], spot[order]
            # overlapping bands of k + 1 diagonals, one from each hit on
            stop = np.searchsorted(key, key + edits[item], side="right")
            starts = np.flatnonzero(stop - np.arange(len(key)) >= bound[item])
            while len(starts):
                i = starts[0]
                one, low, high = int(item[i]), i, stop[i]
                # bands that overlap make one region
                for j in starts:
                    if j >= high or item[j] != one:
                        break
                    high = max(high, stop[j])
                if len(np.unique(spot[low:high])) >= bound[one]:
                    base = one * _ITEM + (_ITEM >> 1)
                    yield one, int(key[low] - base), int(key[high - 1] - base)
                starts = starts[np.searchsorted(starts, high) :]


def aligned(passage: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int] | None:
    """(edits, end) of the best occurrence of ``passage`` in ``text`` that starts on diagonals low..high, or None above ``k`` edits.

    Row by row along the passage, in the band of diagonals that k edits can reach; the start in the text is free.
    """
    m, n = len(passage), len(text)
    low, high = low - k, high + k
    width, far = high - low + 1, m + n + 1
    steps = np.arange(width)
    start = low + steps  # place in the text after the part matched so far, on each diagonal
    row = np.where((start >= 0) & (start <= n), 0, far)
    padded = np.concatenate((text, [np.uint32(0xFFFFFFFF)]))
    for i in range(m):
        place = np.clip(low + i + steps, -1, n)
        other = np.where(place >= 0, padded[np.minimum(place, n)] != passage[i], True)
        nxt = row + other  # match or substitute: same diagonal
        nxt[:-1] = np.minimum(nxt[:-1], row[1:] + 1)  # a character of the passage is missing
        end = low + i + 1 + steps
        nxt[(end < 0) | (end > n)] = far
        nxt = np.minimum.accumulate(nxt - steps) + steps  # extra characters in the text
        row = np.where((end < 0) | (end > n), far, nxt)
        if row.min() > k:
            return None
    best = int(np.argmin(row))
    return int(row[best]), low + m + best


def _best_of(passages: Passages, c: np.ndarray, shift: int, best: dict[int, tuple[int, int]]) -> None:
    """Puts into ``best`` the (fewest edits, end) of each passage that occurs in ``c``, which begins at ``shift`` of its text."""
    for n, low, high in passages.regions(c):
        _, own, k = passages.items[n]
        if best.get(n, (1, 0))[0] == 0:
            continue
        same = [d for d in range(max(0, low), min(high, len(c) - len(own)) + 1) if np.array_equal(c[d : d + len(own)], own)] if high - low <= k else []
        found = (0, same[0] + len(own)) if same else aligned(own, c, low, high, k)
        if found and found[0] <= k and (found := (found[0], found[1] + shift)) < best.get(n, (k + 1, 0)):
            best[n] = found


def occurrences(passages: Passages, text: str) -> list[tuple]:
    """(passage, fewest edits, end in the normalised text) of each passage that occurs in the text.

    Long texts are searched in segments that overlap by the longest passage and its edits, so that every occurrence lies
    in one; this bounds the hits held at once, also where text and passages repeat themselves.
    """
    c = normalised(text)
    best: dict[int, tuple[int, int]] = {}
    overlap = max((len(t) + k for _, t, k in passages.items), default=0)
    length = max(SEGMENT, 2 * overlap)
    for at in range(0, max(1, len(c) - overlap), length - overlap):
        _best_of(passages, c[at : at + length], at, best)
    return [(passages.items[n][0], *v) for n, v in sorted(best.items())]


def _different(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(passage, item_id, text): the key of each passage's text, under which repeated passages are one."""
    return benchmark.select(F.md5(text).alias("passage"), F.col(item).cast("long").alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())


def _rounds(named: DataFrame, block_bytes: int, round_bytes: int) -> Iterator[tuple[list[list[tuple[str, str]]], int]]:
    """The different texts of ``named`` in rounds of about ``round_bytes``, dealt by their key, each as blocks of ``block_bytes``.

    One round is in the driver at a time. Gives each round with the number of rounds.
    """
    texts = named.groupBy("passage").agg(F.first("text").alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-2 * size // round_bytes) if size > round_bytes else 1
    if n > 1:
        texts = written(texts, "passages")
    for i in range(n):
        blocks, held = [[]], 0
        for r in (texts.where(F.pmod(F.xxhash64("passage"), F.lit(n)) == i) if n > 1 else texts).collect():
            own = len(r.text.encode("utf-8", "surrogatepass"))
            if held and held + own > block_bytes:
                blocks.append([])
                held = 0
            blocks[-1].append((r.passage, r.text))
            held += own
        yield blocks, n
    if n > 1:
        discard(texts)


@functools.lru_cache(maxsize=1)
def _only(broadcasted) -> Passages:
    """The index of a round of one block, kept for the worker's next tasks."""
    return Passages(broadcasted.value[0][0], broadcasted.value[1])


def _found(shared, texts: list[str | None]) -> list[list[tuple]]:
    """The occurrences in each text of the passages of all blocks of a round."""
    blocks, max_error = shared.value
    out: list[list[tuple]] = [[] for _ in texts]
    for block in blocks:
        passages = _only(shared) if len(blocks) == 1 else Passages(block, max_error)
        for i, t in enumerate(texts):
            if t is not None:
                out[i] += occurrences(passages, t)
    return out


def _gathered(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.Table]:
    """Batches as they come, or with several blocks about ``TEXT_BYTES`` of them at once, as each block is indexed anew for them."""
    many, held, size = len(shared.value[0]) > 1, [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if not many or size >= TEXT_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def find_passages(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    max_error: float = MAX_ERROR, block_bytes: int = BLOCK_BYTES, round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """(doc_id, item_id, edits, end_char): each passage that occurs in each row with at most ``max_error`` edits a character.

    The rows are read once for each round of passages; a round's hits are written and its broadcast is taken back before
    the next one.
    """
    spark = df.sparkSession
    small_batches(spark)
    slim = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col(text).isNotNull())
    named = _different(benchmark, item, item_text)
    schema = pa.schema([("doc_id", pa.int64()), ("passage", pa.string()), ("edits", pa.int64()), ("end_char", pa.int64())])
    hits = None
    for blocks, n in _rounds(named, block_bytes, round_bytes):
        shared = spark.sparkContext.broadcast((blocks, max_error))

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for t in _gathered(batches, shared):
                ids, found = t.column(0).to_pylist(), _found(shared, t.column(1).to_pylist())
                rows = [(d, *hit) for d, own in zip(ids, found, strict=True) for hit in own]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        part = slim.mapInArrow(searched, "doc_id long, passage string, edits long, end_char long")
        if n > 1:
            part = written(part, "passages")
            shared.unpersist(blocking=True)
        hits = part if hits is None else hits.unionByName(part)
    return hits.join(named.select("passage", "item_id"), "passage").select("doc_id", "item_id", "edits", "end_char")


def contaminated_ids(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The ids of the rows in which a passage occurs, once each."""
    return find_passages(df, benchmark, **options).select("doc_id").distinct()


def without_passages(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    max_error: float = MAX_ERROR, block_bytes: int = BLOCK_BYTES, round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """The rows of ``df``, with all their columns, in which no passage occurs.

    Each row is decided by its own text, also rows that share an id or have none; null texts stay. One round of passages
    filters the rows as they are read. With more, each round only finds texts in which passages occur, by their keys,
    and the rows are dropped once at the end.
    """
    spark, place = df.sparkSession, df.columns.index(text)
    small_batches(spark)
    bad = None
    for blocks, n in _rounds(_different(benchmark, item, item_text), block_bytes, round_bytes):
        shared = spark.sparkContext.broadcast((blocks, max_error))

        def cleaned(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for t in _gathered(batches, shared):
                clean = pa.array([not own for own in _found(shared, t.column(place).to_pylist())], pa.bool_())
                yield from t.filter(clean).to_batches()

        def hit(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for t in _gathered(batches, shared):
                texts = t.column(0).to_pylist()
                keys = {hashlib.md5(x.encode("utf-8", "surrogatepass")).digest() for x, own in zip(texts, _found(shared, texts), strict=True) if own}
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(keys), pa.binary())], names=["key"])

        if n == 1:
            return df.mapInArrow(cleaned, df.schema)
        part = written(df.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInArrow(hit, "key binary").distinct(), "passages")
        shared.unpersist(blocking=True)
        bad = part if bad is None else bad.unionByName(part)
    key = free_name(df, "text_key")
    found = written(bad.distinct().select(F.col("key").alias(key)), "passages")
    # a hot text is on the side of the rows, whose partitions AQE splits; the other side has each key once
    return df.withColumn(key, F.unhex(F.md5(text))).join(found, key, "left_anti").select(*df.columns)
