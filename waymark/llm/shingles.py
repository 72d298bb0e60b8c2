"""Word shingles of whole texts as 64-bit hashes, for Arrow batches at once.

Words are maximal runs of bytes other than ``\\x20 \\x09-\\x0D`` after
lower-casing A-Z. A text's set holds the hashes of its distinct runs of
``k`` words; a text of fewer words has its whole sequence as one; a null
text or one without words has the empty set.

A word's hash is a polynomial in random values of its bytes, taken from
prefix sums over a bounded piece; a shingle's hash mixes those of its
words in order.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0xD6E8FEB86659FD93  # odd, hence invertible modulo 2**64
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at once; longer batches and texts go in slices.
SLICE = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.cache
def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values[65:91] = values[97:123]  # A-Z as a-z
    return values


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first byte, hash) of each word in ``data``, hashed in pieces of about ``SLICE`` bytes cut at gaps."""
    gap = _GAP[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True]))))
    start, stop = edge[::2], edge[1::2]
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        till = max(at + 1, int(np.searchsorted(stop, start[at] + SLICE, side="right")))
        low, high = int(start[at]), int(stop[till - 1])
        up, down = _powers(1 << max(16, (high - low).bit_length()))
        prefix = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_byte_values()[data[low:high]] * up[: high - low], out=prefix[1:])
        a, b = start[at:till] - low, stop[at:till] - low
        out[at:till] = mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(np.uint64))
        at = till
    return start, out


def sliced_sets(texts: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingle hashes of each text, in lists for about ``SLICE`` bytes of text or one text at a time."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=n + 1 + texts.offset)[texts.offset :] if n else np.zeros(1, np.int32)
    body = texts.buffers()[2] if n else None
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + SLICE, side="right")) - 1)
        stop = min(stop, n)
        yield _sets_of(data, offsets[at : stop + 1].astype(np.int64), valid[at:stop], k)
        at = stop


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """All sets of ``sliced_sets`` in one list."""
    return [s for part in sliced_sets(texts, k) for s in part]


def _sets_of(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray, k: int) -> list[np.ndarray]:
    # a gap before each text keeps words of neighbours apart
    lengths = np.diff(offsets)
    flat = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), 1):
        flat[a - offsets[0] + i : b - offsets[0] + i] = data[a:b]
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    start, word = word_hashes(flat)
    bounds = np.searchsorted(start, begins)
    whole = np.zeros(max(0, len(word) - k + 1), np.uint64)
    for i in range(k):
        whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + word[i : i + len(whole)])
    out = []
    for a, b, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), valid.tolist(), strict=True):
        if not ok or a == b:
            out.append(np.zeros(0, np.uint64))
        elif b - a >= k:
            s = np.sort(whole[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            h = np.full(1, b - a, np.uint64)
            for w in word[a:b]:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
            out.append(h)
    return out
