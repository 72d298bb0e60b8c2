"""Periodic runs of words in whole texts, by longest common extensions over a difference cover.

Words are maximal runs of bytes other than ``\\x20 \\x09-\\x0D`` and are compared exactly. A run is a stretch of consecutive
words with smallest period q, at least ``max(min_words, min_repeats * q)`` words long, that no neighbouring word extends.

Longest common extensions (how many words agree from places i and j on): only suffixes at places whose residue modulo 31 lies
in a difference cover are sorted, by the words of a block and then by doubling of ranks. Any two places reach sorted ones after
the same few steps, so a query compares at most 30 words and then takes a minimum over the common prefixes of neighbours in
sorted order, from a sparse table.

Runs: words that agree at distance q form stretches of ``m = max(min_words - q, (min_repeats - 1) * q)`` or more places. The
places of a grid of step ``m / 2`` meet the first half of each such stretch, and over all q these grids have a harmonic number
of places a word. A grid place whose words agree is extended to the right by one query, to the left by bisection with further
ones. A stretch found for several periods belongs to the least, which divides the others.

Many short texts are worked on at once, with a word of its own between two texts; a long text is one piece of work, whose
memory is a small multiple of its own. Null and empty texts have no words and no runs. Texts are never cut.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import free_name, small_batches

#: A perfect difference set: every difference modulo 31 occurs between two of its members.
MODULUS, COVER = 31, np.array([1, 5, 11, 24, 25, 27])
MIN_WORDS, MIN_REPEATS = 24, 3
#: Words worked on at once; a text that has more is worked on alone.
WORDS_AT_ONCE = 1 << 17
#: Grid places looked at at once.
PLACES_AT_ONCE = 1 << 21


def _steps_to_cover() -> np.ndarray:
    """For residues (r, s) the least d such that r + d and s + d both lie in the cover."""
    inside = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    r, s, d = np.ogrid[:MODULUS, :MODULUS, :MODULUS]
    both = inside[(r + d) % MODULUS] & inside[(s + d) % MODULUS]
    return both.argmax(axis=2)


_STEPS = _steps_to_cover()
_NTH = np.full(MODULUS, -1)
_NTH[COVER] = np.arange(len(COVER))


class Extensions:
    """Longest common extensions of places of ``x``, in which equal suffixes must not occur (a last symbol of its own)."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        self.x = np.concatenate([x, np.full(2 * MODULUS, -1, x.dtype)])
        at = (np.arange(0, self.n, MODULUS)[:, None] + COVER).ravel()
        self.places = at[at < self.n]
        self._sort()
        self._neighbours()

    def _index(self, place: np.ndarray) -> np.ndarray:
        """Where sampled places stand in ``places``; those past the end stand behind the last."""
        return np.minimum(place // MODULUS * len(COVER) + _NTH[place % MODULUS], len(self.places))

    def _sort(self) -> None:
        """``order`` of the sampled suffixes, and for each doubling the rank by the first words."""
        s = len(self.places)
        self.order, rank, self.levels = np.arange(s), np.zeros(s + 1, np.int64), []
        rank[s] = -1
        open_slots = np.arange(s)
        bits = max(1, int(self.x.max()).bit_length() if self.n else 1) + 1
        at_once = max(1, 62 // bits)
        for first in range(0, MODULUS, at_once):
            if len(open_slots) == 0:
                break
            where = self.places[self.order[open_slots]]
            key = np.zeros(len(where), np.int64)
            for k in range(first, min(first + at_once, MODULUS)):
                key = (key << bits) | (self.x[np.minimum(where + k, self.n)].astype(np.int64) + 1)
            open_slots = self._refine(rank, open_slots, key)
        width = MODULUS
        while True:
            self.levels.append(rank.copy() if len(open_slots) else rank)
            if len(open_slots) == 0:
                break
            key = rank[self._index(self.places[self.order[open_slots]] + width)]
            open_slots = self._refine(rank, open_slots, key)
            width *= 2
        self.slot = np.empty(s + 1, np.int64)
        self.slot[self.order] = np.arange(s)

    def _refine(self, rank: np.ndarray, slots: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Orders the members of ties by ``key``; gives the slots that are still tied."""
        members = self.order[slots]
        by = np.lexsort((key, rank[members]))
        members, key = members[by], key[by]
        old = rank[members]
        self.order[slots] = members
        new = np.ones(len(slots), bool)
        new[1:] = (old[1:] != old[:-1]) | (key[1:] != key[:-1])
        begin = np.flatnonzero(new)
        rank[members] = np.repeat(slots[begin], np.diff(np.append(begin, len(slots))))
        alone = new & np.append(new[1:], True)
        return slots[~alone]

    def _neighbours(self) -> None:
        """The common prefixes of neighbours in ``order``, and their sparse table of minima."""
        a, b = self.places[self.order[:-1]], self.places[self.order[1:]]
        same = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[level]
            same += np.where(rank[self._index(a + same)] == rank[self._index(b + same)], MODULUS << level, 0)
        same += self._words(a + same, b + same, np.full(len(a), MODULUS))
        del self.levels
        self.minima = [same.astype(np.int32)]
        step = 1
        while 2 * step <= len(same):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def _words(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words agree from i and j on, up to ``limit``, compared one by one."""
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero(limit > 0)
        for step in range(int(limit.max(initial=0))):
            live = live[limit[live] > step]
            live = live[self.x[np.minimum(i[live] + step, self.n)] == self.x[np.minimum(j[live] + step, self.n + 1)]]
            if not len(live):
                break
            out[live] = step + 1
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from places i and j > i on."""
        steps = _STEPS[i % MODULUS, j % MODULUS]
        out = self._words(i, j, steps)
        far = np.flatnonzero(out == steps)
        if len(far):
            a, b = (self.slot[self._index(p[far] + steps[far])] for p in (i, j))
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            least = np.empty(len(far), np.int64)
            for k in np.unique(level):
                here = level == k
                row = self.minima[k]
                least[here] = np.minimum(row[low[here]], row[high[here] - (1 << k)])
            out[far] += least
        return out


def runs_of(x: np.ndarray, begins: np.ndarray, lengths: np.ndarray, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> np.ndarray:
    """Rows (text, start, length, period) by text, start and period.

    ``x`` holds the numbered words of several texts at ``begins``, with a number of its own after each text.
    """
    most = np.where(lengths >= min_words, lengths // min_repeats, 0)
    texts = np.repeat(np.arange(len(lengths)), most)
    if not len(texts):
        return np.zeros((0, 4), np.int64)
    extend = Extensions(x)
    period = np.arange(len(texts)) - np.repeat(np.cumsum(most) - most, most) + 1
    need = np.maximum(min_words - period, (min_repeats - 1) * period)
    grid = (need + 1) // 2
    ahead = need - grid + 1  # a stretch goes on so far behind its first grid place
    places = (lengths[texts] - period - ahead) // grid + 1
    cuts = np.append(np.searchsorted(np.cumsum(places), np.arange(0, places.sum(), PLACES_AT_ONCE)), len(texts))
    found = []
    for low, high in itertools.pairwise(np.unique(cuts)):
        n = places[low:high]
        pair = np.repeat(np.arange(low, high), n)
        at = (np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)) * grid[pair]
        for probe in (np.zeros_like(ahead), ahead - 1, (ahead - 1) // 2):
            i = begins[texts[pair]] + at + probe[pair]
            same = np.flatnonzero(x[i] == x[i + period[pair]])
            pair, at = pair[same], at[same]
        if len(pair):
            found.append(_stretches(extend, begins[texts[pair]], at, period[pair], grid[pair], ahead[pair], texts[pair]))
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    rows = rows[rows[:, 2] >= np.maximum(min_words, min_repeats * rows[:, 3])]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    least = np.ones(len(rows), bool)
    least[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[least]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _stretches(extend: Extensions, begin, at, period, grid, ahead, text) -> np.ndarray:
    """The stretches that begin at most a grid step before these places, as rows (text, start, length, period)."""
    right = extend(begin + at, begin + at + period)
    keep = np.flatnonzero(right >= ahead)
    begin, at, period, grid, text, right = (c[keep] for c in (begin, at, period, grid, text, right))
    # an earlier grid place stands in the same stretch
    earlier = np.flatnonzero(at >= grid)
    again = np.zeros(len(at), bool)
    before = (begin + at - grid)[earlier]
    again[earlier] = extend(before, before + period[earlier]) >= grid[earlier]
    begin, at, period, grid, text, right = (c[~again] for c in (begin, at, period, grid, text, right))
    low, high = np.maximum(at - grid + 1, 0), at.copy()
    while len(todo := np.flatnonzero(low < high)):
        mid = (low[todo] + high[todo]) // 2
        reaches = extend(begin[todo] + mid, begin[todo] + mid + period[todo]) >= at[todo] - mid
        high[todo[reaches]] = mid[reaches]
        low[todo[~reaches]] = mid[~reaches] + 1
    return np.stack([text, low, at + right - low + period, period], axis=1)


def _pieces(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    """The words of each text, in lists of about ``WORDS_AT_ONCE`` words or of one longer text."""
    piece, held = [], 0
    for text in texts:
        value = text.as_py()
        words = value.encode("utf-8", "surrogatepass").split() if value else []
        if piece and held + len(words) > WORDS_AT_ONCE:
            yield piece
            piece, held = [], 0
        piece.append(words)
        held += len(words)
    if piece:
        yield piece


def find_in(piece: list[list[bytes]], min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> np.ndarray:
    """Rows (text, start, length, period) of the runs in lists of words."""
    lengths = np.array([len(w) for w in piece], np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    numbers = defaultdict(itertools.count().__next__)
    x = np.empty(int(lengths.sum()) + len(piece), np.int32)
    for words, begin in zip(piece, begins.tolist(), strict=True):
        x[begin : begin + len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
    x[begins + lengths] = len(numbers) + np.arange(len(piece))
    return runs_of(x, begins, lengths, min_words, min_repeats)


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words left when of each run only its first period stays."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, runs[:, 1] + runs[:, 3], 1)
    np.add.at(change, runs[:, 1] + runs[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def periodic(text: Column, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> Column:
    """A struct of the number of words, the runs by start and period, and the text in which each run is its first period only."""
    small_batches()

    @F.arrow_udf("n_words long, runs array<struct<start long, length long, period long>>, collapsed string, collapsed_sha256 string")
    def worked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            n_words, counts, rows, left = [], [], [], []
            for piece in _pieces(texts):
                found = find_in(piece, min_words, min_repeats)
                bounds = np.searchsorted(found[:, 0], np.arange(len(piece) + 1))
                for i, words in enumerate(piece):
                    left.append(_collapsed(words, found[bounds[i] : bounds[i + 1]]))
                n_words += map(len, piece)
                counts.append(np.diff(bounds))
                rows.append(found[:, 1:])
            flat = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else np.zeros(0, np.int64))]).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], names=["start", "length", "period"])
            yield pa.StructArray.from_arrays(
                [
                    pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), runs),
                    pa.array(left, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(b).hexdigest() for b in left], pa.string()),
                ],
                names=["n_words", "runs", "collapsed", "collapsed_sha256"],
            )

    return worked(text)


def find_runs(df: DataFrame, text: Column | str = "text", min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """``df`` with ``n_words``, ``runs``, ``collapsed`` and ``collapsed_sha256``; columns of these names are replaced."""
    names = ("n_words", "runs", "collapsed", "collapsed_sha256")
    found = free_name(df, "periodic")
    column = F.col(text) if isinstance(text, str) else text
    kept = [c for c in df.columns if c.lower() not in names]
    worked = df.withColumn(found, periodic(column, min_words, min_repeats))
    return worked.select(*kept, *(F.col(f"{found}.{c}").alias(c) for c in names))
