"""Hard-negative mining: exact integer scores of anchors against all rows, by Kronecker-packed products.

Components become integers, ``floor(scale * x)``. The components of several candidates are biased to be non-negative and put
into separated fields of one wide integer; the anchors' are biased too. One multiplication of a packed component with an
anchor's, summed over the components, then gives the scores of all these candidates at once, each in its own field, since no
field can overflow: a field is as wide as the largest sum of products needs. Shifts and masks take the fields apart, and the
biases are taken off again. Where the fields fit 53 bits the wide integers are held in doubles, in which each sum is still
exact and for which there is a fast matrix product; components too large for that use Python's integers.

Anchors and candidates meet in the cells of a grid: a block of anchors, bounded in bytes, with one of ``chunks`` parts of
the rows, which streams past it. A cell keeps the best few for each anchor, and these are merged by anchor. The first round
finds an anchor's positives, the second, with their scores as bounds, its negatives.

Rows with a null label, a null vector or a null or non-finite component take no part. Rows are told apart by themselves, not
by their id: rows that share an id are each an anchor and each other's candidates. A null id is no anchor and comes last among
equal scores. Only vectors of as many components as the anchor's have a score; empty vectors have score 0 with each other.
Scores beyond a long count as its nearest value. An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm.common import discard, small_batches, written

#: Bytes of anchors' components in a block.
ANCHOR_BYTES = 8 << 20
#: Products of components that make a cell worth a task, and rows of a cell at most.
CELL_PRODUCTS, CELL_ROWS = 1 << 27, 1 << 17
#: Anchors and candidates of one matrix product.
TILE_ANCHORS, TILE_ROWS = 256, 4096
EXACT_BITS = 53
#: Candidates in one wide integer where Python's integers are used.
WIDE_FIELDS = 16
_LONG = np.iinfo(np.int64)


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of finite values: doubles that hold whole numbers, or Python's integers where these are large."""
    values = values.astype(np.float64)
    if values.size == 0 or np.abs(values).max() < 2.0**40:
        return np.floor(scale * values)
    out = np.empty(values.shape, object)
    out.ravel()[:] = [int(x) * scale if abs(x) >= 2.0**60 else int(np.floor(scale * x)) for x in values.ravel().tolist()]
    return out


class Anchors:
    """Anchors' integer components, biased once, to be multiplied with packed candidates."""

    def __init__(self, components: np.ndarray):
        self.dim = components.shape[1]
        self.bias = int(max(0, -components.min())) if components.size else 0
        self.biased = components + self.bias
        self.largest = int(self.biased.max()) if components.size else 0
        self.sums = components.sum(axis=1)

    def scores(self, components: np.ndarray) -> np.ndarray:
        """The inner products with each anchor (rows) of each candidate (columns)."""
        n, dim = components.shape
        if not n or not dim:
            return np.zeros((len(self.biased), n), np.int64)
        bias = int(max(0, -components.min()))
        biased = components + bias
        width = max(1, (dim * self.largest * int(biased.max())).bit_length())
        exact = width <= EXACT_BITS and biased.dtype != object and self.biased.dtype != object
        fields = EXACT_BITS // width if exact else WIDE_FIELDS
        per = -(-n // fields)
        packed = np.zeros((per, dim), np.float64 if exact else object)
        for f in range(fields):
            part = biased[f * per : (f + 1) * per]
            if exact:
                packed[: len(part)] += part * float(1 << width * f)
            else:
                packed[: len(part)] += self._whole(part) * (1 << width * f)
        sums, own = components.sum(axis=1)[None, :], self.sums[:, None]
        if exact:
            sums, own = sums.astype(np.int64), own.astype(np.int64)
        else:
            sums, own = self._whole(sums), self._whole(own)
        both = own * bias + sums * self.bias + dim * self.bias * bias
        if exact:
            product = (self.biased @ packed.T).astype(np.int64)
            mask = (1 << width) - 1
            fielded = np.concatenate([(product >> width * f) & mask for f in range(fields)], axis=1)[:, :n]
            return fielded - both
        product = self._whole(self.biased) @ packed.T
        fielded = np.concatenate([(product >> width * f) & ((1 << width) - 1) for f in range(fields)], axis=1)[:, :n]
        return np.clip(fielded - both, int(_LONG.min), int(_LONG.max)).astype(np.int64)

    @staticmethod
    def _whole(values: np.ndarray) -> np.ndarray:
        if values.dtype == object:
            return values
        out = np.empty(values.shape, object)
        out.ravel()[:] = [int(x) for x in values.ravel().tolist()]
        return out


class Cell:
    """A block of anchors, and the best candidates so far of each of their bands.

    A band is an anchor with bounds of the score; without ``positives`` each anchor has one, of any score and the same label,
    and with them one for each positive's score, of another label.
    """

    def __init__(self, head: pa.RecordBatch, dim: int, scale: int, k: int, low: int, high: int):
        self.rows, self.labels = head["row"].to_numpy(), head["label"].to_numpy()
        matrix = integers(_matrix(head["vec"], dim), scale)
        bounds = head["positives"]
        self.negative = bounds.null_count < len(bounds)
        self.k, self.scale = k, scale
        if self.negative:
            counts = np.diff(bounds.offsets.to_numpy())
            score = bounds.flatten().to_numpy()
            self.band_anchor = np.repeat(np.arange(len(self.rows)), counts)
            self.band = np.arange(len(score)) - np.repeat(np.cumsum(counts) - counts, counts)
            whole, rest = np.divmod(score, 100)
            self.least, self.most = low * whole - (-low * rest) // 100, high * whole + (high * rest) // 100
        else:
            self.band_anchor = np.arange(len(self.rows))
            self.band = np.zeros(len(self.rows), np.int64)
            self.least, self.most = np.full(len(self.rows), _LONG.min), np.full(len(self.rows), _LONG.max)
        edges = np.arange(0, len(self.rows), TILE_ANCHORS)
        self.tiles = [(a, Anchors(matrix[a : a + TILE_ANCHORS])) for a in edges.tolist()]
        # a candidate comes after all earlier ones of its score, so a full band only takes larger scores
        self.last = np.full(len(self.band), _LONG.min)
        self.full = np.zeros(len(self.band), bool)
        self.best = np.zeros((0, 4), np.int64)  # band's place, score, order, candidate's place among those seen
        self.seen_rows, self.seen_ids, self.seen = [], [], 0
        self.step = 64

    def feed(self, tail: pa.RecordBatch, dim: int) -> None:
        matrix = integers(_matrix(tail["vec"], dim), self.scale)
        rows, labels = tail["row"].to_numpy(), tail["label"].to_numpy()
        at = 0
        while at < len(rows):
            till = min(at + self.step, len(rows))
            self._take(matrix[at:till], rows[at:till], labels[at:till], tail["id"].slice(at, till - at))
            at, self.step = till, min(2 * self.step, TILE_ROWS)

    def _take(self, matrix: np.ndarray, rows: np.ndarray, labels: np.ndarray, ids: pa.Array) -> None:
        new = []
        for first, anchors in self.tiles:
            score = anchors.scores(matrix)
            low, high = np.searchsorted(self.band_anchor, [first, first + TILE_ANCHORS])
            owner = self.band_anchor[low:high]
            # bands hold few rows: those that pass by score are looked at by label
            s = score[owner - first]
            least = np.maximum(self.least[low:high], self.last[low:high] + self.full[low:high])
            band, col = np.nonzero((s >= least[:, None]) & (s <= self.most[low:high, None]))
            same = self.labels[owner[band]] == labels[col]
            ok = ~same if self.negative else same & (self.rows[owner[band]] != rows[col])
            band, col = band[ok], col[ok]
            new.append(np.stack([band + low, s[band, col], col + self.seen], axis=1))
        found = np.concatenate(new)
        self.seen += len(rows)
        if not len(found):
            return
        used, place = np.unique(found[:, 2], return_inverse=True)
        base = sum(map(len, self.seen_rows))
        self.seen_rows.append(rows[used - (self.seen - len(rows))])
        self.seen_ids.append(ids.take(pa.array(used - (self.seen - len(rows)))))
        both = np.concatenate([self.best, np.column_stack([found, base + place])])
        both = both[np.lexsort((both[:, 2], ~both[:, 1], both[:, 0]))]
        nth = np.arange(len(both)) - np.searchsorted(both[:, 0], both[:, 0])
        self.best = both[nth < self.k]
        counts = np.bincount(self.best[:, 0], minlength=len(self.band))
        self.full = counts == self.k
        self.last[self.full] = self.best[np.cumsum(counts)[self.full] - 1, 1]
        if base > 4 * len(self.best) + TILE_ROWS:
            self._forget()

    def _forget(self) -> None:
        """Keeps the ids and rows of those candidates only that are still among the best."""
        used, place = np.unique(self.best[:, 3], return_inverse=True)
        self.seen_rows = [np.concatenate(self.seen_rows)[used]]
        self.seen_ids = [pa.concat_arrays(self.seen_ids).take(pa.array(used))]
        self.best[:, 3] = place

    def result(self) -> pa.RecordBatch | None:
        if not len(self.best):
            return None
        band, score, _, place = self.best.T
        take = pa.array(np.ascontiguousarray(place))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.rows[self.band_anchor[band]]), pa.array(self.band[band], pa.int32()),
                pa.array(np.concatenate(self.seen_rows)).take(take), pa.concat_arrays(self.seen_ids).take(take), pa.array(np.ascontiguousarray(score)),
            ],
            names=["anchor", "band", "row", "id", "score"],
        )


def _matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dim)


def _best_in_cells(rows: DataFrame, anchors: DataFrame, groups: int, chunks: int, scale: int, k: int, low: int, high: int) -> DataFrame:
    """(anchor, band, row, id, score): the ``k`` best candidates of each band in each cell.

    ``rows`` has (row, id, label, vec), ``anchors`` also ``positives``, an array of scores or null.
    """
    dim = F.size("vec").alias("dim")
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    chunk = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(chunks)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    heads = anchors.select(dim, group.alias("group"), numbers(chunks).alias("chunk"), F.lit(0).alias("kind"), "row", "id", "label", "vec", "positives")
    tails = rows.select(dim, numbers(groups).alias("group"), chunk.alias("chunk"), F.lit(1).alias("kind"), "row", "id", "label", "vec", F.lit(None).cast("array<long>").alias("positives"))
    cell = ["dim", "group", "chunk"]
    dealt = heads.unionByName(tails).repartition(max(1, min(groups * chunks, 20_000)), *cell)
    dealt = dealt.sortWithinPartitions(*cell, "kind", F.col("id").asc_nulls_last(), "row")

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head, now = None, [], None
        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in (*cell, "kind")], axis=1)
            cuts = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys))
            at = 0
            for cut in cuts.tolist():
                part, key = batch.slice(at, cut - at), tuple(keys[at].tolist())
                at = cut
                if not part.num_rows:
                    continue
                if key[:3] != now:
                    if held is not None and (out := held.result()) is not None:
                        yield out
                    held, head, now = None, [], key[:3]
                if key[3] == 0:
                    head.append(part)
                    continue
                if head:
                    held, head = Cell(pa.Table.from_batches(head).combine_chunks().to_batches()[0], key[0], scale, k, low, high), []
                if held is not None:
                    held.feed(part, key[0])
        if held is not None and (out := held.result()) is not None:
            yield out

    return dealt.mapInArrow(worked, "anchor long, band int, row long, id long, score long")


def mine(
    df: DataFrame, anchor: Column, key: str = "vec_id", label: Column | str = "label", vector: str = "embedding",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score).

    Anchors are the rows where ``anchor`` holds. Each one's ``positives`` best other rows of its label (a whole number) stand
    with the ``negatives`` best rows of other labels whose score is ``low`` to ``high`` percent of the positive's. Higher
    scores come first, then smaller ids.
    """
    spark = df.sparkSession
    small_batches(spark)
    sound = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    named = F.col(label) if isinstance(label, str) else label
    rows = df.where(sound & named.isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), named.cast("long").alias("label"), F.col(vector).alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor")
    )
    rows = written(rows, "vectors")  # from here on a row has its number
    size = F.size("vec").cast("long")
    facts = rows.agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors"), F.sum(F.when(F.col("anchor"), size)).alias("parts")).first()
    n, asked, parts = facts["n"], facts["anchors"] or 0, facts["parts"] or 0
    groups = max(1, -(-8 * parts // ANCHOR_BYTES))
    block = max(1, asked // groups)
    per = min(CELL_ROWS, max(CELL_PRODUCTS // max(1, parts // groups), block))
    chunks = max(1, -(-n // per), min(-(-n // 512), 3 * spark.sparkContext.defaultParallelism))
    slim = rows.select("row", "id", "label", "vec")
    anchors = rows.where("anchor").select("row", "id", "label", "vec")
    shape = (groups, chunks, scale)

    def merged(found: DataFrame, k: int) -> DataFrame:
        order = W.partitionBy("anchor", "band").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = _best_in_cells(slim, anchors.withColumn("positives", F.lit(None).cast("array<long>")), *shape, positives, low, high)
    best = written(merged(first, positives).select("anchor", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    bounds = best.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("listed"))
    asking = anchors.join(bounds, "row").select("row", "id", "label", "vec", F.col("listed.positive_score").alias("positives"))
    second = _best_in_cells(slim, asking, *shape, negatives, low, high)
    found = written(merged(second, negatives).select("anchor", F.col("band").alias("at"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "negatives")
    ids = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = best.join(ids, "anchor").select("anchor", (F.col("rank") - 1).alias("at"), F.col("rank").alias("positive_rank"), "anchor_id", "positive_id", "positive_score")
    out = found.join(pairs, ["anchor", "at"]).select("anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score")
    out = written(out, "mined")
    for done in (rows, best, found):
        discard(done)
    return out
