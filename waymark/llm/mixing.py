"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they
belong to). Word capacity flows from the patterns to the quotas of their
sources; a pattern can be repeated up to ``max_repeats`` times, each
repetition costing more than the one before, so first passes are used up
before second ones. A pattern's flow then becomes whole passes over its
documents plus a seeded selection that takes the rest: the documents
whose prefix sum, in the order of a seeded hash, stays within it.

Only aggregates (a row per pattern) reach the driver, and their number is
checked. The prefix sums run over hash buckets, refined twice, so rows
are ordered only inside one bucket in 16 million.

Null texts have 0 words and null sources are a source of their own, last
in order. Documents without words take nothing. Repeated rows are counted
each on its own. An empty table gives an empty result. A pattern's taken
words differ from its flow by less than one document.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm.common import discard, written

WORD = r"[^\x20\x09-\x0D]+"
#: Patterns above this are refused: the flow is solved on the driver.
MAX_PATTERNS = 50_000


def code_point_order(names):
    return sorted(names, key=lambda s: (s is None, s or ""))


def source_targets(
    sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, words: int | None = None
) -> dict[str | None, float]:
    """Shares of all ``words`` by weight, none above ``cap`` times its source's size; what is above goes to the others by weight."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(code_point_order(sizes))}
    left, of, out = sum(sizes.values()) if words is None else words, sum(weight.values()), {}
    # the sources that end at their cap are the first ones in the order of cap by weight
    for s in sorted(sizes, key=lambda s: (cap * sizes[s] / weight[s], s is None, s or "")):
        if cap * sizes[s] * of >= left * weight[s]:
            break
        out[s] = float(cap * sizes[s])
        left, of = left - cap * sizes[s], of - weight[s]
    return out | {s: left * weight[s] / of for s in sizes if s not in out}


def min_cost_flow(capacity: dict[str, int], members: dict[str, list], quota: dict, repeats: int) -> dict[str, int]:
    """Words that each pattern gives: the most that the quotas take, at the least cost.

    Level r of a pattern holds its capacity again at cost r, which makes the cost convex. All costs lie on the arcs out of
    the start, so shortest paths of cost r are those through a pattern whose levels below r are used up: the flow is found
    as one maximum flow per level, each going on from the one before.
    """
    patterns = [p for p in sorted(capacity) if capacity[p] > 0]
    sources = {s: len(patterns) + i for i, s in enumerate(quota)}
    network = _Network(len(patterns) + len(sources))
    for n, p in enumerate(patterns):
        for s in members[p]:
            network.arc(n, sources[s], 1 << 62)
    for s, q in quota.items():
        network.arc(sources[s], network.sink, q)
    given = [network.arc(network.start, n, 0) for n in range(len(patterns))]
    for _ in range(repeats):
        for n, p in enumerate(patterns):
            network.room[given[n]] += capacity[p]
        network.fill()
    return {p: network.room[given[n] ^ 1] for n, p in enumerate(patterns)}


class _Network:
    """A flow network between ``start`` and ``sink``; arcs are numbered in pairs with their reverse."""

    def __init__(self, nodes: int):
        self.start, self.sink = nodes, nodes + 1
        self.head: list[int] = []
        self.room: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(nodes + 2)]

    def arc(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.head))
            self.head.append(y)
            self.room.append(r)
        return len(self.head) - 2

    def fill(self) -> None:
        """Adds a maximum flow: blocking flows over shortest paths, until the sink is cut off."""
        while (depth := self._depths())[self.sink] >= 0:
            nxt = [0] * len(self.out)
            path: list[int] = []
            at = self.start
            while True:
                if at == self.sink:
                    push = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= push
                        self.room[e ^ 1] += push
                    # back to where the first full arc leaves
                    full = next(i for i, e in enumerate(path) if not self.room[e])
                    at = self.head[path[full] ^ 1]
                    del path[full:]
                    continue
                while nxt[at] < len(self.out[at]):
                    e = self.out[at][nxt[at]]
                    if self.room[e] and depth[self.head[e]] == depth[at] + 1:
                        break
                    nxt[at] += 1
                if nxt[at] < len(self.out[at]):
                    path.append(self.out[at][nxt[at]])
                    at = self.head[path[-1]]
                elif path:
                    at = self.head[path.pop() ^ 1]
                    nxt[at] += 1
                else:
                    break

    def _depths(self) -> list[int]:
        depth = [-1] * len(self.out)
        depth[self.start], line = 0, [self.start]
        for a in line:
            for e in self.out[a]:
                if self.room[e] and depth[self.head[e]] < 0:
                    depth[self.head[e]] = depth[a] + 1
                    line.append(self.head[e])
        return depth


def seeded_order(key: Column, size: Column, seed: int) -> Column:
    """60 bits that put the rows in a random order; the same on any engine that has md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), size.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _edge(rows: DataFrame, known: DataFrame, bits: int) -> DataFrame:
    """Per pattern, the bucket of the leading ``bits`` that ``rest`` falls into and the words before it."""
    bucket = F.shiftright("order", 60 - bits)
    upto = W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = (
        rows.join(F.broadcast(known.select("pattern", "rest", "spent")), "pattern")
        .groupBy("pattern", "rest", "spent", bucket.alias("bucket"))
        .agg(F.sum("size").alias("words"))
        .withColumn("upto", F.col("spent") + F.sum("words").over(upto))
        .where(F.col("upto") > F.col("rest"))
        .groupBy("pattern", "rest")
        .agg(F.min("bucket").alias("edge"), F.min_by(F.col("upto") - F.col("words"), "bucket").alias("spent"))
    )
    return written(found, f"mix-edge-{bits}")


def with_selection(slim: DataFrame, wanted: DataFrame, of: DataFrame) -> DataFrame:
    """The rows ``of``, those of ``slim`` with more columns, with ``extra``: whether a row's middle lies within the ``rest`` words of its pattern, in seeded order.

    ``wanted`` has (pattern, full, rest), a row per pattern. Buckets of the leading 12 bits of the order are summed, then
    those of 24 bits inside the one that ``rest`` falls into; only rows of that last bucket are ordered one by one.
    """
    first = _edge(slim, wanted.withColumn("spent", F.lit(0).cast("long")), 12)
    at_first = slim.select("pattern", "order", "size").join(F.broadcast(first.select("pattern", "edge")), "pattern").where(F.shiftright("order", 48) == F.col("edge"))
    last = _edge(at_first.drop("edge"), first, 24)
    rows = of.join(F.broadcast(wanted.select("pattern", "full")), "pattern", "left").join(F.broadcast(last), "pattern", "left")
    bucket, edge = F.shiftright("order", 36), F.col("edge")
    whole = rows.where(edge.isNull() | (bucket != edge)).withColumn("extra", F.coalesce(bucket < edge, F.lit(False)))
    # carried columns settle the order of rows of one id and size, so that it is the same each time
    ties = [F.xxhash64("carried")] if "carried" in of.columns else []
    one_by_one = W.partitionBy("pattern").orderBy("order", "doc_id", "size", *ties).rowsBetween(W.unboundedPreceding, W.currentRow)
    middle2 = 2 * (F.col("spent") + F.sum("size").over(one_by_one)) - F.col("size")
    return whole.unionByName(rows.where(bucket == edge).withColumn("extra", middle2 <= 2 * F.col("rest")))


@dataclass(frozen=True)
class Mix:
    """``rows``: (doc_id, size, pattern, copies, taken, and carried where asked for), one for each row; ``sources``: (size, target) of each source;
    ``members``: the sources of each pattern, whose text is the one in ``rows``."""

    rows: DataFrame
    sources: dict[str | None, tuple[int, float]]
    members: dict[str, list[str | None]]


def pattern_of(members: Column) -> Column:
    """The set of sources of a row as text; null sources stand as null."""
    return F.to_json(F.sort_array(F.array_distinct(members)))


def mix(
    df: DataFrame, members: Column, key: str = "doc_id", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 17,
    carry: tuple[str, ...] = (),
) -> Mix:
    """How often the mix takes each row; ``members`` is an array with the sources of a row.

    The columns ``carry`` come back as the struct ``carried`` beside the decision on their row.
    """
    spark = df.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = df.select(F.col(key).alias("doc_id"), size.alias("size"), pattern_of(members).alias("pattern"), *([F.struct(*carry).alias("carried")] if carry else []))
    sized = sized.withColumn("order", seeded_order(F.col("doc_id"), F.col("size"), seed))
    slim = written(sized.drop("carried"), "mix-sizes")

    totals = slim.groupBy("pattern").agg(F.sum("size").alias("size"))
    got = totals.limit(MAX_PATTERNS + 1).collect()
    if len(got) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    capacity = {r["pattern"]: r["size"] for r in got}
    members_of = {p: json.loads(p) for p in capacity}
    sizes: dict[str | None, int] = {}
    for p, words in capacity.items():
        for s in members_of[p]:
            sizes[s] = sizes.get(s, 0) + words
    targets = source_targets(sizes, weights, max_repeats, sum(capacity.values()))
    flow = min_cost_flow(capacity, members_of, {s: int(t) for s, t in targets.items()}, max_repeats)
    wanted = spark.createDataFrame(
        [(p, n // capacity[p], n % capacity[p]) for p, n in sorted(flow.items())], "pattern string, full int, rest long"
    )
    copies = F.when(F.col("size") > 0, F.coalesce("full", F.lit(0)) + F.col("extra").cast("int")).otherwise(0)
    # rows with all that they carry are read again rather than kept a second time
    rows = with_selection(slim, wanted, sized if carry else slim).withColumn("copies", copies)
    if carry:
        discard(slim)
    rows = rows.select("doc_id", "size", "pattern", "copies", (F.col("size") * F.col("copies")).alias("taken"), *(["carried"] if carry else []))
    return Mix(rows, {s: (sizes[s], targets[s]) for s in sizes}, members_of)


def oracle_sql() -> str:
    """DuckDB text for the mix of ``documents`` by ``source`` with the defaults."""
    return """
    WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
    o AS (SELECT *, ('0x' || md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR)[:15])::BIGINT AS ord FROM d),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
    r AS (SELECT *, coalesce(sum(3 * source_size) OVER b, 0)::BIGINT AS caps, coalesce(sum(w) OVER b, 0)::BIGINT AS ws,
                 (SELECT sum(source_size) FROM s)::BIGINT AS t, (SELECT sum(w) FROM s)::BIGINT AS tw
          FROM s WINDOW b AS (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, 3 * source_size * (tw - ws) < (t - caps) * w AS capped FROM r),
    f AS (SELECT sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END)::BIGINT AS caps, sum(CASE WHEN capped THEN w ELSE 0 END)::BIGINT AS ws FROM c),
    g AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE ((t - f.caps) * w)::DOUBLE / (tw - f.ws) END AS target FROM c, f),
    n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS full_,
                 CASE WHEN source_size > 0 THEN floor(target)::BIGINT % source_size ELSE 0 END AS rest FROM g),
    x AS (SELECT o.doc_id, o.size, n.source_size, n.target, n.full_,
                 2 * sum(o.size) OVER (PARTITION BY o.source ORDER BY ord, o.doc_id, o.size ROWS UNBOUNDED PRECEDING) - o.size <= 2 * n.rest AS extra
          FROM o JOIN n ON o.source IS NOT DISTINCT FROM n.source)
    SELECT doc_id, size, source_size, target, (size * (full_ + extra::INT))::BIGINT AS taken FROM x"""
