"""Connected components of large graphs: chunks contracted by union-find, then star steps in which hubs are split.

An edge is kept as (hi, lo), hi > lo. A step replaces edges by others that link the same nodes and lie nearer to a star
forest, in which every node but a component's least hangs on that least one. Two kinds alternate: the first hangs a node's
greater neighbours on the least node around it, the second its smaller ones. A chain of n nodes whose edges lie anywhere
takes about log2 n rounds at worst; one whose edges lie in order in their files shrinks to its tasks' ends before the first.

A hub's edges never meet in one task. Edges are dealt by (node, ``SALTS`` parts of the neighbour); the least neighbour is
found per part, then per node from a row a part, and goes back to the parts that the node has. The parts of a node are at
most its edges, so a node of few edges costs no more rows than it has, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.sources.sinks import drop_written, written

#: Edges that a task contracts at once, and parts that a hub's edges are dealt to.
CHUNK, SALTS = 1 << 20, 256


def least_linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node linked with each of the nodes 0 to n - 1 over the edges (a, b): roots hang on smaller ones, then paths halve."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (hi, lo) of a star forest that links the same nodes."""
    codes, nodes = pd.factorize(np.concatenate([a, b]), sort=True)
    label = least_linked(codes[: len(a)], codes[len(a) :], len(nodes))
    hung = np.flatnonzero(label != np.arange(len(nodes)))
    return np.asarray(nodes)[hung], np.asarray(nodes)[label[hung]]


def contract(edges: DataFrame) -> DataFrame:
    """``edges`` (hi, lo) with each chunk of ``CHUNK`` edges of a task replaced by a star forest: never more rows, often far fewer."""
    size = CHUNK

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= size:
                yield forest(held)
                held, n = [], 0
        if n:
            yield forest(held)

    def forest(held: list[pd.DataFrame]) -> pd.DataFrame:
        hi, lo = _contracted(np.concatenate([b["hi"].to_numpy() for b in held]), np.concatenate([b["lo"].to_numpy() for b in held]))
        return pd.DataFrame({"hi": hi, "lo": lo})

    return edges.mapInPandas(stars, edges.schema)


def _with_least(rows: DataFrame) -> DataFrame:
    """``rows`` (u, v) with m, the least of u and all its v, without bringing a node's rows together."""
    parts = rows.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    per_part = parts.groupBy("u", "s").agg(F.min("v").alias("m"))
    per_node = per_part.groupBy("u").agg(F.least(F.min("m"), F.col("u")).alias("m"), F.collect_list("s").alias("parts"))  # at most SALTS
    return parts.join(per_node.select("u", "m", F.explode("parts").alias("s")), ["u", "s"]).select("u", "v", "m")


def hang_greater(edges: DataFrame) -> DataFrame:
    """Every node's greater neighbours hung on the least node among it and its neighbours."""
    both = edges.select(F.inline(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in (("hi", "lo"), ("lo", "hi"))))))
    return _with_least(both).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def hang_smaller(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours hung on the least of them."""
    met = _with_least(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    moved = met.where("v > m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(met.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()


def _hung(edges: DataFrame) -> DataFrame:
    """(n, least, most): what each node hangs on; nodes on which others hang also count as hanging on themselves."""
    ends = F.array(F.struct(F.col("hi").alias("n"), F.col("lo").alias("t")), F.struct(F.col("lo").alias("n"), F.col("lo").alias("t")))
    return edges.select(F.inline(ends)).groupBy("n").agg(F.min("t").alias("least"), F.max("t").alias("most"))


def star_forest(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(n, least): each node of the edges (a, b), of any order and repeated, with the least node linked with it; written.

    Each round is written, which keeps lineage short and survives lost executors; the number of edges after each is
    added to ``rounds`` where it is given. A round without two targets for any node is the last.
    """
    straight = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    now = written(contract(straight).distinct(), "stars")
    while True:
        if rounds is not None:
            rounds.append(now.count())
        hung = written(_hung(now), "hung")
        if hung.where("least <> most").isEmpty():
            drop_written(now)
            return hung.select("n", "least")
        drop_written(hung)
        after = written(hang_smaller(hang_greater(now)), "stars")
        drop_written(now)
        now = after


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", rounds: list[int] | None = None) -> DataFrame:
    """(node, component, isolated): the least node that is reachable over the undirected ``edges`` (a, b).

    Ids are numbers or texts, of one type in both tables. Edges with a null end are passed over, and those of a node with
    itself link nothing; repeated rows of either table count once. A node without edges is its own component. Ends that
    are not among ``nodes`` link others but give no row. Empty tables give no rows, or isolated nodes.
    """
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    found = star_forest(ends, rounds)
    own = nodes.where(F.col(node).isNotNull()).select(F.col(node).alias("n")).distinct()
    told = own.join(found, "n", "left")
    return told.select(F.col("n").alias(node), F.coalesce("least", "n").alias("component"), F.col("least").isNull().alias("isolated"))
