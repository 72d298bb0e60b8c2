"""Points in intervals: the bucketed range join and what is built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many buckets an interval may touch before it moves to wider ones, and how many widths there are.
WIDE, LEVELS = 32, 3


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, bucket: float, how: str = "inner", condition: Column | None = None) -> DataFrame:
    """Pairs of a point and an interval of the same keys that covers it, ends included, and meets ``condition``.

    Intervals are exploded to the buckets of width ``bucket`` that they touch, so the join is an equi-join on keys and
    bucket with an exact test after it; a point lies in one bucket, hence no pair comes twice. Choose ``bucket`` near the
    usual length. An interval of more than ``WIDE`` buckets goes to buckets ``WIDE`` times as wide, and so on, so that
    none up to ``WIDE`` ** ``LEVELS`` buckets becomes more than ``WIDE`` + 1 rows; points meet one bucket of each width.
    ``points`` and ``intervals`` share no column names but the keys. ``how`` is inner, left_semi or left_anti; the last
    two give back rows of ``points`` as they are, also those with nulls, and use one width only.
    """
    levels = LEVELS if how == "inner" else 1
    spread = intervals.where(F.col(end) >= F.col(start))
    length = (F.col(end) - F.col(start)) / F.lit(float(bucket) * WIDE)
    level = F.when(length <= 1, 0).otherwise(F.ceil(F.log(float(WIDE), length) - 1e-9)).cast("int")
    spread = spread.withColumn("_level", F.least(level, F.lit(levels - 1)))
    width = F.lit(float(bucket)) * F.pow(F.lit(float(WIDE)), F.col("_level"))
    spread = spread.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    spread = spread.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    place = lambda n: F.struct(F.lit(n).alias("_at_level"), F.floor(F.col(at) / F.lit(float(bucket) * WIDE**n)).alias("_at_bucket"))
    match = (F.col("_at_bucket") == F.col("_bucket")) & (F.col("_at_level") == F.col("_level")) & (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    for k in keys:
        match &= F.col(k) == F.col(f"_k_{k}")
    if condition is not None:
        match &= condition
    hit = points.select("*", F.inline(F.array(*map(place, range(levels))))).join(spread, match, how)
    return hit.drop("_at_level", "_at_bucket", "_level", "_bucket", *(f"_k_{k}" for k in keys))


def interval_stats(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, bucket: float, **aggs: Column) -> DataFrame:
    """``points`` (distinct on keys and ``at``) with aggregates over the intervals that cover them; null where none does."""
    hit = range_join(points.select(*keys, at), intervals, keys, at, start, end, bucket)
    return points.join(hit.groupBy(*keys, at).agg(*(c.alias(n) for n, c in aggs.items())), [*keys, at], "left")


def exists_near(events: DataFrame, occupied: DataFrame, keys: list[str], at: str, other_at: str, window: float, condition: Column) -> DataFrame:
    """``events`` with ``near``: whether a row of ``occupied`` lies within ``window`` of it and meets ``condition``; never null."""
    spans = occupied.withColumn("_lo", F.col(other_at) - F.lit(window)).withColumn("_hi", F.col(other_at) + F.lit(window))
    part = lambda how: range_join(events, spans, keys, at, "_lo", "_hi", 2 * window, how, condition)
    return part("left_semi").withColumn("near", F.lit(True)).unionByName(part("left_anti").withColumn("near", F.lit(False)))


def split_daily(intervals: DataFrame, start: str, end: str, day_minutes: int = 1440) -> DataFrame:
    """One piece per calendar day that an interval touches; pieces before the last end a second before midnight."""
    first, last = F.floor(F.col(start) / day_minutes), F.floor(F.col(end) / day_minutes)
    d = intervals.where(F.col(end) >= F.col(start)).withColumn("day", F.explode(F.sequence(first, last)))
    return d.withColumn("piece_start", F.greatest(F.col(start), (F.col("day") * day_minutes).cast("double"))).withColumn(
        "piece_end", F.least(F.col(end), ((F.col("day") + 1) * day_minutes).cast("double") - 1.0 / 60)
    )


def open_as_of(intervals: DataFrame, now: Column, start: str, end: str, cap: float) -> DataFrame:
    """What is known at ``now``: started intervals only; an end in the future or missing runs to ``now``, at most ``cap`` after the start."""
    known_end = F.when(F.col(end) <= now, F.col(end))
    return intervals.where(F.col(start) <= now).withColumn("known_end", F.coalesce(known_end, F.least(now, F.col(start) + F.lit(float(cap)))))


def in_force(intervals: DataFrame, now: Column, start: str, end: str) -> DataFrame:
    """Intervals in force at ``now``; a missing start or end is open."""
    return intervals.where((F.col(start).isNull() | (F.col(start) <= now)) & (F.col(end).isNull() | (F.col(end) >= now)))


def spread_to_incident(nodes: DataFrame, edges: DataFrame, node: str, value: str) -> DataFrame:
    """A value of nodes put on every edge at them; the largest wins."""
    ends = edges.select("a", "b", F.explode(F.array("a", "b")).alias(node))
    return ends.join(nodes, node).groupBy("a", "b").agg(F.max(value).alias(value))


def expand_aggregate(pairs: DataFrame, order: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs that span skipped nodes become the consecutive pairs between them; ``order`` has (node, position). Others stay."""
    one, two = order.select(F.col("node").alias(a), F.col("position").alias("_pa")), order.select(F.col("node").alias(b), F.col("position").alias("_pb"))
    d = pairs.join(one, a).join(two, b)
    low, high = F.least("_pa", "_pb"), F.greatest("_pa", "_pb")
    steps = d.where(high > low).withColumn("_p", F.explode(F.sequence(low, high - 1))).drop(a, b, "_pa", "_pb")
    left, right = order.select(F.col("node").alias(a), F.col("position").alias("_p")), order.select(F.col("node").alias(b), (F.col("position") - 1).alias("_p"))
    return steps.join(left, "_p").join(right, "_p").drop("_p")
