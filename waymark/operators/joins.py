"""Keyed joins: as-of values, latest rows, semi-joins, cross-checks and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def join_schedule_observation(schedule: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    return schedule.join(observed, keys, "left")


def observations_as_of(log: DataFrame, keys: list[str], reveal: str, value: str, now: Column) -> DataFrame:
    """The largest value per key among those known at ``now``."""
    return log.where(F.col(reveal) <= now).groupBy(*keys).agg(F.max(value).alias(value))


def observations_as_of_many(log: DataFrame, instants: DataFrame, keys: list[str], reveal: str, value: str, now: str) -> DataFrame:
    """Per key and instant the largest value known by then.

    Reveals and instants of a key are put in one order and a running maximum does the rest: one shuffle on the key, no
    join of each instant with all earlier reveals. ``instants`` has (keys, now). A log without reveal times can't tell
    what was known when, and is refused.
    """
    if reveal not in log.columns:
        raise ValueError(f"the log has no column {reveal}: it can't be replayed")
    a = log.select(*keys, F.col(reveal).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_kind"))
    b = instants.select(*keys, F.col(now).alias("_t"), F.lit(None).cast(log.schema[value].dataType).alias("_v"), F.lit(1).alias("_kind"))
    w = W.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = a.unionByName(b).withColumn("_m", F.max("_v").over(w)).where("_kind = 1 AND _m IS NOT NULL")
    return both.select(*keys, F.col("_t").alias(now), F.col("_m").alias(value))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], value: str | None = None) -> DataFrame:
    """The first row per key in ``order``; rows without ``value`` are passed over."""
    if value is not None:
        df = df.where(F.col(value).isNotNull())
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def lookup_default(df: DataFrame, dim: DataFrame, key: str, column: str, default) -> DataFrame:
    return df.join(dim.select(key, column), key, "left").withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def restrict_to_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose composite key occurs in ``keys``, exactly."""
    return df.join(keys, keys.columns, "left_semi")


def touching_keys(df: DataFrame, key: list[str], touches: Column) -> DataFrame:
    """All rows of the keys that touch at least once."""
    return df.join(df.where(touches).select(*key).distinct(), key, "left_semi")


def unseen_keys(test: DataFrame, train: DataFrame, key: list[str]) -> DataFrame:
    return test.select(*key).distinct().join(train.select(*key), key, "left_anti")


def source_coverage(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys are in both, only in ``a``, only in ``b``."""
    one, two = a.select(*keys).distinct().withColumn("_a", F.lit(True)), b.select(*keys).distinct().withColumn("_b", F.lit(True))
    where = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "only_a").otherwise("only_b")
    return one.join(two, keys, "full_outer").groupBy(where.alias("found_in")).agg(F.count("*").alias("n"))


def crosscheck_sources(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str], tolerance: float = 0.0, place: str | None = None) -> DataFrame:
    """Per field how many rows agree, differ, or are known to one source or neither.

    With ``place``, rows of the same keys must also be of the same place: those that are not are left out of the fields,
    and the field ``place`` tells how many agree and differ in it.
    """
    side = lambda df, s: df.select(*keys, *(F.col(f).alias(f"{f}_{s}") for f in fields), F.col(place).alias(f"_at_{s}") if place else F.lit(0).alias(f"_at_{s}"))
    joined = side(a, "a").join(side(b, "b"), keys)
    both = joined.where("_at_a = _at_b")
    stacked = both.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_a").cast("double").alias("x"), F.col(f"{f}_b").cast("double").alias("y")) for f in fields))).alias("r")).select("r.*")
    x, y = F.col("x"), F.col("y")
    found = stacked.groupBy("field").agg(
        F.count_if(F.abs(x - y) <= tolerance).alias("agree"), F.count_if(F.abs(x - y) > tolerance).alias("differ"),
        F.count_if(x.isNotNull() & y.isNull()).alias("only_a"), F.count_if(x.isNull() & y.isNotNull()).alias("only_b"),
        F.count_if(x.isNull() & y.isNull()).alias("neither"),
    )
    if place is None:
        return found
    zero = F.lit(0).cast("long")
    places = joined.agg(F.lit("place").alias("field"), F.count_if(F.expr("_at_a = _at_b")).alias("agree"), F.count_if(F.expr("_at_a <> _at_b")).alias("differ"), zero.alias("only_a"), zero.alias("only_b"), zero.alias("neither"))
    return found.unionByName(places)


def update_from(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str], moment: Column, low: Column, high: Column) -> DataFrame:
    """``target`` with ``columns`` replaced where the source's ``moment`` lies in (low, high]."""
    due = source.where((moment > low) & (moment <= high)).select(*keys, F.lit(True).alias("_due"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    out = target.join(due, keys, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("_due"), F.col(f"_new_{c}")).otherwise(F.col(c)))
    return out.select(*target.columns)


def align_by_position(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """k-th row of ``a`` with k-th row of ``b``, only for keys with as many rows in both. Columns get suffixes ``_a`` and ``_b``."""
    def numbered(df: DataFrame, tag: str) -> DataFrame:
        n = F.count(F.lit(1)).over(W.partitionBy(key))
        return df.select(key, F.row_number().over(W.partitionBy(key).orderBy(order)).alias("k"), n.alias("n"), *(F.col(c).alias(f"{c}{tag}") for c in df.columns if c != key))

    return numbered(a, "_a").join(numbered(b, "_b"), [key, "k", "n"])
