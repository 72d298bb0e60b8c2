"""Exact ranks and running totals over any number of distinct values, without a window that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.sources.sinks import written


def with_running_totals(df: DataFrame, group: list[str], value: str, descending: bool = False, parts: int | None = None, **totals: Column) -> DataFrame:
    """``df`` with, for each named column of ``totals``, ``before_<name>``, its sum over the rows of the group before this one in
    order of ``value``, and ``all_<name>``, the group's.

    A group has each value in one row, so no tie can lie across two ranges. Rows are dealt to ranges of (group, value) and written,
    so that their ranges stay as they are however often a later step runs; totals by range, a row for each range of
    a group, give what lies before a range, and a window inside the range the rest.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.desc(value) if descending else F.asc(value)
    named = df.withColumns({f"_t_{n}": c for n, c in totals.items()})
    ranged = written(named.repartitionByRange(parts, *group, order).withColumn("_part", F.spark_partition_id()), "ranks")
    sums = ranged.groupBy(*group, "_part").agg(*(F.sum(f"_t_{n}").alias(f"_s_{n}") for n in totals))
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(1))  # a row for each range
    past = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*group, "_part", *(F.coalesce(F.sum(f"_s_{n}").over(past), F.lit(0)).alias(f"_b_{n}") for n in totals), *(F.sum(f"_s_{n}").over(whole).alias(f"all_{n}") for n in totals))
    sums = sums.withColumnsRenamed({g: f"_g_{g}" for g in group}).withColumnRenamed("_part", "_of")
    inside = W.partitionBy(*group, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    here = ranged.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_t_{n}").over(inside), F.lit(0)) for n in totals})
    match = F.col("_part") == F.col("_of")
    for g in group:
        match &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    both = here.join(sums, match)
    before = [(F.col(f"_b_{n}") + F.col(f"_i_{n}")).alias(f"before_{n}") for n in totals]
    return both.select(*df.columns, *before, *(f"all_{n}" for n in totals))
