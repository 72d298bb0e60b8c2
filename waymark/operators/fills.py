"""Filling gaps in one source from another: what may be filled, why not, and the fill itself.

Rows are a trip's stops in long form: a row per stop and field with ``own`` (the value to complete), ``other`` (the second
source's, for the same stop) and ``latest`` (a time that ``other`` may not exceed, such as the second source's departure
for an arrival, or null). All three are timestamps. Only stops that both sources have are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.columns import swap_day_month


def minutes_between(a: Column, b: Column) -> Column:
    return F.abs(F.timestamp_diff("SECOND", a, b)) / 60.0


def _neighbours(rows: DataFrame, trip: str, field: str, order: str, slack_days: int) -> DataFrame:
    """Adds the nearest known values on both sides in both sources, how many stops away the own ones are, and the trip's span."""
    w = W.partitionBy(trip, field).orderBy(order)
    before, after = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    every = W.partitionBy(trip)
    d = rows.withColumn("_n", F.row_number().over(w)).withColumn("_known", F.when(F.col("own").isNotNull(), F.col("_n")))
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    nxt = lambda c: F.first(c, ignorenulls=True).over(after)
    days = F.expr(f"INTERVAL {slack_days} DAY")
    return d.select(
        *rows.columns, "_n", last("own").alias("prev_own"), nxt("own").alias("next_own"), (F.col("_n") - last("_known")).alias("prev_hops"),
        (nxt("_known") - F.col("_n")).alias("next_hops"), last("other").alias("prev_other"), nxt("other").alias("next_other"),
        (F.min("own").over(every) - days).alias("span_from"), (F.max("own").over(every) + days).alias("span_to"),
    )


def fill_checks(rows: DataFrame, trip: str, field: str, order: str, pace: float = 120.0, slack_days: int = 1) -> DataFrame:
    """What could be filled, each value checked against the known ones alone: ``reason`` is null where it may be.

    In this order: after ``latest``; outside the trip's known span with ``slack_days`` on both sides; before the last or
    after the next known value; further from either than ``pace`` minutes a stop; out of order in the second source.
    Trips without any known value are left out.
    """
    d = _neighbours(rows, trip, field, order, slack_days).where("own IS NULL AND other IS NOT NULL AND span_from IS NOT NULL")
    v = F.col("other")
    far = lambda side: F.coalesce(minutes_between(v, F.col(f"{side}_own")) > pace * F.col(f"{side}_hops"), F.lit(False))
    reason = (
        F.when(v > F.col("latest"), "after_latest").when(~v.between(F.col("span_from"), F.col("span_to")), "outside_span")
        .when(v < F.col("prev_own"), "before_previous").when(v > F.col("next_own"), "after_next")
        .when(far("prev") | far("next"), "implausible_pace").when((v < F.col("prev_other")) | (v > F.col("next_other")), "out_of_order")
    )
    return d.select(*rows.columns, reason.alias("reason"))


def rejection_summary(checked: DataFrame, field: str) -> DataFrame:
    """How many values were accepted and rejected, by field and reason, with totals by field and over all (``all``)."""
    d = checked.select(field, F.coalesce("reason", F.lit("accepted")).alias("reason"))
    n = d.rollup(field, "reason").agg(F.count("*").alias("n"), F.count_if(F.col("reason") == "accepted").alias("accepted"))
    return n.select(F.coalesce(field, F.lit("all")).alias("field"), F.coalesce("reason", F.lit("all")).alias("reason"), "n", (F.col("accepted") / F.col("n")).alias("accepted_share"))


def top_beneficiaries(checked: DataFrame, group: str, k: int = 12) -> DataFrame:
    """The ``k`` groups that gain most accepted values."""
    gained = checked.where("reason IS NULL").groupBy(group).agg(F.count("*").alias("gained"))
    return gained.orderBy(F.desc("gained"), group).limit(k)


def fill_from_reference(
    rows: DataFrame, trip: str, field: str, order: str, earliest: Column, latest: Column, pace: float = 120.0, slack_days: int = 1
) -> DataFrame:
    """``rows`` with ``filled`` (the value after filling) and ``origin``: own, other, repaired, rejected, unrepairable or none.

    Stops are taken in order, and an accepted value is a known one for those after it. A value is accepted if it lies
    between ``earliest`` and ``latest``, in the trip's known span, between its known neighbours in both sources, and no
    further from the own ones than ``pace`` minutes a stop. One that is not is tried again with day and month exchanged.
    Trips without any known value are not filled. The fold runs over one field of one trip, as an array in Spark's own
    higher-order functions.
    """
    d = _neighbours(rows, trip, field, order, slack_days)
    kept = [c for c in rows.columns if c not in (trip, field)]
    item = F.struct(
        F.col("_n").alias("_at"), *kept, "next_own", "next_hops", "prev_other", "next_other", "span_from", "span_to", swap_day_month(F.col("other")).alias("swapped"),
        earliest.alias("_earliest"), latest.alias("_latest"),
    )
    per = d.groupBy(trip, field).agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    time = rows.schema["own"].dataType.simpleString()
    none = F.lit(None).cast(time)
    start = F.struct(none.alias("prev"), F.lit(0).alias("hops"), F.array().cast(f"array<struct<filled:{time},origin:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        def fits(v: Column) -> Column:
            yes = lambda c: F.coalesce(c, F.lit(True))
            near = yes(minutes_between(v, state["prev"]) <= pace * (state["hops"] + 1)) & yes(minutes_between(v, x["next_own"]) <= pace * x["next_hops"])
            ordered = yes(v >= state["prev"]) & yes(v <= x["next_own"]) & yes(v >= x["prev_other"]) & yes(v <= x["next_other"])
            return F.coalesce(v.between(x["_earliest"], x["_latest"]) & v.between(x["span_from"], x["span_to"]), F.lit(False)) & ordered & near

        origin = (
            F.when(x["own"].isNotNull(), "own").when(x["other"].isNull() | x["span_from"].isNull(), "none").when(fits(x["other"]), "other")
            .when(x["swapped"].isNull(), "unrepairable").when(fits(x["swapped"]), "repaired").otherwise("rejected")
        )
        value = F.when(origin == "own", x["own"]).when(origin == "other", x["other"]).when(origin == "repaired", x["swapped"])
        known = value.isNotNull()
        return F.struct(
            F.when(known, value).otherwise(state["prev"]).alias("prev"), F.when(known, 0).otherwise(state["hops"] + 1).alias("hops"),
            F.concat(state["out"], F.array(F.struct(value.alias("filled"), origin.alias("origin")))).alias("out"),
        )

    told = F.aggregate("_rows", start, step, lambda s: s["out"])
    both = per.select(trip, field, F.inline(F.arrays_zip(F.col("_rows").alias("r"), told.alias("t"))))
    return both.select(trip, field, *(F.col(f"r.{c}") for c in kept), F.col("t.filled"), F.col("t.origin"))
