"""Forecasts by the timetable, what they are held against, and reports of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.operators.sequence import ORDER, TRIP, along

CLASSES = ("SPIKE", "RECOVERY", "MODERATE", "STEADY")


def persistence(seen: DataFrame, stops: DataFrame, t0: int, target: Column | None = None, eligible: Column | None = None) -> DataFrame:
    """Per trip seen at or after ``t0`` and later stop with a known delay: the first delay seen then, held flat, and the hops since.

    A trip first seen after ``t0`` is taken over where it appears. ``seen`` has (trip, tick, stop, delay). Of ``stops`` only
    those count for which ``target`` holds, and of trips only those for which ``eligible`` does; an unknown one does not.
    """
    scored = F.lit(True)
    for asked in (target, eligible):
        scored &= F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    first = seen.where(F.col("tick") >= t0).groupBy(TRIP).agg(F.min_by(F.struct("delay", ORDER), F.struct("tick", ORDER)).alias("f"))
    later = stops.where(F.col("arr_delay").isNotNull() & scored).select(TRIP, F.col(ORDER).alias("k"), F.col("arr_delay").alias("actual"))
    d = first.select(TRIP, F.col("f.delay").alias("persist"), F.col(f"f.{ORDER}").alias("takeover")).join(later, TRIP).where("k > takeover")
    return d.withColumn("hop", F.col("k") - F.col("takeover"))


def booked_projection(at: DataFrame, stops: DataFrame, t0: int, horizon: int = 240) -> DataFrame:
    """Where the trips at ``t0`` will be, by their present delay and booked times.

    ``at`` has their positions at ``t0`` with ``delay``. A standing trip leaves when its booked dwell is up, or now if that
    has passed, and is as late from there on; a moving one keeps its delay. Arrivals never run backwards. The list ends
    for good at the first arrival over ``horizon``. Gives (trip, k, hop, arr, delay, lead_min, prev_station, station_id).
    """
    zero = F.lit(0).cast("long")
    leaves = F.greatest(F.col("arr") + F.greatest(zero, F.col("sched_dep") - F.col("sched_arr")), F.lit(t0).cast("long"))
    standing = F.col("mode") == "at_station"
    held = F.when(standing, leaves - F.col("sched_dep")).otherwise(F.col("delay"))
    world = at.select(TRIP, F.col(ORDER).alias("k0"), held.alias("held"), F.when(standing, leaves).otherwise(F.col("dep")).alias("left"))
    later = stops.select(TRIP, F.col(ORDER).alias("k"), "station_id", F.lag("station_id").over(along()).alias("prev_station"), "sched_arr", "sched_dep")
    d = later.join(world, TRIP).where("k > k0")
    # an arrival is no earlier than any departure before it, and a departure no earlier than its arrival
    w = W.partitionBy(TRIP).orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    raw = F.col("sched_arr") + F.col("held")
    latest = F.greatest(raw, F.col("sched_dep") + F.col("held"))
    d = d.withColumn("arr", F.greatest(raw, F.col("left"), F.max(latest).over(w)))
    d = d.withColumn("_top", F.max("arr").over(W.partitionBy(TRIP).orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow))).where(F.col("_top") <= t0 + horizon)
    return d.select(
        TRIP, "k", (F.col("k") - F.col("k0")).alias("hop"), "arr", (F.col("arr") - F.col("sched_arr")).alias("delay"), (F.col("arr") - t0).alias("lead_min"),
        "prev_station", "station_id", "sched_arr",
    )


def forecast_rows(projected: DataFrame, truth: DataFrame, base: Column) -> DataFrame:
    """``projected`` as forecast rows: the section run before each stop, and booked and observed arrivals as timestamps.

    ``truth`` has (trip, k, actual_arr), null where unknown; ``base`` is the moment from which minutes count.
    """
    moment = lambda m: F.timestamp_add("MINUTE", F.col(m), base)
    d = projected.join(truth, [TRIP, "k"], "left")
    section = F.concat(F.col("prev_station").cast("string"), F.lit("-"), F.col("station_id").cast("string"))
    return d.select(
        TRIP, "k", "hop", "lead_min", "delay", section.alias("block_section"), F.col("sched_arr").alias("minutes_from_start"),
        moment("sched_arr").alias("sched_arr_ts"), moment("actual_arr").alias("actual_arr_ts"),
    )


def scenario_class(scored: DataFrame, n: int, size: float = 30.0, steady: float = 10.0) -> DataFrame:
    """The class of each trip by its largest rise or fall against persistence, and ``pick``: the place among the ``n`` that a
    round over the classes takes, each giving its trips with most forecasts first; null for the others."""
    rise = F.col("actual") - F.col("persist")
    per = scored.groupBy(TRIP).agg(F.count("*").alias("n_forecasts"), F.max(rise).alias("rise"), F.max(-rise).alias("fall"))
    name = F.when(F.col("rise") > size, "SPIKE").when(F.col("fall") > size, "RECOVERY").when(F.greatest("rise", "fall") < steady, "STEADY").otherwise("MODERATE")
    per = per.select(TRIP, "n_forecasts", name.alias("class"))
    # no class gives more than n, so only those are ordered
    best = per.withColumn("rank", F.row_number().over(W.partitionBy("class").orderBy(F.desc("n_forecasts"), TRIP))).where(F.col("rank") <= n)
    place = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class"))
    picked = best.orderBy("rank", place).limit(n).withColumn("pick", F.row_number().over(W.orderBy("rank", place))).select(TRIP, "pick")
    return per.join(picked, TRIP, "left")


def journey_report(stops: DataFrame, scored: DataFrame, size: float = 30.0) -> DataFrame:
    """The lines of a report per trip, by ``k``: stops up to the takeover as observed, then each forecast beside what happened.

    ``scored`` has (trip, k, hop, pred, actual, persist). A rise over ``size`` is a SPIKE if the forecast is short of it by
    less than half, else SPIKE MISSED; a fall over it is a recovery.
    """
    from waymark.functions.columns import hhmm

    takeover = scored.groupBy(TRIP).agg(F.min(F.col("k") - F.col("hop")).alias("takeover"))
    base = stops.select(TRIP, F.col(ORDER).alias("k"), "station_id", hhmm(F.col("sched_arr")).alias("booked"), F.when(F.col("actual_arr").isNotNull(), hhmm(F.col("actual_arr"))).alias("seen"), "arr_delay", "actual_arr")
    none = F.lit(None).cast("long")
    now = F.col("k") == F.col("takeover")
    missing = F.col("actual_arr").isNull()
    note = F.concat_ws(" ", F.when(missing, F.lit("not reported")), F.when(now, F.lit("<== NOW")))
    observed = base.join(takeover, TRIP).where("k <= takeover").select(
        TRIP, "k", "station_id", F.lit("observed").alias("part"), "booked", "seen", F.col("arr_delay").alias("delay"), none.alias("pred"), none.alias("error"), note.alias("note")
    )
    error, rise = F.col("pred") - F.col("actual"), F.col("actual") - F.col("persist")
    flag = F.when(rise > size, F.when(error > -size / 2, "SPIKE").otherwise("SPIKE MISSED")).when(-rise > size, "recovery").otherwise("")
    forecast = base.drop("arr_delay").join(scored, [TRIP, "k"]).select(
        TRIP, "k", "station_id", F.lit("forecast").alias("part"), "booked", "seen", F.col("actual").alias("delay"), "pred", error.alias("error"), flag.alias("note")
    )
    return observed.unionByName(forecast)


def journey_summary(scored: DataFrame) -> DataFrame:
    """Per trip: forecasts, their MAE, that of persistence, and the gain."""
    off = lambda c: F.avg(F.abs(F.col(c) - F.col("actual")))
    d = scored.groupBy(TRIP).agg(F.count("*").alias("n"), off("pred").alias("mae"), off("persist").alias("persist_mae"))
    return d.withColumn("gain", F.col("persist_mae") - F.col("mae"))


def state_fidelity(a: DataFrame, b: DataFrame, columns: list[str], limit: float = 0.25, k: int = 10) -> DataFrame:
    """The ``k`` columns whose means in two worlds differ most: both means, their ratio (1 where both are 0, 99 where only the
    second is), and whether it is off by more than ``limit``."""
    long = lambda df, name: df.agg(*(F.avg(c).alias(c) for c in columns)).select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias(name)) for c in columns))))
    d = long(a, "mean_a").join(long(b, "mean_b"), "column")
    ratio = F.when(F.abs("mean_b") > 1e-6, F.col("mean_a") / F.col("mean_b")).when(F.abs("mean_a") < 1e-6, 1.0).otherwise(99.0)
    d = d.withColumn("ratio", ratio).withColumn("_off", F.abs(F.col("ratio") - 1.0))
    return d.orderBy(F.desc("_off"), F.desc("column")).limit(k).withColumn("drift", F.col("_off") > limit).drop("_off")
