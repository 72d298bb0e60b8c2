"""What can be known at a moment of movements, closures and failures: observed so far, carried on, or booked.

Times are minutes. An interval that ends no later than it starts is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _seen(c: str, now: Column) -> Column:
    return F.when(F.col(c) <= now, F.col(c))


def known_movements(stops: DataFrame, now: Column, ahead: int = 240, stand: int = 37, move: int = 17, trip: str = "instance_id", order: str = "stop_idx") -> DataFrame:
    """(trip, order, kind, station_id, next_station, start, end): where vehicles stand (``station``) and run (``section``).

    Of a stop: from its observed arrival to its observed departure, else ``stand`` minutes on, and at least until now; if not
    seen yet and booked within ``ahead`` of now, as booked, with ``stand`` minutes where the booked departure is no later.
    Of a leg: from the observed departure to the next observed arrival, else ``move`` minutes on, and at least until now; if
    not left yet and booked to leave within ``ahead``, as booked, with ``move`` minutes likewise. A section is inbound to its
    ``next_station``.
    """
    w = W.partitionBy(trip).orderBy(order)
    booked = lambda c: (F.col(c) > now) & (F.col(c) <= now + ahead)
    d = stops.select(
        trip, order, "station_id", "sched_arr", "sched_dep", F.lead("station_id").over(w).alias("next_station"), F.lead("sched_arr").over(w).alias("next_sched"),
        _seen("actual_arr", now).alias("arr"), _seen("actual_dep", now).alias("dep"), F.lead(_seen("actual_arr", now)).over(w).alias("next_arr"),
    )
    on = lambda start, minutes: F.greatest(start + minutes, now)
    after = lambda end, start, minutes: F.when(F.col(end) > F.col(start), F.col(end)).otherwise(F.col(start) + minutes)
    station = F.when(F.col("arr").isNotNull(), F.struct(F.col("arr").alias("start"), F.coalesce("dep", on(F.col("arr"), stand)).alias("end"))).when(
        booked("sched_arr"), F.struct(F.col("sched_arr").alias("start"), after("sched_dep", "sched_arr", stand).alias("end"))
    )
    leg = F.when(F.col("dep").isNotNull(), F.struct(F.col("dep").alias("start"), F.coalesce("next_arr", on(F.col("dep"), move)).alias("end"))).when(
        booked("sched_dep"), F.struct(F.col("sched_dep").alias("start"), after("next_sched", "sched_dep", move).alias("end"))
    )
    none = F.lit(None).cast("long")
    one = lambda kind, nxt, x: F.struct(F.lit(kind).alias("kind"), nxt.cast("long").alias("next_station"), x["start"].cast("double").alias("start"), x["end"].cast("double").alias("end"))
    both = F.array(one("station", none, station), F.when(F.col("next_station").isNotNull(), one("section", F.col("next_station"), leg)))
    return d.select(trip, order, "station_id", F.explode(both).alias("i")).select(trip, order, "i.kind", "station_id", "i.next_station", "i.start", "i.end").where(F.col("end") > F.col("start"))


def known_closures(blocks: DataFrame, now: Column) -> DataFrame:
    """``blocks`` (start, permitted_end, cleared and more) with ``end``: when they were cleared, if that has happened.

    Closures are planned, so those to come are known as well. One that is not cleared lasts as permitted, and at least until
    now if it has begun; its real end is not known.
    """
    planned = F.coalesce("permitted_end", "start")
    end = F.when(F.col("cleared") <= now, F.col("cleared")).when(F.col("start") <= now, F.greatest(planned, now)).otherwise(planned)
    return blocks.withColumn("end", end).where(F.col("end") > F.col("start"))


def known_failures(failures: DataFrame, now: Column) -> DataFrame:
    """``failures`` (start, finish and more) with ``end``: those that have begun, until they were over or until now.

    Failures are not planned: one to come is not known.
    """
    begun = failures.where(F.col("start") <= now)
    return begun.withColumn("end", F.when(F.col("finish") <= now, F.col("finish")).otherwise(now)).where(F.col("end") > F.col("start"))
