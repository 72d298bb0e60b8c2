"""The audit of the feature set: every feature of trips and stations beside a mutant of it that looks ahead."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import leaks, traffic
from waymark.operators import sequence as seq
from waymark.plans.book import query
from waymark.plans.journeys import RAW_T0 as T0
from waymark.plans.journeys import entry_features, moved, reached
from waymark.plans.trips import HORIZON, TICK
from waymark.sources import fixtures as fx
from waymark.sources import sinks
from waymark.sources.fixtures import JUNCTIONS, stops

KEY = ["instance_id", "blk", "tick"]
NEAR = [T0 - 2 * TICK, T0 - TICK, T0, T0 + TICK]


class Sight(NamedTuple):
    """A world at the instants ``NEAR``, each table written once: positions with all that trips' stops tell of them, minutes to
    later stations as told, and as seen ahead."""

    at: DataFrame
    etas: DataFrame
    ahead: DataFrame


def _histories_digest(c):
    return F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s * 31 + x["delay"] + 7 * x["at_stop"] + 11 * x["dwell"])


def _timed(world):
    nxt = lambda c: F.lead(c).over(seq.along())
    t = seq.look_ahead(seq.trips_in_time(world)).withColumns({"next_arr": nxt("arr"), "next_arr_delay": nxt("arr_delay")})
    return seq.with_history(t, F.col("sched_dep") > F.col("sched_arr"), 5)


def _etas_seen_ahead(at):
    """Minutes to later stations by when they will really be reached."""
    later = F.filter("_whole", lambda x: x["k"] > F.col("stop_idx"))
    d = at.select(*KEY, F.inline(F.transform(later, lambda x: F.struct(x["k"].alias("k"), x["station_id"].alias("station_id"), x["arr"].alias("reached")))))
    d = d.withColumn("eta", F.greatest(F.lit(0).cast("long"), F.col("reached") - F.col("tick"))).where(F.col("eta") <= HORIZON)
    return d.groupBy(*KEY, "station_id").agg(F.max_by("eta", "k").alias("eta"))


def sighted(world):
    """The ``Sight`` of a world: its stops are windowed here, and features read no more than a few rows of each trip."""
    timed = _timed(world)
    at = seq.journey_history(seq.eta_next(seq.delay_now(seq.position_at_instants(timed, NEAR))))
    whole = seq.listed_stops(seq.trips_in_time(world), "station_id", "sched_arr", "arr")
    at = sinks.written(at.join(whole, "instance_id").join(entry_features(world), "instance_id", "left"), "sight")
    return Sight(at, sinks.written(seq.listed_etas(at, HORIZON), "etas"), sinks.written(_etas_seen_ahead(at), "ahead"))


def _conflicts(etas):
    user = F.split_part("instance_id", F.lit("_"), F.lit(1)).cast("long")
    found = traffic.path_conflicts(etas, user % 3, user % 10, 10, JUNCTIONS, window=120, queue=60)
    near = seq.junction_etas(etas, JUNCTIONS).select(*KEY, F.col("nearest").alias("eta_nearest"))
    return near.join(found, KEY, "full")


def trip_features(sight):
    """What a trip's vector is made of at ``T0``, each with its mutant."""
    now = lambda df: df.where(F.col("tick") == T0)
    standing, zero = F.col("mode") == "at_station", F.lit(0).cast("long")
    leg = F.greatest(zero, F.col("next_sched_arr") - F.col("sched_dep"))
    moving = ~standing & F.col("next_sched_arr").isNotNull()
    own = now(sight.at).select(
        *KEY,
        *leaks.place("delay", F.col("delay"), F.coalesce("dep_delay", "arr_delay", "est")),
        *leaks.place("leaves_late", seq.departure_delay(), F.coalesce("dep_delay", zero)),
        *leaks.place("eta_next", F.col("eta_next"), F.col("next_arr") - F.col("tick")),
        *leaks.place("at_stop", F.when(standing, F.col("tick") - F.col("arr")), F.when(standing, F.col("dep") - F.col("arr"))),
        *leaks.place("over_run", F.when(moving, F.greatest(zero, F.col("tick") - F.col("dep") - leg)), F.when(moving, F.col("next_arr") - F.col("dep") - leg)),
        *leaks.place("least_next_delay", F.when(moving, F.col("tick") - F.col("next_sched_arr")), F.when(moving, F.col("next_arr_delay"))),
        *leaks.place("remaining_dwell", F.when(standing, F.greatest(zero, F.col("sched_dep") - F.col("tick"))), F.when(standing, F.col("dep") - F.col("tick"))),
        *leaks.place("observed", F.when(standing, F.col("arr_delay")).otherwise(F.coalesce("dep_delay", "arr_delay")).isNotNull().cast("int"), F.coalesce("next_arr_delay", zero)),
        *leaks.place("history", _histories_digest("history"), _histories_digest("_history")),
        *leaks.place("entry_delay", F.when(F.col("stop_idx") >= F.col("entry_stop"), F.col("entry_delay")), F.col("entry_delay")),
        *leaks.place("entry_trend", F.when(F.col("stop_idx") >= F.col("entry_stop"), F.col("entry_trend")), F.col("entry_trend")),
    )
    sealed = _conflicts(now(sight.etas))
    ahead = leaks.opened(_conflicts(now(sight.ahead)), KEY)
    return own.join(sealed, KEY, "left").join(ahead, KEY, "left").drop("blk", "tick")


def station_features(sight):
    """State and memory of the stations at ``T0``, each with its mutant."""
    at = sight.at
    halt = F.col("sched_dep") > F.col("sched_arr")
    place = ["blk", "tick", "station_id"]

    def states(at, etas):
        occ = traffic.occupancy(at, halt)
        dim = at.sparkSession.range(fx.STATIONS).selectExpr("id AS station_id", "id % 4 AS platforms", "1 + id % 3 AS capacity")
        none = occ.select(*place).limit(0).selectExpr("*", "0L AS freight", "0L AS freight_due")
        spine = at.select("blk").distinct().select("blk", F.explode(F.array(*(F.lit(t).cast("long") for t in NEAR))).alias("tick"))
        return traffic.station_state_rows(occ, dim, traffic.decay_pressure(etas, JUNCTIONS, 350.0, 1000.0), none, spine)

    dense = states(at, sight.etas).withColumn("load", F.col("capacity_ratio") * 0.5 + F.col("incoming") * 0.5)
    kept = seq.station_memory(dense, ["blk", "station_id"], "tick", "load", "delayed_density", "critical")
    ahead = F.lead("load").over(seq.W.partitionBy("blk", "station_id").orderBy("tick"))
    kept = kept.withColumn("_ahead", ahead).where(F.col("tick") == T0)
    names = ["platform_ratio", "capacity_ratio", "incoming", "max_delay", "delayed_density", "approach_density", "since_critical"]
    own = kept.select(*place, *names, *leaks.place("congestion", F.col("congestion"), F.col("_ahead")), *leaks.place("mixed", F.col("mixed"), 0.7 * F.col("_ahead") + 0.3 * F.col("delayed_density")))
    late = at.withColumn("delay", F.coalesce("next_arr_delay", "delay")).withColumn("eta_next", F.col("next_arr") - F.col("tick"))
    # a station's occupants a tick later are what a builder that reads one tick too far would see
    shifted = lambda df: df.withColumn("tick", F.col("tick") - TICK)
    mutant = states(shifted(late), shifted(sight.ahead))
    mutant = seq.station_memory(mutant.withColumn("load", F.col("capacity_ratio")), ["blk", "station_id"], "tick", "load", "delayed_density", "critical").where(F.col("tick") == T0)
    return own.join(leaks.opened(mutant.select(*place, *names), place), place, "left").drop("tick")


TRIP_PLACES = [
    "delay", "leaves_late", "eta_next", "at_stop", "over_run", "least_next_delay", "remaining_dwell", "observed", "history", "entry_delay", "entry_trend", "eta_nearest", "overlaps", "same_group",
    "higher_priority", "queue", "junction_gap", "headway_ahead", "headway_behind", "precedence_eta",
]
STATION_PLACES = ["congestion", "mixed", "platform_ratio", "capacity_ratio", "incoming", "max_delay", "delayed_density", "approach_density", "since_critical"]


def audits(world):
    told, pair = sinks.written(reached(world), "told"), (3, 991)
    sights = {by: sighted(moved(told, by)) for by in pair}
    sinks.drop_written(told)
    trips = leaks.leak_audit(trip_features, sights, dict.__getitem__, pair, ["instance_id"])
    places = leaks.leak_audit(station_features, sights, dict.__getitem__, pair, ["blk", "station_id"])
    return trips.select(F.lit("trip").alias("of"), "*").unionByName(places.select(F.lit("station").alias("of"), "*"))


@query(
    "Q1_leak_harness",
    "SELECT * FROM (VALUES " + ", ".join(f"('trip', '{c}', true, true)" for c in TRIP_PLACES) + ", " + ", ".join(f"('station', '{c}', true, true)" for c in STATION_PLACES) + ") v(\"of\", feature, clean, caught)",
)
def _(spark, d):
    found = audits(stops(spark, d))
    verdicts = [leaks.verdict(found.where(F.col("of") == of)).select(F.lit(of).alias("of"), "*") for of in ("trip", "station")]
    return verdicts[0].unionByName(verdicts[1])
