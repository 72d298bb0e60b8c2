"""What trips do to each other and to the network at a tick: conflicts, occupancy, dense state rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Width of a band of etas, in widest frames.
BAND = 4


def _zero() -> Column:
    return F.lit(0).cast("long")


def path_conflicts(
    etas: DataFrame, group: Column, level: Column, levels: int, junctions: tuple[int, ...], window: int = 20, queue: int = 15, gap_cap: int = 90, headway_cap: int = 75, trip: str = "instance_id", keys: tuple[str, ...] = ("blk", "tick")
) -> DataFrame:
    """Counts and gaps between a trip and the others that head for the same stations at the same tick.

    ``etas`` has a row per trip, tick and station with whole minutes in ``eta``; ``level`` is the priority as 0 to
    ``levels`` - 1. Trips at a station are first counted by eta and group, with a count for each level beside it, which are
    few however many trips there are. Range frames over these counts tell the neighbours, so no pair of trips is ever a row,
    and a frame has a row per minute and group, not per level. Frames reach no further than the
    windows and caps (a gap beyond its cap counts as the cap), so etas are dealt to bands with a halo of the widest frame
    on both sides: a window's partition is one band of one station at one tick, and only rows of the band itself are kept.
    """
    place = [*keys, "station_id"]
    widest = max(window, queue, gap_cap, headway_cap)
    band = BAND * widest
    d = etas.withColumn("_g", group).withColumn("_l", level)
    at_level = {k: f"_at_{k}" for k in range(1, levels)}
    h = d.groupBy(*place, "eta", "_g").agg(F.count("*").alias("_n"), *(F.count_if(F.col("_l") == k).alias(c) for k, c in at_level.items()))
    bands = F.sequence(F.floor((F.col("eta") - widest) / band), F.floor((F.col("eta") + widest) / band))
    h = h.withColumn("_band", F.explode(bands))
    by_eta = W.partitionBy(*place, "_band").orderBy("eta")
    near, behind = by_eta.rangeBetween(-window, window), by_eta.rangeBetween(0, queue)
    reach = max(gap_cap, headway_cap)
    among = W.partitionBy(*place, "_band", "_g").orderBy("eta").rangeBetween(-window, window)
    tied = F.sum("_n").over(by_eta.rangeBetween(0, 0)) > 1
    h = h.withColumns({
        "_overlap": F.sum("_n").over(near) - 1, "_same": F.sum("_n").over(among) - 1, "_queue": F.sum("_n").over(behind) - 1,
        "_ahead": F.col("eta") - F.max("eta").over(by_eta.rangeBetween(-reach, -1)),
        "_behind": F.when(tied, _zero()).otherwise(F.min("eta").over(by_eta.rangeBetween(1, reach)) - F.col("eta")),
        **{c: F.sum(c).over(near) for c in at_level.values()},
    }).where(F.col("_band") == F.floor(F.col("eta") / band))
    cell = [*place, "eta", "_g"]
    h = h.drop("_n", "_band").withColumnsRenamed({c: f"_of_{c}" for c in cell})
    match = F.lit(True)
    for c in cell:
        match &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    above = (F.when(F.lit(k) > F.col("_l"), F.col(c)).otherwise(_zero()) for k, c in at_level.items())
    d = d.select(trip, *cell, "_l").join(h, match).withColumn("_higher", sum(above, _zero()))
    gap = F.when(F.col("station_id").isin(*junctions), F.least("_ahead", "_behind"))
    capped = lambda c, cap: F.least(F.coalesce(F.min(c), F.lit(cap).cast("long")), F.lit(cap).cast("long"))
    return d.groupBy(trip, *keys).agg(
        F.sum("_overlap").alias("overlaps"), F.sum("_same").alias("same_group"), F.sum("_higher").alias("higher_priority"), F.sum("_queue").alias("queue"),
        capped(gap, gap_cap).alias("junction_gap"), capped(F.col("_ahead"), headway_cap).alias("headway_ahead"), capped(F.col("_behind"), headway_cap).alias("headway_behind"),
        capped(F.when(F.col("_higher") > 0, F.col("eta")), headway_cap).alias("precedence_eta"),
    )


def occupancy(at: DataFrame, halt: Column, keys: tuple[str, ...] = ("blk", "tick"), late: int = 8, near: int = 25) -> DataFrame:
    """Per tick and station: trips standing at a booked halt, others standing, delayed ones, the largest delay, and trips due
    within ``near`` minutes.

    Delays are those of all trips located at the station: standing at it, or under way with it as their last stop.
    """
    standing, none = F.col("mode") == "at_station", F.lit(None).cast("long")
    one = lambda c: c.cast("long")
    here = F.struct(
        F.col("station_id"), one(standing & halt).alias("halting"), one(standing & ~halt).alias("passing"), one(F.col("delay") >= late).alias("delayed"),
        F.col("delay").alias("delay"), _zero().alias("approaching"),
    )
    ahead = F.struct(
        F.col("next_station").alias("station_id"), _zero().alias("halting"), _zero().alias("passing"), _zero().alias("delayed"), none.alias("delay"),
        one(F.col("eta_next") <= near).alias("approaching"),
    )
    d = at.select(*keys, F.explode(F.array(here, F.when(F.col("next_station").isNotNull(), ahead))).alias("s")).where("s IS NOT NULL").select(*keys, "s.*")
    total = lambda c: F.sum(c).alias(c)
    return d.groupBy(*keys, "station_id").agg(
        total("halting"), total("passing"), total("delayed"), F.greatest(_zero(), F.max("delay")).alias("max_delay"), total("approaching")
    )


def decay_pressure(etas: DataFrame, junctions: tuple[int, ...], scale: float = 35.0, limit: float = 150.0, keys: tuple[str, ...] = ("blk", "tick")) -> DataFrame:
    """The sum of exp(-eta / scale) over trips due at each junction in under ``limit`` minutes."""
    due = etas.where(F.col("station_id").isin(*junctions) & (F.col("eta") < limit))
    return due.groupBy(*keys, "station_id").agg(F.sum(F.exp(-F.col("eta") / scale)).alias("pressure"))


def tick_spine(blocks: DataFrame, tick: int, length: int, block: str = "blk") -> DataFrame:
    """Every tick from 0 to ``length`` minutes of each distinct ``block``, whether anything runs then or not."""
    ticks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length).cast("long"), F.lit(tick).cast("long")))
    return blocks.select(block).distinct().select(block, ticks.alias("tick"))


def station_state_rows(
    occupied: DataFrame, stations: DataFrame, pressure: DataFrame, freight: DataFrame, ticks: DataFrame | None = None,
    keys: tuple[str, ...] = ("blk", "tick"), full: float = 0.85, worst: int = 30, busy: float = 5.0,
) -> DataFrame:
    """A row for every station at every tick of ``ticks``, or else of ``occupied``, empty stations included.

    ``stations`` (station_id, platforms, capacity) is the network's dimension, so the grid grows with the ticks only;
    ``pressure`` (keys, station_id, pressure) and ``freight`` (keys, station_id, freight, freight_due) may lack rows.
    Ratios end at 1. A station is critical by its trips and freight over capacity, or by its largest delay. Unknown
    platforms count as none, an unknown capacity as 1.
    """
    grid = (occupied if ticks is None else ticks).select(*keys).distinct().crossJoin(stations)
    d = grid.join(occupied, [*keys, "station_id"], "left").join(pressure, [*keys, "station_id"], "left").join(freight, [*keys, "station_id"], "left")
    n = lambda c: F.coalesce(F.col(c), _zero())
    cap = F.greatest(F.col("capacity"), F.lit(1))
    total = n("halting") + n("passing") + n("freight")
    upto1 = lambda x: F.least(F.lit(1.0), x)
    d = d.withColumn("capacity_ratio", upto1(total / cap)).withColumn("incoming", upto1(F.coalesce("pressure", F.lit(0.0)) / busy))
    return d.select(
        *keys, "station_id",
        F.when(F.col("platforms") > 0, upto1(n("halting") / F.col("platforms"))).otherwise(0.0).alias("platform_ratio"), "capacity_ratio",
        F.greatest(F.lit(0.0), (cap - total) / cap).alias("available_ratio"), n("freight").alias("freight"), n("passing").alias("passing"), "incoming",
        n("max_delay").alias("max_delay"), upto1(n("delayed") / cap).alias("delayed_density"),
        upto1((n("approaching") + n("freight_due")) / busy).alias("approach_density"), ((F.col("capacity_ratio") > full) | (n("max_delay") > worst)).alias("critical"),
    )


def section_occupancy(at: DataFrame, keys: tuple[str, ...] = ("blk", "tick")) -> DataFrame:
    """Trips under way per tick and unordered pair (a, b) of last and next station."""
    on = at.where("mode = 'in_transit' AND next_station IS NOT NULL")
    return on.groupBy(*keys, F.least("station_id", "next_station").alias("a"), F.greatest("station_id", "next_station").alias("b")).agg(F.count("*").alias("trips"))


def section_state_rows(at: DataFrame, sections: DataFrame, freight: DataFrame, disrupted: DataFrame, keys: tuple[str, ...] = ("blk", "tick")) -> DataFrame:
    """A row for every section at every tick: its load by trips and freight per line, disruption and booked values on a scale.

    A leg over several sections is on all of them. ``sections`` has (a, b, lines, run_min, loss_min), ``freight`` (keys, a,
    freight) and ``disrupted`` (keys, a, severity, multiplier) may lack rows. Unknown lines count as one, an unknown loss as
    none; an unknown run stays null, as ``least`` would pass it over.
    """
    on = at.where("mode = 'in_transit' AND next_station IS NOT NULL AND next_station <> station_id")
    on = on.select(*keys, F.explode(F.sequence(F.least("station_id", "next_station"), F.greatest("station_id", "next_station") - 1)).alias("a"))
    place = [*keys, "a"]
    d = at.select(*keys).distinct().crossJoin(sections).join(on.groupBy(*place).agg(F.count("*").alias("trips")), place, "left").join(freight, place, "left").join(disrupted, place, "left")
    n = lambda c: F.coalesce(F.col(c), _zero())
    lines = F.greatest(F.col("lines"), F.lit(1))
    upto = lambda top, x: F.least(F.lit(top), x)
    return d.select(
        *keys, "a", "b", n("trips").alias("trips"), upto(1.5, (n("trips") + n("freight")) / lines).alias("load"), upto(1.5, n("freight") / lines).alias("freight_load"),
        F.coalesce("severity", F.lit(0.0)).alias("severity"), F.coalesce("multiplier", F.lit(1.0)).alias("multiplier"),
        F.when(F.col("run_min").isNotNull(), upto(1.0, F.col("run_min") / 20.0)).alias("run_norm"), upto(1.0, F.coalesce("loss_min", F.lit(0.0)) / 60.0).alias("loss_norm"),
    )
