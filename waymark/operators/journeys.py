"""Trips as nested records, causes of their delays, feature vectors, and checks of what was built."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.columns import clamped_log, signed_log

#: What a stop of a nested trip holds; its order is the stop's place.
STOP = ("stop_idx", "station_id", "sched_arr", "sched_dep", "actual_arr", "actual_dep", "arr_delay", "dep_delay", "is_target", "has_actual", "is_halt", "allowance_min", "km")


def nest_journeys(stops: DataFrame, trip: str, attributes: dict[str, Column], valid: Column | None = None, shortest: int = 2) -> DataFrame:
    """One row per trip with its stops in order as an array of structs (see ``STOP``) and trip-level ``attributes``.

    ``attributes`` are aggregates over a trip's stops. Trips of fewer than ``shortest`` stops, and those for which ``valid``
    (an aggregate) is false, are left out. Columns of ``STOP`` that ``stops`` lacks are null.
    """
    held = [F.col(c) if c in stops.columns else F.lit(None).alias(c) for c in STOP]
    nested = stops.groupBy(trip).agg(
        F.array_sort(F.collect_list(F.struct(*held))).alias("stops"), *(c.alias(n) for n, c in attributes.items()), F.coalesce(valid if valid is not None else F.lit(True), F.lit(True)).alias("_valid")
    )
    return nested.where((F.size("stops") >= shortest) & F.col("_valid")).drop("_valid")


def cause_pivot(detentions: DataFrame, keys: list[str], text: Column, minutes: Column, groups: tuple[str, ...], rest: str = "OTHER") -> DataFrame:
    """Minutes per cause and in total for each key; a cause is the first of ``groups`` that its description holds, else ``rest``."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    cause = F.coalesce(*(F.when(upper.contains(g), F.lit(g)) for g in groups), F.lit(rest))
    m = F.coalesce(minutes.cast("double"), F.lit(0.0))
    d = detentions.select(*keys, cause.alias("_cause"), m.alias("_m"))
    names = [*groups, *([] if rest in groups else [rest])]
    by = [F.coalesce(F.sum(F.when(F.col("_cause") == g, F.col("_m"))), F.lit(0.0)).alias(g.lower().replace(" ", "_")) for g in names]
    return d.groupBy(*keys).agg(*by, F.sum("_m").alias("total"))


def attach_causes(trips: DataFrame, causes: DataFrame, keys: list[str]) -> DataFrame:
    """``trips`` with the columns of ``cause_pivot``; trips without detentions have 0."""
    d = trips.join(causes, keys, "left")
    return d.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in causes.columns if c not in keys})


# The order of a trip's features with how each is put on a scale. "log": signed, against the scale; "eta":
# logarithm of minutes up to the cap; "tanh": against the scale; "share": over the scale, up to the cap; "gap": 1 less the
# share; "centred": less 1, within the cap on both sides; "over1": less 1, up to the cap; "as is". The last entry of each
# is the value of a missing column.
VECTOR = (
    ("delay", "log", 240.0, None, 0.0), ("delay_velocity", "tanh", 5.0, None, 0.0), ("eta_next", "eta", None, 90.0, 90.0),
    ("eta_nearest", "eta", None, 90.0, 90.0), ("eta_second", "eta", None, 90.0, 90.0), ("junctions_ahead", "share", 4.0, 1.0, 0.0),
    ("priority", "as is", None, None, 0.5), ("speed_factor", "centred", None, 1.0, 1.0), ("stops_left", "share", 19.0, 1.0, 0.0),
    ("progress", "as is", None, None, 0.0), ("in_transit", "as is", None, None, 0.0), ("at_halt", "as is", None, None, 0.0),
    ("at_stop", "share", 30.0, 1.5, 0.0), ("since_departure", "share", 60.0, 1.5, 0.0), ("over_run", "share", 30.0, 1.5, 0.0),
    ("least_next_delay", "tanh", 30.0, None, 0.0), ("vehicles", "share", 24.0, 1.5, 0.0), ("overlaps", "share", 6.0, 1.5, 0.0),
    ("same_group", "share", 6.0, 1.5, 0.0), ("higher_priority", "share", 6.0, 1.5, 0.0), ("queue", "share", 6.0, 1.5, 0.0),
    ("junction_gap", "gap", 90.0, 1.0, 90.0), ("freight_in_section", "share", 2.0, 1.5, 0.0), ("freight_at_station", "share", 3.0, 1.5, 0.0),
    ("freight_due_next", "share", 3.0, 1.5, 0.0), ("section_disrupted", "as is", None, None, 0.0), ("section_multiplier", "over1", None, 2.0, 1.0),
    ("entry_delay", "log", 240.0, None, 0.0), ("entry_trend", "tanh", 15.0, None, 0.0), ("has_upstream", "as is", None, None, 0.0),
    ("day_sin", "as is", None, None, 0.0), ("day_cos", "as is", None, None, 1.0), ("delay_observed", "as is", None, None, 1.0),
    ("precedence_eta", "gap", 75.0, 1.0, 75.0), ("next_halt", "as is", None, None, 0.0), ("next_dwell", "share", 10.0, 1.5, 0.0),
    ("next_allowance", "share", 10.0, 1.5, 0.0), ("slack_ahead", "share", 30.0, 1.5, 0.0),
)
#: How many features each version has: the second lacks the two about slack.
VERSIONS = {"full": 38, "no_slack": 36}
EVENTS = tuple(f"f{i}" for i in range(8))
# Fixed values, as above: the features of a station and of a section at a tick.
STATION_VECTOR = (
    ("platform_ratio", "as is", None, None, 0.0), ("capacity_ratio", "as is", None, None, 0.0), ("available_ratio", "as is", None, None, 1.0),
    ("freight_ratio", "share", 1.0, 1.5, 0.0), ("incoming", "as is", None, None, 0.0), ("max_delay", "share", 120.0, 2.0, 0.0),
    ("delayed_density", "as is", None, None, 0.0), ("approach_density", "as is", None, None, 0.0), ("congestion", "as is", None, None, 0.0),
    ("mixed", "as is", None, None, 0.0), ("since_critical", "share", 20.0, 1.0, 0.0), ("critical", "as is", None, None, 0.0),
    ("day_sin", "as is", None, None, 0.0), ("day_cos", "as is", None, None, 1.0), ("is_junction", "as is", None, None, 0.0),
    ("platforms", "share", 7.0, 1.0, 0.0), ("capacity", "share", 11.0, 1.0, 2.0), ("loop_lines", "share", 9.0, 1.0, 0.0),
    ("crew_change", "as is", None, None, 0.0), ("traction_change", "as is", None, None, 0.0),
)
SECTION_VECTOR = (
    ("run_norm", "as is", None, None, 0.3), ("load", "as is", None, None, 0.0), ("freight_load", "as is", None, None, 0.0), ("multiplier", "over1", None, None, 1.0),
    ("severity", "as is", None, None, 0.0), ("loss_norm", "as is", None, None, 0.0), ("a_junction", "as is", None, None, 0.0), ("b_junction", "as is", None, None, 0.0),
    ("day_sin", "as is", None, None, 0.0), ("day_cos", "as is", None, None, 1.0),
)


def scaled(name: str, kind: str, scale: float | None, cap: float | None, missing: float, columns: list[str]) -> Column:
    """One feature of ``VECTOR`` from the column of its name, or its default where that is missing, null or NaN."""
    x = F.col(name).cast("double") if name in columns else F.lit(missing)
    x = F.coalesce(F.nanvl(x, F.lit(missing)), F.lit(missing))
    upto = lambda v, top: v if top is None else F.least(v, F.lit(top))
    return {
        "as is": lambda: x,
        "log": lambda: signed_log(x) / math.log1p(scale),
        "eta": lambda: clamped_log(x, cap),
        "tanh": lambda: F.tanh(x / scale),
        "share": lambda: upto(x / scale, cap),
        "gap": lambda: 1.0 - upto(x / scale, cap),
        "centred": lambda: F.greatest(F.lit(-cap), upto(x - 1.0, cap)),
        "over1": lambda: upto(x - 1.0, cap),
    }[kind]()


def select_feature_set(version: str) -> tuple[str, ...]:
    """The names of a version's features in order, with those of the junction events after them."""
    if version not in VERSIONS:
        raise ValueError(f"{version}: the versions are {', '.join(VERSIONS)}")
    return (*(v[0] for v in VECTOR[: VERSIONS[version]]), *EVENTS)


def check_width(df: DataFrame, vector: str, version: str) -> DataFrame:
    """One row: vectors, and those whose width isn't the version's."""
    return df.agg(F.count(vector).alias("n"), F.count_if(F.size(vector) != len(select_feature_set(version))).alias("wrong_width"))


def vector_of(spec: tuple, columns: list[str]) -> list[Column]:
    return [scaled(*v, columns) for v in spec]


def assemble_vectors(df: DataFrame, version: str = "full") -> DataFrame:
    """Adds ``vector``: the features of the version in order; columns that ``df`` lacks take their defaults."""
    events = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in EVENTS]
    return df.withColumn("vector", F.array(*vector_of(VECTOR[: VERSIONS[version]], df.columns), *events))


def place_vectors(df: DataFrame, spec: tuple) -> DataFrame:
    """Adds ``vector`` by ``STATION_VECTOR`` or ``SECTION_VECTOR``; truth values count as 0 and 1."""
    flags = {c: F.col(c).cast("int") for c, t in df.dtypes if t == "boolean"}
    return df.withColumns(flags).withColumn("vector", F.array(*vector_of(spec, df.columns)))


def integrity_check(rows: DataFrame, day: str, tick: str, trip: str, manifest: DataFrame) -> DataFrame:
    """A row per check of a build against its ``manifest`` (first_day, last_day, n_days; one row): trips that occur again in a
    snapshot, days built, days the manifest tells, and days outside its range."""
    again = rows.groupBy(day, tick, trip).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("repeated"))
    days = rows.select(F.col(day).alias("d")).distinct().join(manifest, how="left")  # one row
    counts = days.agg(F.count("*").alias("days"), F.max("n_days").alias("told"), F.count_if((F.col("d") < F.col("first_day")) | (F.col("d") > F.col("last_day"))).alias("outside"))
    one = again.join(counts, how="left")
    cells = F.array(*(F.struct(F.lit(name).alias("check"), F.col(c).cast("long").alias("value"), bad.alias("failed")) for name, c, bad in (
        ("repeated_trips", "repeated", F.col("repeated") > 0), ("days", "days", F.lit(False)), ("days_told", "told", ~F.col("told").eqNullSafe(F.col("days"))),
        ("days_outside", "outside", F.col("outside") > 0),
    )))
    return one.select(F.inline(cells))
