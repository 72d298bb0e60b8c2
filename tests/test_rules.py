"""Hand-made cases of the rules: ties, single days, long stands, nulls, and what must not be known yet."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import contracts, fills, journeys, leaks, learned, linked, network, outlook, profiles, ranges, scoring, traffic
from waymark.operators import sequence as seq
from waymark.streaming import feeds

STOP = "instance_id string, blk long, stop_idx long, station_id long, sched_arr long, sched_dep long, actual_arr long, actual_dep long"


def trip(spark, *stops, name="t"):
    """Stops as (station, booked arrival, booked departure, arrival, departure)."""
    return spark.createDataFrame([(name, 0, i, *s) for i, s in enumerate(stops)], STOP)


def at_tick(timed, tick):
    return seq.position_at(timed, tick).where(F.col("tick") == tick)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_standing_trip_past_its_booked_departure_is_held(spark):
    s = trip(spark, (1, 0, 5, 0, 5), (2, 20, 25, 22, 90), (3, 40, 45, 110, 115))
    at = at_tick(seq.look_ahead(seq.trips_in_time(s)), 60)  # 35 minutes after it should have left
    assert got(at.select("mode", seq.departure_delay())) == [("at_station", 35)]
    assert got(seq.path_etas(at, s, 75).select("station_id", "eta")) == [(2, 0), (3, 50)]


def test_unknown_departure_under_way_counts_as_none(spark):
    s = trip(spark, (1, 0, 5, 9, None), (2, 20, 25, 50, 55))
    assert got(at_tick(seq.trips_in_time(s), 20).select("mode", seq.departure_delay())) == [("in_transit", 0)]


def test_etas_end_for_good_at_the_first_one_over_the_horizon(spark):
    s = trip(spark, (1, 0, 5, 0, 5), (2, 100, 100, None, None), (3, 30, 30, None, None), (1, 10, 11, None, None))
    at = at_tick(seq.trips_in_time(s), 5).where("mode = 'at_station'")
    assert got(seq.path_etas(at, s, 75).select("station_id", "eta")) == [(1, 0)]


def test_stages_grow_only_while_standing(spark):
    s = trip(spark, (1, 0, 10, 0, 40), (2, 60, 65, 100, 105))
    at = seq.with_fresh(seq.position_at(seq.trips_in_time(s), 5))
    stages = got(at.where("stop_idx = 0").select("mode", "stage", "fresh", "tick"))
    assert {r[1] for r in stages if r[0] == "in_transit"} == {0}
    assert sorted(r[3] for r in stages if r[2] and r[0] == "at_station") == [5, 15, 30]  # stage 1, 2 and 3
    assert [r[3] for r in stages if r[2] and r[0] == "in_transit"] == [0]  # the very arrival, at the trip's first stop


def test_targets_and_long_stands(spark):
    s = trip(spark, (1, 0, 10, 0, 300), (2, 60, 65, 320, None), (3, 80, 85, None, 350))
    marked = seq.next_targets(seq.trips_in_time(s), 2, F.lit(True), F.lit(True))
    at = seq.departure_targets(seq.horizon_targets(seq.with_fresh(seq.position_at(marked, 5)), 2))
    rows = {r.tick: r for r in at.where("mode = 'at_station' AND stop_idx = 0").collect()}
    assert (rows[5].targets, rows[5].mask) == ([260, 0], [1, 0])
    assert (rows[5].next_departure_delay, rows[5].next_departure_mask) == (260, 1)  # the arrival's, as no departure is known
    assert (rows[5].remaining_dwell, rows[5].remaining_dwell_mask) == (0, 0)  # 295 minutes are too long to be a target
    assert (rows[10].targets, rows[10].remaining_dwell_mask) == ([0, 0], 0)  # not the first of its stage
    none = seq.next_targets(seq.trips_in_time(s), 2, F.lit(True), F.lit(False))
    assert not any(m for r in seq.horizon_targets(seq.with_fresh(seq.position_at(none, 5)), 2).collect() for m in r.mask)


def test_history_hides_the_coming_departure(spark):
    worlds = [trip(spark, (1, 0, 5, 0, 5), (2, 20, 25, 22, leaves), (3, 40, 45, leaves + 20, leaves + 25)) for leaves in (90, 160)]
    seen = [seq.journey_history(at_tick(seq.with_history(seq.trips_in_time(w), F.lit(True)), 60)).select("history", "n_history").first() for w in worlds]
    assert seen[0] == seen[1]
    last = seen[0].history[-1]
    assert (last.delay, last.step, last.at_stop, last.dwell) == (2, 2, 33, 38)


def test_prefix_counts_observed_arrivals_only(spark):
    s = trip(spark, (1, 0, 0, 3, 3), (2, 10, 10, None, 15), (3, 20, 20, 30, 30), (4, 30, 30, 34, 34), (5, 40, 40, 52, 52), (6, 50, 50, 60, 60)).withColumn("km", F.col("stop_idx") * 10.0)
    r = {x.stop_idx: x for x in seq.prefix_features(seq.carry_forward(s)).collect()}
    assert (r[0].n_prior, r[0].last_delay, r[0].trend, r[0].km, r[0].step_sd) == (0, 0, 0, 0.0, 0.0)
    assert (r[2].n_prior, r[2].last_delay, r[2].trend) == (1, 3, 0)
    assert (r[4].n_prior, r[4].last_delay, r[4].trend, r[4].max_delay, r[4].recovered, r[4].km) == (3, 4, 1, 10, 6, 30.0)
    assert (r[5].n_prior, r[5].trend) == (4, 9)


@pytest.mark.parametrize("n,want", [(1, "T"), (2, "VT"), (3, "rVT"), (5, "rVTTT"), (12, "rrrVVVVTTTTT")])
def test_split_keeps_a_test_day(spark, n, want):
    df = spark.range(n).withColumnRenamed("id", "day")
    names = {"test": "T", "validation": "V", "train": "r"}
    assert "".join(names[r.split] for r in seq.assign_split(df, "day", 5, 4).orderBy("day").collect()) == want


def test_speeds_and_order_come_from_observed_times(spark):
    s = trip(spark, (1, 0, 5, 10, 5), (2, 10, 15, 3, 20), (3, 20, 25, 50, None), (4, 30, 35, 60, 61)).withColumn("km", F.col("station_id") * 100.0)
    assert got(seq.leg_checks(s, "km").select("stop_idx", "leaves_before_arrival", "runs_backwards", "kmh", "too_fast")) == [
        (0, True, True, None, False), (1, False, False, 200.0, True), (2, False, False, None, False), (3, False, False, None, False),
    ]


def test_feature_statuses(spark):
    n = 1000
    df = spark.range(n).selectExpr(
        "5 AS one", "5 + id % 2 / 1000 AS pinned", "CAST(id < 20 AS INT) AS few", "CAST(id % 100 = 0 OR id < 60 AS INT) * 1 AS sparse", "CAST(id < 10 AS INT) AS rare", "id AS fine", "CAST(NULL AS DOUBLE) AS none"
    )
    status = {r["column"]: r.status for r in profiles.feature_audit(df, df.columns, sparse_ok=("rare",), constant_ok=("one",), few=5).collect()}
    assert status == {"one": "constant-ok", "pinned": "saturated", "few": "sparse", "sparse": "sparse", "rare": "empty-ok", "fine": "ok", "none": "constant"}
    assert {r.status for r in profiles.feature_audit(df, ["few"], few=50).collect()} == {"few"}


def test_near_is_never_lost_to_a_null(spark):
    e = spark.createDataFrame([(1, 10.0, None), (1, 10.0, None), (2, 10.0, "x"), (None, 10.0, "y"), (1, None, "z")], "key long, t double, note string")
    o = spark.createDataFrame([(1, 15.0)], "key long, o double")
    near = ranges.exists_near(e, o, ["key"], "t", "o", 5.0, F.lit(True))
    assert got(near.select("key", "t", "note", "near")) == got(spark.createDataFrame([(1, 10.0, None, True)] * 2 + [(2, 10.0, "x", False), (None, 10.0, "y", False), (1, None, "z", False)], "key long, t double, note string, near boolean"))


def test_long_intervals_meet_each_point_once(spark):
    points = spark.range(0, 5000, 7).selectExpr("id", "CAST(id AS DOUBLE) AS t", "id % 2 AS k")
    spans = spark.createDataFrame([(0, 0.0, 5000.0, "all"), (0, 100.0, 180.0, "some"), (1, 7.0, 7.0, "point"), (1, 50.0, 40.0, "reversed"), (0, 0.0, 1e6, "far")], "k long, s double, e double, name string")
    hit = ranges.range_join(points, spans, ["k"], "t", "s", "e", 1.0).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"))
    evens = [i for i in range(0, 5000, 7) if i % 2 == 0]
    want = {"all": len(evens), "far": len(evens), "some": sum(100 <= i <= 180 for i in evens), "point": 1}
    assert {r.name: (r.n, r.d) for r in hit.collect()} == {k: (v, v) for k, v in want.items()}


def test_runaways_need_a_late_rise(spark):
    rows = [("a", k, 0, e, 0) for k, e in enumerate((5, 10, 20, 45))]  # the last is over 40 and more than 20 over the middle
    rows += [("b", k, 0, e, 0) for k, e in enumerate((50, 50, 50, 50))] + [("c", k, 0, e, 0) for k, e in enumerate((0, 0, 90))]
    df = spark.createDataFrame(rows, "trip string, hop long, pred long, actual long, persist long")
    d = {r.series: r for r in scoring.journey_robust_stats(df, "trip", "hop").collect()}
    assert (d["model"].runaways, d["model"].trips, d["persistence"].mean) == (1, 3, d["model"].mean)


def test_half_a_rise_is_a_hit(spark):
    df = spark.createDataFrame([(16, 40, 0), (14, 40, 0), (-16, -40, 0), (40, 10, 0)], "pred long, actual long, persist long")
    d = {r.rule: r for r in scoring.event_detection(df, scoring.rollout_rules()).collect()}
    assert (d["spike"].events, d["spike"].recall, d["spike"].precision) == (2, 0.5, 0.5)
    assert (d["recovery"].events, d["recovery"].recall) == (1, 1.0)


def moment(day, hour=10, minute=0, month=9):
    return dt.datetime(2025, month, day, hour, minute)


FILL = "trip string, field string, k long, own timestamp_ntz, other timestamp_ntz, latest timestamp_ntz"


def filled(spark, rows):
    df = spark.createDataFrame([("t", "arrival", k, own, other, None) for k, (own, other) in enumerate(rows)], FILL)
    bounds = F.lit("2025-01-01").cast("timestamp_ntz"), F.lit("2026-01-01").cast("timestamp_ntz")
    return [(r.filled, r.origin) for r in fills.fill_from_reference(df, "trip", "field", "k", *bounds).orderBy("k").collect()]


def test_fills_become_neighbours(spark):
    # the second gap is more than two hours a stop from the known value, but not from the first fill
    rows = [(moment(9, 10), moment(9, 10)), (None, moment(9, 11, 50)), (None, moment(9, 13, 40)), (None, moment(9, 17)), (None, None)]
    assert filled(spark, rows) == [(moment(9, 10), "own"), (moment(9, 11, 50), "other"), (moment(9, 13, 40), "other"), (None, "rejected"), (None, "none")]


def test_exchanged_days_are_repaired(spark):
    known = [(moment(9, 10, month=11), None), (moment(9, 12, month=11), moment(9, 12, month=11))]
    assert filled(spark, [known[0], (None, moment(11, 10, 30, month=9)), known[1]])[1] == (moment(9, 10, 30, month=11), "repaired")
    assert filled(spark, [known[0], (None, moment(13, 11, month=9)), known[1]])[1] == (None, "unrepairable")  # there is no 13th month
    assert filled(spark, [(None, moment(9)), (None, moment(9, 11))]) == [(None, "none")] * 2


def test_reasons_in_order(spark):
    day = moment(9, 10)
    rows = [
        (0, day, day, None), (1, None, moment(9, 10, 30), moment(9, 10, 20)), (2, None, moment(20), None), (3, None, moment(9, 9), None),
        (4, None, moment(9, 20), None), (5, moment(9, 19), moment(9, 19), None), (6, None, moment(9, 19, 30), None), (7, None, moment(9, 19, 20), None),
    ]
    df = spark.createDataFrame([("t", "arrival", *r) for r in rows], FILL)
    reasons = {r.k: r.reason for r in fills.fill_checks(df, "trip", "field", "k").collect()}
    assert reasons == {1: "after_latest", 2: "outside_span", 3: "before_previous", 4: "after_next", 6: "out_of_order", 7: "out_of_order"}


def test_projection_holds_and_never_runs_backwards(spark):
    s = trip(spark, (1, 0, 10, 0, 30), (2, 20, 21, None, None), (3, 22, 22, None, None), (4, 400, 400, None, None), (5, 30, 30, None, None))
    at = seq.delay_now(at_tick(seq.trips_in_time(s), 20))
    p = outlook.booked_projection(at, s, 20, 240)
    # it stands since 0 and was due to leave at 10, so it leaves now, ten minutes late
    assert got(p.select("k", "arr", "delay", "hop", "lead_min")) == [(1, 30, 10, 1, 10), (2, 32, 10, 2, 12)]


def test_components_and_lone_places(spark):
    nodes = spark.range(8).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(5, 1), (1, 0), (2, 3), (3, 3), (None, 4)], "a long, b long")
    found = linked.components(nodes, edges)
    assert got(found) == [(0, 0, False), (1, 0, False), (2, 2, False), (3, 2, False), (4, 4, True), (5, 0, False), (6, 6, True), (7, 7, True)]
    with pytest.raises(ValueError):
        network.assert_connected(found)
    network.assert_connected(linked.components(nodes.where("node < 2"), edges))
    chain = spark.range(60).selectExpr("id AS a", "id + 1 AS b")
    assert linked.components(spark.range(61).withColumnRenamed("id", "node"), chain).select("component").distinct().collect()[0][0] == 0


def test_next_junction_on_the_route(spark):
    at = spark.createDataFrame([(1, 2, [1, 2, 5, 9]), (9, None, [1, 9]), (7, 8, [3, 5]), (5, 9, [5, 9]), (1, 2, None)], "station_id long, next_station long, r array<long>")
    assert got(network.next_junction(at, "r", (5, 9)).select("station_id", "junction", "branch")) == [(1, 5, 2), (1, None, None), (5, 9, 5), (7, 5, 3), (9, 9, 1)]


def test_vectors_take_defaults(spark):
    v = journeys.assemble_vectors(spark.createDataFrame([(float("nan"), None)], "delay double, priority double")).first().vector
    assert len(v) == 46 and v[0] == 0.0 and v[6] == 0.5 and v[2] == 1.0
    assert len(journeys.select_feature_set("no_slack")) == 44
    with pytest.raises(ValueError):
        journeys.select_feature_set("other")


def test_causes_by_first_keyword(spark):
    df = spark.createDataFrame([(1, "alarm in traffic", 5.0), (1, "Loco", None), (1, None, 2.0), (2, "TRAFFIC", 1.0)], "k long, t string, m double")
    p = journeys.cause_pivot(df, ["k"], F.col("t"), F.col("m"), ("TRAFFIC", "ALARM", "LOCO"))
    assert got(p.select("k", "traffic", "alarm", "loco", "other", "total")) == [(1, 5.0, 0.0, 0.0, 2.0, 7.0), (2, 1.0, 0.0, 0.0, 0.0, 1.0)]


def test_rebuild_drops_what_is_no_longer_valid(spark):
    build = lambda df: df.groupBy("k").agg(F.sum("v").alias("v")).where("v > 0")
    cache = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    history = spark.createDataFrame([("a", -5), ("b", 9), ("c", 3)], "k string, v long")
    changed = spark.createDataFrame([("a",), ("c",)], "k string")
    assert got(feeds.incremental_rebuild(cache, changed, history, build, ["k"])) == [("b", 2), ("c", 3)]


def test_upserts_and_rebuilds_over_a_restart(spark, tmp_path):
    folder, schema = str(tmp_path / "run"), "k string, v long, minute long"

    def arrive(*rows):
        df = spark.createDataFrame(list(rows), schema).withColumn("ts", F.timestamp_seconds(F.col("minute") * 60)).drop("minute")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")

    stream = lambda: feeds.event_stream(spark, str(tmp_path)).select("k", "v")
    build = lambda df: df.groupBy("k").agg(F.sum("v").alias("v")).where("v > 0")
    history = lambda: spark.read.parquet(f"{tmp_path}/events.parquet").select("k", "v")
    arrive(("a", 1, 0), ("b", 2, 0))
    assert got(feeds.upsert_sink(stream(), ["k"], [F.col("v")], folder + "1")) == [("a", 1), ("b", 2)]
    assert got(feeds.rebuild_sink(stream(), history, build, ["k"], folder + "2")) == [("a", 1), ("b", 2)]
    arrive(("a", -4, 1), ("c", 5, 1), ("c", 4, 1))
    assert got(feeds.upsert_sink(stream(), ["k"], [F.col("v")], folder + "1")) == [("a", -4), ("b", 2), ("c", 4)]
    assert got(feeds.rebuild_sink(stream(), history, build, ["k"], folder + "2")) == [("b", 2), ("c", 9)]


CONFLICT = "blk long, tick long, instance_id string, junction long, branch long, eta long, priority double, overlaps long, queue long"


def test_conflicts_of_trips_of_which_little_is_known(spark):
    rows = [(0, 0, "a", 5, 4, None, 0.9, 12, 1), (0, 0, "b", 5, None, None, None, None, None), (0, 0, "c", 5, 4, 30, 0.2, None, 2), (0, 0, "d", None, 4, 30, 0.2, 1, 1)]
    trips = spark.createDataFrame(rows, CONFLICT)
    edges = network.junction_conflicts(trips, 60.0)
    found = got(edges.select("src", "dst", "gap", F.round("priority_delta", 6), "other_first", "cross_branch", F.round("stored_overlap", 6)))
    # both trips without an eta are 999 minutes away, an unknown priority is the middle one, unknown overlaps are none
    assert found == [("a", "b", 0, -0.4, 0, 0, 1.5), ("b", "a", 0, 0.4, 0, 0, 0.0)]
    events = network.event_features(network.junction_events(trips, edges))
    assert got(events.select("instance_id", "f0", "f3", "f4", "y3")) == [("a", 1 / 6, 1 / 6, 1.0, 1), ("b", 1 / 6, 0.0, 1.0, 0), ("c", 0.0, 2 / 6, 0.0, 1), ("d", 0.0, 1 / 6, 0.0, 1)]


def test_conflict_pairs_equal_a_plain_count(spark):
    rng = random.Random(3)
    rows = [(0, i % 2, f"t{i}", i % 3, i % 4, rng.randrange(0, 400), rng.random(), 1, 1) for i in range(150)]
    edges = got(network.junction_conflicts(spark.createDataFrame(rows, CONFLICT), 45.0).select("src", "dst", "gap"))
    wanted = [(a[2], b[2], abs(a[5] - b[5])) for a in rows for b in rows if a[1] == b[1] and a[3] == b[3] and a[2] != b[2] and abs(a[5] - b[5]) <= 45]
    assert edges == sorted(wanted, key=str)


def test_an_unknown_run_stays_unknown(spark):
    at = spark.createDataFrame([(0, 0, "in_transit", 1, 2)], "blk long, tick long, mode string, station_id long, next_station long")
    sections = spark.createDataFrame([(1, 2, None, None, None), (2, 3, 2, 10.0, 30.0)], "a long, b long, lines long, run_min double, loss_min double")
    none = spark.createDataFrame([], "blk long, tick long, a long, freight long, severity double, multiplier double")
    rows = traffic.section_state_rows(at, sections, none.drop("severity", "multiplier"), none.drop("freight"))
    assert got(rows.select("a", "trips", "load", "run_norm", "loss_norm")) == [(1, 1, 1.0, None, 0.0), (2, 0, 0.0, 0.5, 0.5)]


def test_memory_goes_on_over_ticks_at_which_nothing_runs(spark):
    ticks = traffic.tick_spine(spark.createDataFrame([(7,)], "blk long"), 3, 30)
    busy = spark.createDataFrame([(7, 3, 0, 4, 0, 9, 0)], "blk long, tick long, station_id long, halting long, passing long, max_delay long, delayed long").withColumn("approaching", F.lit(0).cast("long"))
    busy = busy.unionByName(busy.withColumn("tick", F.lit(21).cast("long")).withColumn("halting", F.lit(0).cast("long")))
    stations = spark.createDataFrame([(0, 2, 4)], "station_id long, platforms long, capacity long")
    none = spark.createDataFrame([], "blk long, tick long, station_id long, pressure double, freight long, freight_due long")
    dense = traffic.station_state_rows(busy, stations, none.drop("freight", "freight_due"), none.drop("pressure"), ticks)
    kept = seq.station_memory(dense, ["blk", "station_id"], "tick", "capacity_ratio", "delayed_density", "critical")
    at = {r["tick"]: (r["congestion"], r["since_critical"]) for r in kept.collect()}
    # one empty tick before the first trip; five between the two, at which load and count go on
    assert [at[t] for t in range(0, 31, 3)] == [(0.0, 0), (0.0, 1), (1.0, 0), (0.0, 1), (0.0, 2), (0.0, 3), (0.0, 4), (0.0, 5), (0.0, 6), (0.0, 7), (0.0, 8)]


def plain_conflicts(rows, window, queue, levels_of):
    """All pairs at one station and tick, by counting."""
    out = {}
    for a in rows:
        others = [b for b in rows if b[0] != a[0]]
        near = [b for b in others if abs(b[1] - a[1]) <= window]
        ahead = [a[1] - b[1] for b in others if b[1] < a[1]]
        behind = [b[1] - a[1] for b in others if b[1] >= a[1]]
        higher = [b for b in near if levels_of(b) > levels_of(a)]
        out[a[0]] = (
            len(near), sum(b[2] == a[2] for b in near), len(higher), sum(0 <= b[1] - a[1] <= queue for b in others),
            min(75, *ahead, 75), min(75, *behind, 75), min(75, a[1]) if higher else 75,
        )
    return out


CONFLICT_COLUMNS = ["overlaps", "same_group", "higher_priority", "queue", "headway_ahead", "headway_behind", "precedence_eta"]


def test_conflicts_at_a_station_equal_a_plain_count(spark):
    rng = random.Random(4)
    rows = [(f"t{i}", rng.choice([rng.randrange(0, 600), 40, 41, 119]), rng.choice([None, 1, 2]), rng.randrange(4)) for i in range(300)]
    etas = spark.createDataFrame(rows, "instance_id string, eta long, g long, l long").selectExpr("*", "0L AS blk", "0L AS tick", "7L AS station_id")
    found = traffic.path_conflicts(etas, F.col("g"), F.col("l"), 4, (7,), window=30, queue=15)
    assert {r["instance_id"]: tuple(r[c] for c in CONFLICT_COLUMNS) for r in found.collect()} == plain_conflicts(rows, 30, 15, lambda r: r[3])


def test_a_hot_station_is_counted_in_bands(spark):
    n = 50_000
    etas = spark.range(n).selectExpr("concat('t', id) AS instance_id", "CASE WHEN id % 2 = 0 THEN 60 ELSE id % 1440 END AS eta", "id % 3 AS g", "id % 10 AS l", "0L AS blk", "0L AS tick", "7L AS station_id")
    found = traffic.path_conflicts(etas, F.col("g"), F.col("l"), 10, (7,), window=20, queue=15)
    assert "_band" in found._jdf.queryExecution().toString().split("Optimized Logical Plan")[1].split("Window")[1]
    rows = [(60 if i % 2 == 0 else i % 1440, i % 3, i % 10) for i in range(n)]
    counts = {}
    for r in rows:
        counts[r] = counts.get(r, 0) + 1
    by_id = {r["instance_id"]: r for r in found.where("instance_id IN ('t0', 't61', 't777')").collect()}
    for i in (0, 61, 777):
        eta, g, l = rows[i]
        near = {k: c for k, c in counts.items() if abs(k[0] - eta) <= 20}
        assert by_id[f"t{i}"]["overlaps"] == sum(near.values()) - 1
        assert by_id[f"t{i}"]["same_group"] == sum(c for k, c in near.items() if k[1] == g) - 1
        assert by_id[f"t{i}"]["higher_priority"] == sum(c for k, c in near.items() if k[2] > l)
        assert by_id[f"t{i}"]["queue"] == sum(c for k, c in counts.items() if 0 <= k[0] - eta <= 15) - 1


def test_positions_at_chosen_instants_are_those_of_all_ticks(spark):
    rng = random.Random(9)
    trips = None
    for n in range(12):
        at, stops_of = rng.randrange(60), []
        for _ in range(6):
            dwell, late = rng.randrange(0, 9), rng.randrange(-3, 20)
            stops_of.append((rng.randrange(9), at, at + dwell, rng.choice([None, at + late]), rng.choice([None, at + dwell + late])))
            at += dwell + rng.randrange(1, 30)
        part = trip(spark, *stops_of, name=f"t{n}")
        trips = part if trips is None else trips.unionByName(part)
    timed = seq.trips_in_time(trips)
    keep = ["instance_id", "stop_idx", "tick", "mode"]
    wanted = [r for r in got(seq.position_at(timed, 1).select(*keep)) if r[2] in (30, 77, 120)]
    assert got(seq.position_at_instants(timed, [77, 30, 120, 77]).select(*keep)) == wanted
    when = spark.createDataFrame([(0, t) for t in (30, 77, 77, 120, None)] + [(1, 50)], "blk long, at long")
    assert got(seq.position_when(timed, when, "at", bucket=10.0).select(*keep)) == wanted


def test_ranks_of_continuous_scores_are_exact(spark):
    rng = random.Random(1)
    rows = [(rng.random(), rng.random() < 0.3, rng.choice([None, "a", "b"])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "s double, y boolean, g string")
    pos, neg = [r[0] for r in rows if r[1]], [r[0] for r in rows if not r[1]]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert scoring.auc_single(df, ["s"], F.col("y")).first()["auc"] == pytest.approx(max(auc, 1 - auc), abs=1e-12)
    down = sorted(rows, reverse=True)
    want = {}
    for recall in (0.25, 0.5):
        hits = 0
        for n, r in enumerate(down, 1):
            hits += r[1]
            if hits >= recall * len(pos):
                want[recall] = (r[0], hits / n)
                break
    found = scoring.precision_at_recall(df, "s", F.col("y"), [0.25, 0.5]).collect()
    assert {r["recall"]: (r["threshold"], pytest.approx(r["precision"])) for r in found} == want
    quantiles = {r["g"]: (r["median"], r["p90"]) for r in scoring.ranked_quantiles(df, ["g"], "s", median=0.5, p90=0.9).collect()}
    for g in (None, "a", "b"):
        own = sorted(r[0] for r in rows if r[2] == g)
        assert quantiles[g] == (own[int(len(own) * 0.5)], own[int(len(own) * 0.9)])


def test_services_are_numbered_the_same_in_every_run(spark):
    df = spark.range(20_000).selectExpr("concat('s', lpad(cast(pmod(xxhash64(id), 7000) AS string), 5, '0')) AS service", "id AS at", "id % 5 AS kind").repartition(13)
    numbered = profiles.register_services(df, "service", ["at"], ["kind"], parts=16)
    first = got(numbered)
    names = sorted({r["service"] for r in df.select("service").distinct().collect()})
    assert {r[0]: r[-1] for r in first} == {n: i for i, n in enumerate(names)}
    assert got(numbered) == first == got(profiles.register_services(df.repartition(5), "service", ["at"], ["kind"], parts=3))
    assert "rangepartitioning" not in numbered._jdf.queryExecution().toString().lower()  # the ranges are written, none is drawn again


def test_the_audit_tells_leaks_and_mutants_that_go_unnoticed(spark):
    world = spark.createDataFrame([(i, 10 * i, 10 * i + 5) for i in range(20)], "k long, past long, future long")
    shift = lambda df, by: df.withColumn("future", F.col("future") + by)
    build = lambda *places: lambda df: df.select("k", *(c for p in places for c in p))
    good = leaks.place("good", F.col("past"), F.col("future"))
    leaky = leaks.place("leaky", F.col("past") + F.when(F.col("k") == 7, F.col("future")).otherwise(0), F.col("future"))
    blind = leaks.place("blind", F.col("past"), F.col("past") + 1)
    audit = leaks.leak_audit(build(good, leaky, blind), world, shift, (1, 5), ["k"])
    assert got(leaks.verdict(audit)) == [("blind", True, False), ("good", True, True), ("leaky", False, True)]
    assert got(audit.where("feature = 'leaky'").select("reading", "n", "differing")) == [("opened", 20, 20), ("sealed", 20, 1)]
    leaks.assert_no_leak(leaks.leak_audit(build(good), world, shift, (1, 5), ["k"]))
    with pytest.raises(ValueError, match=r"blind \(its mutant was not caught\), leaky \(leaks\)|leaky \(leaks\), blind"):
        leaks.assert_no_leak(audit)


def test_contracts_of_a_catalog(spark):
    good = spark.createDataFrame([("1", 1), ("2", 2)], "n string, k long")
    bad = spark.createDataFrame([("x", 1), ("2", 1), (None, None), ("1e3", None)], "n string, k long")
    asked = contracts.Contract(required=("n", "k"), key=("k",), numeric=("n",))
    tables = {"good": lambda: good, "bad": lambda: bad, "short": lambda: bad.select("n"), "empty": lambda: good.limit(0)}
    found = contracts.check_catalog(tables, dict.fromkeys(["good", "bad", "short", "empty", "absent"], asked))
    assert got(contracts.broken(found)) == [
        ("absent", "present", "", 0), ("bad", "not_numeric", "n", 1), ("bad", "null_keys", "", 2), ("bad", "repeated_keys", "", 2),
        ("short", "missing_column", "k", 1), ("short", "not_numeric", "n", 1),
    ]
    with pytest.raises(ValueError):
        contracts.check_catalog(tables, {})


def test_a_planted_rise_is_learnt_and_noise_is_not(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        trip_name, x, z = f"t{i // 5}", rng.random(), rng.random()
        rise = (60.0 if x + 0.3 * z > 0.8 else 5.0) + rng.gauss(0, 3) + 80 * x
        rows.append((trip_name, x, z, rng.random(), rise, rng.choice([5.0, 70.0])))
    df = learned.grouped_split(spark.createDataFrame(rows, "trip string, x double, z double, w double, rise double, noise double"), "trip", 0.4)
    assert df.groupBy("trip").agg(F.countDistinct("held_out").alias("n")).where("n > 1").count() == 0
    told = learned.rise_classifier(df, ["x", "z", "w"], "rise", 30.0, rounds=8)
    assert told.first()["auc"] > 0.97 and told.where("recall = 0.9").first()["precision"] > 0.9
    blind = learned.rise_classifier(df, ["x", "z", "w"], "noise", 30.0, rounds=8).first()["auc"]
    assert 0.4 < blind < 0.6
    size = learned.rise_regressor(df, ["x", "z", "w"], "rise", 30.0, rounds=8).first()
    assert size["mae"] < 0.8 * size["median_mae"] and size["r2"] > 0.3
    assert learned.rise_regressor(df, ["w"], "rise", 30.0, rounds=8).first()["r2"] < 0.1


def test_only_targets_of_eligible_trips_are_scored(spark):
    s = trip(spark, (1, 0, 5, 0, 5), (2, 20, 25, 30, 35), (3, 40, 45, 50, 55), (4, 60, 65, None, None), (None, 80, 85, 99, None))
    timed = seq.trips_in_time(s.unionByName(s.withColumn("instance_id", F.lit("u"))))
    seen = seq.delay_now(seq.position_at(timed, 10))
    rows = got(outlook.persistence(seen, timed, 10, F.col("station_id") != 2, F.col("instance_id") == "t").select("instance_id", "k", "persist", "hop", "actual"))
    assert rows == [("t", 2, 0, 2, 10)]
    assert outlook.persistence(seen, timed, 10).count() == 6
