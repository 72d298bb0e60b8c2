"""Queries over trips: filling, positions, looking ahead and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import sequence as seq
from waymark.plans.book import query
from waymark.sources.fixtures import JUNCTIONS, STOPS_SQL, stops

TICK, POSITION_TICK, HORIZON = 720, 180, 1440

FILLED_SQL = f"""WITH {STOPS_SQL},
k AS (SELECT *, actual_arr - sched_arr AS arr_delay, actual_dep - sched_dep AS dep_delay FROM stops),
p AS (SELECT *, coalesce(last_value(coalesce(arr_delay, dep_delay) IGNORE NULLS) OVER (PARTITION BY instance_id
  ORDER BY stop_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_delay FROM k),
q AS (SELECT *, coalesce(arr_delay, prev_delay) AS est_arr, coalesce(arr_delay, dep_delay, prev_delay) AS est FROM p),
a AS (SELECT *, coalesce(actual_arr, sched_arr + est_arr) AS a0 FROM q),
filled AS (SELECT *, coalesce(actual_dep, greatest(sched_dep + est, a0)) AS d0 FROM a)"""
TIMED_SQL = f"""{FILLED_SQL},
x AS (SELECT *, CASE WHEN stop_idx = 0 THEN d0 ELSE greatest(a0, d0) END AS latest FROM filled),
timed AS (SELECT *, CASE WHEN stop_idx = 0 THEN a0 ELSE greatest(a0, max(latest) OVER (PARTITION BY instance_id
  ORDER BY stop_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END AS arr,
             max(latest) OVER (PARTITION BY instance_id ORDER BY stop_idx ROWS UNBOUNDED PRECEDING) AS dep FROM x)"""


def positions_sql(tick: int) -> str:
    return f"""{TIMED_SQL},
n AS (SELECT *, lead(arr) OVER t AS next_arr, lead(sched_arr) OVER t AS next_sched_arr, lead(station_id) OVER t AS next_station
  FROM timed WINDOW t AS (PARTITION BY instance_id ORDER BY stop_idx)),
g AS (SELECT *, 'in_transit' AS mode, arr - 1 AS lo, arr AS hi FROM n WHERE stop_idx = 0
      UNION ALL SELECT *, 'at_station', arr, dep FROM n WHERE dep > arr
      UNION ALL SELECT *, 'in_transit', dep, next_arr FROM n WHERE next_arr > dep),
att AS (SELECT *, unnest(range((CAST(floor(lo / {tick}.0) AS BIGINT) + 1) * {tick}, CAST(floor(hi / {tick}.0) AS BIGINT) * {tick} + 1, {tick})) AS tick FROM g),
seen AS (SELECT *, CASE WHEN mode = 'at_station' THEN coalesce(arr_delay, est_arr) ELSE coalesce(dep_delay, arr_delay, est) END AS delay,
  CASE WHEN mode = 'at_station' THEN greatest(coalesce(arr_delay, 0), tick - sched_dep) ELSE coalesce(dep_delay, 0) END AS leaves_late FROM att)"""


def timed(spark, d):
    return seq.trips_in_time(stops(spark, d))


def seen(spark, d, tick=TICK):
    return seq.delay_now(seq.position_at(seq.look_ahead(timed(spark, d)), tick))


def seen_at(spark, d, *instants):
    return seq.delay_now(seq.position_at_instants(seq.look_ahead(timed(spark, d)), list(instants)))


def etas(spark, d):
    at = seen(spark, d)
    return seq.path_etas(at, stops(spark, d), HORIZON)


ETAS_SQL = f"""{positions_sql(TICK)},
h AS (SELECT s.instance_id, s.blk, s.tick, l.station_id, l.stop_idx AS k, s.leaves_late + greatest(0, l.sched_arr - s.sched_dep) AS eta
      FROM seen s JOIN stops l ON l.instance_id = s.instance_id AND l.stop_idx > s.stop_idx),
c AS (SELECT *, max(eta) OVER (PARTITION BY instance_id, blk, tick ORDER BY k ROWS UNBOUNDED PRECEDING) AS top FROM h),
u AS (SELECT instance_id, blk, tick, station_id, k, eta FROM c WHERE top <= {HORIZON}
      UNION ALL SELECT instance_id, blk, tick, station_id, stop_idx, 0 FROM seen WHERE mode = 'at_station'),
etas AS (SELECT instance_id, blk, tick, station_id, max_by(eta, k) AS eta FROM u GROUP BY ALL)"""


@query("stops_adapter", f"WITH {STOPS_SQL} SELECT * FROM stops")
def _(spark, d):
    return stops(spark, d)


@query("E1_carry_forward", f"{FILLED_SQL} SELECT instance_id, stop_idx, arr_delay, dep_delay, est_arr, est, a0, d0 FROM filled")
def _(spark, d):
    return seq.carry_forward(stops(spark, d)).select("instance_id", "stop_idx", "arr_delay", "dep_delay", "est_arr", "est", "a0", "d0")


@query("E2_clamp_monotone", f"{TIMED_SQL} SELECT instance_id, stop_idx, arr, dep FROM timed")
def _(spark, d):
    return timed(spark, d).select("instance_id", "stop_idx", "arr", "dep")


@query("E3_position_at", f"{positions_sql(POSITION_TICK)} SELECT instance_id, blk, tick, stop_idx, mode FROM att")
def _(spark, d):
    return seq.position_at(timed(spark, d), POSITION_TICK).select("instance_id", "blk", "tick", "stop_idx", "mode")


@query("E4_delay_now", f"{positions_sql(TICK)} SELECT instance_id, tick, stop_idx, mode, delay FROM seen")
def _(spark, d):
    return seen(spark, d).select("instance_id", "tick", "stop_idx", "mode", "delay")


@query("E5_causal_departure_delay", f"{positions_sql(TICK)} SELECT instance_id, tick, leaves_late AS delay FROM seen")
def _(spark, d):
    at = seq.position_at(timed(spark, d), TICK)
    return at.select("instance_id", "tick", seq.departure_delay().alias("delay"))


@query(
    "E6_eta_next",
    f"""{positions_sql(TICK)} SELECT instance_id, tick,
    CASE WHEN next_sched_arr IS NULL THEN 0 ELSE greatest(0, (CASE WHEN mode = 'at_station' THEN greatest(sched_dep + delay, tick) ELSE dep END) + greatest(0,
      next_sched_arr - sched_dep) - tick) END AS eta_next
    FROM seen WHERE next_sched_arr IS NOT NULL""",
)
def _(spark, d):
    return seq.eta_next(seen(spark, d)).where("next_sched_arr IS NOT NULL").select("instance_id", "tick", "eta_next")


@query("E7_path_etas", f"{ETAS_SQL} SELECT * FROM etas")
def _(spark, d):
    return etas(spark, d)


@query(
    "E8_junction_etas",
    f"""{ETAS_SQL}, j AS (SELECT instance_id, blk, tick, coalesce(list_sort(list(eta) FILTER (station_id IN {JUNCTIONS})), []) AS l FROM etas GROUP BY ALL)
    SELECT instance_id, blk, tick, coalesce(l[1], 90) AS nearest, coalesce(l[2], 90) AS second, len(l) AS n_junctions FROM j""",
)
def _(spark, d):
    return seq.junction_etas(etas(spark, d), JUNCTIONS)


@query(
    "E9_delay_velocity",
    f"{positions_sql(TICK)} SELECT instance_id, tick, coalesce(delay - lag(delay) OVER (PARTITION BY instance_id ORDER BY tick), 0) AS velocity FROM seen",
)
def _(spark, d):
    w = seq.along(order="tick")
    return seen(spark, d).select("instance_id", "tick", F.coalesce(F.col("delay") - F.lag("delay").over(w), F.lit(0).cast("long")).alias("velocity"))


@query(
    "E10_dwell_and_run",
    f"""{positions_sql(TICK)} SELECT instance_id, tick, CASE WHEN mode = 'at_station' THEN tick - arr ELSE 0 END AS at_stop,
    CASE WHEN mode = 'in_transit' AND tick > dep THEN tick - dep ELSE 0 END AS since_departure,
    CASE WHEN mode = 'in_transit' THEN greatest(0, tick - dep - (next_sched_arr - sched_dep)) END AS over_run FROM seen""",
)
def _(spark, d):
    moving, zero = F.col("mode") == "in_transit", F.lit(0).cast("long")
    return seen(spark, d).select(
        "instance_id", "tick",
        F.when(~moving, F.col("tick") - F.col("arr")).otherwise(zero).alias("at_stop"),
        F.when(moving & (F.col("tick") > F.col("dep")), F.col("tick") - F.col("dep")).otherwise(zero).alias("since_departure"),
        F.when(moving, F.greatest(zero, F.col("tick") - F.col("dep") - (F.col("next_sched_arr") - F.col("sched_dep")))).alias("over_run"),
    )


@query(
    "E11_slack_ahead",
    f"""WITH {STOPS_SQL} SELECT instance_id, stop_idx, coalesce(lead(sched_dep - sched_arr) OVER t, 0) AS next_slack,
    coalesce(sum(sched_dep - sched_arr) OVER (PARTITION BY instance_id ORDER BY stop_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::BIGINT AS slack_ahead
    FROM stops WINDOW t AS (PARTITION BY instance_id ORDER BY stop_idx)""",
)
def _(spark, d):
    return seq.look_ahead(stops(spark, d)).select("instance_id", "stop_idx", "next_slack", "slack_ahead")


# a target is a stop at station 2 or later; users that end in 0 only act
FRESH_SQL = f"""{positions_sql(POSITION_TICK)},
sg AS (SELECT *, CASE WHEN mode = 'at_station' THEN (tick - arr >= 5)::INT + (tick - arr >= 15)::INT + (tick - arr >= 30)::INT ELSE 0 END AS stage FROM seen),
fr AS (SELECT s.*, tick = min(tick) OVER (PARTITION BY instance_id, stop_idx, mode, stage) AS fresh FROM sg s),
ok AS (SELECT instance_id, stop_idx, arr_delay, coalesce(dep_delay, arr_delay) AS leave, station_id >= 2 AND user_id % 10 <> 0 AND arr_delay IS NOT NULL AS ok FROM filled)"""


def fresh_positions(spark, d):
    marked = seq.next_targets(timed(spark, d), 8, F.col("station_id") >= 2, F.col("user_id") % 10 != 0)
    return seq.with_fresh(seq.position_at(marked, POSITION_TICK))


@query(
    "E12_horizon_targets",
    f"""{FRESH_SQL}, far AS (SELECT f.instance_id, f.tick, t.k, fresh AND ok AS ok, o.arr_delay AS v FROM fr f CROSS JOIN range(1, 9) t(k)
      LEFT JOIN ok o ON o.instance_id = f.instance_id AND o.stop_idx = f.stop_idx + t.k)
    SELECT instance_id, tick, k, CASE WHEN ok THEN v ELSE 0 END AS target, coalesce(ok, false)::INT AS mask FROM far""",
)
def _(spark, d):
    wide = seq.horizon_targets(fresh_positions(spark, d), 8)
    long = wide.select("instance_id", "tick", F.posexplode(F.arrays_zip("targets", "mask")).alias("k0", "x"))
    return long.select("instance_id", "tick", (F.col("k0") + 1).cast("long").alias("k"), F.col("x.targets").alias("target"), F.col("x.mask").alias("mask"))


@query("E13_first_per_stage", f"{FRESH_SQL} SELECT instance_id, stop_idx, mode, stage, min(tick) AS tick FROM fr GROUP BY ALL")
def _(spark, d):
    return seq.first_per_stage(seen(spark, d, POSITION_TICK)).select("instance_id", "stop_idx", "mode", "stage", "tick")


@query(
    "E14_departure_targets",
    f"""{FRESH_SQL}, dt AS (SELECT f.instance_id, tick, coalesce(fresh AND ok, false) AS m, leave, fresh AND mode = 'at_station' AND dep - tick <= 190 AS stands, dep - tick AS rest
      FROM fr f LEFT JOIN ok o ON o.instance_id = f.instance_id AND o.stop_idx = f.stop_idx + 1)
    SELECT instance_id, tick, CASE WHEN m THEN leave ELSE 0 END AS next_departure_delay, m::INT AS next_departure_mask,
           CASE WHEN stands THEN rest ELSE 0 END AS remaining_dwell, stands::INT AS remaining_dwell_mask FROM dt""",
)
def _(spark, d):
    got = seq.departure_targets(fresh_positions(spark, d))
    return got.select("instance_id", "tick", "next_departure_delay", "next_departure_mask", "remaining_dwell", "remaining_dwell_mask")


@query(
    "E16_leg_plausibility",
    f"""{FILLED_SQL}, k2 AS (SELECT *, coalesce(arr_delay, dep_delay) AS v FROM filled WHERE coalesce(arr_delay, dep_delay) IS NOT NULL),
    j AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY instance_id ORDER BY stop_idx)) AS jump FROM k2)
    SELECT instance_id, count(*) FILTER (jump > 25) = 0 AS plausible, min(stop_idx) FILTER (jump > 25) AS first_jump, max(jump) AS worst_jump FROM j GROUP BY instance_id""",
)
def _(spark, d):
    return seq.leg_plausibility(seq.carry_forward(stops(spark, d)), 25)


@query(
    "E17_region_slice",
    f"""WITH {STOPS_SQL}, w AS (SELECT *, min(stop_idx) FILTER (station_id BETWEEN 5 AND 9) OVER p AS f, max(stop_idx) FILTER (station_id BETWEEN 5 AND 9) OVER p AS l FROM stops WINDOW p AS (PARTITION BY instance_id))
    SELECT instance_id, stop_idx, station_id, f AS n_before FROM w WHERE stop_idx BETWEEN f AND l""",
)
def _(spark, d):
    return seq.region_slice(stops(spark, d), F.col("station_id").between(5, 9)).select("instance_id", "stop_idx", "station_id", "n_before")


@query(
    "E18_anchor_time",
    f"""WITH {STOPS_SQL} SELECT instance_id, coalesce(arg_min(actual_arr, stop_idx) FILTER (actual_arr IS NOT NULL), arg_min(sched_arr, stop_idx), arg_min(sched_dep, stop_idx)) AS anchor FROM stops GROUP BY instance_id""",
)
def _(spark, d):
    return seq.anchor_time(stops(spark, d))


@query(
    "D5_prefix_features",
    f"""{FILLED_SQL}, w AS (SELECT instance_id, stop_idx, coalesce(max(7.0::DOUBLE * stop_idx + station_id % 5) OVER b, 0) AS km,
        coalesce(list(arr_delay) FILTER (arr_delay IS NOT NULL) OVER b, []) AS l
        FROM filled WINDOW b AS (PARTITION BY instance_id ORDER BY stop_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    z AS (SELECT *, list_transform(range(2, len(l) + 1), lambda i: l[i] - l[i - 1]) AS steps FROM w)
    SELECT instance_id, stop_idx, len(l) AS n_prior, coalesce(l[-1], 0) AS last_delay, coalesce(l[-1] - l[greatest(1, len(l) - 3)], 0) AS trend, coalesce(list_max(l), 0) AS max_delay,
    km, coalesce(round(list_stddev_pop(steps), 6), 0) AS step_sd, coalesce(-list_sum(list_filter(steps, lambda x: x < 0)), 0)::BIGINT AS recovered,
    coalesce(round(list_avg(steps[-5:]), 6), 0) AS mean_step5 FROM z""",
)
def _(spark, d):
    far = seq.carry_forward(stops(spark, d)).withColumn("km", 7.0 * F.col("stop_idx") + F.col("station_id") % 5)
    f = seq.prefix_features(far)
    return f.withColumn("step_sd", F.round("step_sd", 6)).withColumn("mean_step5", F.round("mean_step5", 6))


@query(
    "E27_collision_number",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE WHEN n > 1 THEN '#' || n::VARCHAR ELSE '' END AS suffix FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS n FROM lineitem)""",
)
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return seq.collision_number(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])


@query(
    "E28_assign_split",
    """WITH d AS (SELECT event_id, ts::DATE AS day FROM events), r AS (SELECT *, dense_rank() OVER (ORDER BY day DESC) AS back FROM d)
    SELECT event_id, day, CASE WHEN back <= nt THEN 'test' WHEN back <= nt + least(4, greatest(1, n - nt - 1)) THEN 'validation' ELSE 'train' END AS split
    FROM (SELECT *, max(back) OVER () AS n, least(5, greatest(1, max(back) OVER () - 2)) AS nt FROM r)""",
)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.to_date("ts").alias("day"))
    return seq.assign_split(e, "day", 5, 4).select("event_id", "day", "split")


HISTORY_ROWS = 5


@query(
    "E29_journey_history",
    f"""{positions_sql(TICK)},
    v AS (SELECT t.*, coalesce(arr_delay, est) AS dd, coalesce(arr_delay, est_arr) AS dp, first_value(est_arr) OVER o AS seed, lag(sched_dep) OVER o AS p_sd, lag(dep) OVER o AS p_dep
          FROM timed t WINDOW o AS (PARTITION BY instance_id ORDER BY stop_idx)),
    u AS (SELECT *, coalesce(lag(dd) OVER (PARTITION BY instance_id ORDER BY stop_idx), seed) AS prev FROM v),
    h AS (SELECT s.instance_id, s.tick, u.stop_idx AS k, s.mode = 'at_station' AND u.stop_idx = s.stop_idx AS pending, u.*  EXCLUDE (instance_id, stop_idx)
          FROM seen s JOIN u ON u.instance_id = s.instance_id AND u.stop_idx BETWEEN s.stop_idx - {HISTORY_ROWS - 1} AND s.stop_idx)
    SELECT instance_id, tick, k, CASE WHEN pending THEN dp ELSE dd END AS delay, CASE WHEN pending THEN dp ELSE dd END - prev AS step,
    CASE WHEN pending THEN greatest(dp, tick - sched_dep) - dp ELSE coalesce(dep_delay, dd) - dd END AS at_stop,
    greatest(0, CASE WHEN pending THEN tick ELSE dep END - arr) AS dwell,
    coalesce(greatest(0, arr - p_dep), 0) - coalesce(greatest(0, sched_arr - p_sd), 0) AS over_run, coalesce(greatest(0, sched_arr - p_sd), 0) AS booked_leg,
    (sched_dep > sched_arr)::BIGINT AS halt, (actual_arr IS NOT NULL)::BIGINT AS observed FROM h""",
)
def _(spark, d):
    told = seq.with_history(timed(spark, d), F.col("sched_dep") > F.col("sched_arr"), HISTORY_ROWS)
    h = seq.journey_history(seq.position_at(told, TICK))
    long = h.select("instance_id", "tick", "stop_idx", "n_history", F.posexplode("history").alias("i", "x"))
    return long.select("instance_id", "tick", (F.col("stop_idx") - F.col("n_history") + 1 + F.col("i")).alias("k"), *(F.col(f"x.{c}") for c in seq.HISTORY))


@query(
    "E37_implied_speed",
    f"""WITH {STOPS_SQL}, n AS (SELECT *, lead(actual_arr) OVER t - actual_dep AS minutes, abs(lead(station_id) OVER t - station_id) * 90.0::DOUBLE AS km FROM stops WINDOW t AS (PARTITION BY instance_id ORDER BY stop_idx)),
    v AS (SELECT *, CASE WHEN minutes > 0 AND km > 0 THEN km / (minutes / 60) END AS kmh FROM n),
    q AS (SELECT *, round(kmh, 3) AS speed FROM v), l AS (SELECT list_sort(list(speed) FILTER (speed IS NOT NULL)) AS l FROM q)
    SELECT count(*) FILTER (actual_dep < actual_arr) AS leaves_before_arrival, count(*) FILTER (minutes < 0) AS runs_backwards, count(*) FILTER (kmh > 160) AS too_fast, count(kmh) AS n_legs,
    (SELECT l[len(l) // 2 + 1] FROM l) AS p50, (SELECT l[floor(len(l) * 0.95::DOUBLE)::BIGINT + 1] FROM l) AS p95, round(max(kmh), 3) AS fastest FROM q""",
)
def _(spark, d):
    from waymark.operators.scoring import ranked_quantiles

    legs = seq.leg_checks(stops(spark, d).withColumn("km", F.col("station_id") * 90.0), "km").withColumn("speed", F.round("kmh", 3))
    counts = legs.agg(
        F.count_if("leaves_before_arrival").alias("leaves_before_arrival"), F.count_if("runs_backwards").alias("runs_backwards"), F.count_if("too_fast").alias("too_fast"),
        F.count("kmh").alias("n_legs"), F.max("speed").alias("fastest"),
    )
    speeds = ranked_quantiles(legs.where("speed IS NOT NULL").withColumn("_all", F.lit(1)), ["_all"], "speed", p50=0.5, p95=0.95)
    return counts.join(speeds.select("p50", "p95"), how="left")  # one row each


# the stored delay of every 97th event is a minute off
STORED_SQL = "stored AS (SELECT *, actual_arr - sched_arr + (event_id % 97 = 0)::INT AS stored_arr, actual_dep - sched_dep - (event_id % 89 = 0)::INT AS stored_dep FROM stops)"


@query(
    "E38_delay_arithmetic_check",
    f"""WITH {STOPS_SQL}, {STORED_SQL}
    SELECT 'arrival' AS field, count(stored_arr) AS n, count(*) FILTER (abs(stored_arr - (actual_arr - sched_arr)) > 1e-6) AS n_wrong FROM stored
    UNION ALL SELECT 'departure', count(stored_dep), count(*) FILTER (abs(stored_dep - (actual_dep - sched_dep)) > 1e-6) FROM stored""",
)
def _(spark, d):
    off = lambda n: (F.col("event_id") % n == 0).cast("int")
    kept = stops(spark, d).withColumn("stored_arr", F.col("actual_arr") - F.col("sched_arr") + off(97)).withColumn("stored_dep", F.col("actual_dep") - F.col("sched_dep") - off(89))
    return seq.delay_arithmetic(kept, {"arrival": ("stored_arr", "actual_arr", "sched_arr"), "departure": ("stored_dep", "actual_dep", "sched_dep")})
