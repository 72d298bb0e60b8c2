"""Queries that score forecasts, and those on the state of traffic at a tick."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.columns import severity, speed_multiplier
from waymark.operators import profiles, ranges, scoring, traffic
from waymark.operators import sequence as seq
from waymark.plans.book import query
from waymark.plans.trips import ETAS_SQL, FILLED_SQL, POSITION_TICK, TICK, etas, positions_sql, seen
from waymark.sources import fixtures as fx
from waymark.sources.fixtures import INTERVALS_SQL, JUNCTIONS, SECTIONS_SQL

SCORED_SQL = f"""{FILLED_SQL},
f0 AS (SELECT instance_id, stop_idx, station_id, blk, prev_delay AS pred, lag(prev_delay) OVER t AS persist, sched_arr - lag(sched_arr) OVER t AS lead_min, arr_delay AS actual
       FROM filled WINDOW t AS (PARTITION BY instance_id ORDER BY stop_idx)),
scored AS (SELECT *, CASE WHEN lead_min < 500 THEN 'short' WHEN lead_min < 1500 THEN 'medium' ELSE 'long' END AS b FROM f0 WHERE actual IS NOT NULL AND lead_min IS NOT NULL)"""


def scored(spark, d):
    """Each stop's delay as forecast from the stop before, with the truth."""
    f = seq.carry_forward(fx.stops(spark, d))
    lag = lambda c: F.lag(c).over(seq.along())
    f = f.select("instance_id", "stop_idx", "station_id", "blk", F.col("prev_delay").alias("pred"), lag("prev_delay").alias("persist"), (F.col("sched_arr") - lag("sched_arr")).alias("lead_min"), F.col("arr_delay").alias("actual"))
    return f.where("actual IS NOT NULL AND lead_min IS NOT NULL")


def lead():
    return F.when(F.col("lead_min") < 500, "short").when(F.col("lead_min") < 1500, "medium").otherwise("long")


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    "D11_error_by_bucket",
    f"""{SCORED_SQL}, er AS (SELECT *, abs(pred - actual) AS err FROM scored)
    SELECT coalesce(b, 'all') AS bucket, count(*) AS n, round(avg(err), 6) AS mae, round(avg(abs(persist - actual)), 6) AS persist_mae, round(avg(pred - actual), 6) AS bias,
    list_sort(list(err))[floor(count(*) * 0.5::DOUBLE)::BIGINT + 1] AS median, list_sort(list(err))[floor(count(*) * 0.9::DOUBLE)::BIGINT + 1] AS p90,
    round(avg(abs(persist - actual)) - avg(err), 6) AS gain FROM er GROUP BY ROLLUP (b)""",
)
def _(spark, d):
    return rounded(scoring.error_by_bucket(scored(spark, d), lead()), "mae", "persist_mae", "bias", "gain")


def _rule_sql(name, event, flag):
    return f"""SELECT '{name}' AS rule, count(*) FILTER ({event}) AS events, round(count(*) FILTER ({event} AND {flag}) / nullif(count(*) FILTER ({event}), 0), 6) AS recall,
    round(count(*) FILTER ({event} AND {flag}) / nullif(count(*) FILTER ({flag}), 0), 6) AS precision, round(avg(abs(pred - actual)) FILTER ({event}), 6) AS event_mae,
    round(count(*) FILTER ({event} AND pred < actual) / nullif(count(*) FILTER ({event}), 0), 6) AS under_share FROM scored"""


# a rollout's rises and falls count as seen from half their size on; the rules on a level and on a step take the full one
RULES = {"step": ("(actual - persist > 15)", "(pred - persist > 15)"), "level": ("(actual >= 30)", "(pred >= 30)")}
ROLLOUT_SQL = {"spike": ("(actual - persist > 20)", "(pred - persist > 10)"), "recovery": ("(persist - actual > 20)", "(persist - pred > 10)")}


@query("D12_event_detection", f"{SCORED_SQL} " + " UNION ALL ".join(_rule_sql(n, *r) for n, r in (RULES | ROLLOUT_SQL).items()))
def _(spark, d):
    rules = {n: (F.expr(e), F.expr(f)) for n, (e, f) in RULES.items()} | scoring.rollout_rules(20.0)
    return rounded(scoring.event_detection(scored(spark, d), rules), "recall", "precision", "event_mae", "under_share")


@query(
    "D13_journey_robust_stats",
    f"""{SCORED_SQL}, two AS (SELECT 'model' AS series, instance_id, stop_idx, abs(pred - actual) AS err FROM scored UNION ALL SELECT 'persistence', instance_id, stop_idx, abs(persist - actual) FROM scored),
    t AS (SELECT series, instance_id, floor(avg(err) * 100 + 0.5::DOUBLE)::BIGINT AS v, list(err ORDER BY stop_idx) AS e FROM two GROUP BY 1, 2),
    l AS (SELECT series, list_sort(list(v)) AS l, count(*) AS n, floor(count(*) * 0.05::DOUBLE)::BIGINT AS k,
      count(*) FILTER (len(e) >= 4 AND e[-1] > 40 AND e[-1] > e[len(e) // 2 + 1] + 20) AS runaways
      FROM t GROUP BY series)
    SELECT series, n AS trips, round(list_avg(l) / 100, 6) AS mean, l[floor(n * 0.5::DOUBLE)::BIGINT + 1] / 100 AS median, round(list_avg(l[k + 1:n - k]) / 100, 6) AS trimmed,
    l[floor(n * 0.75::DOUBLE)::BIGINT + 1] / 100 AS p75, l[floor(n * 0.9::DOUBLE)::BIGINT + 1] / 100 AS p90, runaways FROM l""",
)
def _(spark, d):
    return rounded(scoring.journey_robust_stats(scored(spark, d), "instance_id", "stop_idx"), "mean", "trimmed")


@query(
    "D14_calibration_table",
    f"""{SCORED_SQL} SELECT (actual >= 0)::INT + (actual >= 15)::INT + (actual >= 30)::INT AS bucket, count(*) AS n, round(avg(actual), 6) AS mean_actual, round(avg(pred), 6) AS mean_pred,
    round(100 * avg(pred) / nullif(avg(actual), 0), 6) AS captured_pct FROM scored GROUP BY 1""",
)
def _(spark, d):
    bucket = sum(((F.col("actual") >= x).cast("int") for x in (15, 30)), (F.col("actual") >= 0).cast("int"))
    return rounded(scoring.calibration_table(scored(spark, d), bucket), "mean_actual", "mean_pred", "captured_pct")


@query(
    "D15_threshold_detection",
    f"""{SCORED_SQL}, x AS (SELECT t::DOUBLE AS threshold, count(*) FILTER (actual >= t AND pred >= t) AS tp, count(*) FILTER (actual < t AND pred >= t) AS fp, count(*) FILTER (actual >= t AND pred < t) AS fn
    FROM scored CROSS JOIN (VALUES (5), (15), (30)) v(t) GROUP BY t) SELECT *, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp / nullif(tp + fp, 0), 6) AS precision FROM x""",
)
def _(spark, d):
    return rounded(scoring.threshold_detection(scored(spark, d), [5.0, 15.0, 30.0]), "recall", "precision")


@query(
    "D16_baseline_gain",
    f"""{SCORED_SQL}, two AS (SELECT *, b AS bucket FROM scored UNION ALL SELECT *, 'all' FROM scored),
    m AS (SELECT bucket, list_sort(list(actual))[floor(count(*) * 0.5::DOUBLE)::BIGINT + 1] AS c FROM two GROUP BY bucket)
    SELECT bucket, count(*) AS n, round(avg(abs(pred - actual)), 6) AS mae, round(avg(abs(actual)), 6) AS mae_zero, round(avg(abs(c - actual)), 6) AS mae_constant,
    round(avg(abs(persist - actual)), 6) AS mae_persist FROM two JOIN m USING (bucket) GROUP BY bucket""",
)
def _(spark, d):
    return rounded(scoring.baseline_gain(scored(spark, d), lead()), "mae", "mae_zero", "mae_constant", "mae_persist")


@query(
    "D17_duplication_profile",
    f"""{positions_sql(POSITION_TICK)}, gs AS (SELECT count(*) AS size, max(delay) - min(delay) AS spread FROM seen GROUP BY instance_id, stop_idx),
    h AS (SELECT *, CASE WHEN size = 1 THEN '1' WHEN size <= 3 THEN '2-3' WHEN size <= 7 THEN '4-7' WHEN size <= 15 THEN '8-15' ELSE '16+' END AS class FROM gs)
    SELECT class, count(*) AS groups, sum(size)::BIGINT AS rows, count(*) FILTER (size > 1 AND spread = 0) AS constant, round(sum(size) / (SELECT sum(size)
      FROM gs), 6) AS share FROM h GROUP BY class""",
)
def _(spark, d):
    return rounded(scoring.duplication_profile(seen(spark, d, POSITION_TICK), ["instance_id", "stop_idx"], "delay"), "share")


@query(
    "D17_group_sizes",
    f"""{positions_sql(POSITION_TICK)}, gs AS (SELECT count(*) AS size FROM seen GROUP BY instance_id, stop_idx), l AS (SELECT list_sort(list(size)) AS l FROM gs)
    SELECT len(l) AS groups, list_sum(l)::BIGINT AS rows, l[-1] AS largest, l[len(l) // 2 + 1] AS median, l[floor(len(l) * 0.9::DOUBLE)::BIGINT + 1] AS p90 FROM l""",
)
def _(spark, d):
    return scoring.group_sizes(seen(spark, d, POSITION_TICK), ["instance_id", "stop_idx"])


@query(
    "D18_position_in_stand",
    f"""{positions_sql(POSITION_TICK)}, kk AS (SELECT abs(tick - sched_arr) AS e, row_number() OVER (g ORDER BY tick) - 1 AS s, row_number() OVER (g ORDER BY tick DESC) - 1 AS t, count(*) OVER g AS n
      FROM seen WINDOW g AS (PARTITION BY instance_id, stop_idx, mode))
    SELECT 'start' AS side, least(9, s)::BIGINT AS k, count(*) AS n, round(avg(e), 6) AS mae FROM kk WHERE n >= 4 GROUP BY ALL
      UNION ALL SELECT 'end', least(9, t)::BIGINT, count(*), round(avg(e), 6) FROM kk WHERE n >= 4 GROUP BY ALL
    UNION ALL SELECT CASE WHEN s = 0 THEN 'first' ELSE 'later' END, NULL, count(*), round(avg(e), 6) FROM kk WHERE n >= 4 GROUP BY ALL
      UNION ALL SELECT 'all', NULL, count(*), round(avg(e), 6) FROM kk""",
)
def _(spark, d):
    at = seen(spark, d, POSITION_TICK)
    return rounded(scoring.position_in_stand(at, ["instance_id", "stop_idx", "mode"], "tick", F.abs(F.col("tick") - F.col("sched_arr"))), "mae")


# increments of delay of users that do not end in 0, between stops with an observed arrival
INCREMENTS_SQL = f"""{FILLED_SQL}, ob AS (SELECT *, arr_delay - lag(dep_delay) OVER (PARTITION BY instance_id ORDER BY stop_idx) AS run FROM filled WHERE actual_arr IS NOT NULL AND user_id % 10 <> 0),
inc AS (SELECT dep_delay - arr_delay AS gain, true AS hold, station_id FROM ob WHERE dep_delay > arr_delay UNION ALL SELECT run, false, station_id FROM ob WHERE run > 0)"""


def increments(spark, d):
    f = seq.carry_forward(fx.stops(spark, d))
    return profiles.delay_increments(f, "instance_id", "stop_idx", F.col("actual_arr").isNotNull(), F.col("user_id") % 10 != 0)


@query(
    "D27_delay_creation_split",
    f"""{INCREMENTS_SQL} SELECT hold, sum(gain)::BIGINT AS minutes, count(*) AS n, round(sum(gain) / (SELECT sum(gain) FROM inc), 6) AS share FROM inc GROUP BY hold""",
)
def _(spark, d):
    total = F.sum("minutes").over(seq.W.partitionBy(F.lit(1)))  # two rows
    split = increments(spark, d).groupBy("hold").agg(F.sum("gain").alias("minutes"), F.count("*").alias("n"))
    return split.withColumn("share", F.round(F.col("minutes") / total, 6))


def _lift_sql(of, where):
    return f"""SELECT '{of}' AS "of", t::DOUBLE AS threshold, count(*) FILTER (gain > t) AS n_large, round(avg((station_id IN {JUNCTIONS})::INT) FILTER (gain > t), 6) AS p_large,
    round(avg((station_id IN {JUNCTIONS})::INT) FILTER (gain <= t), 6) AS p_small,
      round(avg((station_id IN {JUNCTIONS})::INT) FILTER (gain > t) / nullif(avg((station_id IN {JUNCTIONS})::INT) FILTER (gain <= t), 0), 6) AS lift
    FROM inc CROSS JOIN (VALUES (2), (5), (10), (20)) v(t) WHERE {where} GROUP BY t HAVING count(*) FILTER (gain > t) > 0"""


@query("D26_lift_table", f"{INCREMENTS_SQL} {_lift_sql('all', 'true')} UNION ALL {_lift_sql('holds', 'hold')}")
def _(spark, d):
    got = scoring.lift_table(increments(spark, d), F.col("station_id").isin(*JUNCTIONS), F.col("gain"), F.col("hold"), [2.0, 5.0, 10.0, 20.0])
    return rounded(got, "p_large", "p_small", "lift")


def _auc_sql(c):
    return f"""SELECT '{c}' AS feature, greatest(a, 1 - a) AS auc, p AS positives, m AS negatives FROM (SELECT (rp - p * (p + 1) / 2) / (p * m) AS a, p, m FROM (
    SELECT sum(rk) FILTER (y) AS rp, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS m FROM (
    SELECT actual >= 30 AS y, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS rk FROM flagged WHERE {c} IS NOT NULL)))"""


@query("D35_auc_single", f"{SCORED_SQL}, flagged AS (SELECT *, 1 AS one FROM scored), au AS (" + " UNION ALL ".join(map(_auc_sql, ["pred", "persist", "lead_min", "station_id"])) + ") SELECT feature, round(auc, 6) AS auc, positives, negatives FROM au ORDER BY auc DESC, feature LIMIT 3")
def _(spark, d):
    return rounded(scoring.auc_single(scored(spark, d).withColumn("one", F.lit(1)), ["pred", "persist", "lead_min", "station_id", "one"], F.col("actual") >= 30, 3), "auc")


@query(
    "D36_precision_at_recall",
    f"""{SCORED_SQL}, t AS (SELECT DISTINCT pred AS threshold FROM scored), x AS (SELECT threshold, count(*) FILTER (actual >= 30) AS tp, count(*) AS told FROM t JOIN scored ON pred >= threshold GROUP BY threshold),
    rr AS (SELECT r::DOUBLE AS recall, max(threshold) AS threshold FROM x CROSS JOIN (VALUES (0.5), (0.7), (0.8), (0.9)) v(r) WHERE tp >= r::DOUBLE * (SELECT count(*)
      FROM scored WHERE actual >= 30) GROUP BY r)
    SELECT recall, threshold, round(tp / told, 6) AS precision FROM rr JOIN x USING (threshold)""",
)
def _(spark, d):
    return rounded(scoring.precision_at_recall(scored(spark, d), "pred", F.col("actual") >= 30, [0.5, 0.7, 0.8, 0.9]), "precision")


@query(
    "D37_weighted_huber",
    f"""{SCORED_SQL}, x AS (SELECT abs(pred - actual)::DOUBLE AS e, CASE WHEN actual - persist > 15 THEN 4 WHEN actual - persist < -15 THEN 3 ELSE 1 END AS w FROM scored)
    SELECT round(sum(w * CASE WHEN e <= 20 THEN e * e / 2 ELSE 20 * (e - 10) END) / sum(w), 6) AS loss FROM x""",
)
def _(spark, d):
    w = F.when(F.col("actual") - F.col("persist") > 15, 4.0).when(F.col("actual") - F.col("persist") < -15, 3.0).otherwise(1.0)
    return rounded(scoring.weighted_huber(scored(spark, d), w, 20.0), "loss")


CONFLICTS_SQL = f"""{ETAS_SQL}, u2 AS (SELECT *, split_part(instance_id, '_', 1)::BIGINT AS usr FROM etas),
    pairs AS (SELECT a.instance_id, a.blk, a.tick, a.station_id, a.eta AS x, y.eta AS y, a.usr % 3 = y.usr % 3 AS same, y.usr % 10 > a.usr % 10 AS higher,
      y.instance_id IS NOT NULL AS met, abs(a.eta - y.eta) AS gap
      FROM u2 a LEFT JOIN u2 y ON y.blk = a.blk AND y.tick = a.tick AND y.station_id = a.station_id AND y.instance_id <> a.instance_id),
    conf AS (SELECT instance_id, blk, tick, count(*) FILTER (met AND gap <= 120) AS n_overlaps, count(*) FILTER (met AND gap <= 120 AND same) AS same_group,
      count(*) FILTER (met AND gap <= 120 AND higher) AS higher_priority,
    count(*) FILTER (met AND y - x BETWEEN 0 AND 60) AS queue, least(90, coalesce(min(gap) FILTER (met AND station_id IN {JUNCTIONS}), 90)) AS junction_gap,
    least(75, coalesce(min(x - y) FILTER (met AND y < x), 75)) AS headway_ahead, least(75, coalesce(min(y - x) FILTER (met AND y >= x), 75)) AS headway_behind,
    least(75, coalesce(min(x) FILTER (met AND gap <= 120 AND higher), 75)) AS precedence_eta FROM pairs GROUP BY instance_id, blk, tick)"""


def conflicts(spark, d):
    user = F.split_part("instance_id", F.lit("_"), F.lit(1)).cast("long")
    return traffic.path_conflicts(etas(spark, d), user % 3, user % 10, 10, JUNCTIONS, window=120, queue=60)


@query("C11_path_conflicts", f"""{CONFLICTS_SQL} SELECT * EXCLUDE (n_overlaps), n_overlaps AS "overlaps" FROM conf""")
def _(spark, d):
    return conflicts(spark, d)


# a stop is a booked halt if it has a booked dwell
D7_SQL = f"""{ETAS_SQL}, en AS (SELECT *, CASE WHEN next_station IS NOT NULL THEN greatest(0, (CASE WHEN mode = 'at_station' THEN greatest(sched_dep + delay, tick) ELSE dep END) + greatest(0, next_sched_arr - sched_dep) - tick) END AS eta_next FROM seen),
    occ AS (SELECT blk, tick, station_id, count(*) FILTER (k = 1 AND mode = 'at_station' AND sched_dep > sched_arr) AS halting,
      count(*) FILTER (k = 1 AND mode = 'at_station' AND sched_dep <= sched_arr) AS passing,
      count(*) FILTER (k = 1 AND delay >= 8) AS delayed, greatest(0, max(delay) FILTER (k = 1)) AS max_delay, count(*) FILTER (k = 2 AND eta_next <= 25) AS approaching FROM (
      SELECT 1 AS k, blk, tick, mode, sched_arr, sched_dep, station_id, delay, eta_next FROM en
        UNION ALL SELECT 2, blk, tick, mode, sched_arr, sched_dep, next_station, delay, eta_next FROM en WHERE next_station IS NOT NULL) GROUP BY blk, tick, station_id),
    pr AS (SELECT blk, tick, station_id, sum(exp(-eta / 350)) AS pressure FROM etas WHERE station_id IN {JUNCTIONS} AND eta < 1000 GROUP BY blk, tick, station_id),
    ticks AS (SELECT DISTINCT blk, tick, ({fx.FIRST_DAY} + blk * {fx.BLOCK_DAYS}) * 1440.0::DOUBLE + tick AS at_min FROM occ), {INTERVALS_SQL},
    stands AS (SELECT event_id, key, start_min - 60 AS due_min, start_min, coalesce(end_min, start_min + 240) AS end_min, value FROM intervals),
    fr AS (SELECT blk, tick, key AS station_id, count(*) FILTER (at_min >= start_min) AS freight, count(*) FILTER (at_min < start_min) AS freight_due,
      max(value) FILTER (at_min >= start_min) AS worst
      FROM ticks JOIN stands ON at_min BETWEEN due_min AND end_min GROUP BY ALL)"""


def occupied(spark, d):
    return traffic.occupancy(seq.eta_next(seen(spark, d)), F.col("sched_dep") > F.col("sched_arr"))


def pressure(spark, d):
    return traffic.decay_pressure(etas(spark, d), JUNCTIONS, 350.0, 1000.0)


def stands(spark, d, at):
    """What occupies a place at each tick beside the trips: intervals in force, and those due within an hour; open ones last four hours."""
    i = fx.intervals(spark, d).select("key", "value", "start_min", (F.col("start_min") - 60).alias("due_min"), F.coalesce("end_min", F.col("start_min") + 240).alias("until_min"))
    ticks = at.select("blk", "tick").distinct().withColumn("at_min", (fx.FIRST_DAY + F.col("blk") * fx.BLOCK_DAYS) * 1440.0 + F.col("tick"))
    here = F.col("at_min") >= F.col("start_min")
    hit = ranges.range_join(ticks, i, [], "at_min", "due_min", "until_min", 120.0)
    return hit.groupBy("blk", "tick", F.col("key").alias("station_id")).agg(
        F.count_if(here).alias("freight"), F.count_if(~here).alias("freight_due"), F.max(F.when(here, F.col("value"))).alias("worst")
    )


@query("D7_occupancy", f"{D7_SQL} SELECT * FROM occ")
def _(spark, d):
    return occupied(spark, d)


@query(
    "D7_section_occupancy",
    f"""{positions_sql(TICK)} SELECT blk, tick, least(station_id, next_station) AS a, greatest(station_id, next_station) AS b, count(*) AS trips FROM seen
    WHERE mode = 'in_transit' AND next_station IS NOT NULL GROUP BY ALL""",
)
def _(spark, d):
    return traffic.section_occupancy(seen(spark, d))


@query("D8_decay_pressure", f"{D7_SQL} SELECT blk, tick, station_id, round(pressure, 6) AS pressure FROM pr")
def _(spark, d):
    return rounded(pressure(spark, d), "pressure")


D9_SQL = f"""{D7_SQL}, grid AS (SELECT blk, tick, s AS station_id, s % 4 AS platforms, 1 + s % 3 AS cap FROM (SELECT DISTINCT blk, tick FROM occ) CROSS JOIN range({fx.STATIONS}) r(s)),
    st0 AS (SELECT g.*, coalesce(halting, 0) AS halting, coalesce(passing, 0) AS passing, coalesce(freight, 0) AS freight, coalesce(halting, 0) + coalesce(passing,
      0) + coalesce(freight, 0) AS total,
      coalesce(delayed, 0) AS delayed, coalesce(max_delay, 0) AS max_delay, coalesce(approaching, 0) + coalesce(freight_due, 0) AS near, coalesce(pressure, 0) AS pressure
      FROM grid g LEFT JOIN occ USING (blk, tick, station_id) LEFT JOIN pr USING (blk, tick, station_id) LEFT JOIN fr USING (blk, tick, station_id)),
    st AS (SELECT blk, tick, station_id, CASE WHEN platforms > 0 THEN least(1, halting / platforms) ELSE 0 END AS platform_ratio, least(1, total / cap) AS capacity_ratio,
      greatest(0, (cap - total) / cap) AS available_ratio,
      freight, passing, least(1, pressure / 5) AS incoming, max_delay, least(1, delayed / cap) AS delayed_density, least(1, near / 5) AS approach_density, least(1,
        total / cap) > 0.85 OR max_delay > 30 AS critical
        FROM st0)"""
RATIOS = ["platform_ratio", "capacity_ratio", "available_ratio", "incoming", "delayed_density", "approach_density"]


def station_states(spark, d, occ, ticks=None):
    dim = spark.range(fx.STATIONS).selectExpr("id AS station_id", "id % 4 AS platforms", "1 + id % 3 AS capacity")
    return traffic.station_state_rows(occ, dim, pressure(spark, d), stands(spark, d, occ if ticks is None else ticks).drop("worst"), ticks)


@query("D9_station_state_rows", f"{D9_SQL} SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in RATIOS) + ") FROM st")
def _(spark, d):
    return rounded(station_states(spark, d, occupied(spark, d)), *RATIOS)


# memory goes on at the ticks of a block at which nothing runs; the rows of these are left out afterwards
BLOCK_MIN = fx.BLOCK_DAYS * 1440
E15_SQL = D9_SQL.replace(
    "ticks AS (SELECT DISTINCT blk, tick,", f"spine AS (SELECT blk, i * {TICK} AS tick FROM (SELECT DISTINCT blk FROM occ), range({BLOCK_MIN // TICK + 1}) r(i)), ticks AS (SELECT blk, tick,"
).replace("AS at_min FROM occ)", "AS at_min FROM spine)").replace("FROM (SELECT DISTINCT blk, tick FROM occ) CROSS JOIN", "FROM spine CROSS JOIN")


E15_SQL = f"""{E15_SQL}, nn AS (SELECT *, capacity_ratio * 0.5 + incoming * 0.5 AS load, row_number() OVER (PARTITION BY blk, station_id ORDER BY tick) - 1 AS n FROM st),
    lastc AS (SELECT a.*, (SELECT max(c.n) FROM nn c
      WHERE c.blk = a.blk AND c.station_id = a.station_id AND c.critical AND c.n < a.n) AS hit, lag(load) OVER (PARTITION BY blk, station_id ORDER BY tick) AS before FROM nn a),
    memory AS (SELECT blk, tick, station_id, coalesce(before, 0) AS congestion, coalesce(before, 0) * 0.7 + delayed_density * 0.3 AS mixed, least(20, coalesce(n - hit - 1, n)) AS since_critical
      FROM lastc WHERE (blk, tick) IN (SELECT (blk, tick) FROM occ))"""


def remembered(spark, d, occ):
    """State rows of the ticks at which trips run, with what the stations remember of all ticks before."""
    dense = station_states(spark, d, occ, traffic.tick_spine(occ, TICK, BLOCK_MIN)).withColumn("load", F.col("capacity_ratio") * 0.5 + F.col("incoming") * 0.5)
    kept = seq.station_memory(dense, ["blk", "station_id"], "tick", "load", "delayed_density", "critical")
    return kept.join(occ.select("blk", "tick").distinct(), ["blk", "tick"], "left_semi")


@query("E15_station_memory", f"{E15_SQL} SELECT blk, tick, station_id, round(congestion, 6) AS congestion, round(mixed, 6) AS mixed, since_critical FROM memory")
def _(spark, d):
    kept = rounded(remembered(spark, d, occupied(spark, d)), "congestion", "mixed")
    return kept.select("blk", "tick", "station_id", "congestion", "mixed", F.col("since_critical").cast("long").alias("since_critical"))


D10_SQL = f"""{D7_SQL}, {SECTIONS_SQL}, grid AS (SELECT blk, tick, a, b, 1 + a % 2 AS lines, CASE WHEN a % 7 <> 3 THEN km * 0.9 END AS run_min, CASE WHEN a % 5 = 0 THEN km * 4 END AS loss_min FROM (SELECT DISTINCT blk, tick FROM seen) CROSS JOIN sections),
    tr AS (SELECT g.blk, g.tick, a, count(s.instance_id) AS trips FROM grid g LEFT
      JOIN seen s ON s.blk = g.blk AND s.tick = g.tick AND s.mode = 'in_transit' AND a >= least(s.station_id, s.next_station) AND a < greatest(s.station_id, s.next_station)
      AND s.next_station IS NOT NULL GROUP BY g.blk, g.tick, a),
    sec AS (SELECT g.blk, g.tick, g.a, g.b, trips, least(1.5::DOUBLE, (trips + coalesce(freight, 0)) / lines) AS load, least(1.5::DOUBLE, coalesce(freight, 0) / lines) AS freight_load,
      CASE WHEN freight > 0 THEN least(1, 0.4 + 0.1 * freight)::DOUBLE ELSE 0 END AS severity, CASE WHEN freight > 0 AND worst > 0 THEN least(4,
        100 / worst)::DOUBLE ELSE 1 END AS multiplier,
      CASE WHEN run_min IS NOT NULL THEN least(1, run_min / 20) END AS run_norm, least(1, coalesce(loss_min, 0) / 60) AS loss_norm FROM grid g JOIN tr USING (blk, tick, a) LEFT
        JOIN fr ON fr.blk = g.blk AND fr.tick = g.tick AND fr.station_id = g.a)"""
SCALED = ["load", "freight_load", "severity", "multiplier", "run_norm", "loss_norm"]


def section_states(spark, d):
    at = seen(spark, d)
    at_sections = stands(spark, d, at).withColumnRenamed("station_id", "a")
    disrupted = at_sections.where("freight > 0").select("blk", "tick", "a", severity(F.col("freight")).alias("severity"), speed_multiplier(F.col("worst")).alias("multiplier"))
    sections = fx.sections(spark).withColumns({"lines": 1 + F.col("a") % 2, "run_min": F.when(F.col("a") % 7 != 3, F.col("km") * 0.9), "loss_min": F.when(F.col("a") % 5 == 0, F.col("km") * 4)})
    return traffic.section_state_rows(at, sections.drop("km"), at_sections.select("blk", "tick", "a", "freight"), disrupted)


@query("D10_section_state_rows", f"{D10_SQL} SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in SCALED) + ") FROM sec")
def _(spark, d):
    return rounded(section_states(spark, d), *SCALED)
