"""Queries on nested trips, causes, feature vectors, checks of a build, and learned rises."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from waymark.functions.columns import severity, speed_multiplier
from waymark.operators import contracts, learned
from waymark.operators import journeys as j
from waymark.operators import sequence as seq
from waymark.plans.book import query
from waymark.plans.checks import PAIRS
from waymark.plans.lines import EVENTS_SQL, junction_event_features
from waymark.plans.scores import CONFLICTS_SQL, D7_SQL, D10_SQL, E15_SQL, conflicts, occupied, remembered, rounded, section_states, stands
from waymark.plans.trips import ETAS_SQL, FILLED_SQL, TICK, etas, positions_sql, seen, timed
from waymark.sources.fixtures import JUNCTIONS, STOPS_SQL, stops, table


@query(
    "D4_nest_journeys",
    f"""{FILLED_SQL}, kn AS (SELECT *, coalesce(arr_delay, dep_delay) AS v FROM filled WHERE coalesce(arr_delay, dep_delay) IS NOT NULL),
    jp AS (SELECT instance_id, max(abs(v - pv)) AS jump FROM (SELECT *, lag(v) OVER (PARTITION BY instance_id ORDER BY stop_idx) AS pv FROM kn) GROUP BY 1)
    SELECT instance_id, count(*) AS n_stops, CASE WHEN arg_max(station_id, stop_idx) > arg_min(station_id, stop_idx) THEN 'DN' ELSE 'UP' END AS direction,
    string_agg(stop_idx || ':' || station_id || ':' || sched_arr || ':' || coalesce(arr_delay::VARCHAR, '-') || ':' || (actual_arr IS NOT NULL)::INT, ' ' ORDER BY stop_idx) AS stops
    FROM filled WHERE instance_id NOT IN (SELECT instance_id FROM jp WHERE jump > 40) GROUP BY instance_id HAVING count(*) >= 2""",
)
def _(spark, d):
    f = seq.carry_forward(stops(spark, d)).withColumn("has_actual", F.col("actual_arr").isNotNull()).withColumn("_v", F.coalesce("arr_delay", "dep_delay"))
    f = f.withColumn("_ok", F.abs(F.col("_v") - F.last("_v", ignorenulls=True).over(seq.before())) <= 40)
    way = F.when(F.max_by("station_id", "stop_idx") > F.min_by("station_id", "stop_idx"), "DN").otherwise("UP")
    nested = j.nest_journeys(f, "instance_id", {"direction": way}, F.bool_and(F.coalesce("_ok", F.lit(True))))
    text = lambda x: F.concat_ws(":", x["stop_idx"].cast("string"), x["station_id"].cast("string"), x["sched_arr"].cast("string"), F.coalesce(x["arr_delay"].cast("string"), F.lit("-")), x["has_actual"].cast("int").cast("string"))
    return nested.select("instance_id", F.size("stops").cast("long").alias("n_stops"), "direction", F.array_join(F.transform("stops", text), " ").alias("stops"))


GROUPS = ("ERR", "PURCH", "SIGN", "OTHER")
CAUSES_SQL = f"""WITH {STOPS_SQL}, dt AS (SELECT s.user_id, s.blk, upper(e.event_type || CASE WHEN e.event_id % 5 = 0 THEN ' error' ELSE '' END) AS txt, CASE WHEN e.event_id % 8 <> 0 THEN e.value END AS m FROM stops s JOIN events e USING (event_id) WHERE s.user_id % 4 <> 1),
dc AS (SELECT *, CASE WHEN contains(txt, 'ERR') THEN 'err' WHEN contains(txt, 'PURCH') THEN 'purch' WHEN contains(txt, 'SIGN') THEN 'sign' ELSE 'other' END AS cause FROM dt),
cp AS (SELECT user_id, blk, round(coalesce(sum(m) FILTER (cause = 'err'), 0), 4) AS err, round(coalesce(sum(m) FILTER (cause = 'purch'), 0), 4) AS purch,
  round(coalesce(sum(m) FILTER (cause = 'sign'), 0), 4) AS sign,
  round(coalesce(sum(m) FILTER (cause = 'other'), 0), 4) AS other, round(coalesce(sum(m), 0), 4) AS total FROM dc GROUP BY ALL)"""


def causes(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    of = stops(spark, d).where("user_id % 4 <> 1").select("event_id", "user_id", "blk").join(e, "event_id")
    text = F.concat("event_type", F.when(F.col("event_id") % 5 == 0, " error").otherwise(""))
    pivot = j.cause_pivot(of, ["user_id", "blk"], text, F.when(F.col("event_id") % 8 != 0, F.col("value")), GROUPS)
    return pivot.withColumns({c: F.round(c, 4) for c in ("err", "purch", "sign", "other", "total")})


@query("D6_cause_pivot", f"{CAUSES_SQL} SELECT * FROM cp")
def _(spark, d):
    return causes(spark, d)


@query(
    "C22_attach_causes",
    f"""{CAUSES_SQL}, tr AS (SELECT instance_id, user_id, blk, count(*) AS n FROM stops GROUP BY ALL)
    SELECT t.*, coalesce(err, 0) AS err, coalesce(purch, 0) AS purch, coalesce(sign, 0) AS sign, coalesce(other, 0) AS other, coalesce(total, 0) AS total FROM tr t LEFT
      JOIN cp USING (user_id, blk)""",
)
def _(spark, d):
    trips = stops(spark, d).groupBy("instance_id", "user_id", "blk").agg(F.count("*").alias("n"))
    return j.attach_causes(trips, causes(spark, d), ["user_id", "blk"])


def entry_features(trips):
    """Per trip that comes into the region (stations 5 to 9): its first stop there, delay and trend observed before, and whether anything was."""
    far = seq.carry_forward(trips).withColumn("km", F.lit(0.0))
    first = seq.region_slice(trips, F.col("station_id").between(5, 9)).groupBy("instance_id").agg(F.min("stop_idx").alias("stop_idx"))
    f = seq.prefix_features(far).join(first, ["instance_id", "stop_idx"])
    return f.select("instance_id", F.col("stop_idx").alias("entry_stop"), F.col("last_delay").alias("entry_delay"), F.col("trend").alias("entry_trend"), (F.col("n_prior") > 0).cast("int").alias("has_upstream"))


def beside(spark, d, at):
    """``at`` with what stands beside each of its rows: in its section, at its station, and due at its next one."""
    here = stands(spark, d, at)
    leg = F.when(F.col("next_station") != F.col("station_id"), F.least("station_id", "next_station"))
    on = here.where("freight > 0").select("blk", "tick", F.col("station_id").alias("leg"), F.col("freight").alias("freight_in_section"), severity(F.col("freight")).alias("section_disrupted"), speed_multiplier(F.col("worst")).alias("section_multiplier"))
    there = here.select("blk", "tick", F.col("station_id").alias("next_station"), F.col("freight_due").alias("freight_due_next"))
    own = here.select("blk", "tick", "station_id", F.col("freight").alias("freight_at_station"))
    d2 = at.withColumn("leg", leg).join(on, ["blk", "tick", "leg"], "left").join(own, ["blk", "tick", "station_id"], "left")
    return d2.join(there, ["blk", "tick", "next_station"], "left").drop("leg")


BESIDE = ("freight_in_section", "section_disrupted", "section_multiplier", "freight_at_station", "freight_due_next")


def nodes(spark, d):
    """A row per trip and tick with the columns from which its vector is made."""
    w = seq.along(order="tick")
    at = seq.eta_next(seen(spark, d))
    moving, zero = F.col("mode") == "in_transit", F.lit(0).cast("long")
    since = F.greatest(zero, F.col("tick") - F.col("dep"))
    under_way = moving & F.col("next_sched_arr").isNotNull()
    turn = F.col("tick") % 1440 * (2 * math.pi / 1440)
    key = ["instance_id", "blk", "tick"]
    sizes = stops(spark, d).groupBy("instance_id").agg(F.count("*").alias("n_stops"))
    # a trip may be twice at one tick, so what stands beside it is told row by row, not by trip and tick
    at = beside(spark, d, at).join(sizes, "instance_id").select(
        *key, *BESIDE, "stop_idx", "delay", F.coalesce(F.col("delay") - F.lag("delay").over(w), zero).alias("delay_velocity"), F.coalesce("eta_next", zero).alias("eta_next"),
        (F.col("user_id") % 10 / 10).alias("priority"), moving.cast("int").alias("in_transit"), F.when(moving, zero).otherwise(F.col("tick") - F.col("arr")).alias("at_stop"),
        F.when(moving, since).otherwise(zero).alias("since_departure"),
        F.coalesce(F.when(moving, F.greatest(zero, since - F.greatest(zero, F.col("next_sched_arr") - F.col("sched_dep")))), zero).alias("over_run"),
        F.col("next_slack").alias("next_allowance"), "slack_ahead",
        (F.col("n_stops") - 1 - F.col("stop_idx")).alias("stops_left"), F.round(F.col("stop_idx") / F.greatest(F.col("n_stops") - 1, F.lit(1)), 4).alias("progress"),
        (F.col("sched_dep") > F.col("sched_arr")).cast("int").alias("at_halt"), F.when(under_way, F.col("tick") - F.col("next_sched_arr")).otherwise(zero).alias("least_next_delay"),
        F.sin(turn).alias("day_sin"), F.cos(turn).alias("day_cos"),
        F.when(moving, F.coalesce("dep_delay", "arr_delay")).otherwise(F.col("arr_delay")).isNotNull().cast("int").alias("delay_observed"),
        (F.col("next_slack") > 0).cast("int").alias("next_halt"), F.greatest(zero, F.col("next_slack")).alias("next_dwell"),
    )
    near = seq.junction_etas(etas(spark, d), JUNCTIONS).select(*key, F.col("nearest").alias("eta_nearest"), F.col("second").alias("eta_second"), F.col("n_junctions").alias("junctions_ahead"))
    met = conflicts(spark, d).drop("headway_ahead", "headway_behind")
    events = junction_event_features(spark, d).select(*key, *(f"f{i}" for i in range(8)))
    joined = at.join(near, key, "left").join(met, key, "left").join(events, key, "left")
    # before a trip has entered the region, nobody knows with what delay it will
    entry = entry_features(stops(spark, d))
    late = {c: F.when(F.col("stop_idx") >= F.col("entry_stop"), F.col(c)) for c in ("entry_delay", "entry_trend", "has_upstream")}
    return joined.join(entry, "instance_id", "left").withColumns(late)


def _eta(c):
    return f"ln(1 + greatest(0, least(coalesce({c}, 90), 90))) / ln(91)"


def _share(c, scale, cap):
    return f"least(coalesce({c}, 0) / {scale}.0, {cap})"


VECTOR_SQL = {
    0: "sign(delay) * ln(1 + abs(delay)) / ln(241)", 1: "tanh(velocity / 5.0)", 2: _eta("eta_next"), 3: _eta("l1"), 4: _eta("l2"), 5: _share("nj", 4, 1), 6: "coalesce(priority, 0.5)", 7: "0", 8: _share("n_stops - 1 - stop_idx", 19, 1), 9: "round(stop_idx / greatest(n_stops - 1, 1), 4)",
    10: "moving", 11: "(sched_dep > sched_arr)::INT", 12: _share("at_stop", 30, 1.5), 13: _share("since", 60, 1.5), 14: _share("over_run", 30, 1.5), 15: "tanh(least_next / 30.0)", 16: "0", 17: _share("n_overlaps", 6, 1.5), 18: _share("same_group", 6, 1.5),
    19: _share("higher_priority", 6, 1.5), 20: _share("queue", 6, 1.5), 21: "1 - least(coalesce(junction_gap, 90) / 90, 1)", 22: _share("leg_freight", 2, 1.5), 23: _share("own_freight", 3, 1.5), 24: _share("due_next", 3, 1.5), 25: "CASE WHEN leg_freight > 0 THEN least(1, 0.4 + 0.1 * leg_freight) ELSE 0 END", 26: "CASE WHEN leg_freight > 0 AND leg_worst > 0 THEN least(least(4, 100 / leg_worst) - 1, 2) ELSE 0 END", 27: "sign(coalesce(entry_delay, 0)) * ln(1 + abs(coalesce(entry_delay, 0))) / ln(241)", 28: "tanh(coalesce(entry_trend, 0) / 15.0)", 29: "coalesce(n_prior > 0, false)::INT", 30: f"sin(tick % 1440 * {2 * math.pi / 1440!r})", 31: f"cos(tick % 1440 * {2 * math.pi / 1440!r})", 32: "(CASE WHEN moving = 1 THEN coalesce(dep_delay, arr_delay) ELSE arr_delay END IS NOT NULL)::INT",
    33: "1 - least(coalesce(precedence_eta, 75) / 75, 1)", 34: "(next_slack > 0)::INT", 35: _share("greatest(0, next_slack)", 10, 1.5), 36: _share("next_slack", 10, 1.5), 37: _share("slack_ahead", 30, 1.5),
}
# the positions at ticks with all that stands beside them; the parts that both start from are stated once
NODES_SQL = f"""{D7_SQL}{CONFLICTS_SQL.removeprefix(ETAS_SQL)}{EVENTS_SQL.removeprefix(ETAS_SQL)},
fx AS (SELECT blk AS fb, tick AS ft, station_id AS fs, freight, freight_due, worst FROM fr),
sz AS (SELECT instance_id, count(*) AS n_stops FROM stops GROUP BY 1),
en5 AS (SELECT instance_id, min(stop_idx) AS k FROM stops WHERE station_id BETWEEN 5 AND 9 GROUP BY 1),
en6 AS (SELECT instance_id, k, list(arr_delay ORDER BY stop_idx) FILTER (stop_idx < k AND arr_delay IS NOT NULL) AS l FROM filled JOIN en5 USING (instance_id) GROUP BY instance_id, k),
ent AS (SELECT instance_id, k AS entry_stop, coalesce(len(l), 0) AS n_prior, coalesce(l[-1], 0) AS entry_delay, coalesce(l[-1] - l[greatest(1, len(l) - 3)], 0) AS entry_trend FROM en6),
la AS (SELECT instance_id AS i, stop_idx AS s, coalesce(lead(sched_dep - sched_arr) OVER t, 0) AS next_slack,
  coalesce(sum(sched_dep - sched_arr) OVER (PARTITION BY instance_id ORDER BY stop_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS slack_ahead
    FROM stops WINDOW t AS (PARTITION BY instance_id ORDER BY stop_idx)),
jl AS (SELECT instance_id, blk, tick, list_sort(coalesce(list(eta) FILTER (station_id IN {JUNCTIONS}), [])) AS l FROM etas GROUP BY ALL),
ve AS (SELECT s.*, next_slack, slack_ahead, coalesce(delay - lag(delay) OVER (PARTITION BY instance_id
  ORDER BY tick), 0) AS velocity, user_id % 10 / 10 AS priority, (mode = 'in_transit')::INT AS moving,
  CASE WHEN mode = 'at_station' THEN tick - arr ELSE 0 END AS at_stop, CASE WHEN mode = 'in_transit' THEN greatest(0, tick - dep) ELSE 0 END AS since,
  CASE WHEN next_sched_arr IS NULL THEN 0 ELSE greatest(0, (CASE WHEN mode = 'at_station' THEN greatest(sched_dep + delay, tick) ELSE dep END) + greatest(0,
    next_sched_arr - sched_dep) - tick) END AS eta_next
  , CASE WHEN mode = 'in_transit' AND next_sched_arr IS NOT NULL THEN tick - next_sched_arr ELSE 0 END AS least_next,
  lf.freight AS leg_freight, lf.worst AS leg_worst, ow.freight AS own_freight, nf.freight_due AS due_next, n_stops, entry_delay, entry_trend, n_prior
  FROM seen s JOIN la ON i = instance_id AND s.stop_idx = la.s JOIN sz USING (instance_id) LEFT JOIN ent ON ent.instance_id = s.instance_id AND s.stop_idx >= entry_stop
  LEFT JOIN fx lf ON lf.fb = s.blk AND lf.ft = s.tick AND s.next_station <> s.station_id AND lf.fs = least(s.station_id, s.next_station)
  LEFT JOIN fx ow ON ow.fb = s.blk AND ow.ft = s.tick AND ow.fs = s.station_id LEFT JOIN fx nf ON nf.fb = s.blk AND nf.ft = s.tick AND nf.fs = s.next_station),
vn AS (SELECT v.*, CASE WHEN moving = 1 AND next_sched_arr IS NOT NULL THEN greatest(0, since - greatest(0, next_sched_arr - sched_dep)) ELSE 0 END AS over_run,
  coalesce(l[1], 90) AS l1, coalesce(l[2], 90) AS l2, coalesce(len(l), 0) AS nj,
  n_overlaps, same_group, higher_priority, queue, junction_gap, precedence_eta FROM ve v LEFT JOIN jl USING (instance_id, blk, tick) LEFT JOIN conf USING (instance_id, blk, tick)),
vl AS (SELECT instance_id, blk, tick, [{", ".join(f"({VECTOR_SQL[i]})::DOUBLE" for i in range(38))}] AS v FROM vn)"""


@query(
    "E32_assemble_vectors",
    f"""{NODES_SQL} SELECT instance_id, tick, unnest(range(46)) AS dim, round(unnest(v || [f0, f1, f2, f3, f4, f5, f6, f7]::DOUBLE[]), 6) AS value FROM vl JOIN ef USING (instance_id, blk, tick)""",
)
def _(spark, d):
    v = j.assemble_vectors(nodes(spark, d))
    return v.select("instance_id", "tick", F.posexplode("vector").alias("dim", "value")).select("instance_id", "tick", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query(
    "B22_select_feature_set",
    f"""{positions_sql(TICK)} SELECT unnest(['full', 'no_slack']) AS version, unnest([46, 44]) AS width, count(*) AS n, 0 AS wrong_width FROM seen GROUP BY 1, 2""",
)
def _(spark, d):
    at = seen(spark, d).select("instance_id", "tick", "delay")
    one = lambda v: j.check_width(j.assemble_vectors(at, v), "vector", v).select(F.lit(v).alias("version"), F.lit(len(j.select_feature_set(v))).alias("width"), "n", "wrong_width")
    return one("full").unionByName(one("no_slack"))


@query(
    "E32_station_vectors",
    f"""{E15_SQL}, sv AS (SELECT blk, tick, station_id, [platform_ratio, capacity_ratio, available_ratio, least(freight / (1 + station_id % 3), 1.5), incoming, least(max_delay / 120, 2), delayed_density, approach_density,
      congestion, mixed, least(since_critical / 20, 1), critical::INT,
      sin(tick % 1440 * {2 * math.pi / 1440!r}), cos(tick % 1440 * {2 * math.pi / 1440!r}), (station_id IN {JUNCTIONS})::INT, least(station_id % 4 / 7, 1),
        least((1 + station_id % 3) / 11, 1), 0, 0, 0]::DOUBLE[] AS v
        FROM st JOIN memory USING (blk, tick, station_id))
    SELECT blk, tick, station_id, unnest(range(20)) AS dim, round(unnest(v), 6) AS value FROM sv""",
)
def _(spark, d):
    turn = F.col("tick") % 1440 * (2 * math.pi / 1440)
    st = remembered(spark, d, occupied(spark, d)).withColumns({
        "capacity": 1 + F.col("station_id") % 3, "platforms": F.col("station_id") % 4, "freight_ratio": F.col("freight") / (1 + F.col("station_id") % 3),
        "is_junction": F.col("station_id").isin(*JUNCTIONS), "day_sin": F.sin(turn), "day_cos": F.cos(turn),
    })
    v = j.place_vectors(st, j.STATION_VECTOR)
    return v.select("blk", "tick", "station_id", F.posexplode("vector").alias("dim", "value")).select("blk", "tick", "station_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query(
    "E32_section_vectors",
    f"""{D10_SQL}, xv AS (SELECT blk, tick, a, [coalesce(run_norm, 0.3), load, freight_load, multiplier - 1, severity, loss_norm, (a IN {JUNCTIONS})::INT, (b IN {JUNCTIONS})::INT, 0, 1]::DOUBLE[] AS v FROM sec)
    SELECT blk, tick, a, unnest(range(10)) AS dim, round(unnest(v), 6) AS value FROM xv""",
)
def _(spark, d):
    sec = section_states(spark, d).withColumns({"a_junction": F.col("a").isin(*JUNCTIONS), "b_junction": F.col("b").isin(*JUNCTIONS)})
    v = j.place_vectors(sec, j.SECTION_VECTOR)
    return v.select("blk", "tick", "a", F.posexplode("vector").alias("dim", "value")).select("blk", "tick", "a", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


# trips of every seventh user are there twice at one tick; the manifest leaves out the first block
@query(
    "D40_integrity_check",
    f"""{positions_sql(TICK)}, bd AS (SELECT blk, tick, instance_id FROM seen UNION ALL SELECT blk, tick, instance_id FROM seen WHERE user_id % 7 = 0 AND tick = 1440),
    mf AS (SELECT min(blk) + 1 AS lo, max(blk) AS hi, count(DISTINCT blk) - 1 AS n FROM seen), rp AS (SELECT coalesce(sum(c - 1), 0)::BIGINT AS r FROM (SELECT count(*) AS c
      FROM bd GROUP BY blk, tick, instance_id)),
    dd AS (SELECT count(*) AS days, count(*) FILTER (blk < lo OR blk > hi) AS off FROM (SELECT DISTINCT blk FROM bd), mf)
    SELECT 'repeated_trips' AS "check", r AS value, r > 0 AS failed FROM rp UNION ALL SELECT 'days', days, false FROM dd UNION ALL SELECT 'days_told', n, n <> days
      FROM dd, mf UNION ALL SELECT 'days_outside', off, off > 0 FROM dd""",
)
def _(spark, d):
    at = seen(spark, d).select("blk", "tick", "instance_id", "user_id")
    manifest = at.agg((F.min("blk") + 1).alias("first_day"), F.max("blk").alias("last_day"), (F.countDistinct("blk") - 1).alias("n_days"))
    return j.integrity_check(at.unionByName(at.where("user_id % 7 = 0 AND tick = 1440")), "blk", "tick", "instance_id", manifest)


RAW_T0 = 2880


def reached(df):
    """Adds where each trip is at ``RAW_T0``, as ``_i`` and ``_mode``."""
    at = seq.position_at_instants(seq.trips_in_time(df), [RAW_T0]).select("instance_id", F.col("stop_idx").alias("_i"), F.col("mode").alias("_mode"))
    return df.join(at, "instance_id", "left")


def moved(d, by):
    """Rows of ``reached`` with every time that a trip has not reached at ``RAW_T0`` later by ``by``."""
    later, pending = F.col("stop_idx") > F.col("_i"), (F.col("stop_idx") == F.col("_i")) & (F.col("_mode") == "at_station")
    move = lambda c, when: F.when(when, F.col(c) + by).otherwise(F.col(c)).alias(c)
    rest = [c for c in d.columns if c not in ("actual_arr", "actual_dep", "_i", "_mode")]
    return d.select(*rest, move("actual_arr", later), move("actual_dep", later | pending))


def raw_shifted(df, by):
    """Every time that a trip has not reached at ``RAW_T0`` is later by ``by``; where it is, is told from the unshifted records."""
    return moved(reached(df), by)


def raw_features(df):
    t = seq.look_ahead(seq.trips_in_time(df)).withColumn("target", F.lead("arr_delay").over(seq.along()))
    told = seq.with_history(t, F.col("sched_dep") > F.col("sched_arr"), 5)
    at = seq.journey_history(seq.eta_next(seq.delay_now(seq.position_at_instants(told, [RAW_T0]), hold=True)))
    past = F.aggregate("history", F.lit(0).cast("long"), lambda s, x: s * 31 + x["delay"] + 7 * x["at_stop"] + 11 * x["dwell"])
    return at.select("instance_id", "delay", "eta_next", F.col("stop_idx").alias("place"), past.alias("past"), seq.departure_delay().alias("leaves"), "target")


@query(
    "Q2_raw_perturbation_audit",
    f"""{positions_sql(RAW_T0)}, an AS (SELECT s.*, (SELECT n.arr_delay FROM timed n WHERE n.instance_id = s.instance_id AND n.stop_idx = s.stop_idx + 1) AS target FROM seen s WHERE tick = {RAW_T0}),
    pp(x, y) AS (VALUES {", ".join(map(str, PAIRS))}), fe(c) AS (VALUES ('delay'), ('eta_next'), ('place'), ('past'), ('leaves'))
    SELECT x AS shift_a, y AS shift_b, c AS "column", (SELECT count(*) FROM an) AS n, 0 AS differing, 0.0::DOUBLE AS most FROM pp, fe
    UNION ALL SELECT x, y, 'target', (SELECT count(*) FROM an), (SELECT count(target) FROM an), (y - x)::DOUBLE FROM pp""",
)
def _(spark, d):
    return contracts.perturbation_audit(raw_features, stops(spark, d), raw_shifted, list(PAIRS), ["instance_id"], ["delay", "eta_next", "place", "past", "leaves", "target"])


@query(
    "Q6_grouped_split",
    f"""WITH {STOPS_SQL}, gs AS (SELECT instance_id, ('0x' || md5('0:' || instance_id)[:8])::BIGINT % 1000 < 400 AS held_out FROM stops) SELECT held_out, count(*) AS n, count(DISTINCT instance_id) AS groups FROM gs GROUP BY held_out""",
)
def _(spark, d):
    split = learned.grouped_split(stops(spark, d), "instance_id", 0.4)
    return split.groupBy("held_out").agg(F.count("*").alias("n"), F.countDistinct("instance_id").alias("groups"))


FEATURES = ["delay", "eta_next", "next_slack", "slack_ahead", "at_stop", "stop_idx"]


def rise_rows(spark, d):
    """Positions with three known targets: features, and the largest rise among the next stops."""
    marked = seq.next_targets(seq.look_ahead(timed(spark, d)), 8, F.col("station_id") >= 2, F.col("user_id") % 10 != 0)
    at = seq.eta_next(seq.delay_now(seq.position_at(marked, TICK)))
    known = F.filter("_next", lambda x: x["ok"])
    at = at.withColumn("_known", known).where(F.size("_known") >= 3)
    rise = F.array_max(F.transform("_known", lambda x: x["arr_delay"])) - F.col("delay")
    stood = F.when(F.col("mode") == "at_station", F.col("tick") - F.col("arr")).otherwise(0)
    return at.select("instance_id", "delay", F.coalesce("eta_next", F.lit(0).cast("long")).alias("eta_next"), "next_slack", "slack_ahead", stood.alias("at_stop"), "stop_idx", rise.alias("rise"))


@query("Q7_rise_classifier")
def _(spark, d):
    return learned.rise_classifier(learned.grouped_split(rise_rows(spark, d), "instance_id", 0.4), FEATURES, "rise", 30.0, rounds=10)


@query("Q7_rise_regressor")
def _(spark, d):
    return learned.rise_regressor(learned.grouped_split(rise_rows(spark, d), "instance_id", 0.4), FEATURES, "rise", 30.0, rounds=10)


