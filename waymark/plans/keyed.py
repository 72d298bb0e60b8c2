"""Queries of keyed joins, interval joins and interval repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import joins, ranges
from waymark.operators import sequence as seq
from waymark.plans.book import query
from waymark.plans.trips import FILLED_SQL, TIMED_SQL, timed
from waymark.sources import fixtures as fx
from waymark.sources.fixtures import INTERVALS_SQL, REVEAL_SQL, SECTIONS_SQL, STOPS_SQL, table

NOW = 28423440 + 10 * 1440.0  # minutes since 1970: ten days into the events
POINTS_SQL = "points AS (SELECT event_id AS pid, event_id % 22 AS key, epoch_us(ts) / 60000000.0::DOUBLE AS at_min FROM events)"


def points(spark, d):
    return table(spark, d, "events").selectExpr("event_id AS pid", "event_id % 22 AS key", f"{fx.micros('ts')} / 60000000D AS at_min")


def spans(spark, d):
    i = fx.intervals(spark, d)
    return i.select("key", F.col("start_min").alias("s"), F.coalesce("end_min", F.col("start_min") + 30).alias("e"), F.col("value").alias("v"))


SPANS_SQL = f"{INTERVALS_SQL}, spans AS (SELECT key, start_min AS s, coalesce(end_min, start_min + 30) AS e, value AS v FROM intervals)"


@query("C1_join_schedule_observation", "SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    j = joins.join_schedule_observation(o, table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey"])
    return j.withColumnRenamed("l_orderkey", "o_orderkey")


@query("C2_observations_as_of", f"WITH {REVEAL_SQL} SELECT user_id, max(value) AS value FROM reveal_log WHERE reveal_min <= {NOW} GROUP BY user_id")
def _(spark, d):
    return joins.observations_as_of(fx.reveal_log(spark, d), ["user_id"], "reveal_min", "value", F.lit(NOW))


@query(
    "C2_observations_as_of_many",
    f"""WITH {REVEAL_SQL}, t AS (SELECT {NOW} + i * 720.0::DOUBLE AS now FROM range(10) r(i))
    SELECT user_id, now, max(value) AS value FROM reveal_log JOIN t ON reveal_min <= now GROUP BY ALL""",
)
def _(spark, d):
    log = fx.reveal_log(spark, d)
    ticks = spark.range(10).select((F.lit(NOW) + F.col("id") * 720.0).alias("now"))
    instants = log.select("user_id").distinct().crossJoin(ticks)
    return joins.observations_as_of_many(log, instants, ["user_id"], "reveal_min", "value", "now")


@query(
    "C3_latest_per_key",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC, l_suppkey DESC) AS n FROM lineitem) WHERE n = 1""",
)
def _(spark, d):
    order = [F.desc_nulls_last("l_shipdate"), F.desc("l_partkey"), F.desc("l_suppkey")]
    return joins.latest_per_key(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


@query("C4_lookup_default", "SELECT c_custkey, coalesce(s_name, 'none') AS s_name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def _(spark, d):
    dim = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "c_custkey")
    return joins.lookup_default(table(spark, d, "customer"), dim, "c_custkey", "s_name", "none").select("c_custkey", "s_name")


@query(
    "C5_restrict_to_keys",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 49)""",
)
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return joins.restrict_to_keys(li, li.where("l_quantity >= 49").select("l_partkey", "l_suppkey")).drop("l_quantity")


@query("C6_touching_keys", f"WITH {STOPS_SQL} SELECT instance_id, stop_idx, station_id FROM stops WHERE instance_id IN (SELECT instance_id FROM stops WHERE station_id = 7)")
def _(spark, d):
    return joins.touching_keys(fx.stops(spark, d).select("instance_id", "stop_idx", "station_id"), ["instance_id"], F.col("station_id") == 7)


@query("C7_interval_count", f"WITH {SPANS_SQL}, {POINTS_SQL} SELECT pid, count(s) AS n FROM points p LEFT JOIN spans i ON i.key = p.key AND at_min BETWEEN s AND e GROUP BY pid")
def _(spark, d):
    got = ranges.interval_stats(points(spark, d), spans(spark, d), ["key"], "at_min", "s", "e", 120.0, n=F.count("*"))
    return got.select("pid", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(
    "C8_interval_max",
    f"""WITH {SPANS_SQL}, {POINTS_SQL} SELECT pid, greatest(1.5::DOUBLE, 1 + coalesce(max(CASE WHEN v > 200 THEN 1.0::DOUBLE ELSE v / 200 END), 0)) AS multiplier FROM points p
    LEFT JOIN spans i ON i.key = p.key AND at_min BETWEEN s AND e GROUP BY pid""",
)
def _(spark, d):
    got = ranges.interval_stats(points(spark, d), spans(spark, d), ["key"], "at_min", "s", "e", 120.0, sev=F.max(F.least(F.lit(1.0), F.col("v") / 200)))
    return got.select("pid", F.greatest(F.lit(1.5), 1 + F.coalesce("sev", F.lit(0.0))).alias("multiplier"))


@query(
    "C9_spread_to_incident",
    f"""WITH {SECTIONS_SQL}, n AS (SELECT event_id % 22 AS node, max(value) AS value FROM events WHERE event_id % 22 % 3 = 0 GROUP BY 1) SELECT a, b, max(value) AS value
    FROM sections JOIN n ON node IN (a, b) GROUP BY a, b""",
)
def _(spark, d):
    n = table(spark, d, "events").selectExpr("event_id % 22 AS node", "value").where("node % 3 = 0").groupBy("node").agg(F.max("value").alias("value"))
    return ranges.spread_to_incident(n, fx.sections(spark), "node", "value")


@query(
    "C10_expand_aggregate",
    """SELECT event_id, least(x, y) + i AS a, least(x, y) + i + 1 AS b FROM (SELECT event_id, event_id % 22 AS x, user_id % 22 AS y FROM events) CROSS JOIN range(22) t(i)
    WHERE i < greatest(x, y) - least(x, y)""",
)
def _(spark, d):
    pairs = table(spark, d, "events").selectExpr("event_id", "event_id % 22 AS a", "user_id % 22 AS b")
    order = spark.range(22).selectExpr("id AS node", "id AS position")
    return ranges.expand_aggregate(pairs, order)


@query(
    "C13_exists_near",
    f"""WITH {POINTS_SQL}, e2 AS (SELECT event_id AS oid, event_id % 22 AS key, epoch_us(ts) / 60000000.0::DOUBLE AS t FROM events
    WHERE event_type = 'error') SELECT pid, bool_or(oid IS NOT NULL) AS near FROM points p LEFT JOIN e2 o ON o.key = p.key AND abs(o.t - p.at_min) <= 90 AND oid <> pid
    GROUP BY pid""",
)
def _(spark, d):
    other = table(spark, d, "events").where("event_type = 'error'").selectExpr("event_id AS oid", "event_id % 22 AS key", f"{fx.micros('ts')} / 60000000D AS t")
    return ranges.exists_near(points(spark, d), other, ["key"], "at_min", "t", 90.0, F.col("oid") != F.col("pid")).select("pid", "near")


@query(
    "C14_join_forecast_truth",
    f"""{FILLED_SQL}, f AS (SELECT instance_id, stop_idx, prev_delay AS pred, sched_arr - lag(sched_arr) OVER (PARTITION BY instance_id ORDER BY stop_idx) AS lead_min FROM filled)
    SELECT f.instance_id, f.stop_idx, lead_min, pred, arr_delay AS truth FROM f JOIN filled t USING (instance_id, stop_idx) WHERE arr_delay IS NOT NULL AND lead_min IS NOT NULL""",
)
def _(spark, d):
    return forecast_truth(spark, d)


def forecast_truth(spark, d):
    f = seq.carry_forward(fx.stops(spark, d))
    forecast = f.select("instance_id", "stop_idx", F.col("prev_delay").alias("pred"), (F.col("sched_arr") - F.lag("sched_arr").over(seq.along())).alias("lead_min"))
    truth = f.where("arr_delay IS NOT NULL").select("instance_id", "stop_idx", F.col("arr_delay").alias("truth"))
    return forecast.where("lead_min IS NOT NULL").join(truth, ["instance_id", "stop_idx"]).select("instance_id", "stop_idx", "lead_min", "pred", "truth")


SECOND_SQL = "second AS (SELECT instance_id, stop_idx, CASE WHEN event_id % 61 = 0 THEN 99 ELSE station_id END AS station_id, coalesce(actual_arr, sched_arr) + CASE WHEN event_id % 97 = 0 THEN 5 ELSE 0 END AS actual_arr, CASE WHEN event_id % 4 = 0 THEN NULL ELSE actual_dep END AS actual_dep FROM stops WHERE event_id % 10 <> 3)"


def second(spark, d):
    return fx.stops(spark, d).where("event_id % 10 <> 3").selectExpr(
        "instance_id", "stop_idx", "CASE WHEN event_id % 61 = 0 THEN 99 ELSE station_id END AS station_id", "coalesce(actual_arr, sched_arr) + CASE WHEN event_id % 97 = 0 THEN 5 ELSE 0 END AS actual_arr", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE actual_dep END AS actual_dep"
    )


@query(
    "C15_crosscheck_sources",
    f"""WITH {STOPS_SQL}, {SECOND_SQL}, j AS (SELECT a.actual_arr AS x1, b.actual_arr AS y1, a.actual_dep AS x2, b.actual_dep AS y2 FROM stops a JOIN second b USING (instance_id, stop_idx) WHERE a.station_id = b.station_id),
    ps AS (SELECT a.station_id = b.station_id AS same FROM stops a JOIN second b USING (instance_id, stop_idx)),
    s AS (SELECT 'actual_arr' AS field, x1 AS x, y1 AS y FROM j UNION ALL SELECT 'actual_dep', x2, y2 FROM j)
    SELECT field, count(*) FILTER (abs(x - y) <= 0) AS agree, count(*) FILTER (abs(x - y) > 0) AS differ, count(*) FILTER (x IS NOT NULL AND y IS NULL) AS only_a,
    count(*) FILTER (x IS NULL AND y IS NOT NULL) AS only_b, count(*) FILTER (x IS NULL AND y IS NULL) AS neither FROM s GROUP BY field
    UNION ALL SELECT 'place', count(*) FILTER (same), count(*) FILTER (NOT same), 0, 0, 0 FROM ps""",
)
def _(spark, d):
    return joins.crosscheck_sources(fx.stops(spark, d), second(spark, d), ["instance_id", "stop_idx"], ["actual_arr", "actual_dep"], place="station_id")


@query(
    "C16_source_coverage",
    """SELECT found_in, count(*) AS n FROM (SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' ELSE 'only_b' END AS found_in
    FROM (SELECT k, bool_or(s = 1) AS a, bool_or(s = 2) AS b FROM (SELECT l_partkey AS k, 1 AS s FROM lineitem WHERE l_quantity < 5 UNION ALL SELECT p_partkey, 2 FROM part
    WHERE p_size < 25) GROUP BY k)) GROUP BY found_in""",
)
def _(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity < 5").select(F.col("l_partkey").alias("k"))
    return joins.source_coverage(a, table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("k")), ["k"])


@query(
    "C17_join_booked_path",
    f"""WITH {STOPS_SQL}, s2 AS (SELECT instance_id, stop_idx, sched_arr, sched_dep FROM stops) SELECT r.instance_id, r.stop_idx, r.actual_arr, s2.sched_dep FROM stops r LEFT
    JOIN s2 USING (instance_id, stop_idx) WHERE r.actual_arr BETWEEN 2000 AND 4000 OR r.actual_dep BETWEEN 2000 AND 4000 OR s2.sched_dep BETWEEN 2000 AND 4000""",
)
def _(spark, d):
    s = fx.stops(spark, d)
    r = s.select("instance_id", "stop_idx", "actual_arr", "actual_dep").join(s.select("instance_id", "stop_idx", "sched_dep"), ["instance_id", "stop_idx"], "left")
    return r.where("actual_arr BETWEEN 2000 AND 4000 OR actual_dep BETWEEN 2000 AND 4000 OR sched_dep BETWEEN 2000 AND 4000").select("instance_id", "stop_idx", "actual_arr", "sched_dep")


@query("C18_unseen_keys", "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, d):
    return joins.unseen_keys(table(spark, d, "orders"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query(
    "C19_update_from",
    f"""WITH {STOPS_SQL} SELECT instance_id, stop_idx, CASE WHEN greatest(actual_arr, actual_dep) > 1000 AND greatest(actual_arr,
    actual_dep) <= 5000 THEN actual_arr END AS actual_arr, CASE WHEN greatest(actual_arr, actual_dep) > 1000 AND greatest(actual_arr,
    actual_dep) <= 5000 THEN actual_dep END AS actual_dep
    FROM stops""",
)
def _(spark, d):
    s = fx.stops(spark, d).select("instance_id", "stop_idx", "actual_arr", "actual_dep")
    blank = s.select("instance_id", "stop_idx", F.lit(None).cast("long").alias("actual_arr"), F.lit(None).cast("long").alias("actual_dep"))
    return joins.update_from(blank, s, ["instance_id", "stop_idx"], ["actual_arr", "actual_dep"], F.greatest("actual_arr", "actual_dep"), F.lit(1000), F.lit(5000))


@query(
    "C21_align_by_position",
    f"""WITH {STOPS_SQL}, a AS (SELECT instance_id, stop_idx, station_id FROM stops), q AS (SELECT instance_id, stop_idx, station_id FROM stops WHERE user_id % 2 = 0 OR stop_idx > 0),
    x AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY instance_id) AS n FROM a WINDOW w AS (PARTITION BY instance_id ORDER BY stop_idx)),
    y AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY instance_id) AS n FROM q WINDOW w AS (PARTITION BY instance_id ORDER BY stop_idx))
    SELECT x.instance_id, k::BIGINT AS k, x.station_id AS station_id_a, y.station_id AS station_id_b FROM x JOIN y USING (instance_id, k, n)""",
)
def _(spark, d):
    s = fx.stops(spark, d)
    a, b = s.select("instance_id", "stop_idx", "station_id"), s.where("user_id % 2 = 0 OR stop_idx > 0").select("instance_id", "stop_idx", "station_id")
    return joins.align_by_position(a, b, "instance_id", "stop_idx").select("instance_id", F.col("k").cast("long").alias("k"), "station_id_a", "station_id_b")


MOVES_SQL = f"""{TIMED_SQL}, w AS (SELECT *, lead(arr) OVER t AS na, lead(station_id) OVER t AS ns FROM timed WINDOW t AS (PARTITION BY instance_id ORDER BY stop_idx)),
moves AS (SELECT instance_id, 'dwell' AS kind, station_id::VARCHAR AS key, arr AS s, dep AS e FROM w WHERE dep > arr
  UNION ALL SELECT instance_id, 'section', least(station_id, ns)::VARCHAR || '|' || greatest(station_id, ns)::VARCHAR, dep, na FROM w WHERE na > dep
  UNION ALL SELECT instance_id, 'inbound', ns::VARCHAR, dep, na FROM w WHERE na > dep)"""


@query("E21_movement_intervals", f"{MOVES_SQL} SELECT * FROM moves")
def _(spark, d):
    return movement_intervals(timed(spark, d))


def movement_intervals(t):
    """Standing, section and inbound intervals between consecutive stops."""
    from waymark.functions.columns import pair_key

    nxt = t.withColumn("na", F.lead("arr").over(seq.along())).withColumn("ns", F.lead("station_id").over(seq.along()))
    row = lambda kind, key, s, e: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.col(s).alias("s"), F.col(e).alias("e"))
    three = F.array(row("dwell", F.col("station_id"), "arr", "dep"), row("section", pair_key(F.col("station_id"), F.col("ns")), "dep", "na"), row("inbound", F.col("ns"), "dep", "na"))
    return nxt.select("instance_id", F.explode(three).alias("m")).select("instance_id", "m.*").where("e > s")


@query(
    "E22_split_interval_daily",
    f"""WITH {INTERVALS_SQL}, i AS (SELECT event_id, start_min AS s, end_min + 2000.0 AS e FROM intervals
    WHERE end_min IS NOT NULL), x AS (SELECT *, unnest(range(floor(s / 1440)::BIGINT, floor(e / 1440)::BIGINT + 1)) AS day
    FROM i) SELECT event_id, day, round(greatest(s, day * 1440.0), 4) AS piece_start, round(least(e, (day + 1) * 1440.0 - 1.0::DOUBLE / 60), 4) AS piece_end FROM x""",
)
def _(spark, d):
    i = fx.intervals(spark, d).where("end_min IS NOT NULL").withColumn("end_min", F.col("end_min") + 2000.0)
    return ranges.split_daily(i, "start_min", "end_min").select("event_id", "day", F.round("piece_start", 4).alias("piece_start"), F.round("piece_end", 4).alias("piece_end"))


@query(
    "E23_split_leg_by_distance",
    f"""{TIMED_SQL}, {SECTIONS_SQL}, w AS (SELECT instance_id, stop_idx, station_id AS f, dep, lead(arr) OVER t AS na, lead(station_id) OVER t AS g FROM timed WINDOW t AS (PARTITION BY instance_id ORDER BY stop_idx)),
    parts AS (SELECT instance_id, stop_idx, dep, na, f, g, a, km, sum(km) OVER (PARTITION BY instance_id, stop_idx
      ORDER BY CASE WHEN g > f THEN a ELSE -a END ROWS UNBOUNDED PRECEDING) AS upto, sum(km) OVER (PARTITION BY instance_id, stop_idx) AS total
      FROM w JOIN sections ON a >= least(f, g) AND b <= greatest(f, g) WHERE na > dep AND f <> g)
    SELECT instance_id, stop_idx, a, round(dep + (na - dep) * (upto - km) / total, 4) AS s, round(dep + (na - dep) * upto / total, 4) AS e FROM parts""",
)
def _(spark, d):
    return split_legs(timed(spark, d), fx.sections(spark)).select("instance_id", "stop_idx", "a", F.round("s", 4).alias("s"), F.round("e", 4).alias("e"))


def split_legs(t, sections):
    """Movements over several sections cut at their cumulative share of the distance, in the direction of travel."""
    legs = t.select("instance_id", "stop_idx", F.col("station_id").alias("f"), "dep", F.lead("arr").over(seq.along()).alias("na"), F.lead("station_id").over(seq.along()).alias("g")).where("na > dep AND f <> g")
    parts = legs.withColumn("a", F.explode(F.sequence(F.least("f", "g"), F.greatest("f", "g") - 1))).join(sections, "a")
    leg = seq.W.partitionBy("instance_id", "stop_idx")
    way = leg.orderBy(F.when(F.col("g") > F.col("f"), F.col("a")).otherwise(-F.col("a"))).rowsBetween(seq.W.unboundedPreceding, 0)
    parts = parts.withColumn("upto", F.sum("km").over(way)).withColumn("total", F.sum("km").over(leg))
    at = lambda x: F.col("dep") + (F.col("na") - F.col("dep")) * x / F.col("total")
    return parts.withColumn("s", at(F.col("upto") - F.col("km"))).withColumn("e", at(F.col("upto")))


@query(
    "E24_open_intervals_as_of",
    f"""WITH {INTERVALS_SQL} SELECT event_id, coalesce(CASE WHEN end_min <= {NOW} THEN end_min END, least({NOW}, start_min + 300)) AS known_end FROM intervals
    WHERE start_min <= {NOW}""",
)
def _(spark, d):
    return ranges.open_as_of(fx.intervals(spark, d), F.lit(NOW), "start_min", "end_min", 300.0).select("event_id", "known_end")


@query(
    "E25_known_or_planned_at",
    f"""{TIMED_SQL}, m AS (SELECT instance_id, stop_idx, station_id, CASE WHEN actual_arr <= 4000 THEN actual_arr END AS ka, CASE WHEN actual_dep <= 4000 THEN actual_dep END AS kd, sched_arr, sched_dep FROM timed),
    y AS (SELECT *, coalesce(ka, CASE WHEN sched_arr BETWEEN 4000 AND 4240 THEN sched_arr END) AS s FROM m)
    SELECT instance_id, stop_idx, s, CASE WHEN kd IS NOT NULL THEN kd WHEN ka IS NOT NULL THEN greatest(ka + 37, 4000) ELSE greatest(sched_dep, s) END AS e FROM y WHERE s IS NOT NULL""",
)
def _(spark, d):
    return known_or_planned(fx.stops(spark, d), 4000, 240, 37).select("instance_id", "stop_idx", "s", "e")


def known_or_planned(stops, now, ahead, carry):
    """Standing intervals at ``now``: as observed so far, carried on where the departure is unknown, as booked if due within ``ahead``."""
    known = lambda c: F.when(F.col(c) <= now, F.col(c))
    d = stops.withColumn("ka", known("actual_arr")).withColumn("kd", known("actual_dep"))
    d = d.withColumn("s", F.coalesce("ka", F.when(F.col("sched_arr").between(now, now + ahead), F.col("sched_arr")))).where("s IS NOT NULL")
    carried = F.greatest(F.col("ka") + carry, F.lit(now).cast("long"))
    return d.withColumn("e", F.when(F.col("kd").isNotNull(), F.col("kd")).when(F.col("ka").isNotNull(), carried).otherwise(F.greatest("sched_dep", "s")))


@query(
    "E26_restriction_in_force",
    f"""WITH {INTERVALS_SQL}, {SECTIONS_SQL}, f AS (SELECT key, max(least(4.0::DOUBLE, 100 / value)) AS m FROM intervals
    WHERE start_min <= {NOW} AND (end_min IS NULL OR end_min >= {NOW}) GROUP BY key) SELECT a, b, max(m) AS m FROM sections JOIN f ON key IN (a, b) GROUP BY a, b""",
)
def _(spark, d):
    from waymark.functions.columns import speed_multiplier

    f = ranges.in_force(fx.intervals(spark, d), F.lit(NOW), "start_min", "end_min").groupBy("key").agg(F.max(speed_multiplier(F.col("value"))).alias("m"))
    return ranges.spread_to_incident(f, fx.sections(spark), "key", "m")
