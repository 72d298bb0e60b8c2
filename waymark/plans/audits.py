"""Queries that profile and audit tables, order them and combine sets of keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import profiles as p
from waymark.operators import sequence as seq
from waymark.plans.book import query
from waymark.plans.scores import SCORED_SQL, rounded, scored
from waymark.plans.trips import FILLED_SQL
from waymark.sources import fixtures as fx
from waymark.sources.fixtures import INTERVALS_SQL, STOPS_SQL, table

LINE = ["l_orderkey", "l_linenumber"]
CHECKED = ["l_partkey", "l_suppkey", "l_quantity"]


@query("D19_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return p.duplicate_keys(table(spark, d, "lineitem"), LINE)


@query(
    "D20_disagreeing_duplicates",
    """WITH g AS (SELECT count(*) AS n, count(DISTINCT l_partkey) > 1 OR count(DISTINCT l_suppkey) > 1 OR count(DISTINCT l_quantity) > 1 AS differs FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    SELECT count(*) AS duplicates, count(*) FILTER (differs) AS differing, count(*) FILTER (NOT differs) AS identical FROM g""",
)
def _(spark, d):
    return p.disagreeing_duplicates(table(spark, d, "lineitem"), LINE, CHECKED)


def _profile_sql(c):
    return f"SELECT '{c}' AS \"column\", count(*) AS n, count({c}) AS known, round(100 * count({c}) / count(*), 6) AS pct, min({c})::VARCHAR AS least, max({c})::VARCHAR AS most FROM stops"


@query("D21_column_profile", f"WITH {STOPS_SQL} " + " UNION ALL ".join(map(_profile_sql, ["actual_arr", "actual_dep", "sched_arr", "station_id"])))
def _(spark, d):
    return p.column_profile(fx.stops(spark, d), ["actual_arr", "actual_dep", "sched_arr", "station_id"])


@query(
    "D19_duplicate_totals",
    """SELECT count(*) AS keys, coalesce(sum(n), 0)::BIGINT AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
)
def _(spark, d):
    return p.duplicate_keys(table(spark, d, "lineitem"), LINE).agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


@query(
    "D22_length_histogram",
    """SELECT length(x) AS length, count(*) AS n FROM (SELECT CASE WHEN event_id % 9 <> 0 THEN event_id::VARCHAR || '_' || event_type END AS x FROM events) GROUP BY 1""",
)
def _(spark, d):
    key = F.when(F.col("event_id") % 9 != 0, F.concat_ws("_", F.col("event_id").cast("string"), "event_type"))
    return p.length_histogram(table(spark, d, "events").select(key.alias("key")), "key")


@query("D23_newest_event", f"WITH {STOPS_SQL} SELECT max(greatest(actual_arr, actual_dep)) AS newest, count(*) AS n FROM stops WHERE greatest(actual_arr, actual_dep) <= 5000")
def _(spark, d):
    return p.newest_event(fx.stops(spark, d), ["actual_arr", "actual_dep"], F.lit(5000))


def _audit_sql(c):
    z, sd = f"count(*) FILTER ({c} = 0)", f"coalesce(stddev_samp({c}), 0)"
    return f"""SELECT '{c}' AS "column", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, min({c})::DOUBLE AS least, max({c})::DOUBLE AS most, count({c}) AS n, {z} AS zeros,
    CASE WHEN {sd} < 1e-8 THEN 'constant' WHEN count({c}) - {z} < 50 THEN 'few' WHEN {sd} < 0.01 AND abs(avg({c})) > 0.01 THEN 'saturated'
    WHEN {z} / count({c}) > 0.98 THEN CASE WHEN '{c}' = 'rare' THEN 'empty-ok' ELSE 'empty' END WHEN {z} / count({c}) > 0.9 THEN 'sparse' ELSE 'ok' END AS status FROM au"""


AUDITED = ["pred", "persist", "lead_min", "station_id", "one", "pinned", "few", "rare", "sparse"]


@query(
    "D24_feature_audit",
    f"""{SCORED_SQL}, au AS (SELECT *, 1 AS one, 5 + (stop_idx % 2) / 1000 AS pinned, (stop_idx = 0)::INT AS few, (stop_idx % 13 = 7 AND station_id < 8)::INT AS rare, (station_id = 4 OR stop_idx = 12)::INT AS sparse FROM scored) """
    + " UNION ALL ".join(map(_audit_sql, AUDITED)),
)
def _(spark, d):
    more = {
        "one": "1", "pinned": "5 + (stop_idx % 2) / 1000", "few": "cast(stop_idx = 0 as int)", "rare": "cast(stop_idx % 13 = 7 and station_id < 8 as int)",
        "sparse": "cast(station_id = 4 or stop_idx = 12 as int)",
    }
    df = scored(spark, d).withColumns({k: F.expr(v) for k, v in more.items()})
    return rounded(p.feature_audit(df, AUDITED, sparse_ok=("rare",)), "mean", "sd")


def _leak_sql(c):
    return f"""SELECT '{c}' AS "column", round(abs(corr({c}, actual)), 6) AS r, round(avg((abs({c} - actual) <= 0.5)::INT), 6) AS identical,
    CASE WHEN abs(corr({c}, actual)) > 0.95 THEN 'leak' WHEN abs(corr({c}, actual)) > 0.8 THEN 'suspect' ELSE 'ok' END AS flag FROM scored"""


@query("D25_leak_correlation", f"{SCORED_SQL} " + " UNION ALL ".join(map(_leak_sql, ["pred", "persist", "lead_min"])))
def _(spark, d):
    return rounded(p.leak_correlation(scored(spark, d), ["pred", "persist", "lead_min"], "actual"), "r", "identical")


SPLIT_SQL = "ed AS (SELECT event_id, user_id, ts::DATE AS day, value FROM events), er AS (SELECT *, dense_rank() OVER (ORDER BY day DESC) AS back FROM ed), es AS (SELECT *, CASE WHEN back <= 5 THEN 'test' WHEN back <= 9 THEN 'validation' ELSE 'train' END AS split FROM er)"


def split_events(spark, d):
    return seq.assign_split(table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "value"), "day", 5, 4)


@query(
    "D28_calendar_coverage",
    f"""WITH {SPLIT_SQL} SELECT split, w AS weekday, count(DISTINCT day) FILTER (isodow(day) - 1 = w) AS n FROM es CROSS JOIN range(7) t(w) GROUP BY split, w""",
)
def _(spark, d):
    return p.calendar_coverage(split_events(spark, d), "split", "day")


# blocks from the fourth on are test, users that end in 0 are not eligible
@query(
    "D29_split_difficulty",
    f"""{FILLED_SQL}, kn AS (SELECT *, CASE WHEN blk >= 4 THEN 'test' ELSE 'train' END AS split FROM filled WHERE arr_delay IS NOT NULL AND user_id % 10 <> 0),
    ls AS (SELECT split, instance_id, list(arr_delay ORDER BY stop_idx) AS l FROM kn GROUP BY ALL HAVING count(*) > 1),
    sp AS (SELECT split, instance_id, unnest(list_transform(range(2, len(l) + 1), lambda i: l[i] - l[i - 1])) AS step FROM ls)
    SELECT split, count(DISTINCT instance_id) AS trips, count(*) AS n, round(100 * count(*) FILTER (step > 30) / count(*), 6) AS rise_pct,
      round(100 * count(*) FILTER (step < -30) / count(*), 6) AS fall_pct,
    round(avg(step), 6) AS mean, round(stddev_pop(step), 6) AS sd FROM sp GROUP BY split""",
)
def _(spark, d):
    s = seq.carry_forward(fx.stops(spark, d)).withColumn("split", F.when(F.col("blk") >= 4, "test").otherwise("train"))
    return rounded(p.split_difficulty(s, "split", "instance_id", "stop_idx", "arr_delay", F.col("user_id") % 10 != 0), "rise_pct", "fall_pct", "mean", "sd")


@query(
    "D30_exposure_buckets",
    f"""WITH {STOPS_SQL}, ex AS (SELECT user_id, count(DISTINCT instance_id) FILTER (blk < 4) AS days, count(*) FILTER (blk >= 4 AND actual_arr IS NOT NULL AND user_id % 10 <> 0) AS n FROM stops GROUP BY user_id)
    SELECT ((days >= 1)::INT + (days >= 3)::INT + (days >= 4)::INT)::BIGINT AS bucket, count(*) AS services, sum(n)::BIGINT AS test_rows, round(sum(n) / nullif((SELECT sum(n)
      FROM ex), 0), 6) AS share FROM ex GROUP BY 1""",
)
def _(spark, d):
    s = fx.stops(spark, d).withColumn("split", F.when(F.col("blk") >= 4, "test").otherwise("train"))
    tests = s.where("split = 'test' AND actual_arr IS NOT NULL AND user_id % 10 <> 0")
    return rounded(p.exposure_buckets(s.select("instance_id", "user_id", "split").distinct(), tests, "user_id", "split", (1, 3, 4)), "share")


@query(
    "D34_drop_partial_days",
    """WITH ed AS (SELECT event_id, user_id, ts::DATE AS day FROM events) SELECT * FROM ed WHERE day IN (SELECT day FROM ed GROUP BY day HAVING count(DISTINCT user_id) >= 10)""",
)
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    return p.drop_partial_days(e, "day", "user_id", 10)


@query(
    "D38_register_services",
    """WITH f AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id
    ORDER BY ts, event_id) = 1) SELECT *, row_number() OVER (ORDER BY user_id) - 1 AS "index" FROM f""",
)
def _(spark, d):
    return p.register_services(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type"])


@query(
    "D39_build_stats",
    f"""WITH {STOPS_SQL} SELECT count(*) AS n, count(*) FILTER (actual_arr IS NOT NULL) AS with_arrival, count(*) FILTER (actual_arr IS NULL AND actual_dep IS NULL) AS unseen,
    count(*) FILTER (station_id IN {fx.JUNCTIONS}) AS at_junction
    FROM stops""",
)
def _(spark, d):
    none = F.col("actual_arr").isNull() & F.col("actual_dep").isNull()
    return p.status_counts(fx.stops(spark, d), with_arrival=F.col("actual_arr").isNotNull(), unseen=none, at_junction=F.col("station_id").isin(*fx.JUNCTIONS))


@query(
    "D41_extreme_trips",
    f"""{FILLED_SQL}, w AS (SELECT instance_id, max(abs(arr_delay)) AS worst, user_id % 10 <> 0 AS eligible FROM filled GROUP BY instance_id, user_id HAVING max(abs(arr_delay)) > 30)
    SELECT instance_id, worst, eligible FROM w QUALIFY row_number() OVER (PARTITION BY eligible ORDER BY worst DESC, instance_id) <= 12""",
)
def _(spark, d):
    return p.extreme_trips(seq.carry_forward(fx.stops(spark, d)), "instance_id", F.col("arr_delay"), F.col("user_id") % 10 != 0, 30, 12)


@query(
    "D42_provenance_mix",
    f"""{FILLED_SQL}, pv AS (SELECT 'arrival' AS field, actual_arr AS x, a0 AS y FROM filled UNION ALL SELECT 'departure', actual_dep, d0 FROM filled)
    SELECT field, count(x) AS observed, count(*) FILTER (x IS NULL AND y IS NOT NULL) AS filled, count(*) AS n, count(*) FILTER (x IS NULL AND y IS NULL) AS missing,
      round(count(x) / count(*), 6) AS share
      FROM pv GROUP BY field""",
)
def _(spark, d):
    f = seq.carry_forward(fx.stops(spark, d))
    return rounded(p.provenance_mix(f, {"arrival": (F.col("actual_arr"), F.col("a0")), "departure": (F.col("actual_dep"), F.col("d0"))}), "share")


@query("F2_top_k_groups", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, l_orderkey, l_linenumber LIMIT 5")
def _(spark, d):
    return p.duplicate_keys(table(spark, d, "lineitem"), LINE).orderBy(F.desc("n"), *LINE).limit(5)


@query(
    "F3_top_k_per_group",
    """SELECT event_type, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3""",
)
def _(spark, d):
    return p.top_k_per_group(table(spark, d, "events"), ["event_type"], [F.desc("value"), F.col("event_id")], 3).select("event_type", "event_id", "value", "rank")


@query("F5_strided_ticks", f"WITH {STOPS_SQL} SELECT instance_id, stop_idx FROM stops WHERE stop_idx % 4 = 0")
def _(spark, d):
    return fx.stops(spark, d).where("pmod(stop_idx, 4) = 0").select("instance_id", "stop_idx")


@query(
    "G1_union_sources",
    f"""WITH {INTERVALS_SQL} SELECT event_id, key, start_min, 'timed' AS origin FROM intervals
    UNION ALL SELECT event_id, event_id % 22, epoch_us(ts) / 60000000.0::DOUBLE, 'click' FROM events WHERE event_type = 'click'""",
)
def _(spark, d):
    timed = fx.intervals(spark, d).select("event_id", "key", "start_min", F.lit("timed").alias("origin"))
    other = table(spark, d, "events").where("event_type = 'click'").selectExpr("event_id", "event_id % 22 AS key", f"{fx.micros('ts')} / 60000000D AS start_min", "'click' AS origin")
    return timed.unionByName(other)


@query("G2_changed_keys", "SELECT DISTINCT user_id FROM events WHERE ts > TIMESTAMP '2024-01-20' AND ts <= TIMESTAMP '2024-01-21'")
def _(spark, d):
    return table(spark, d, "events").where("ts > TIMESTAMP_NTZ'2024-01-20' AND ts <= TIMESTAMP_NTZ'2024-01-21'").select("user_id").distinct()


@query(
    "G3_key_sets",
    """SELECT 'both' AS found, count(*) AS n FROM (SELECT l_partkey FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size < 25) UNION ALL SELECT 'only_a', count(*)
    FROM (SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size < 25)""",
)
def _(spark, d):
    a, b = table(spark, d, "lineitem").select("l_partkey"), table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"))
    n = lambda name, x: x.agg(F.lit(name).alias("found"), F.count("*").alias("n"))
    return n("both", a.intersect(b)).unionByName(n("only_a", a.subtract(b)))


@query(
    "Q4_window_sanity",
    f"""WITH {INTERVALS_SQL} SELECT count(*) AS n, count(*) FILTER (end_min < start_min) AS reversed, count(*) FILTER (end_min IS NULL) AS open,
    count(*) FILTER (start_min < 28423440 OR start_min > 28460000 OR end_min > 28460000) AS outside
    FROM intervals""",
)
def _(spark, d):
    return p.window_sanity(fx.intervals(spark, d), "start_min", "end_min", F.lit(28423440.0), F.lit(28460000.0))
