"""Queries over single columns: codes, times, pairs, categories and normalised features."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import columns as c
from waymark.operators import sequence as seq
from waymark.plans.book import query
from waymark.plans.trips import FILLED_SQL
from waymark.sources.fixtures import STOPS_SQL, stops, table


@query(
    "B1_normalize_code",
    """SELECT event_id, CASE WHEN length((user_id * 977)::VARCHAR) < 5 THEN lpad((user_id * 977)::VARCHAR, 5, '0') ELSE (user_id * 977)::VARCHAR END AS code FROM events""",
)
def _(spark, d):
    return table(spark, d, "events").select("event_id", c.normalize_code(F.col("user_id") * 977).alias("code"))


@query(
    "B2_parse_ts",
    "SELECT event_id, coalesce(try_strptime(CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%d/%m/%Y %H:%M') WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M') ELSE 'n/a' END, '%Y-%m-%d %H:%M'), try_strptime(CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%d/%m/%Y %H:%M') END, '%d/%m/%Y %H:%M')) AS moment FROM events",
)
def _(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "dd/MM/yyyy HH:mm")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm")).otherwise("n/a")
    return table(spark, d, "events").select("event_id", c.parse_ts(text, ["yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm"]).cast("timestamp_ntz").alias("moment"))


@query(
    "B3_delay_minutes",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch(l_shipdate - o_orderdate) / 60.0::DOUBLE AS delay FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def _(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c.delay_minutes(F.col("l_shipdate"), F.col("o_orderdate")).alias("delay"))


@query("B4_rel_minutes", "SELECT event_id, trunc(epoch(ts - TIMESTAMP '2024-01-05'))::DOUBLE / 60.0::DOUBLE AS minute FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", c.rel_minutes(F.col("ts"), F.expr("TIMESTAMP_NTZ'2024-01-05 11:00:00'")).alias("minute"))


@query(
    "B5_fill_sched_pair",
    f"""WITH {STOPS_SQL} SELECT instance_id, stop_idx, coalesce(actual_arr, actual_dep) AS arr, coalesce(actual_dep, actual_arr) AS dep FROM stops
    WHERE actual_arr IS NOT NULL OR actual_dep IS NOT NULL""",
)
def _(spark, d):
    arr, dep = c.fill_pair(F.col("actual_arr"), F.col("actual_dep"))
    return stops(spark, d).select("instance_id", "stop_idx", arr.alias("arr"), dep.alias("dep")).where("arr IS NOT NULL")


@query(
    "B6_domain_filter",
    """SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_mktsegment IN ('BUILDING', 'MACHINERY')""",
)
def _(spark, d):
    members = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(members, "c_nationkey", "left_semi").select("c_custkey", "c_nationkey")


PAIR_TEXT = "replace(p_name, ' ', ' - ') || CASE WHEN p_partkey % 5 = 0 THEN '-x' ELSE '' END"


@query(
    "B7_parse_pair",
    f"""SELECT p_partkey, CASE WHEN len(s) = 2 THEN upper(trim(s[1])) END AS a, CASE WHEN len(s) = 2 THEN upper(trim(s[2])) END AS b
    FROM (SELECT p_partkey, string_split({PAIR_TEXT}, '-') AS s FROM part)""",
)
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", c.parse_pair(F.expr(PAIR_TEXT)).alias("p"))
    return p.select("p_partkey", "p.a", "p.b")


@query(
    "B8_pair_key",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(l_partkey, l_suppkey)::VARCHAR || '|' || greatest(l_partkey, l_suppkey)::VARCHAR AS key FROM lineitem""",
)
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c.pair_key(F.col("l_partkey"), F.col("l_suppkey")).alias("key"))


CLASSES = {"error": (0.9, "alarm"), "purchase": (0.5, "money"), "signup": (0.5, "people")}


@query(
    "B9_map_category",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 0.9 WHEN 'purchase' THEN 0.5 WHEN 'signup' THEN 0.5 ELSE 0.1 END::DOUBLE AS priority,
    CASE event_type WHEN 'error' THEN 'alarm' WHEN 'purchase' THEN 'money' WHEN 'signup' THEN 'people' ELSE 'other' END AS class
    FROM events""",
)
def _(spark, d):
    got = c.map_category(F.col("event_type"), CLASSES, (0.1, "other"), ["priority", "class"])
    return table(spark, d, "events").select("event_id", *(v.alias(k) for k, v in got.items()))


@query("B10_eligibility", "SELECT event_id, event_type NOT IN ('view', 'click') AS eligible FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", c.eligible(F.col("event_type"), ["view", "click"]).alias("eligible"))


@query(
    "B11_cyclic_encode",
    """SELECT event_id, round(sin(m * 2 * pi() / 1440), 6) AS day_sin, round(cos(m * 2 * pi() / 1440), 6) AS day_cos, round(sin(w * 2 * pi() / 7), 6) AS week_sin, round(cos(w * 2 * pi() / 7), 6) AS week_cos
    FROM (SELECT event_id, hour(ts) * 60 + minute(ts) AS m, isodow(ts) - 1 AS w FROM events)""",
)
def _(spark, d):
    got = c.cyclic_encode(F.hour("ts") * 60 + F.minute("ts"), F.weekday("ts"))
    return table(spark, d, "events").select("event_id", *(F.round(v, 6).alias(k) for k, v in got.items()))


@query(
    "B12_normalize_features",
    """SELECT event_id, round(sign(x) * ln(1 + abs(x)), 6) AS slog, round(ln(1 + least(greatest(x, 0.0), 60.0)) / ln(61.0::DOUBLE), 6) AS clog, round(tanh(x / 30.0), 6) AS squashed,
    round(coalesce(least(CASE WHEN event_id % 4 = 0 THEN NULL ELSE x / (event_id % 4) END, 5.0), 0), 6) AS ratio FROM (SELECT event_id, value - 50.0::DOUBLE AS x FROM events)""",
)
def _(spark, d):
    x = F.col("value") - 50.0
    return table(spark, d, "events").select(
        "event_id", F.round(c.signed_log(x), 6).alias("slog"), F.round(c.clamped_log(x, 60.0), 6).alias("clog"), F.round(c.squash(x, 30.0), 6).alias("squashed"),
        F.round(c.capped_ratio(x, F.col("event_id") % 4, 5.0), 6).alias("ratio"),
    )


@query("B13_denormalize", "SELECT event_id, round(value - 50.0::DOUBLE, 4) AS from_log, round(least(value, 150.0::DOUBLE) - 50.0, 4) AS from_tanh FROM events")
def _(spark, d):
    x, y = F.col("value") - 50.0, F.least("value", F.lit(150.0)) - 50.0
    return table(spark, d, "events").select("event_id", F.round(c.signed_exp(c.signed_log(x)), 4).alias("from_log"), F.round(c.unsquash(c.squash(y, 80.0), 80.0), 4).alias("from_tanh"))


@query(
    "B14_safe_number",
    """SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 7 = 0 THEN 'x' WHEN event_id % 11 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS DOUBLE), -1.0) AS n
    FROM events""",
)
def _(spark, d):
    text = F.when(F.col("event_id") % 7 == 0, "x").when(F.col("event_id") % 11 == 0, None).otherwise(F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select("event_id", c.safe_number(text, -1.0).alias("n"))


@query("B15_allowance_minutes", "SELECT event_id, (value + CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 50 END) / 60.0::DOUBLE AS minutes FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", c.allowance_minutes(F.col("value"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 50)).alias("minutes"))


@query(
    "B16_instance_key",
    """SELECT event_id, user_id::VARCHAR || '_' || ts::DATE::VARCHAR AS key, split_part(user_id::VARCHAR || '_' || ts::DATE::VARCHAR, '_', 2)::DATE AS day FROM events""",
)
def _(spark, d):
    e = table(spark, d, "events").select("event_id", c.instance_key(F.col("user_id"), F.to_date("ts")).alias("key"))
    return e.withColumn("day", F.to_date(F.split_part("key", F.lit("_"), F.lit(2))))


@query(
    "B17_severity",
    """SELECT event_id, round(least(1.0, 0.4 + 0.1 * coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 13 END, 0))::DOUBLE, 6) AS severity FROM events""",
)
def _(spark, d):
    n = F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 13)
    return table(spark, d, "events").select("event_id", F.round(c.severity(n), 6).alias("severity"))


@query("B18_speed_multiplier", "SELECT event_id, CASE WHEN value - 20 > 0 THEN least(4.0::DOUBLE, 100.0 / (value - 20)) END AS multiplier FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", c.speed_multiplier(F.col("value") - 20).alias("multiplier"))


@query("B19_swap_day_month", "SELECT event_id, CASE WHEN day(ts) <= 12 THEN make_timestamp(year(ts), day(ts), month(ts), hour(ts), minute(ts), 0.0) END AS swapped FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", c.swap_day_month(F.date_trunc("minute", "ts")).cast("timestamp_ntz").alias("swapped"))


@query("B20_stage_bucket", "SELECT event_id, (value >= 5)::INT + (value >= 15)::INT + (value >= 30)::INT AS stage FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", c.stage_bucket(F.col("value"), (5, 15, 30)).alias("stage"))


@query(
    "B21_hhmm",
    f"""WITH {STOPS_SQL} SELECT instance_id, stop_idx, lpad(((sched_arr % 1440 + 1440) % 1440 // 60)::VARCHAR, 2,
    '0') || ':' || lpad((((sched_arr % 1440 + 1440) % 1440) % 60)::VARCHAR, 2, '0') AS hhmm
    FROM stops""",
)
def _(spark, d):
    return stops(spark, d).select("instance_id", "stop_idx", c.hhmm(F.col("sched_arr")).alias("hhmm"))


@query(
    "B23_sched_direction",
    f"""WITH {STOPS_SQL} SELECT instance_id, CASE WHEN arg_max(station_id, stop_idx) > arg_min(station_id, stop_idx) THEN 'DN' ELSE 'UP' END AS direction FROM stops
    GROUP BY instance_id""",
)
def _(spark, d):
    return stops(spark, d).groupBy("instance_id").agg(F.when(F.max_by("station_id", "stop_idx") > F.min_by("station_id", "stop_idx"), "DN").otherwise("UP").alias("direction"))
