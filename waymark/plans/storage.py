"""Queries of sources and sinks: what they return has been written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.plans.audits import SPLIT_SQL, split_events
from waymark.plans.book import query
from waymark.sources import fixtures as fx
from waymark.sources import readers, sinks
from waymark.sources.fixtures import STOPS_SQL, table
from waymark.sources.keyed import KeyedTable

LINE = ["l_orderkey", "l_linenumber"]
LINE_COLUMNS = [*LINE, "l_partkey", "l_suppkey", "l_quantity"]
NEWEST_SQL = "ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC, l_suppkey DESC"


def newest_first():
    return [F.desc_nulls_last("l_shipdate"), F.desc("l_partkey"), F.desc("l_suppkey")]


def lines(spark, d):
    return table(spark, d, "lineitem").select(*LINE_COLUMNS, "l_shipdate")


@query("A1_scan_csv", "SELECT p_partkey, p_name, p_size FROM part")
def _(spark, d):
    path = sinks.shared_folder(spark, "csv")
    table(spark, d, "part").select("p_size", "p_name", "p_type", "p_partkey").write.csv(path, header=True)  # in another order
    return readers.scan_csv(spark, path, "p_partkey long, p_name string, p_size int")


@query("A2_scan_json_records", "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    path = sinks.shared_folder(spark, "json")
    counts = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    # a record per day with its few kinds of event
    days = counts.groupBy("day").agg(F.collect_list(F.struct("event_type", "n")).alias("kinds"))
    days.select(F.date_format("day", "dd/MM/yy").alias("train_start_date"), "kinds", F.col("day").cast("string").alias("file")).repartition("file").write.partitionBy("file").json(path)
    records = readers.scan_json_records(spark, f"{path}/*", "train_start_date string, kinds array<struct<event_type: string, n: long>>")
    return records.select(F.to_date("train_start_date", "dd/MM/yy").alias("day"), F.inline("kinds"))


@query("A3_scan_table", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def _(spark, d):
    keys = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return readers.scan_table(table(spark, d, "orders"), ["o_orderkey", "o_totalprice"], keys)


@query("A4_catalog", "SELECT lpad(user_id::VARCHAR, 5, '0') AS code, event_id AS serial, value / 2 AS minutes FROM events")
def _(spark, d):
    catalog = readers.Catalog(
        {"feed": ("stop_rows", {"code": "lpad(cast(user_id as string), 5, '0')", "serial": "event_id", "minutes": "value"})},
        overrides={"feed": ("events", {"minutes": "value / 2"})},
    )
    return catalog.scan(spark, "feed", lambda s, name: table(s, d, name))


@query("A5_scan_or_fallback", "SELECT event_id, value FROM events WHERE event_type = 'error'")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "value", "event_type")
    return readers.scan_or_fallback(e.where("event_type = 'no such'"), e.where("event_type = 'error'")).select("event_id", "value")


@query("A6_write_partitioned", f"WITH {STOPS_SQL} SELECT instance_id, stop_idx, station_id, blk FROM stops")
def _(spark, d):
    path = sinks.shared_folder(spark, "partitioned")
    s = fx.stops(spark, d).select("instance_id", "stop_idx", "station_id", "blk")
    sinks.write_partitioned(s.withColumn("blk", F.col("blk") + 1000), path, ["blk"], ["instance_id", "stop_idx"])
    sinks.write_partitioned(s, path, ["blk"], ["instance_id", "stop_idx"])  # none of the first folders must survive
    return spark.read.schema(s.schema).parquet(path)


TARGET_SQL = f"t AS (SELECT * FROM lineitem WHERE l_quantity < 25 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber {NEWEST_SQL}) = 1), s AS (SELECT * FROM lineitem WHERE l_quantity >= 20 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber {NEWEST_SQL}) = 1)"


def target(spark, d):
    # a write keeps the newest row of each key itself
    return lines(spark, d).where("l_quantity < 25")


def keyed_table(spark, df, label):
    # small buckets, so that the table splits at the sizes tested too
    return KeyedTable(spark, sinks.shared_folder(spark, label), df.schema, LINE, bucket_rows=20_000)


@query(
    "A7_insert_ignore",
    f"""WITH {TARGET_SQL} SELECT {', '.join(LINE_COLUMNS)} FROM t UNION ALL SELECT {', '.join(LINE_COLUMNS)} FROM s
    WHERE (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM t)""",
)
def _(spark, d):
    kept = keyed_table(spark, lines(spark, d), "inserted")
    kept.insert(target(spark, d), newest_first())
    for _ in range(2):  # the second insert finds nothing new
        kept.insert(lines(spark, d).where("l_quantity >= 20"), newest_first())
    return kept.read().select(*LINE_COLUMNS)


@query(
    "A8_upsert",
    f"""WITH {TARGET_SQL} SELECT {', '.join(LINE_COLUMNS)} FROM s UNION ALL SELECT {', '.join(LINE_COLUMNS)} FROM t
    WHERE (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM s)""",
)
def _(spark, d):
    kept = keyed_table(spark, lines(spark, d), "keyed")
    kept.upsert(target(spark, d), newest_first())
    for _ in range(2):  # a repeated write changes nothing
        kept.upsert(lines(spark, d).where("l_quantity >= 20"), newest_first())
    return kept.read().select(*LINE_COLUMNS)


@query("A9_export_days", f"WITH {STOPS_SQL} SELECT blk, count(*) AS n, count(actual_arr) AS observed, count(DISTINCT user_id) AS vehicles FROM stops GROUP BY blk")
def _(spark, d):
    path = sinks.shared_folder(spark, "days")
    s = fx.stops(spark, d)
    sinks.export_days(s, path, "blk", ["instance_id", "stop_idx"], F.col("actual_arr").isNotNull(), "user_id")
    # counted again over what the files hold
    back = readers.scan_csv(spark, path, s.drop("blk").schema.add("blk", "long"))
    return back.groupBy("blk").agg(F.count("*").alias("n"), F.count("actual_arr").alias("observed"), F.count_distinct("user_id").alias("vehicles"))


@query("A10_stage_day_file", "SELECT count(*) AS n, min(epoch_us(ts)) AS \"first\", max(epoch_us(ts)) AS \"last\" FROM events")
def _(spark, d):
    path = sinks.shared_folder(spark, "day")
    table(spark, d, "events").selectExpr("event_id", f"{fx.micros('ts')} AS us").write.csv(path, header=True, compression="gzip")
    return readers.day_profile(readers.scan_csv(spark, path, "event_id long, us long"), "us")


@query("A11_reload_dimension", "SELECT s_suppkey, s_name, 1 AS version FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier")
def _(spark, d):
    path = sinks.shared_folder(spark, "dimension")
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    sinks.reload_dimension(s, path, 1)
    sinks.reload_dimension(s, path, 2)
    sinks.reload_dimension(s.where("s_suppkey % 2 = 0"), path, 1)
    return spark.read.schema("s_suppkey long, s_name string, version int").parquet(path)


FORECAST_SQL = f"""WITH {STOPS_SQL}, fc AS (SELECT instance_id, station_id, floor(sched_arr / 720.0)::BIGINT * 720 AS issued_at, CASE WHEN event_id % 11 > 0 THEN sched_arr END AS sched_arr,
sched_arr - floor(sched_arr / 720.0)::BIGINT * 720 AS lead_min, (actual_arr - sched_arr) * 0.5::DOUBLE AS delay
  FROM stops), dim AS (SELECT i AS station_id, concat('S', i) AS code FROM range(20) t(i))
SELECT issued_at, instance_id, coalesce(code, station_id::VARCHAR) AS code, round(delay, 1) AS delay, round(coalesce(sched_arr + delay, issued_at + lead_min),
  1) AS predicted_arr
  FROM fc LEFT JOIN dim USING (station_id)"""


def forecasts(spark, d):
    issued = "CAST(floor(sched_arr / 720D) AS BIGINT) * 720"
    return fx.stops(spark, d).selectExpr(
        "instance_id", "station_id", f"{issued} AS issued_at", "CASE WHEN event_id % 11 > 0 THEN sched_arr END AS sched_arr", f"sched_arr - {issued} AS lead_min", "(actual_arr - sched_arr) * 0.5D AS delay"
    )


def codes(spark):
    return spark.range(20).selectExpr("id AS station_id", "concat('S', id) AS code")


@query("A12_forecast_read", FORECAST_SQL)
def _(spark, d):
    return sinks.view_forecast(forecasts(spark, d), codes(spark))


@query("A13_forecast_latest", f"{FORECAST_SQL} WHERE issued_at = (SELECT max(issued_at) FROM fc)")
def _(spark, d):
    return sinks.view_forecast(forecasts(spark, d), codes(spark), latest=True)


@query(
    "A14_evolve_schema",
    """SELECT event_id, value, NULL::BIGINT AS user_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, NULL, user_id FROM events WHERE event_type IS DISTINCT FROM 'click'""",
)
def _(spark, d):
    e = table(spark, d, "events")
    click = F.col("event_type").eqNullSafe("click")
    return sinks.evolve_schema(e.where(click).select("event_id", "value"), e.where(~click).select("event_id", "user_id"))


def _days_sql(s):
    return f"count(DISTINCT day) FILTER (split = '{s}') AS {s}_days"


@query(
    "A15_build_manifest",
    f"""WITH {SPLIT_SQL} SELECT count(*) AS n, min(day) AS first_day, max(day) AS last_day, count(DISTINCT user_id) AS n_groups, {_days_sql('train')}, {_days_sql('validation')},
    {_days_sql('test')}, string_agg(DISTINCT day::VARCHAR, ','
    ORDER BY day::VARCHAR) AS days FROM es""",
)
def _(spark, d):
    return sinks.build_manifest(split_events(spark, d), "day", "split", "user_id")


@query(
    "A16_load_timetable",
    f"""WITH {STOPS_SQL} SELECT instance_id, stop_idx, user_id::VARCHAR AS code, sched_arr, NULL::BIGINT AS actual_arr, NULL::BIGINT AS actual_dep FROM stops""",
)
def _(spark, d):
    s = fx.stops(spark, d).select("instance_id", "stop_idx", F.lpad(F.col("user_id").cast("string"), 8, "0").alias("code"), "sched_arr", "actual_arr", "actual_dep")
    return readers.load_timetable(s, "code", ["actual_arr", "actual_dep"])
