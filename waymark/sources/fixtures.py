"""Trips, intervals and logs derived from the ``events`` table, and their SQL twins.

A trip is what one user did in one block of six days; times are minutes
from the block's start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_DAY, BLOCK_DAYS, STATIONS = 19723, 6, 22
JUNCTIONS = (0, 10, 11, 21)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col: str) -> str:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})"


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per stop: scheduled and actual times of a trip in minutes of its block."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "value", f"{micros('ts')} AS us")
    b = e.withColumn("blk", F.expr(f"CAST(floor((floor(us / 86400000000D) - {FIRST_DAY}) / {BLOCK_DAYS}D) AS BIGINT)"))
    r = b.withColumn("stop_idx", F.expr("CAST(row_number() OVER (PARTITION BY user_id, blk ORDER BY us, event_id) AS BIGINT) - 1")).withColumn(
        "arr_min", F.expr(f"CAST(floor((us - ({FIRST_DAY} + blk * {BLOCK_DAYS}) * 86400000000) / 60000000D) AS BIGINT)")
    )
    return r.selectExpr(
        "concat(CAST(user_id AS STRING), '_', CAST(blk AS STRING)) AS instance_id",
        "blk",
        "stop_idx",
        "user_id",
        "event_id",
        f"event_id % {STATIONS} AS station_id",
        "arr_min - ((event_id * 7919) % 61 - 15) AS sched_arr",
        "arr_min - ((event_id * 7919) % 61 - 15) + event_id % 7 AS sched_dep",
        "CASE WHEN event_id % 5 = 0 THEN NULL ELSE arr_min END AS actual_arr",
        "CASE WHEN event_id % 6 = 0 THEN NULL ELSE arr_min + (event_id * 31) % 19 END AS actual_dep",
    )


STOPS_SQL = f"""
e AS (SELECT event_id, user_id, value, epoch_us(ts) AS us FROM events),
b AS (SELECT *, CAST(floor((floor(us / 86400000000.0) - {FIRST_DAY}) / {BLOCK_DAYS}.0) AS BIGINT) AS blk FROM e),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, blk ORDER BY us, event_id) AS BIGINT) - 1 AS stop_idx,
             CAST(floor((us - ({FIRST_DAY} + blk * {BLOCK_DAYS}) * 86400000000) / 60000000.0) AS BIGINT) AS arr_min FROM b),
stops AS (SELECT concat(CAST(user_id AS VARCHAR), '_', CAST(blk AS VARCHAR)) AS instance_id, blk, stop_idx, user_id, event_id,
             CAST(event_id % {STATIONS} AS BIGINT) AS station_id,
             arr_min - ((event_id * 7919) % 61 - 15) AS sched_arr,
             arr_min - ((event_id * 7919) % 61 - 15) + event_id % 7 AS sched_dep,
             CASE WHEN event_id % 5 = 0 THEN NULL ELSE arr_min END AS actual_arr,
             CASE WHEN event_id % 6 = 0 THEN NULL ELSE arr_min + (event_id * 31) % 19 END AS actual_dep FROM r)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed events at a station: (event_id, key, start_min, end_min or null, value), minutes since 1970."""
    e = table(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')")
    return e.selectExpr(
        "event_id",
        f"event_id % {STATIONS} AS key",
        f"{micros('ts')} / 60000000D AS start_min",
        f"CASE WHEN event_id % 9 = 0 THEN NULL ELSE {micros('ts')} / 60000000D + value END AS end_min",
        "value",
    )


INTERVALS_SQL = f"""
intervals AS (SELECT event_id, event_id % {STATIONS} AS key, epoch_us(ts) / 60000000.0::DOUBLE AS start_min,
              CASE WHEN event_id % 9 = 0 THEN NULL ELSE epoch_us(ts) / 60000000.0::DOUBLE + value END AS end_min, value
              FROM events WHERE event_type IN ('error', 'purchase'))"""


def reveal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and the minute at which each became known."""
    e = table(spark, sf_dir, "events")
    return e.selectExpr("user_id", "event_id", "value", f"{micros('ts')} / 60000000D AS event_min", f"{micros('ts')} / 60000000D + event_id % 13 AS reveal_min")


REVEAL_SQL = """
reveal_log AS (SELECT user_id, event_id, value, epoch_us(ts) / 60000000.0::DOUBLE AS event_min,
               epoch_us(ts) / 60000000.0::DOUBLE + event_id % 13 AS reveal_min FROM events)"""


def sections(spark: SparkSession) -> DataFrame:
    """The generated line: neighbouring stations are joined."""
    return spark.range(STATIONS - 1).selectExpr("id AS a", "id + 1 AS b", "5.0D + id % 7 AS km")


SECTIONS_SQL = f"sections AS (SELECT i AS a, i + 1 AS b, (5.0 + i % 7)::DOUBLE AS km FROM range({STATIONS - 1}) t(i))"
