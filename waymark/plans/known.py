"""Queries on what can be known at a moment."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import known
from waymark.plans.book import query
from waymark.sources.fixtures import INTERVALS_SQL, STOPS_SQL, intervals, stops

NOW, CLOCK = 4000, 28431360.0  # minutes of a block, and since 1970


@query(
    "E25_known_movements",
    f"""WITH {STOPS_SQL}, kn AS (SELECT instance_id, stop_idx, station_id, sched_arr, sched_dep, CASE WHEN actual_arr <= {NOW} THEN actual_arr END AS a, CASE WHEN actual_dep <= {NOW} THEN actual_dep END AS d FROM stops),
    nx AS (SELECT k.*, n.station_id AS next_station, n.a AS na, n.sched_arr AS ns FROM kn k LEFT JOIN kn n ON n.instance_id = k.instance_id AND n.stop_idx = k.stop_idx + 1),
    iv AS (SELECT instance_id, stop_idx, 'station' AS kind, station_id, NULL::BIGINT AS next_station,
      CASE WHEN a IS NOT NULL THEN a WHEN sched_arr > {NOW} AND sched_arr <= {NOW + 240} THEN sched_arr END AS s,
      CASE WHEN a IS NOT NULL THEN coalesce(d, greatest(a + 37, {NOW})) WHEN sched_dep > sched_arr THEN sched_dep ELSE sched_arr + 37 END AS e FROM nx
    UNION ALL SELECT instance_id, stop_idx, 'section', station_id, next_station, CASE WHEN d IS NOT NULL THEN d WHEN sched_dep > {NOW} AND sched_dep <= {NOW + 240} THEN sched_dep END,
      CASE WHEN d IS NOT NULL THEN coalesce(na, greatest(d + 17, {NOW})) WHEN ns > sched_dep THEN ns ELSE sched_dep + 17 END FROM nx WHERE next_station IS NOT NULL)
    SELECT instance_id, stop_idx, kind, station_id, next_station, s::DOUBLE AS start, e::DOUBLE AS "end" FROM iv WHERE e > s""",
)
def _(spark, d):
    return known.known_movements(stops(spark, d), F.lit(NOW).cast("long"))


# an interval's end is when a closure was cleared; it was permitted for half an hour, or for no stated time
@query(
    "E25_known_closures",
    f"""WITH {INTERVALS_SQL}, pl AS (SELECT event_id, key, start_min AS start, CASE WHEN event_id % 4 <> 0 THEN start_min + 30 END AS permitted_end, end_min AS cleared FROM intervals),
    en AS (SELECT *, CASE WHEN cleared <= {CLOCK}::DOUBLE THEN cleared WHEN start <= {CLOCK}::DOUBLE THEN greatest(coalesce(permitted_end, start),
      {CLOCK}::DOUBLE) ELSE coalesce(permitted_end, start) END AS "end"
      FROM pl)
    SELECT event_id, key, start, "end" FROM en WHERE "end" > start""",
)
def _(spark, d):
    i = intervals(spark, d).select("event_id", "key", F.col("start_min").alias("start"), F.when(F.col("event_id") % 4 != 0, F.col("start_min") + 30).alias("permitted_end"), F.col("end_min").alias("cleared"))
    return known.known_closures(i, F.lit(CLOCK)).select("event_id", "key", "start", "end")


@query(
    "E25_known_failures",
    f"""WITH {INTERVALS_SQL}, en AS (SELECT event_id, key, start_min AS start, least(coalesce(end_min, {CLOCK}::DOUBLE), {CLOCK}::DOUBLE) AS "end" FROM intervals WHERE start_min <= {CLOCK}::DOUBLE)
    SELECT * FROM en WHERE "end" > start""",
)
def _(spark, d):
    i = intervals(spark, d).select("event_id", "key", F.col("start_min").alias("start"), F.col("end_min").alias("finish"))
    return known.known_failures(i, F.lit(CLOCK)).select("event_id", "key", "start", "end")
