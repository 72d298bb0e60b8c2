"""Queries of streams over the events, of clocks and of replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import joins
from waymark.plans.book import query
from waymark.sources import fixtures as fx
from waymark.sources import sinks
from waymark.sources.fixtures import REVEAL_SQL, STOPS_SQL, table
from waymark.streaming import feeds, timers

START = 28423440  # 2024-01-16 in minutes since 1970


@query(
    "H2_changed_keys",
    f"""WITH {REVEAL_SQL} SELECT 'event' AS clock, user_id FROM reveal_log WHERE event_min > {START} AND event_min <= {START + 60} UNION SELECT 'write', user_id FROM reveal_log
    WHERE reveal_min > {START} AND reveal_min <= {START + 60}""",
)
def _(spark, d):
    log = fx.reveal_log(spark, d)
    keys = lambda name, c: log.where(f"{c} > {START} AND {c} <= {START + 60}").select(F.lit(name).alias("clock"), "user_id").distinct()
    return keys("event", "event_min").unionByName(keys("write", "reveal_min"))


@query("H3_lookback_overlap", "SELECT event_id, user_id, value FROM events")
def _(spark, d):
    # every file is read twice, as two reads that overlap would
    one, two = (feeds.event_stream(spark, d).select("event_id", "user_id", "value", "ts") for _ in range(2))
    return feeds.read_with_overlap(one.union(two), "ts", ["event_id"], "15 minutes").select("event_id", "user_id", "value")


@query(
    "H4_auto_clock",
    f"""WITH {REVEAL_SQL}, t AS (SELECT max(event_min) AS newest_event, max(reveal_min) AS newest_write
    FROM reveal_log) SELECT *, CASE WHEN newest_write - newest_event > 1440 THEN 'event' ELSE 'write' END AS clock FROM t""",
)
def _(spark, d):
    return feeds.auto_clock(fx.reveal_log(spark, d), "event_min", "reveal_min", 1440.0)


@query("H5_tick_windows", "SELECT event_type, (epoch_us(ts) // 180000000) * 3 AS tick_min, count(*) AS n, max(value) AS most FROM events GROUP BY ALL")
def _(spark, d):
    return feeds.tick_windows(feeds.event_stream(spark, d), "ts", ["event_type"], 3, "15 minutes", n=F.count("*"), most=F.max("value"))


@query("H7_keyed_memory", "SELECT user_id, count(*) AS n, max(value) AS most, arg_max(value, ts) AS last_value FROM events GROUP BY user_id")
def _(spark, d):
    return feeds.keyed_memory(feeds.event_stream(spark, d), ["user_id"], n=F.count("*"), most=F.max("value"), last_value=F.max_by("value", "ts"))


# a station's load in three hours is its events over three; memory begins anew each day and moves on where no event is
TICK_MIN, CAPACITY = 180, 3.0


@query(
    "H7_advancing_memory",
    f"""WITH e AS (SELECT event_id % {fx.STATIONS} AS station_id, epoch_us(ts) // 1000 AS ms FROM events), c AS (SELECT station_id, ms // {TICK_MIN * 60000} AS tick, count(*) AS n FROM e GROUP BY ALL),
    k AS (SELECT station_id, min(tick) * {TICK_MIN} // 1440 * 1440 // {TICK_MIN} AS first_tick FROM c GROUP BY 1), w AS (SELECT max(ms) // {TICK_MIN * 60000} AS open_tick FROM e),
    sp AS (SELECT station_id, unnest(range(first_tick, open_tick)) AS tick FROM k, w),
    s AS (SELECT station_id, tick, n IS NOT NULL AS seen, least(1, coalesce(n, 0) / {CAPACITY}) AS load, coalesce(n, 0) / {CAPACITY} > 0.85 AS critical, tick * {TICK_MIN} // 1440 AS day
      FROM sp LEFT JOIN c USING (station_id, tick)),
    m AS (SELECT *, coalesce(lag(load) OVER d, 0) AS congestion, row_number() OVER d - 1 AS i, max(tick) FILTER (critical) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM s
      WINDOW d AS (PARTITION BY station_id, day ORDER BY tick))
    SELECT station_id, tick, round(congestion, 6) AS congestion, round(0.7 * congestion + 0.3 * load, 6) AS mixed, least(20, coalesce(tick - hit - 1, i)) AS since_critical, seen FROM m""",
)
def _(spark, d):
    stream = feeds.event_stream(spark, d).withColumn("station_id", F.col("event_id") % fx.STATIONS)
    kept = timers.advancing_memory(stream, ["station_id"], "ts", F.lit(1.0), TICK_MIN, capacity=CAPACITY)
    return kept.select("station_id", "tick", F.round("congestion", 6).alias("congestion"), F.round("mixed", 6).alias("mixed"), "since_critical", "seen")


WARN, CRITICAL = 60, 120


@query(
    "H9_silence_alarm",
    f"""WITH e AS (SELECT DISTINCT event_type, epoch_us(ts) // 1000 AS ms FROM events), w AS (SELECT max(ms) AS now FROM e),
    g AS (SELECT event_type, ms, coalesce(lead(ms) OVER (PARTITION BY event_type ORDER BY ms), now) - ms AS gap FROM e, w), l AS (SELECT * FROM (VALUES ('warn', {WARN}), ('critical', {CRITICAL})) v(level, minutes))
    SELECT event_type, ms AS newest_ms, level, ms + minutes * 60000 AS alarm_ms FROM g JOIN l ON gap >= minutes * 60000""",
)
def _(spark, d):
    return timers.silence_log(feeds.event_stream(spark, d), ["event_type"], "ts", {"warn": WARN, "critical": CRITICAL})


@query(
    "H9_staleness",
    """WITH m AS (SELECT epoch_us(ts) // 60000000 AS minute, count(*) AS n FROM events GROUP BY 1), g AS (SELECT *, minute - lag(minute) OVER (ORDER BY minute) AS gap FROM m)
    SELECT minute, gap, n, CASE WHEN gap >= 30 THEN 'critical' ELSE 'warn' END AS level FROM g WHERE gap >= 12""",
)
def _(spark, d):
    return feeds.staleness(table(spark, d, "events"), F.expr(f"floor({fx.micros('ts')} / 60000000D)"), 12, 30)


@query(
    "H10_replay_as_of",
    f"""WITH {REVEAL_SQL}, t AS (SELECT {START} + i * 3.0::DOUBLE AS now FROM range(20) r(i))
    SELECT user_id, now, max(value) AS value FROM reveal_log JOIN t ON reveal_min <= now GROUP BY ALL""",
)
def _(spark, d):
    log = fx.reveal_log(spark, d)
    ticks = F.explode(F.expr(f"transform(sequence(0, 19), i -> {START} + i * 3.0D)")).alias("now")
    return joins.observations_as_of_many(log, log.select("user_id").distinct().select("user_id", ticks), ["user_id"], "reveal_min", "value", "now")


# the events come in as four files, by the minute in which they were written; every ninth is written two days late
PARTS, DELAY = 4, "cast((event_id % 9 = 0) as int) * 2880"


@query(
    "H11_late_corrections",
    f"""WITH ar AS (SELECT event_id, event_type, ts, epoch_us(ts) // 60000000 + (event_id % 9 = 0)::INT * 2880 AS seen FROM events),
    sz AS (SELECT min(seen) AS lo, max(seen) - min(seen) + 1 AS span FROM ar), pt AS (SELECT *, (seen - lo) * {PARTS} // span AS part FROM ar, sz),
    wm AS (SELECT p.part, (SELECT max(ts) FROM pt q WHERE q.part < p.part - 1) - INTERVAL 720 MINUTE AS mark FROM (SELECT DISTINCT part FROM pt) p),
    lw AS (SELECT p.*, mark IS NULL OR make_timestamp(((epoch_us(ts) // 10800000000) + 1) * 10800000000) > mark AS taken FROM pt p JOIN wm USING (part))
    SELECT event_type, (epoch_us(ts) // 10800000000) * 180 AS tick_min, count(*) AS n, count(*) FILTER (taken) AS streamed, count(*) FILTER (NOT taken) AS lost FROM lw GROUP BY ALL""",
)
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "ts").withColumn("seen", F.expr(f"CAST(floor({fx.micros('ts')} / 60000000D) AS BIGINT) + {DELAY}"))
    span = e.agg(F.min("seen").alias("lo"), (F.max("seen") - F.min("seen") + 1).alias("span"))
    dealt = e.join(span, how="left").withColumn("part", F.expr(f"CAST(floor((seen - lo) * {PARTS} / span) AS INT)"))  # one row
    folder = sinks.shared_folder(spark, "arrivals")
    for part in range(PARTS):  # one after another, as the source takes files by their age
        dealt.where(F.col("part") == part).select("event_id", "event_type", "ts").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    stream = feeds.event_stream(spark, folder, maxFilesPerTrigger="1")
    return feeds.late_corrections(stream, e, "ts", ["event_type"], 180, "720 minutes")


# records of trips as known at a moment, brought up to date for those that changed after it
REBUILT = 4000


def build_trips(stops):
    """A record per trip of at least three observed stops."""
    seen = F.coalesce("actual_arr", "actual_dep")
    trips = stops.groupBy("instance_id").agg(F.count("*").alias("n"), F.count(seen).alias("observed"), F.max(seen).alias("newest"), F.max_by("station_id", F.when(seen.isNotNull(), F.col("stop_idx"))).alias("place"))
    return trips.where("observed >= 3")


@query(
    "H6_incremental_rebuild",
    f"""WITH {STOPS_SQL}, ob AS (SELECT *, coalesce(actual_arr, actual_dep) AS seen FROM stops)
    SELECT instance_id, count(*) AS n, count(seen) AS observed, max(seen) AS newest, arg_max(station_id, stop_idx) FILTER (seen IS NOT NULL) AS place FROM ob GROUP BY 1
      HAVING count(seen) >= 3""",
)
def _(spark, d):
    now = fx.stops(spark, d)
    known = lambda c: F.when(F.col(c) <= REBUILT, F.col(c)).alias(c)
    before = now.select(*(c for c in now.columns if c not in ("actual_arr", "actual_dep")), known("actual_arr"), known("actual_dep"))
    cache = sinks.written(build_trips(before), "trips")
    changed = now.where(f"actual_arr > {REBUILT} OR actual_dep > {REBUILT}").select("instance_id")
    return feeds.incremental_rebuild(cache, changed, now, build_trips, ["instance_id"])


@query(
    "H12_forecast_sink",
    """SELECT user_id, epoch_us(ts) // 43200000000 AS tick, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, tick ORDER BY event_id) = 1""",
)
def _(spark, d):
    stream = feeds.event_stream(spark, d).select("user_id", F.floor(F.unix_micros("ts") / 43200000000).cast("long").alias("tick"), "event_id", "value")
    return feeds.forecast_sink(stream, ["user_id", "tick"], [F.col("event_id")])


@query(
    "Q5_reveal_mask_audit",
    f"""WITH {REVEAL_SQL}, t AS (SELECT {START} + i * 360.0::DOUBLE AS now FROM range(8) r(i))
    SELECT now, count(*) FILTER (reveal_min <= now) AS known, count(*) FILTER (event_min <= now AND reveal_min > now) AS masked,
      max(reveal_min) FILTER (reveal_min <= now) <= now AS clean
      FROM reveal_log CROSS JOIN t GROUP BY now""",
)
def _(spark, d):
    # every row is counted at the first instant that knows it, then the few instants are summed up
    now = lambda c: F.greatest(F.lit(0), F.ceil((F.col(c) - START) / 360.0)).cast("long")
    log = fx.reveal_log(spark, d).select(now("event_min").alias("e"), now("reveal_min").alias("r"), "reveal_min")
    counts = log.groupBy("e", "r").agg(F.count("*").alias("n"), F.max("reveal_min").alias("newest"))
    at = F.explode(F.sequence(F.col("e"), F.lit(7).cast("long")))
    seen = counts.where("e <= 7").select("*", at.alias("i"))
    known = F.col("r") <= F.col("i")
    per = seen.groupBy("i").agg(
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("masked"), F.max(F.when(known, F.col("newest"))).alias("newest")
    )
    instant = START + F.col("i") * 360.0
    return per.select(instant.alias("now"), "known", "masked", (F.col("newest") <= instant).alias("clean"))
