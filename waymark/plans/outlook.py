"""Queries on forecasts by the timetable and on reports of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import outlook as o
from waymark.operators import sequence as seq
from waymark.plans.book import query
from waymark.plans.scores import SCORED_SQL, rounded, scored
from waymark.plans.trips import TICK, positions_sql, seen, seen_at, timed
from waymark.sources.fixtures import BLOCK_DAYS, FIRST_DAY, stops

T0, HORIZON = 2880, 2880


def persist_sql(scored: str = "") -> str:
    return f"""{positions_sql(TICK)},
f1 AS (SELECT instance_id, arg_min(delay, tick * 1000 + stop_idx) AS persist, arg_min(stop_idx, tick * 1000 + stop_idx) AS takeover FROM seen WHERE tick >= {T0} GROUP BY instance_id),
held AS (SELECT f1.instance_id, t.stop_idx AS k, persist, takeover, t.stop_idx - takeover AS hop, arr_delay AS actual FROM f1
  JOIN timed t ON t.instance_id = f1.instance_id AND t.stop_idx > takeover WHERE arr_delay IS NOT NULL{scored})"""


PERSIST_SQL = persist_sql()


def persisted(spark, d):
    return o.persistence(seen(spark, d), timed(spark, d), T0)


@query("E33_persistence", f"{PERSIST_SQL} SELECT instance_id, k, persist, hop, actual FROM held")
def _(spark, d):
    return persisted(spark, d).select("instance_id", "k", "persist", "hop", "actual")


# arrivals from a list of all that lies before them
def projected_sql(persist: str) -> str:
    return f"""{persist},
p0 AS (SELECT *, greatest(arr + greatest(0, sched_dep - sched_arr), {T0}) AS leaves FROM seen WHERE tick = {T0}),
w0 AS (SELECT instance_id, stop_idx AS k0, CASE WHEN mode = 'at_station' THEN leaves - sched_dep ELSE delay END AS held,
  CASE WHEN mode = 'at_station' THEN leaves ELSE dep END AS gone
  FROM p0),
pk AS (SELECT s.instance_id, s.stop_idx AS k, k0, held, gone, s.sched_arr, s.station_id, (SELECT x.station_id FROM stops x
  WHERE x.instance_id = s.instance_id AND x.stop_idx = s.stop_idx - 1) AS prev_station,
         (SELECT list(greatest(x.sched_arr, x.sched_dep) + held) FROM stops x WHERE x.instance_id = s.instance_id AND x.stop_idx > k0 AND x.stop_idx < s.stop_idx) AS before
       FROM stops s JOIN w0 ON w0.instance_id = s.instance_id AND s.stop_idx > k0),
pa AS (SELECT *, greatest(sched_arr + held, gone, coalesce(list_max(before), gone)) AS arr FROM pk),
pc AS (SELECT *, NOT EXISTS (SELECT 1 FROM pa b WHERE b.instance_id = pa.instance_id AND b.k <= pa.k AND b.arr > {T0 + HORIZON}) AS keep FROM pa),
projected AS (SELECT instance_id, k, k - k0 AS hop, arr, arr - sched_arr AS delay, arr - {T0} AS lead_min, prev_station, station_id, sched_arr FROM pc WHERE keep)"""


# E34 and B24 read nothing of the persistence
PROJECTED_SQL = projected_sql(persist_sql(" AND t.station_id >= 2 AND t.user_id % 10 <> 0"))


def projected(spark, d):
    return o.booked_projection(seen_at(spark, d, T0), stops(spark, d), T0, HORIZON)


@query("E34_booked_projection", f"{PROJECTED_SQL} SELECT instance_id, k, hop, arr, delay, lead_min FROM projected")
def _(spark, d):
    return projected(spark, d).select("instance_id", "k", "hop", "arr", "delay", "lead_min")


@query(
    "B24_forecast_projection",
    f"""{PROJECTED_SQL} SELECT p.instance_id, p.k, hop, lead_min, delay, prev_station::VARCHAR || '-' || p.station_id::VARCHAR AS block_section, p.sched_arr AS minutes_from_start,
    strftime(TIMESTAMP '1970-01-01' + to_days(({FIRST_DAY} + blk * {BLOCK_DAYS})::INT) + to_minutes(p.sched_arr), '%Y-%m-%d %H:%M') AS sched_arr_ts,
    strftime(TIMESTAMP '1970-01-01' + to_days(({FIRST_DAY} + blk * {BLOCK_DAYS})::INT) + to_minutes(s.actual_arr), '%Y-%m-%d %H:%M') AS actual_arr_ts
    FROM projected p JOIN stops s ON s.instance_id = p.instance_id AND s.stop_idx = p.k""",
)
def _(spark, d):
    truth = stops(spark, d).select("instance_id", F.col("stop_idx").alias("k"), "actual_arr", "blk")
    base = F.expr(f"timestampadd(DAY, {FIRST_DAY} + blk * {BLOCK_DAYS}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    rows = o.forecast_rows(projected(spark, d), truth, base)
    return rows.select("instance_id", "k", "hop", "lead_min", "delay", "block_section", "minutes_from_start", text("sched_arr_ts"), text("actual_arr_ts"))


@query(
    "E35_scenario_class",
    f"""{SCORED_SQL}, pt AS (SELECT instance_id, count(*) AS n_forecasts, max(actual - persist) AS up, max(persist - actual) AS down, max(abs(actual - persist)) AS most FROM scored GROUP BY 1),
    cl AS (SELECT instance_id, n_forecasts, CASE WHEN up > 30 THEN 'SPIKE' WHEN down > 30 THEN 'RECOVERY' WHEN most < 10 THEN 'STEADY' ELSE 'MODERATE' END AS class FROM pt),
    rk AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n_forecasts DESC, instance_id) AS r, list_position(['SPIKE', 'RECOVERY', 'MODERATE', 'STEADY'], class) AS c FROM cl),
    pi AS (SELECT *, row_number() OVER (ORDER BY r, c) AS pick FROM rk)
    SELECT instance_id, n_forecasts, class, CASE WHEN pick <= 12 THEN pick END AS pick FROM pi""",
)
def _(spark, d):
    return o.scenario_class(scored(spark, d), 12)


REPORT_SQL = f"""{projected_sql(PERSIST_SQL)}, js AS (SELECT p.instance_id, p.k, h.hop, p.delay AS pred, h.actual, h.persist FROM projected p JOIN held h ON h.instance_id = p.instance_id AND h.k = p.k)"""


def compared(spark, d):
    """Projections beside what happened and persistence, with the hops since the takeover."""
    p = projected(spark, d).select("instance_id", "k", F.col("delay").alias("pred"))
    return p.join(persisted(spark, d).select("instance_id", "k", "hop", "actual", "persist"), ["instance_id", "k"])


def _clock(x):
    return f"lpad((({x} % 1440 + 1440) % 1440 // 60)::VARCHAR, 2, '0') || ':' || lpad((({x} % 1440 + 1440) % 60)::VARCHAR, 2, '0')"


@query(
    "E36_journey_report",
    f"""{REPORT_SQL}, tk AS (SELECT instance_id, min(k - hop) AS t FROM js GROUP BY 1),
    bs AS (SELECT instance_id, stop_idx AS k, station_id, {_clock('sched_arr')} AS booked, {_clock('actual_arr')} AS seen, actual_arr, arr_delay FROM timed)
    SELECT b.instance_id, b.k, station_id, 'observed' AS part, booked, seen, arr_delay AS delay, NULL::BIGINT AS pred, NULL::BIGINT AS error,
      trim(CASE WHEN actual_arr IS NULL THEN 'not reported ' ELSE '' END || CASE WHEN k = t THEN '<== NOW' ELSE '' END) AS note FROM bs b JOIN tk USING (instance_id) WHERE k <= t
    UNION ALL SELECT j.instance_id, j.k, station_id, 'forecast', booked, seen, actual, pred, pred - actual,
      CASE WHEN actual - persist > 30 AND pred - actual > -15 THEN 'SPIKE' WHEN actual - persist > 30 THEN 'SPIKE MISSED' WHEN persist - actual > 30 THEN 'recovery' ELSE '' END
        FROM js j JOIN bs USING (instance_id, k)""",
)
def _(spark, d):
    return o.journey_report(seq.carry_forward(stops(spark, d)), compared(spark, d))


@query(
    "E36_journey_summary",
    f"""{REPORT_SQL} SELECT instance_id, count(*) AS n, round(avg(abs(pred - actual)), 6) AS mae, round(avg(abs(persist - actual)), 6) AS persist_mae,
    round(avg(abs(persist - actual)) - avg(abs(pred - actual)), 6) AS gain
    FROM js GROUP BY 1""",
)
def _(spark, d):
    return rounded(o.journey_summary(compared(spark, d)), "mae", "persist_mae", "gain")


FIDELITY = ["delay", "next_slack", "slack_ahead", "stop_idx"]


@query(
    "D32_state_fidelity",
    f"""{positions_sql(TICK)}, la AS (SELECT instance_id AS i, stop_idx AS s, coalesce(lead(sched_dep - sched_arr) OVER t, 0) AS next_slack,
      coalesce(sum(sched_dep - sched_arr) OVER (PARTITION BY instance_id ORDER BY stop_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS slack_ahead
        FROM stops WINDOW t AS (PARTITION BY instance_id ORDER BY stop_idx)),
    wa AS (SELECT CASE WHEN mode = 'at_station' THEN greatest(delay, tick - sched_dep) ELSE delay END AS held, delay, next_slack, slack_ahead, stop_idx FROM seen
      JOIN la ON i = instance_id AND s = stop_idx),
    dm AS (SELECT 'delay' AS "column", avg(delay) AS mean_a, avg(held) AS mean_b FROM wa UNION ALL """
    + " UNION ALL ".join(f"SELECT '{c}', avg({c}), avg({c}) FROM wa" for c in FIDELITY[1:])
    + """), dr AS (SELECT *, CASE WHEN abs(mean_b) > 1e-6 THEN mean_a / mean_b WHEN abs(mean_a) < 1e-6 THEN 1 ELSE 99 END AS ratio FROM dm)
    SELECT "column", round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(ratio, 6) AS ratio, abs(ratio - 1) > 0.25 AS drift FROM dr
      ORDER BY abs(ratio - 1) DESC, "column" DESC LIMIT 3""",
)
def _(spark, d):
    at = seq.position_at(seq.look_ahead(timed(spark, d)), TICK)
    return rounded(o.state_fidelity(seq.delay_now(at), seq.delay_now(at, hold=True), FIDELITY, k=3), "mean_a", "mean_b", "ratio")


