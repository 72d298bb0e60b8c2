"""Queries that complete one source of times from another."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import fills
from waymark.plans.book import query
from waymark.plans.scores import rounded
from waymark.sources.fixtures import BLOCK_DAYS, FIRST_DAY, STOPS_SQL, stops

EARLIEST, LATEST = "2024-01-01 00:00:00", "2024-03-01 00:00:00"
#: Minutes a stop; stops of these trips are hours apart.
PACE = 900
# the second source: late by a day and a half or early at some stops, day and month exchanged or nothing known at others
OTHER = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 97 = 0 THEN {m} + 2160 WHEN event_id % 89 = 0 THEN {m} - 300 WHEN event_id % 83 = 0 THEN {m} + 45 ELSE {m} END"
SWAPPED = "event_id % 11 = 0"


def two_sources(spark, d):
    """A row per stop and field of both sources, as timestamps; the second has what the first lacks."""
    s = stops(spark, d)
    # minutes of every stop, also of those whose times the first source lacks
    m = {"arrival": "coalesce(actual_arr, sched_arr + (event_id * 7919) % 61 - 15)", "departure": "coalesce(actual_dep, sched_arr + (event_id * 7919) % 61 - 15 + (event_id * 31) % 19)"}
    base = F.expr(f"timestampadd(DAY, {FIRST_DAY} + blk * {BLOCK_DAYS}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    ts = lambda minutes: F.timestamp_add("MINUTE", minutes, base)

    def second(field):
        v = ts(F.expr(OTHER.format(m=m[field])))
        swapped = fills.swap_day_month(v)
        return F.when(F.expr(SWAPPED), F.coalesce(swapped, v)).otherwise(v)

    own = {"arrival": ts(F.col("actual_arr")), "departure": ts(F.col("actual_dep"))}
    latest = {"arrival": second("departure"), "departure": F.lit(None).cast("timestamp_ntz")}
    cells = F.array(*(F.struct(F.lit(f).alias("field"), own[f].alias("own"), second(f).alias("other"), latest[f].alias("latest")) for f in ("arrival", "departure")))
    return s.select("instance_id", "stop_idx", "user_id", F.inline(cells))


def _swap(x):
    return f"CASE WHEN day({x}) <= 12 THEN make_timestamp(year({x}), day({x}), month({x}), hour({x}), minute({x}), second({x})::DOUBLE) END"


def _moment(minutes):
    return f"(TIMESTAMP '1970-01-01' + to_days(({FIRST_DAY} + blk * {BLOCK_DAYS})::INT) + to_minutes(({minutes})::BIGINT))"


TWO_SQL = f"""{STOPS_SQL},
mm AS (SELECT *, coalesce(actual_arr, sched_arr + (event_id * 7919) % 61 - 15) AS ma, coalesce(actual_dep, sched_arr + (event_id * 7919) % 61 - 15 + (event_id * 31) % 19) AS md FROM stops),
oo AS (SELECT *, {_moment(OTHER.format(m='ma'))} AS oa0, {_moment(OTHER.format(m='md'))} AS od0 FROM mm),
op AS (SELECT *, CASE WHEN {SWAPPED} THEN coalesce({_swap('oa0')}, oa0) ELSE oa0 END AS oa, CASE WHEN {SWAPPED} THEN coalesce({_swap('od0')}, od0) ELSE od0 END AS od FROM oo),
two AS (SELECT instance_id, stop_idx, user_id, 'arrival' AS field, {_moment('actual_arr')} AS own, oa AS other, od AS latest FROM op
        UNION ALL SELECT instance_id, stop_idx, user_id, 'departure', {_moment('actual_dep')}, od, NULL FROM op),
sp AS (SELECT instance_id, min(own) - INTERVAL 1 DAY AS lo, max(own) + INTERVAL 1 DAY AS hi FROM two GROUP BY 1),
nb AS (SELECT t.*, lo, hi, (SELECT max(x.stop_idx) FROM two x WHERE x.instance_id = t.instance_id AND x.field = t.field AND x.stop_idx < t.stop_idx AND x.own IS NOT NULL) AS pk,
         (SELECT min(x.stop_idx) FROM two x WHERE x.instance_id = t.instance_id AND x.field = t.field AND x.stop_idx > t.stop_idx AND x.own IS NOT NULL) AS nk,
         (SELECT max(x.stop_idx) FROM two x WHERE x.instance_id = t.instance_id AND x.field = t.field AND x.stop_idx < t.stop_idx AND x.other IS NOT NULL) AS pr,
         (SELECT min(x.stop_idx) FROM two x WHERE x.instance_id = t.instance_id AND x.field = t.field AND x.stop_idx > t.stop_idx AND x.other IS NOT NULL) AS nr
       FROM two t JOIN sp USING (instance_id)),
nv AS (SELECT n.*, a.own AS pv, b.own AS nxv, c.other AS prv, e.other AS nrv FROM nb n
       LEFT JOIN two a ON a.instance_id = n.instance_id AND a.field = n.field AND a.stop_idx = pk LEFT JOIN two b ON b.instance_id = n.instance_id AND b.field = n.field AND b.stop_idx = nk
       LEFT JOIN two c ON c.instance_id = n.instance_id AND c.field = n.field AND c.stop_idx = pr LEFT
         JOIN two e ON e.instance_id = n.instance_id AND e.field = n.field AND e.stop_idx = nr)"""
CHECKED_SQL = f"""WITH {TWO_SQL},
ck AS (SELECT instance_id, stop_idx, user_id, field, CASE WHEN other > latest THEN 'after_latest' WHEN other < lo OR other > hi THEN 'outside_span' WHEN other < pv THEN 'before_previous' WHEN other > nxv THEN 'after_next'
         WHEN abs(epoch(other - pv)) / 60 > {PACE} * (stop_idx - pk) OR abs(epoch(other - nxv)) / 60 > {PACE} * (nk - stop_idx) THEN 'implausible_pace'
         WHEN other < prv OR other > nrv THEN 'out_of_order' END AS reason
       FROM nv WHERE own IS NULL AND other IS NOT NULL AND lo IS NOT NULL)"""


def checked(spark, d):
    return fills.fill_checks(two_sources(spark, d), "instance_id", "field", "stop_idx", pace=PACE)


@query("E20_validate_fill", f"{CHECKED_SQL} SELECT instance_id, stop_idx, field, reason FROM ck")
def _(spark, d):
    return checked(spark, d).select("instance_id", "stop_idx", "field", "reason")


@query(
    "D31_rejection_summary",
    f"""{CHECKED_SQL}, na AS (SELECT field, coalesce(reason, 'accepted') AS reason FROM ck)
    SELECT coalesce(field, 'all') AS field, coalesce(reason, 'all') AS reason, count(*) AS n, round(count(*) FILTER (reason = 'accepted') / count(*), 6) AS accepted_share
      FROM na GROUP BY ROLLUP (field, reason)""",
)
def _(spark, d):
    return rounded(fills.rejection_summary(checked(spark, d), "field"), "accepted_share")


@query("D31_top_beneficiaries", f"{CHECKED_SQL} SELECT user_id, count(*) AS gained FROM ck WHERE reason IS NULL GROUP BY user_id ORDER BY gained DESC, user_id LIMIT 12")
def _(spark, d):
    return fills.top_beneficiaries(checked(spark, d), "user_id")


def _fits(v):
    return f"""({v} BETWEEN TIMESTAMP '{EARLIEST}' AND TIMESTAMP '{LATEST}' AND {v} BETWEEN lo AND hi AND coalesce({v} >= last, true) AND coalesce({v} <= nxv, true)
      AND coalesce({v} >= prv, true) AND coalesce({v} <= nrv, true) AND coalesce(abs(epoch({v} - last)) / 60 <= {PACE} * hops,
        true) AND coalesce(abs(epoch({v} - nxv)) / 60 <= {PACE} * (nk - s.stop_idx), true))"""


@query(
    "E19_fill_from_reference",
    f"""WITH RECURSIVE {TWO_SQL}, sw AS (SELECT *, {_swap('other')} AS swapped FROM nv),
    go AS (SELECT instance_id, field, -1::BIGINT AS stop_idx, NULL::TIMESTAMP AS last, 1 AS hops, NULL::TIMESTAMP AS filled, ''::VARCHAR AS origin
      FROM (SELECT DISTINCT instance_id, field FROM sw)
      UNION ALL
      SELECT instance_id, field, stop_idx, CASE WHEN filled IS NOT NULL THEN filled ELSE last END, CASE WHEN filled IS NOT NULL THEN 1 ELSE hops + 1 END, filled, origin FROM (
        SELECT *, CASE origin WHEN 'own' THEN own WHEN 'other' THEN other WHEN 'repaired' THEN swapped END AS filled FROM (
          SELECT s.instance_id, s.field, s.stop_idx, g.last, g.hops, s.own, s.other, s.swapped,
            CASE WHEN own IS NOT NULL THEN 'own' WHEN other IS NULL OR lo IS NULL THEN 'none' WHEN {_fits('other')} THEN 'other' WHEN swapped IS NULL THEN 'unrepairable' WHEN {_fits('swapped')} THEN 'repaired' ELSE 'rejected' END AS origin
          FROM go g JOIN sw s ON s.instance_id = g.instance_id AND s.field = g.field AND s.stop_idx = g.stop_idx + 1)))
    SELECT instance_id, field, stop_idx, strftime(filled, '%Y-%m-%d %H:%M') AS filled, origin FROM go WHERE stop_idx >= 0""",
)
def _(spark, d):
    got = fills.fill_from_reference(
        two_sources(spark, d), "instance_id", "field", "stop_idx", F.lit(EARLIEST).cast("timestamp_ntz"), F.lit(LATEST).cast("timestamp_ntz"), pace=PACE
    )
    return got.select("instance_id", "field", "stop_idx", F.date_format("filled", "yyyy-MM-dd HH:mm").alias("filled"), "origin")
