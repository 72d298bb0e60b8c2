"""Queries that audit causality, compare worlds and check tables against their contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import contracts
from waymark.plans.book import query
from waymark.plans.keyed import known_or_planned
from waymark.plans.storage import FORECAST_SQL, codes, forecasts
from waymark.sources import fixtures as fx
from waymark.sources import sinks
from waymark.sources.fixtures import STOPS_SQL, table

NOW, AHEAD, CARRY = 4000, 240, 37
# The pairs of shifts, in minutes, by which two worlds differ.
PAIRS = [(1, 4), (3, 11), (17, 53), (137, 991)]


def shifted(stops, by):
    """The same trips with all that is observed after ``NOW`` moved by ``by`` minutes."""
    later = lambda c: F.when(F.col(c) > NOW, F.col(c) + by).otherwise(F.col(c))
    return stops.withColumns({c: later(c) for c in ("actual_arr", "actual_dep")})


def _world_sql(w):
    """Features as of ``NOW`` and the target in the world shifted by ``w``."""
    late = lambda c: f"CASE WHEN {c} > {NOW} THEN {c} + {w} ELSE {c} END"
    known = lambda c: f"CASE WHEN {late(c)} <= {NOW} THEN {late(c)} END"
    s = f"coalesce({known('actual_arr')}, CASE WHEN sched_arr BETWEEN {NOW} AND {NOW + AHEAD} THEN sched_arr END)"
    e = f"CASE WHEN {known('actual_dep')} IS NOT NULL THEN {known('actual_dep')} WHEN {known('actual_arr')} IS NOT NULL THEN greatest({known('actual_arr')} + {CARRY}, {NOW}) ELSE greatest(sched_dep, {s}) END"
    return f"{s} AS s_{w}, {e} AS e_{w}, {late('actual_arr')} AS t_{w}"


def _cells_sql():
    """A select for each pair and column; both worlds keep a row if it has a start in either."""
    return " UNION ALL ".join(
        f"""SELECT {x} AS shift_a, {y} AS shift_b, '{name}' AS "column", s_x IS NULL OR s_y IS NULL AS lacks, {c}_x AS x, {c}_y AS y
        FROM (SELECT {_world_sql('x')}, {_world_sql('y')} FROM (SELECT *, {x} AS x, {y} AS y FROM stops)) WHERE s_x IS NOT NULL OR s_y IS NOT NULL"""
        for x, y in PAIRS
        for name, c in (("s", "s"), ("e", "e"), ("actual_arr", "t"))
    )


@query(
    "Q1_perturbation_audit",
    f"""WITH {STOPS_SQL}, cells AS ({_cells_sql()})
    SELECT shift_a, shift_b, "column", count(*) AS n, count(*) FILTER (lacks OR x IS DISTINCT FROM y) AS differing, coalesce(max(abs(x - y)), 0)::DOUBLE AS most FROM cells GROUP BY ALL""",
)
def _(spark, d):
    s = fx.stops(spark, d).select("instance_id", "stop_idx", "sched_arr", "sched_dep", "actual_arr", "actual_dep")
    build = lambda world: known_or_planned(world, NOW, AHEAD, CARRY)
    return contracts.perturbation_audit(build, s, shifted, PAIRS, ["instance_id", "stop_idx"], ["s", "e", "actual_arr"])


@query(
    "G4_two_worlds",
    f"""WITH {STOPS_SQL}, j AS (SELECT 'value' AS "column", a.event_id IS NULL OR b.event_id IS NULL AS lacks, a.station_id AS x, b.station_id + (b.event_id % 97 = 0)::BIGINT AS y
      FROM (SELECT * FROM stops WHERE event_id % 10 <> 3) a FULL JOIN (SELECT * FROM stops WHERE event_id % 10 <> 4) b USING (instance_id, stop_idx))
    SELECT "column", count(*) AS n, count(*) FILTER (lacks OR x IS DISTINCT FROM y) AS differing, coalesce(max(abs(x - y)), 0)::DOUBLE AS most FROM j GROUP BY 1""",
)
def _(spark, d):
    s = fx.stops(spark, d)
    a = s.where("event_id % 10 <> 3").selectExpr("instance_id", "stop_idx", "station_id AS value")
    b = s.where("event_id % 10 <> 4").selectExpr("instance_id", "stop_idx", "station_id + CAST(event_id % 97 = 0 AS BIGINT) AS value")
    return contracts.two_worlds(a, b, ["instance_id", "stop_idx"], ["value"])


@query(
    "Q3_contract_check",
    """WITH k AS (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)
    SELECT 'events' AS "table", "check", value FROM (SELECT 'missing_columns' AS "check", 1::BIGINT AS value UNION ALL SELECT 'rows', count(*) FROM events
    UNION ALL SELECT 'longest_key', max(length(user_id::VARCHAR || '|' || event_type)) FROM events
      UNION ALL SELECT 'not_numeric', count(*) FILTER (TRY_CAST(event_type AS DOUBLE) IS NULL AND event_type IS NOT NULL) FROM events
    UNION ALL SELECT 'newest_write', max(epoch_us(ts)) FROM events UNION ALL SELECT 'repeated_keys', count(*) FILTER (n > 1) FROM k)""",
)
def _(spark, d):
    e = table(spark, d, "events")
    return contracts.contract_check(e, "events", ["event_id", "user_id", "arrival_time"], ["user_id", "event_type"], "event_type", F.expr(fx.micros("ts")))


# what is asked of each table: required columns, key, columns that must hold numbers; two contracts that no table meets are among them
CATALOG = {
    "region": (("r_regionkey", "r_name"), ("r_regionkey",), ("r_name",)),
    "nation": (("n_nationkey", "n_name", "n_regionkey"), ("n_nationkey",), ("n_regionkey",)),
    "supplier": (("s_suppkey", "s_name"), ("s_suppkey",), ()),
    "customer": (("c_custkey", "c_mktsegment"), ("c_custkey",), ("c_mktsegment",)),
    "part": (("p_partkey", "p_name", "p_size", "p_weight"), ("p_partkey",), ("p_size", "p_name")),
    "orders": (("o_orderkey", "o_custkey"), ("o_custkey",), ("o_orderkey",)),
    "lineitem": (("l_orderkey", "l_linenumber"), ("l_orderkey", "l_linenumber"), ("l_quantity", "l_returnflag")),
    "events": (("event_id", "user_id", "ts", "arrival_time"), ("user_id", "event_type"), ("event_type", "value")),
    "stations": (("code",), ("code",), ()),
}


def _catalog_sql():
    parts = []
    for name, (_, key, numeric) in CATALOG.items():
        if name == "stations":
            parts.append("SELECT 'stations', 'present', '', 0::BIGINT")
            continue
        keys, text = ", ".join(key), " || '|' || ".join(f"{k}::VARCHAR" for k in key)
        parts.append(f"SELECT '{name}', 'present', '', 1::BIGINT UNION ALL SELECT '{name}', 'rows', '', count(*) FROM {name}")
        parts += [f"SELECT '{name}', 'not_numeric', '{c}', count(*) FILTER (TRY_CAST({c} AS DOUBLE) IS NULL AND {c} IS NOT NULL) FROM {name}" for c in numeric]
        parts.append(f"SELECT '{name}', 'repeated_keys', '', count(*) FROM (SELECT 1 FROM {name} GROUP BY {keys} HAVING count(*) > 1)")
        parts.append(f"SELECT '{name}', 'null_keys', '', count(*) FILTER ({' OR '.join(f'{k} IS NULL' for k in key)}) FROM {name} UNION ALL SELECT '{name}', 'longest_key', '', max(length({text})) FROM {name}")
    parts.append("SELECT 'part', 'missing_column', 'p_weight', 1::BIGINT UNION ALL SELECT 'events', 'missing_column', 'arrival_time', 1::BIGINT")
    parts.append("SELECT 'events', 'newest_write', '', max(epoch_us(ts)) FROM events")
    return 'SELECT * FROM (' + " UNION ALL ".join(parts) + ') v("table", "check", "column", value)'


@query("Q3_contract_catalog", _catalog_sql())
def _(spark, d):
    tables = {name: (lambda name=name: table(spark, d, name)) for name in CATALOG if name != "stations"}
    written = {"events": F.expr(fx.micros("ts"))}
    return contracts.check_catalog(tables, {name: contracts.Contract(*c, written=written.get(name)) for name, c in CATALOG.items()})


@query("F1_order_latest", f"SELECT * FROM ({FORECAST_SQL} WHERE issued_at = (SELECT max(issued_at) FROM fc)) ORDER BY predicted_arr, instance_id, code")
def _(spark, d):
    return sinks.view_forecast(forecasts(spark, d), codes(spark), latest=True).orderBy("predicted_arr", "instance_id", "code")


@query("F4_sequence_order", f"WITH {STOPS_SQL} SELECT instance_id, stop_idx, lag(station_id) OVER (PARTITION BY instance_id ORDER BY stop_idx) AS previous FROM stops")
def _(spark, d):
    from waymark.operators import sequence as seq

    # rows are dealt anew first: only the sequence column may decide
    s = fx.stops(spark, d).select("instance_id", "stop_idx", "station_id").repartition("station_id")
    return s.select("instance_id", "stop_idx", F.lag("station_id").over(seq.along()).alias("previous"))
