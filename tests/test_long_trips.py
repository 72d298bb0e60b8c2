"""Work on long trips and at busy stations grows with their rows, not with the square of a trip's stops or of a station's cells."""

import re

from pyspark.sql import functions as F

from tests.test_rules import CONFLICT_COLUMNS, got, plain_conflicts
from waymark.operators import sequence as seq
from waymark.operators import traffic
from waymark.plans import leaks
from waymark.sources import fixtures as fx


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def long_trip(spark, n):
    s = spark.range(n).selectExpr("'t' AS instance_id", "id AS stop_idx", "id % 7 AS station_id", "10 * id AS sched_arr", "10 * id + id % 3 AS sched_dep", "10 * id AS actual_arr", "10 * id + id % 3 AS actual_dep")
    return s.withColumn("blk", F.lit(0).cast("long"))


def test_no_stop_of_a_long_trip_goes_through_all_later_ones(spark):
    s = long_trip(spark, 3000)
    ahead = seq.look_ahead(seq.trips_in_time(s))
    etas = seq.path_etas(seq.position_at_instants(ahead, [15000]), s, 75)
    assert not re.search(r"RowFrame, 1, unboundedfollowing", plan(etas))
    # under way from stop 1499, booked to leave it at 14992
    assert got(etas.select("station_id", "eta")) == sorted(((1499 + k) % 7, 10 * k - 2) for k in range(1, 8))
    assert got(ahead.where("stop_idx IN (0, 1500, 2998, 2999)").orderBy("stop_idx").select("slack_ahead")) == sorted(
        [(sum(i % 3 for i in range(k + 1, 3000)),) for k in (0, 1500, 2998, 2999)], key=str
    )


def test_a_frame_of_conflicts_has_no_row_for_each_level(spark):
    rows = [(f"{i}_0", 0, 0, 7, i % 40, i % 3, i // 40 % 10) for i in range(800)]
    etas = spark.createDataFrame([r[:5] for r in rows], "instance_id string, blk long, tick long, station_id long, eta long")
    user = F.split_part("instance_id", F.lit("_"), F.lit(1)).cast("long")
    found = traffic.path_conflicts(etas, user % 3, F.floor(user / 40) % 10, 10, (7,), window=5, queue=3)
    counts = [a for a in re.findall(r"Aggregate \[(.*?)\], ", plan(found)) if "eta#" in a]
    assert counts and not any(re.search(r"\b_l#", a) for a in counts)
    wanted = plain_conflicts([(r[0], r[4], r[5], r[6]) for r in rows], 5, 3, lambda r: r[3])
    assert {r["instance_id"]: tuple(r[c] for c in CONFLICT_COLUMNS) for r in found.collect()} == wanted


def test_the_harness_windows_each_world_once(spark, monkeypatch):
    calls, timed = [], leaks._timed
    monkeypatch.setattr(leaks, "_timed", lambda world: calls.append(1) or timed(world))
    leaks.audits(fx.stops(spark, "/root/testdata/sf0.001"))
    assert len(calls) == 2
