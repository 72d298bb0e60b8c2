"""Junctions ahead of a trip that is at two stops at one tick; the twin leaves open there which of the two counts."""

import pytest
from pyspark.sql import functions as F

from tests.oracle import same
from tests.test_rules import got, trip
from waymark.operators import sequence as seq
from waymark.plans import registry

#: Settles the twin's ties: a stop that is over the horizon from either place ends the list, and the place further on counts.
SETTLED = (
    ("l.stop_idx AS k", "l.stop_idx * 100000 + s.stop_idx AS k"),
    ("ORDER BY k ROWS", "ORDER BY k // 100000 RANGE"),
    ("station_id, stop_idx, 0 FROM seen", "station_id, stop_idx * 100000 + stop_idx, 0 FROM seen"),
)


def settled(sql):
    for old, new in SETTLED:
        assert sql.count(old) == 1
        sql = sql.replace(old, new)
    return sql


def test_junctions_end_for_both_places_where_they_end_for_either(spark):
    s = trip(spark, (1, 10, 10, None, 4), (2, 20, 90, 6, 30), (3, 100, 100, None, None), (4, 110, 110, None, None))
    at = seq.position_at(seq.trips_in_time(s), 10).where("tick = 10")
    ahead = lambda horizon: got(seq.junction_etas(seq.path_etas(at, s, horizon), (3, 4)).select("nearest", "second", "n_junctions"))
    # from the first stop the third is 84 minutes ahead, over the horizon of 75; both places see it at 95, and the second counts
    assert ahead(75) == [(90, 90, 0)]
    assert ahead(95) == [(-4, 6, 2)]


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """60 copies of the events of a user with shifted event ids: trip 1323_3 is at stops 0 and 1 at tick 720, with junctions ahead of both."""
    folder = tmp_path_factory.mktemp("crowded")
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("user_id = 1323")
    copies = events.crossJoin(spark.range(60).withColumnRenamed("id", "_copy"))
    copies = copies.withColumn("event_id", F.col("event_id") + 100000 * F.col("_copy")).drop("_copy")
    copies.coalesce(1).write.parquet(f"{folder}/all")
    next(folder.joinpath("all").glob("*.parquet")).rename(folder / "events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["E7_path_etas", "E8_junction_etas"])
def test_query_equals_its_twin_with_settled_ties(spark, crowded, name):
    at = registry.queries()["E3_position_at"](spark, crowded).where("instance_id = '1323_3' AND tick = 720")
    assert got(at.select("stop_idx", "mode")) == [(0, "in_transit"), (1, "at_station")]
    same(registry.queries()[name](spark, crowded), settled(registry.oracle_sql()[name]), crowded)
