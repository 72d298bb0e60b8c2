"""A trip whose first departure is known to lie before its estimated arrival is there twice at that arrival."""

import pytest
from pyspark.sql import functions as F

from tests.oracle import same
from tests.test_rules import got, trip
from waymark.operators import scoring
from waymark.operators import sequence as seq
from waymark.plans import registry


def early(spark):
    """Estimated to come at 10, known to have left at 4: its first arrival is a tick of its leg as well."""
    return trip(spark, (1, 10, 10, None, 4), (2, 20, 25, 20, 25), (3, 30, 35, 33, 40))


def test_a_stand_is_as_long_as_its_rows(spark):
    at = seq.position_at(seq.trips_in_time(early(spark)), 6).where("stop_idx = 0 AND mode = 'in_transit'")
    assert got(at.select("tick")) == [(12,), (18,), (6,)]
    twice = at.unionByName(at.where("tick = 6"))
    three = scoring.position_in_stand(twice.where("tick < 18"), ["instance_id", "stop_idx", "mode"], "tick", F.col("tick"))
    assert got(three.select("side", "k", "n")) == [("all", None, 3)]  # three rows are no stand of four, whichever of two comes first
    four = scoring.position_in_stand(twice, ["instance_id", "stop_idx", "mode"], "tick", F.col("tick"))
    assert sorted(got(four.where("side = 'end'").select("k", "n"))) == [(0, 1), (1, 1), (2, 1), (3, 1)]


def marked_twice(spark):
    marked = seq.next_targets(seq.trips_in_time(early(spark)), 2, F.lit(True), F.lit(True))
    return seq.with_fresh(seq.position_at(marked, 10)).where("tick = 10")


def test_both_rows_of_a_tick_have_their_targets(spark):
    rows = seq.horizon_targets(marked_twice(spark), 2).select("stop_idx", "targets", "mask").collect()
    assert [tuple(r) for r in rows] == [(0, [0, 3], [1, 1])] * 2
    assert seq.first_per_stage(seq.position_at(seq.trips_in_time(early(spark)), 10)).where("tick = 10").count() == 1


def test_etas_end_for_both_places_where_they_end_for_either(spark):
    s = trip(spark, (1, 10, 10, None, 4), (2, 20, 90, 6, 30), (3, 100, 100, None, None), (4, 110, 110, None, None))
    at = seq.position_at(seq.trips_in_time(s), 10).where("tick = 10")
    assert got(at.select("stop_idx", "mode")) == [(0, "in_transit"), (1, "at_station")]
    # from the first stop the third is 84 minutes ahead, from the second 4 less than none
    assert got(seq.path_etas(at, s, 75).select("station_id", "eta")) == [(2, 0)]
    assert got(seq.path_etas(at, s, 95).select("station_id", "eta")) == [(2, 0), (3, -4), (4, 6)]


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """Events of three users, one of whom (1323) is on a trip that is at one tick twice."""
    folder = tmp_path_factory.mktemp("few")
    spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("user_id IN (1321, 1323, 1324)").coalesce(1).write.parquet(f"{folder}/all")
    next(folder.joinpath("all").glob("*.parquet")).rename(folder / "events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["E14_departure_targets", "E32_assemble_vectors"])
def test_query_equals_its_twin_on_such_a_trip(spark, few, name):
    same(registry.queries()[name](spark, few), registry.oracle_sql()[name], few)
