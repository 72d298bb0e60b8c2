"""What is known at nine o'clock (minute 540): hand-made movements, closures and failures."""

import pytest
from pyspark.sql import functions as F

from waymark.operators import known

STOP = "instance_id string, stop_idx long, station_id long, sched_arr long, sched_dep long, actual_arr long, actual_dep long"


def counts(spark, stops, at, now=540):
    """(at station 1, on the section to 2) at a minute, of stops (station, booked and observed times)."""
    df = spark.createDataFrame([("t", i, *s) for i, s in enumerate(stops)], STOP)
    d = known.known_movements(df, F.lit(now).cast("long")).where((F.col("start") <= at) & (F.col("end") >= at))
    return d.where("kind = 'station' AND station_id = 1").count(), d.where("kind = 'section' AND next_station = 2").count()


@pytest.mark.parametrize(
    "stops,at,want",
    [
        ([(1, None, None, 660, 690)], 670, (0, 0)),  # not seen at nine
        ([(1, None, None, 530, None)], 540, (1, 0)),  # standing at nine
        ([(1, None, None, 530, None)], 560, (1, 0)),  # and carried on
        ([(1, None, None, 530, None)], 570, (0, 0)),
        ([(1, None, None, 500, 535), (2, None, None, None, None)], 540, (0, 1)),  # under way, no arrival yet
        ([(1, 600, 620, None, None), (2, 640, 650, None, None)], 610, (1, 0)),  # booked
        ([(1, 600, 620, None, None), (2, 640, 650, None, None)], 630, (0, 1)),
        ([(1, 600, 620, None, None), (2, 640, 650, None, None)], 570, (0, 0)),
        ([(1, 800, 820, None, None)], 810, (0, 0)),  # beyond four hours
        ([(1, 600, 590, None, None)], 636, (1, 0)),  # booked to leave before it comes: a usual stand
    ],
)
def test_movements(spark, stops, at, want):
    assert counts(spark, stops, at) == want


def test_closures_and_failures(spark):
    blocks = spark.createDataFrame([("late", 520.0, 570.0, 615.0), ("planned", 660.0, 720.0, None), ("over", 400.0, 500.0, 510.0), ("open", 530.0, None, None), ("none", 600.0, None, None)], "n string, start double, permitted_end double, cleared double")
    got = {r.n: r.end for r in known.known_closures(blocks, F.lit(540.0)).collect()}
    assert got == {"late": 570.0, "planned": 720.0, "over": 510.0, "open": 540.0}
    failures = spark.createDataFrame([("later", 660.0, 700.0), ("open", 525.0, None), ("ends", 500.0, 600.0), ("over", 400.0, 450.0)], "n string, start double, finish double")
    assert {r.n: r.end for r in known.known_failures(failures, F.lit(540.0)).collect()} == {"open": 540.0, "ends": 540.0, "over": 450.0}
