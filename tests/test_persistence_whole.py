"""E33 and E36 leave out no stop and no trip: stations 0 and 1 and users that end in 0 count like others."""

from pyspark.sql import functions as F

from waymark.plans import outlook, registry
from waymark.plans.trips import timed

SF = "/root/testdata/sf0.01"


def test_every_station_and_user_is_scored(spark):
    rows = registry.queries()["E33_persistence"](spark, SF).join(timed(spark, SF).withColumnRenamed("stop_idx", "k"), ["instance_id", "k"]).cache()
    assert rows.where("station_id < 2").count() and rows.where("user_id % 10 = 0").count()
    hidden = F.expr("cast(split_part(instance_id, '_', 1) AS long) % 10 = 0")
    for name in ("E36_journey_report", "E36_journey_summary"):
        assert registry.queries()[name](spark, SF).where(hidden).count(), name


def test_reports_read_the_whole_persistence():
    for name in ("E33_persistence", "E36_journey_report", "E36_journey_summary"):
        assert outlook.PERSIST_SQL in registry.oracle_sql()[name] and "user_id % 10" not in registry.oracle_sql()[name]
