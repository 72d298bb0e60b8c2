"""Streams over files that arrive one after another, with a restart in between; sinks on small tables."""

import time

import pytest
from pyspark.sql import functions as F

from waymark.operators import sequence, traffic
from waymark.sources import readers, sinks
from waymark.streaming import feeds, timers

SCHEMA = "event_id long, user_id long, value double, minute long"


def arrive(spark, folder, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("minute") * 60 + 1704067200)).drop("minute")
    df.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_memory_is_carried_over_a_restart(spark, tmp_path):
    folder = str(tmp_path / "run")
    run = lambda: feeds.keyed_memory(feeds.event_stream(spark, str(tmp_path)), ["user_id"], folder, n=F.count("*"), last=F.max_by("value", "ts"))
    arrive(spark, tmp_path, [(1, 7, 1.0, 0), (2, 7, 2.0, 1), (3, 8, 5.0, 1)])
    assert got(run()) == [(7, 2, 2.0), (8, 1, 5.0)]
    arrive(spark, tmp_path, [(4, 7, 9.0, 5)])
    assert got(run()) == [(7, 3, 9.0), (8, 1, 5.0)]
    assert got(run()) == [(7, 3, 9.0), (8, 1, 5.0)]  # nothing new


def test_overlapping_reads_give_each_row_once(spark, tmp_path):
    folder = str(tmp_path / "run")
    run = lambda: feeds.read_with_overlap(feeds.event_stream(spark, str(tmp_path)), "ts", ["event_id"], "15 minutes", folder).select("event_id", "value")
    arrive(spark, tmp_path, [(1, 7, 1.0, 0), (2, 7, 2.0, 1)])
    run()
    arrive(spark, tmp_path, [(2, 7, 2.0, 1), (3, 7, 3.0, 4), (3, 7, 3.0, 4)])
    assert got(run()) == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_forecast_sink_keeps_the_first_issue(spark, tmp_path):
    folder = str(tmp_path / "run")
    run = lambda: feeds.forecast_sink(feeds.event_stream(spark, str(tmp_path)).select("user_id", "event_id", "value"), ["user_id"], [F.col("event_id")], folder)
    arrive(spark, tmp_path, [(2, 7, 2.0, 0), (1, 7, 1.0, 0)])
    assert got(run()) == [(7, 1, 1.0)]
    arrive(spark, tmp_path, [(0, 7, 5.0, 1), (5, 8, 6.0, 1)])
    assert got(run()) == [(7, 1, 1.0), (8, 5, 6.0)]


def test_bad_json_records_are_left_out(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n"n": 1,\n"stops": [{"code": "A"}]}')
    (tmp_path / "b.json").write_text('{"n": 2, "stops": [')
    assert got(readers.scan_json_records(spark, str(tmp_path), "n long, stops array<struct<code: string>>").select("n", F.size("stops"))) == [(1, 1)]


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("﻿CODE,N\nA,1\nB,no number\n".encode())
    assert got(readers.scan_csv(spark, str(tmp_path / "x.csv"), "code string, n int").fillna(-1)) == [("A", 1), ("B", -1)]


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one/x.csv").write_text("n,more,code\n1,x,A\n2,y,B\n")
    assert got(readers.scan_csv(spark, str(tmp_path / "one"), "code string, n int")) == [("A", 1), ("B", 2)]
    with pytest.raises(ValueError, match="no column speed"):
        readers.scan_csv(spark, str(tmp_path / "one"), "code string, speed int")
    (tmp_path / "one/y.csv").write_text("code,more,n\nC,z,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.scan_csv(spark, str(tmp_path / "one"), "code string, n int").collect()


def test_fallback(spark):
    none, some = spark.range(0), spark.range(2)
    assert readers.scan_or_fallback(none, some).count() == 2 and readers.scan_or_fallback(some, none).count() == 2
    with pytest.raises(ValueError):
        readers.scan_or_fallback(none, none)


def test_timetable_keys(spark):
    df = spark.createDataFrame([("00120", 1), ("000", 2), (None, 3)], "code string, actual long")
    assert [tuple(r) for r in readers.load_timetable(df, "code", ["actual"]).collect()] == [("120", None), ("0", None), (None, None)]


def test_upsert_and_insert_on_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "y"), (2, "x"), (3, "z"), (None, "n")], "k long, v string")
    assert got(sinks.upsert(old, new, ["k"], [F.col("v")]).fillna(-1)) == [(-1, "n"), (1, "a"), (2, "x"), (3, "z")]
    assert got(sinks.insert_ignore(old, new, ["k"], [F.col("v")]).fillna(-1)) == [(-1, "n"), (3, "z")]


def ticks_of(spark, tmp_path, folder):
    stream = feeds.event_stream(spark, str(tmp_path))
    kept = timers.advancing_memory(stream, ["user_id"], "ts", F.col("value"), 10, capacity=2.0, folder=folder)
    return sorted((r["user_id"], r["tick"] - 1704067200 // 600, r["congestion"], round(r["mixed"], 6), r["since_critical"], r["seen"]) for r in kept.collect())


def test_memory_moves_on_without_rows_and_over_a_restart(spark, tmp_path):
    folder = str(tmp_path / "run")
    # user 7 is busy at once and then silent for five ticks; user 8 comes later that day and moves the clock
    arrive(spark, tmp_path, [(1, 7, 2.0, 5), (2, 7, 1.0, 12), (3, 8, 1.0, 31)])
    first = ticks_of(spark, tmp_path, folder)
    assert first == [
        (7, 0, 0.0, 0.3, 0, True), (7, 1, 1.0, 0.85, 0, True), (7, 2, 0.5, 0.35, 1, False),
        (8, 0, 0.0, 0.0, 0, False), (8, 1, 0.0, 0.0, 1, False), (8, 2, 0.0, 0.0, 2, False),
    ]
    arrive(spark, tmp_path, [(4, 7, 2.0, 3), (5, 8, 2.0, 79)])  # the first is too late
    both = ticks_of(spark, tmp_path, folder)
    assert [r for r in both if r[1] < 3] == first
    assert [r[4] for r in both if r[0] == 7] == [0, 0, 1, 2, 3, 4, 5]
    assert [(r[2], r[3], r[5]) for r in both if r[0] == 7][3:] == [(0.0, 0.0, False)] * 4
    assert [r for r in both if r[0] == 8][3:5] == [(8, 3, 0.0, 0.15, 3, True), (8, 4, 0.5, 0.35, 4, False)]
    # the batch operator over all ticks gives the same
    spine = traffic.tick_spine(spark.createDataFrame([(7,), (8,)], "blk long"), 1, 6)
    loads = spark.createDataFrame([(7, 0, 1.0), (7, 1, 0.5), (8, 3, 0.5)], "blk long, tick long, load double")
    dense = spine.join(loads, ["blk", "tick"], "left").fillna(0.0, "load").withColumn("critical", F.col("load") > 0.85)
    batch = sequence.station_memory(dense, ["blk"], "tick", "load", "load", "critical")
    assert sorted((r["blk"], r["tick"], r["congestion"], round(r["mixed"], 6), r["since_critical"]) for r in batch.collect()) == [r[:5] for r in both]


def test_memory_begins_anew_each_day(spark, tmp_path):
    arrive(spark, tmp_path, [(1, 7, 2.0, 1425), (2, 8, 0.0, 1461)])
    rows = [r for r in ticks_of(spark, tmp_path, str(tmp_path / "run")) if r[0] == 7]
    assert [r[1] for r in rows] == list(range(146))
    assert rows[142:] == [(7, 142, 0.0, 0.3, 20, True), (7, 143, 1.0, 0.7, 0, False), (7, 144, 0.0, 0.0, 0, False), (7, 145, 0.0, 0.0, 1, False)]


def test_silence_of_one_feed_among_others(spark, tmp_path):
    folder = str(tmp_path / "run")
    log = lambda: sorted((r["user_id"], r["level"], (r["newest_ms"] - 1704067200000) // 60000, (r["alarm_ms"] - 1704067200000) // 60000) for r in timers.silence_log(feeds.event_stream(spark, str(tmp_path)), ["user_id"], "ts", {"critical": 30, "warn": 12}, folder=folder).collect())
    arrive(spark, tmp_path, [(1, 7, 1.0, 0), (2, 8, 1.0, 5), (3, 8, 1.0, 15)])
    assert log() == [(7, "warn", 0, 12)]
    arrive(spark, tmp_path, [(4, 8, 1.0, 20), (5, 8, 1.0, 29)])
    assert log() == [(7, "warn", 0, 12)]  # told once
    arrive(spark, tmp_path, [(6, 7, 1.0, 33), (7, 8, 1.0, 34)])
    assert log() == [(7, "critical", 0, 30), (7, "warn", 0, 12)]
    arrive(spark, tmp_path, [(8, 8, 1.0, 36), (9, 8, 1.0, 46)])
    assert log() == [(7, "critical", 0, 30), (7, "warn", 0, 12), (7, "warn", 33, 45)]


def test_alarm_while_nothing_comes_at_all(spark, tmp_path):
    arrive(spark, tmp_path, [(1, 7, 1.0, 0)])
    told, watch = [], timers.StreamWatch({"warn": 1.0, "critical": 3600.0})
    spark.streams.addListener(watch)
    alarms = timers.silence_alarms(feeds.event_stream(spark, str(tmp_path)), ["user_id"], "ts", {"warn": 0.02, "critical": 0.05}, by_event=False)
    query = timers.run_with_timers(alarms, str(tmp_path / "run"), lambda b, i: told.extend(r["level"] for r in b.collect()), live="500 milliseconds")
    try:
        end = time.time() + 90
        while time.time() < end and len(told) < 2:
            time.sleep(0.5)
        assert told == ["warn", "critical"]
        assert list(watch.level(time.time() + 5).values()) == ["warn"]  # the stream runs, but takes in nothing
    finally:
        query.stop()
    end = time.time() + 20
    while time.time() < end and watch.level(time.time()):
        time.sleep(0.2)
    assert watch.level(time.time()) == {}
    spark.streams.removeListener(watch)
