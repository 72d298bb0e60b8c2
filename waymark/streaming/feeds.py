"""Structured Streaming over growing files of events.

Each function runs a stream until the files present are read
(``availableNow``) and returns the table it has written. A run with the same
``folder`` goes on where the last one stopped, by Spark's checkpoint. Batches
write to a folder of their own number, overwritten when a batch is repeated,
so every result is the same after a restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from waymark.sources.keyed import KeyedTable
from waymark.sources.sinks import shared_folder


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", moment: str = "ts", **options: str) -> DataFrame:
    """The table's files as a stream; ``moment`` becomes a TIMESTAMP, which watermarks need. ``options`` are the file source's."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # as a pattern the path may be a file as well as a folder
    return spark.readStream.schema(schema).options(**options).parquet(path[:-1] + "[t]").withColumn(moment, F.col(moment).cast("timestamp"))


def _run(df: DataFrame, mode: str, folder: str, each: Callable[[DataFrame, int], None]) -> None:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
    writer.foreachBatch(each).trigger(availableNow=True).start().awaitTermination()


def _batches(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/rows").select(*schema.names)


def newest_rows(df: DataFrame, mode: str, keys: list[str], folder: str | None = None) -> DataFrame:
    """Runs an aggregated stream into a table by key: of each key the row that the latest batch gave."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark, "stream")
    kept = KeyedTable(spark, f"{folder}/rows", df.schema, keys)
    _run(df, mode, folder, lambda b, i: kept.upsert(b, [F.lit(0)]))
    return kept.read()


def tick_windows(stream: DataFrame, moment: str, keys: list[str], minutes: int, late: str, folder: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates by ``keys`` in windows of ``minutes``; rows later than ``late`` behind the newest are passed over."""
    windows = stream.withWatermark(moment, late).groupBy(*keys, F.window(moment, f"{minutes} minutes").alias("w"))
    start = (F.unix_seconds("w.start") / 60).cast("long").alias("tick_min")
    found = windows.agg(*(c.alias(n) for n, c in aggregates.items())).select(*keys, start, *aggregates)
    return newest_rows(found, "update", [*keys, "tick_min"], folder)


def keyed_memory(stream: DataFrame, keys: list[str], folder: str | None = None, **aggregates: Column) -> DataFrame:
    """Per key what is carried from batch to batch, in Spark's state store."""
    found = stream.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return newest_rows(found, "update", keys, folder)


def read_with_overlap(stream: DataFrame, moment: str, keys: list[str], overlap: str, folder: str | None = None) -> DataFrame:
    """The stream's rows once each, though reads may overlap by ``overlap``."""
    folder = folder or shared_folder(stream.sparkSession, "stream")
    once = stream.withWatermark(moment, overlap).dropDuplicatesWithinWatermark(keys)
    _run(once, "append", folder, lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/rows/batch={i}"))
    return _batches(stream.sparkSession, folder, once.schema)


def forecast_sink(stream: DataFrame, keys: list[str], order: list[Column], folder: str | None = None) -> DataFrame:
    """Appends each batch's first row per key unless the table has the key: repeated issues and batches change nothing."""
    folder = folder or shared_folder(stream.sparkSession, "stream")
    kept = KeyedTable(stream.sparkSession, f"{folder}/rows", stream.schema, keys)
    _run(stream, "append", folder, lambda b, i: kept.insert(b, order))
    return kept.read()


def upsert_sink(stream: DataFrame, keys: list[str], order: list[Column], folder: str | None = None) -> DataFrame:
    """Each batch's first row per key replaces the table's row of that key."""
    folder = folder or shared_folder(stream.sparkSession, "stream")
    kept = KeyedTable(stream.sparkSession, f"{folder}/rows", stream.schema, keys)
    _run(stream, "append", folder, lambda b, i: kept.upsert(b, order))
    return kept.read()


def incremental_rebuild(cache: DataFrame, changed: DataFrame, history: DataFrame, build: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """``cache`` with the records of ``changed`` keys built anew from all their rows in ``history``.

    ``build`` makes a record per key and leaves out what is no valid record; such a key is dropped even if the cache had
    it. Other records stay as they are. Only the history of changed keys is read by ``build``.
    """
    touched = changed.select(*keys).distinct()
    anew = build(history.join(touched, keys, "left_semi"))
    return cache.join(touched, keys, "left_anti").unionByName(anew.select(*cache.columns))


def rebuild_sink(stream: DataFrame, history: Callable[[], DataFrame], build: Callable[[DataFrame], DataFrame], keys: list[str], folder: str | None = None) -> DataFrame:
    """Keeps the table of built records up to date: each batch names changed keys, whose records are replaced or, where no valid
    one results, marked as gone. ``history`` gives all rows at the moment of a batch."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, "stream")
    schema = build(history()).withColumn("_gone", F.lit(False)).schema
    kept = KeyedTable(spark, f"{folder}/rows", schema, keys)

    def replace(batch: DataFrame, i: int) -> None:
        touched = batch.select(*keys).distinct()
        anew = build(history().join(touched, keys, "left_semi")).withColumn("_gone", F.lit(False))
        lost = touched.join(anew.select(*keys), keys, "left_anti").withColumn("_gone", F.lit(True))
        kept.upsert(anew.unionByName(lost, allowMissingColumns=True), [F.col("_gone")])

    _run(stream.select(*keys), "append", folder, replace)
    return kept.read().where("NOT _gone").drop("_gone")


def late_corrections(stream: DataFrame, log: DataFrame, moment: str, keys: list[str], minutes: int, late: str, folder: str | None = None) -> DataFrame:
    """Per key and window the rows that a stream has counted, all that the log holds (``n``), and those ``lost`` to the watermark.

    A stream passes over corrections that come later than ``late`` behind the newest row, and does not rewind what it has
    taken in; counting the log anew heals that.
    """
    counted = tick_windows(stream, moment, keys, minutes, late, folder, streamed=F.count("*"))
    start = F.floor(F.unix_seconds(F.col(moment).cast("timestamp")) / (60 * minutes)).cast("long") * minutes
    whole = log.groupBy(*keys, start.alias("tick_min")).agg(F.count("*").alias("n"))
    d = whole.join(counted, [*keys, "tick_min"], "left").withColumn("streamed", F.coalesce("streamed", F.lit(0).cast("long")))
    return d.withColumn("lost", F.col("n") - F.col("streamed"))


def auto_clock(log: DataFrame, event: str, write: str, limit: float) -> DataFrame:
    """Which clock a run goes by: the event's if the newest event is older than ``limit`` at the newest write, else the write's."""
    t = log.agg(F.max(event).alias("newest_event"), F.max(write).alias("newest_write"))
    return t.withColumn("clock", F.when(F.col("newest_write") - F.col("newest_event") > limit, "event").otherwise("write"))


def staleness(log: DataFrame, minute: Column, warn: float, critical: float) -> DataFrame:
    """Gaps between minutes with arrivals that reach ``warn``, with their level.

    Arrivals are counted by minute first. Minutes are ordered inside their day, and a day's first minute follows the last
    one of the day before, so only a row per day is ordered without a key.
    """
    minutes = log.groupBy(minute.cast("long").alias("minute")).agg(F.count("*").alias("n")).withColumn("_day", F.floor(F.col("minute") / 1440))
    days = minutes.groupBy("_day").agg(F.max("minute").alias("_newest"))
    before = days.select("_day", F.lag("_newest").over(W.orderBy("_day")).alias("_before"))
    previous = F.coalesce(F.lag("minute").over(W.partitionBy("_day").orderBy("minute")), "_before")
    gaps = minutes.join(before, "_day").withColumn("gap", F.col("minute") - previous)
    level = F.when(F.col("gap") >= critical, "critical").otherwise("warn")
    return gaps.where(F.col("gap") >= warn).select("minute", "gap", "n", level.alias("level"))
