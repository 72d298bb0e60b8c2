"""Writing tables: whole replacement, inserts and upserts by key, exports, views of forecasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; in local mode below a fresh local one where that is unset."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        known = sc._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            known = sc._jsc.sc().getCheckpointDir()
        root = known.get()
    return f"{root.rstrip('/')}/waymark/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once in the shared folder and read back, which cuts its lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._waymark_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a ``written`` table that no later step reads."""
    remove_folder(df.sparkSession, df._waymark_path)


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_partitioned(df: DataFrame, path: str, by: list[str], order: list[str]) -> None:
    """One folder per value of ``by``; the whole output is replaced, so no stale partition survives.

    Rows are dealt by range of (by, order): a folder gets few files, and a large one is written by several tasks.
    """
    df.repartitionByRange(*by, *order).write.partitionBy(*by).option("partitionOverwriteMode", "static").mode("overwrite").parquet(path)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows to append: the first per key in ``order``, of the keys that ``target`` does not have."""
    return first_per_key(new, keys, order).join(target.select(*keys), keys, "left_anti")


def upsert(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``target`` with each key's row replaced by the first of ``new`` in ``order``, and new keys added."""
    both = target.withColumn("_new", F.lit(1)).unionByName(new.withColumn("_new", F.lit(0)))
    return first_per_key(both, keys, [F.col("_new"), *order]).drop("_new")


def export_days(df: DataFrame, path: str, day: str, order: list[str], observed: Column, vehicle: str) -> DataFrame:
    """Writes a folder of CSV per day, in ``order`` and with nulls as empty fields; gives the counts per day.

    Days are dealt by range of (day, order), so that a large day is written by several tasks, each in order.
    """
    dealt = df.repartitionByRange(day, *order).sortWithinPartitions(day, *order)
    dealt.write.partitionBy(day).options(header=True, nullValue="", emptyValue='""').mode("overwrite").csv(path)
    return df.groupBy(day).agg(F.count("*").alias("n"), F.count_if(observed).alias("observed"), F.count_distinct(vehicle).alias("vehicles"))


def reload_dimension(df: DataFrame, path: str, version: int | None = None) -> None:
    """Replaces the whole table, or, with ``version``, that version's rows alone."""
    if version is None:
        df.write.mode("overwrite").parquet(path)
    else:
        df.withColumn("version", F.lit(version)).write.partitionBy("version").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def evolve_schema(target: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows with both tables' columns; what a row lacks is null."""
    return target.unionByName(new, allowMissingColumns=True)


def view_forecast(forecast: DataFrame, stations: DataFrame, latest: bool = False) -> DataFrame:
    """Forecasts with the station's code and the predicted minute of arrival; with ``latest`` those of the newest issue only.

    ``forecast`` has (issued_at, instance_id, station_id, sched_arr, lead_min, delay), ``stations`` (station_id, code).
    """
    if latest:
        newest = forecast.agg(F.max("issued_at").alias("issued_at"))  # one row
        forecast = forecast.join(F.broadcast(newest), "issued_at", "left_semi")
    named = forecast.join(stations, "station_id", "left")
    return named.select(
        "issued_at", "instance_id", F.coalesce("code", F.col("station_id").cast("string")).alias("code"), F.round("delay", 1).alias("delay"),
        F.round(F.coalesce(F.col("sched_arr") + F.col("delay"), F.col("issued_at") + F.col("lead_min")), 1).alias("predicted_arr"),
    )


def build_manifest(df: DataFrame, day: str, split: str, group: str) -> DataFrame:
    """One row about a build: its rows, days and groups, and the days of each split."""
    days = lambda s: F.count_distinct(F.when(F.col(split) == s, F.col(day)))
    return df.agg(
        F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count_distinct(group).alias("n_groups"),
        days("train").alias("train_days"), days("validation").alias("validation_days"), days("test").alias("test_days"),
        F.array_join(F.sort_array(F.collect_set(F.col(day).cast("string"))), ",").alias("days"),
    )
