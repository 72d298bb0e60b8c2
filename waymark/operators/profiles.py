"""Profiles and audits of tables: duplicate keys, column statistics, leaks, splits, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.operators.ranks import with_running_totals


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many they have."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def disagreeing_duplicates(df: DataFrame, keys: list[str], checked: list[str]) -> DataFrame:
    """One row: duplicate keys, those whose rows differ in a checked column (null counts as a value), and identical copies."""
    differs = F.lit(False)
    for c in checked:
        known = F.count(c)
        differs = differs | (F.min(c) != F.max(c)) | ((known > 0) & (known < F.count("*")))
    d = df.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(differs, F.lit(False)).alias("differs")).where("n > 1")
    return d.agg(F.count("*").alias("duplicates"), F.count_if("differs").alias("differing"), F.count_if(~F.col("differs")).alias("identical"))


def _long(df: DataFrame, columns: list[str], stats) -> DataFrame:
    """One aggregation over all columns, then a row for each column."""
    one = df.agg(*(F.struct(*stats(c)).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns))).alias("x")).select("x.column", "x.s.*")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, known values and their percentage, smallest and largest value as text, for each column, in one pass."""
    return _long(df, columns, lambda c: [F.count("*").alias("n"), F.count(c).alias("known"), F.round(100 * F.count(c) / F.count("*"), 6).alias("pct"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("most")])


def length_histogram(df: DataFrame, column: str) -> DataFrame:
    """Rows by text length; a null text has a null length."""
    return df.groupBy(F.length(column).cast("long").alias("length")).agg(F.count("*").alias("n"))


def newest_event(df: DataFrame, times: list[str], upto: Column) -> DataFrame:
    """The latest of a row's times, over the rows where that very value is not after ``upto``."""
    at = F.greatest(*times)
    return df.where(at <= upto).agg(F.max(at).alias("newest"), F.count("*").alias("n"))


def feature_audit(df: DataFrame, columns: list[str], sparse_ok: tuple[str, ...] = (), constant_ok: tuple[str, ...] = (), few: int = 50) -> DataFrame:
    """Mean, spread, range and zeros of each column, and a status.

    In this order: constant (no spread), few (under ``few`` values that are not zero), saturated (hardly any spread
    about a value other than zero), empty (over 98 % zero), sparse (over 90 %), else ok. Expected cases end in ``-ok``.
    """
    d = _long(df, columns, lambda c: [
        F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most"),
        F.count(c).alias("n"), F.count_if(F.col(c) == 0).alias("zeros"),
    ])
    zero, sd = F.col("zeros") / F.col("n"), F.coalesce("sd", F.lit(0.0))
    known = lambda names, name: F.when(F.col("column").isin(*names), f"{name}-ok").otherwise(name)
    status = (
        F.when(sd < 1e-8, known(constant_ok, "constant")).when(F.col("n") - F.col("zeros") < few, F.lit("few"))
        .when((sd < 0.01) & (F.abs("mean") > 0.01), F.lit("saturated")).when(zero > 0.98, known(sparse_ok, "empty")).when(zero > 0.90, F.lit("sparse")).otherwise("ok")
    )
    return d.withColumn("status", status)


def leak_correlation(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Absolute correlation of each column with the target, the share within 0.5 of it, and a flag over 0.95 and 0.80."""
    same = lambda c: F.avg((F.abs(F.col(c) - F.col(target)) <= 0.5).cast("double"))
    d = _long(df, columns, lambda c: [F.abs(F.corr(F.col(c).cast("double"), F.col(target).cast("double"))).alias("r"), same(c).alias("identical")])
    return d.withColumn("flag", F.when(F.col("r") > 0.95, "leak").when(F.col("r") > 0.80, "suspect").otherwise("ok"))


def calendar_coverage(days: DataFrame, split: str, day: str) -> DataFrame:
    """Distinct days by split and weekday (Monday 0); weekdays that a split lacks come with 0."""
    seen = days.select(split, day).distinct().groupBy(split).agg(*(F.count_if(F.weekday(day) == k).alias(f"d{k}") for k in range(7)))
    pairs = F.array(*(F.struct(F.lit(k).cast("long").alias("weekday"), F.col(f"d{k}").alias("n")) for k in range(7)))
    return seen.select(split, F.explode(pairs).alias("x")).select(split, "x.*")


def split_difficulty(stops: DataFrame, split: str, trip: str, order: str, delay: str, eligible: Column, big: float = 30.0) -> DataFrame:
    """Per split, over eligible trips with two known delays: trips, steps between consecutive known delays, their mean and
    spread, and the percentages of big rises and falls."""
    known = stops.where(eligible & F.col(delay).isNotNull())
    s = known.select(split, trip, (F.col(delay) - F.lag(delay).over(W.partitionBy(trip).orderBy(order))).alias("s")).where("s IS NOT NULL")
    share = lambda c: 100 * F.count_if(c) / F.count("*")
    return s.groupBy(split).agg(
        F.countDistinct(trip).alias("trips"), F.count("*").alias("n"), share(F.col("s") > big).alias("rise_pct"), share(F.col("s") < -big).alias("fall_pct"),
        F.avg("s").alias("mean"), F.stddev_pop("s").alias("sd"),
    )


def exposure_buckets(trips: DataFrame, test_rows: DataFrame, key: str, split: str, edges: tuple[int, ...]) -> DataFrame:
    """Services and test rows by the number of training trips of their service; services without test rows count as well.

    ``trips`` has a row per trip with its split, ``test_rows`` a row per test stop that counts. Buckets are numbered by
    how many of the ascending ``edges`` are reached.
    """
    services = trips.groupBy(key).agg(F.count_if(F.col(split) == "train").alias("days"))
    rows = services.join(test_rows.groupBy(key).agg(F.count("*").alias("rows")), key, "left")
    bucket = sum(((F.col("days") >= e).cast("long") for e in edges), F.lit(0).cast("long"))
    d = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("services"), F.coalesce(F.sum("rows"), F.lit(0).cast("long")).alias("test_rows"))
    return d.withColumn("share", F.col("test_rows") / F.nullif(F.sum("test_rows").over(W.partitionBy(F.lit(1))), F.lit(0)))  # a row per bucket


def delay_increments(stops: DataFrame, trip: str, order: str, observed: Column, eligible: Column) -> DataFrame:
    """The positive increments of delay of eligible trips between observed stops, with the stop they end at: ``gain`` minutes
    standing (``hold``) at it, or running to it from the last observed stop."""
    seen = stops.where(observed & eligible)
    run = F.col("arr_delay") - F.lag("dep_delay").over(W.partitionBy(trip).orderBy(order))
    one = F.array(
        F.struct((F.col("dep_delay") - F.col("arr_delay")).alias("gain"), F.lit(True).alias("hold")), F.struct(run.alias("gain"), F.lit(False).alias("hold"))
    )
    return seen.withColumn("_i", one).select(*stops.columns, F.inline("_i")).where("gain > 0")


def drop_partial_days(df: DataFrame, day: str, trip: str, least: int) -> DataFrame:
    """Rows of days with at least ``least`` trips. Days are few and their counts pre-aggregated, so the join is small."""
    full = df.groupBy(day).agg(F.countDistinct(trip).alias("_n")).where(F.col("_n") >= least).select(day)
    return df.join(full, day, "left_semi")


def register_services(df: DataFrame, service: str, order: list[str], keep: list[str], parts: int | None = None) -> DataFrame:
    """The first record of each service with its position among the sorted services.

    Services are dealt to ranges once, numbered inside them and moved up by the services of the ranges before.
    """
    first = df.groupBy(service).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_f")).select(service, "_f.*")
    numbered = with_running_totals(first, [], service, parts=parts, n=F.lit(1).cast("long"))
    return numbered.withColumn("index", F.col("before_n")).drop("before_n", "all_n")


def status_counts(df: DataFrame, **counted: Column) -> DataFrame:
    """One row of named counters."""
    return df.agg(F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in counted.items()))


def extreme_trips(stops: DataFrame, trip: str, delay: Column, eligible: Column, over: float, k: int) -> DataFrame:
    """Of eligible trips and of the others each the ``k`` whose delay exceeds ``over`` by most."""
    worst = stops.groupBy(trip).agg(F.max(F.abs(delay)).alias("worst"), F.bool_and(eligible).alias("eligible")).where(F.col("worst") > over)
    return top_k_per_group(worst, ["eligible"], [F.desc("worst"), F.col(trip)], k).drop("rank")


def provenance_mix(df: DataFrame, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """For each named (observed, filled) pair of columns: values observed, filled in and missing, with the observed share."""
    one = F.array(*(F.struct(F.lit(n).alias("field"), a.isNotNull().alias("seen"), (a.isNull() & b.isNotNull()).alias("made")) for n, (a, b) in fields.items()))
    d = df.select(F.explode(one).alias("x")).groupBy("x.field").agg(F.count_if("x.seen").alias("observed"), F.count_if("x.made").alias("filled"), F.count("*").alias("n"))
    return d.withColumn("missing", F.col("n") - F.col("observed") - F.col("filled")).withColumn("share", F.col("observed") / F.col("n"))


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps only ``k`` a group on each task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def window_sanity(df: DataFrame, start: str, end: str, least: Column, most: Column) -> DataFrame:
    """Windows that end before they start, have no end, or lie outside the allowed range; one row."""
    s, e = F.col(start), F.col(end)
    return status_counts(df, reversed=e < s, open=e.isNull(), outside=(s < least) | (s > most) | (e > most))
