"""Contiguous shards of near-equal bytes, from prefix sums of per-partition totals.

Rows are put in a fixed global order: by a hash partition of the row, then
by doc_id, size and checksum. Totals per partition are summed into
prefixes, a window adds the prefix inside each partition, and the global
byte prefix is cut at equal targets. Only DataFrame functions are used.

The number of partitions follows the row count, so that a partition stays
small at any size; the rows of one partition are ordered by a window that
may spill. The hash covers the id, the text's checksum and the size, so
rows that share an id or have none still spread. Null texts have 0 bytes.
An empty table gives an empty result; fewer rows than shards leave shards
empty. A shard's bytes differ from the target by less than one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm.common import discard, free_name, written


def balanced_shards(
    df: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text", overhead: int = 8, rows_per_partition: int = 50_000, row: str | None = None
) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row: ``n_shards`` runs of near-equal bytes, slots gapless from 0.

    ``size`` is the text's UTF-8 bytes plus ``overhead``. With ``row``, a column of whole numbers of which each row has its
    own, the result has that too, as ``row``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    own = F.col(row).cast("long") if row else F.lit(None).cast("long")
    slim = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        own.alias("row"),
    )
    # one pass over the texts; what follows reads a few bytes a row
    slim = written(slim, "shard-sizes")
    parts = max(1, -(-slim.count() // rows_per_partition))
    slim = slim.withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(parts)).cast("int"))

    # rows that are alike are interchangeable: those of one input partition are one row until they are placed
    alike = slim.groupBy("part", "doc_id", "size", "text_crc32", "row", F.spark_partition_id().alias("src")).agg(F.count("*").alias("n"))

    # a row per partition: the only window without a key runs on these
    totals = alike.groupBy("part").agg(F.sum(F.col("size") * F.col("n")).alias("part_bytes"), F.sum("n").alias("part_rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    prefixes = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all_bytes"),
    )
    inside = W.partitionBy("part").orderBy("doc_id", "size", "text_crc32", "row", "src").rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = alike.withColumn("upto", F.sum(F.col("size") * F.col("n")).over(inside)).withColumn("nth", F.sum("n").over(inside))
    placed = (
        ordered.withColumn("left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("upto", F.col("upto") - F.col("left") * F.col("size"))
        .withColumn("nth", F.col("nth") - F.col("left"))
        .join(prefixes, "part")
        .select(
            "doc_id", "size", "text_crc32", "row",
            # twice the byte prefix up to the middle of the row, so that all stays in whole numbers
            (2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")).alias("middle2"),
            (F.col("rows_before") + F.col("nth") - 1).alias("rank"),
            "all_bytes",
        )
        .withColumn("shard", F.expr(f"least({n_shards - 1}, cast(middle2 * {n_shards} div greatest(1, 2 * all_bytes) as int))"))
    )
    placed = written(placed.select("doc_id", "size", "text_crc32", "row", "shard", "rank"), "shard-ranks")
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", *(["row"] if row else []), "shard", (F.col("rank") - F.col("first_rank")).alias("slot")
    )


def write_shards(df: DataFrame, path: str, n_shards: int = 24, key: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """Writes the rows of ``df``, with all their columns and their ``slot``, as Parquet in a folder per shard; gives what was written.

    The files of a shard hold its rows in the order of their slots, one range after another, so that a shard is written by
    several tasks. Columns named ``shard`` or ``slot`` are replaced.
    """
    row = free_name(df, "row")
    numbered = written(df.drop("shard", "slot").withColumn(row, F.monotonically_increasing_id()), "shard-rows")
    places = balanced_shards(numbered, n_shards, key, text, overhead, row=row).select(F.col("row").alias(row), "shard", "slot")
    dealt = numbered.join(places, row).drop(row).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").parquet(path)
    discard(numbered)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)
