"""From raw documents to training shards, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its
predecessor kept. ``run`` writes what a stage returns as Parquet in the
shared folder and gives the reread table to the next one.

Every stage decides on rows, not on ids: rows that share an id, or have
none, are handled each by its own text and source. Columns beyond those of
``documents`` are left out, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontaminate, language, mixing, neardup, sharding
from waymark.llm.common import discard, scratch, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SEED, SHARDS = 17, 24


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told with a sufficient margin, and puts that language into ``lang``.

    Null and empty texts and those without a letter go. Without any labelled row no language can be told, and all go.
    """
    model = language.train(docs)
    found = language.identify(docs, model).where(~F.col("rejected"))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates on 5-word shingles, that of smallest id (none comes last); texts without words stay."""
    return neardup.without_near_duplicates(docs.select(*COLUMNS), k=5, percent=80)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows in whose text a benchmark passage occurs; null and empty texts stay."""
    return decontaminate.without_passages(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops rows as the mix by source takes them, a row for each copy. Null sources are one source; texts without words are not taken."""
    rows = mixing.mix(docs, F.array("source"), seed=SEED, carry=tuple(COLUMNS)).rows.where(F.col("copies") > 0)
    return rows.select("carried.*", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each row: shards of near-equal bytes. A null text counts as empty."""
    return sharding.balanced_shards(docs, n_shards=SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL has no zstandard encoder, by which the first stage decides.
ORACLE_SQL = None


def _through(spark: SparkSession, sf_dir: str, stages: list) -> DataFrame:
    """The documents after these stages. What a stage has written on its way is deleted with its input once its output is written."""
    with scratch() as keep:
        docs = table(spark, sf_dir, "documents").select(*COLUMNS)
        for name, stage in stages:
            with scratch() as keep_stage:
                after = keep_stage(written(stage(spark, docs, sf_dir), f"stage-{name}"))
            discard(docs)
            docs = after
        return keep(docs) if stages else docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each row that the stages leave."""
    return _through(spark, sf_dir, STAGES)


def write_training_shards(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The end of the pipeline with the texts: a folder of Parquet files per shard below ``path``, rows in the order of their slots."""
    with scratch():
        mixed = _through(spark, sf_dir, STAGES[:-1])
        out = sharding.write_shards(mixed, path, n_shards=SHARDS)
        discard(mixed)
        return out
