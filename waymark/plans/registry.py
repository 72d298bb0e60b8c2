"""All trip and interval queries by name, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.plans import audits, book, checks, cleaning, feeds, gaps, journeys, keyed, known, leaks, lines, outlook, scores, storage, trips  # noqa: F401


def queries():
    return dict(book.QUERIES)


def oracle_sql():
    return dict(book.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.QUERIES["E3_position_at"](spark, sf_dir)
