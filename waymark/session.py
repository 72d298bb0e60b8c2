"""One place for the session settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "waymark", master: str | None = None, **extra: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``extra`` adds settings, with ``__`` for dots."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    for k, v in extra.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
