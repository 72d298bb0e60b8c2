"""Audit of features against the future: each feature as it is, and as it would be if it looked ahead.

A place is where a feature could read what is not known yet. ``sealed`` is what the pipeline reads there, ``opened`` what a
faulty one would. In two worlds that differ only after the moment of the features, a sealed feature may not differ, and
an opened one must, or else the audit could not have seen the fault there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.contracts import two_worlds

OPEN = "__open"


def place(name: str, sealed: Column, opened: Column) -> list[Column]:
    """Both readings of one place, to be selected side by side."""
    return [sealed.alias(name), opened.alias(f"{name}{OPEN}")]


def opened(df: DataFrame, keys: list[str]) -> DataFrame:
    """Features made from opened inputs, to be joined to the same ones from sealed inputs."""
    return df.withColumnsRenamed({c: f"{c}{OPEN}" for c in df.columns if c not in keys})


def leak_audit[World, Shifted](build: Callable[[Shifted], DataFrame], world: World, shift: Callable[[World, int], Shifted], pair: tuple[int, int], keys: list[str]) -> DataFrame:
    """(feature, reading, n, differing) of every place that ``build`` gives: rows that differ between the worlds shifted by either of ``pair``."""
    a, b = (build(shift(world, by)) for by in pair)
    found = two_worlds(a, b, keys, [c for c in a.columns if c not in keys])
    is_open = F.endswith(F.col("column"), F.lit(OPEN))
    name = F.when(is_open, F.substring_index("column", OPEN, 1)).otherwise(F.col("column"))
    return found.select(name.alias("feature"), F.when(is_open, "opened").otherwise("sealed").alias("reading"), "n", "differing")


def verdict(audit: DataFrame) -> DataFrame:
    """(feature, clean, caught): whether the feature knows nothing of the future, and whether its mutant was found out."""
    some = lambda reading: F.bool_or((F.col("reading") == reading) & (F.col("differing") > 0))
    return audit.groupBy("feature").agg((~some("sealed")).alias("clean"), some("opened").alias("caught"))


def assert_no_leak(audit: DataFrame) -> None:
    """Raises if a feature leaks, or if a mutant went unnoticed."""
    bad = [r for r in verdict(audit).collect() if not (r["clean"] and r["caught"])]  # a row for each feature
    if bad:
        told = ", ".join(f"{r['feature']} ({'leaks' if not r['clean'] else 'its mutant was not caught'})" for r in bad)
        raise ValueError(f"audit of the future: {told}")
