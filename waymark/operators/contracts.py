"""Checks of a pipeline against itself and of tables against what is asked of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_worlds(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per column, how many rows of the two tables differ and by how much at most; a row that one of them lacks differs."""
    one = a.select(*keys, F.lit(True).alias("_a"), *(F.col(c).cast("double").alias(f"{c}_a") for c in columns))
    two = b.select(*keys, F.lit(True).alias("_b"), *(F.col(c).cast("double").alias(f"{c}_b") for c in columns))
    both = one.join(two, keys, "full_outer")
    cell = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"{c}_a").alias("x"), F.col(f"{c}_b").alias("y"))
    cells = both.select("_a", "_b", F.explode(F.array(*map(cell, columns))).alias("r")).select("_a", "_b", "r.*")
    differs = F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("x").eqNullSafe(F.col("y"))
    return cells.groupBy("column").agg(
        F.count("*").alias("n"), F.count_if(differs).alias("differing"), F.coalesce(F.max(F.abs(F.col("x") - F.col("y"))), F.lit(0.0)).alias("most")
    )


def perturbation_audit(
    build: Callable[[DataFrame], DataFrame], df: DataFrame, shift: Callable[[DataFrame, int], DataFrame], pairs: list[tuple[int, int]], keys: list[str], columns: list[str]
) -> DataFrame:
    """``build`` run on ``df`` shifted in two ways, for each of the few ``pairs``; what may not know the shifted values may not differ."""
    out = None
    for x, y in pairs:
        found = two_worlds(build(shift(df, x)), build(shift(df, y)), keys, columns)
        part = found.select(F.lit(x).alias("shift_a"), F.lit(y).alias("shift_b"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def contract_check(df: DataFrame, name: str, required: list[str], key: list[str], numeric: str, written: Column) -> DataFrame:
    """A row per check of a table: columns present, rows, repeated keys, longest key, values that are no number, newest write."""
    present = sum(c in df.columns for c in required)
    totals = df.agg(
        F.count("*").alias("rows"), F.max(F.length(F.concat_ws("|", *(F.col(c).cast("string") for c in key)))).cast("long").alias("longest_key"),
        F.count_if(F.col(numeric).isNotNull() & F.col(numeric).try_cast("double").isNull()).alias("not_numeric"), F.max(written).cast("long").alias("newest_write"),
    )
    repeated = df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_keys"))
    one = totals.crossJoin(F.broadcast(repeated))  # one row each
    checks = [("missing_columns", F.lit(len(required) - present).cast("long")), *((c, F.col(c)) for c in ("rows", "longest_key", "not_numeric", "newest_write", "repeated_keys"))]
    rows = F.array(*(F.struct(F.lit(c).alias("check"), v.alias("value")) for c, v in checks))
    return one.select(F.lit(name).alias("table"), F.inline(rows))


@dataclass(frozen=True)
class Contract:
    """What is asked of a table: columns it must have, its key, columns that must hold numbers, and when its rows were written."""

    required: tuple[str, ...]
    key: tuple[str, ...]
    numeric: tuple[str, ...] = ()
    written: Column | None = None


def check_catalog(tables: Mapping[str, Callable[[], DataFrame]], contracts: Mapping[str, Contract]) -> DataFrame:
    """(table, check, column, value) for every contract of a catalog, tables that it lacks among them.

    Per table: whether it is there, required columns that are missing (each by name), rows, repeated and null keys, the
    longest key, values of each numeric column that are no number, and the newest write. Each table is read once for its totals
    and once by key. ``tables`` gives each table by name when it is called, and raises if there is none.
    """
    out = None
    for name, contract in contracts.items():
        part = _checked(name, tables, contract)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("the catalog has no contract")
    return out


def _checked(name: str, tables: Mapping[str, Callable[[], DataFrame]], contract: Contract) -> DataFrame:
    from pyspark.sql import SparkSession

    found: list[tuple[str, str, Column]] = [("present", "", F.lit(int(name in tables)).cast("long"))]
    if name not in tables:
        one = SparkSession.active().range(1)
        return one.select(F.lit(name).alias("table"), F.inline(_cells(found)))
    df = tables[name]()
    have = {c.lower() for c in df.columns}
    found += [("missing_column", c, F.lit(1).cast("long")) for c in contract.required if c.lower() not in have]
    totals, key = [F.count("*").alias("rows")], [c for c in contract.key if c.lower() in have]
    text = F.concat_ws("|", *(F.col(c).cast("string") for c in key))
    for c in contract.numeric:
        if c.lower() in have:
            totals.append(F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull()).alias(f"number_{c}"))
            found.append(("not_numeric", c, F.col(f"number_{c}")))
    if contract.written is not None:
        totals.append(F.max(contract.written).cast("long").alias("newest"))
        found.append(("newest_write", "", F.col("newest")))
    found.append(("rows", "", F.col("rows")))
    one = df.agg(*totals)
    if key and len(key) == len(contract.key):
        some_null = F.lit(False)
        for c in key:
            some_null |= F.col(c).isNull()
        by_key = df.groupBy(*key).agg(F.count("*").alias("n")).agg(
            F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum(F.when(some_null, F.col("n"))), F.lit(0)).alias("null_keys"), F.max(F.length(text)).cast("long").alias("longest")
        )
        one = one.join(by_key, how="left")  # one row each
        found += [("repeated_keys", "", F.col("repeated")), ("null_keys", "", F.col("null_keys")), ("longest_key", "", F.col("longest"))]
    return one.select(F.lit(name).alias("table"), F.inline(_cells(found)))


def _cells(found: list[tuple[str, str, Column]]) -> Column:
    return F.array(*(F.struct(F.lit(check).alias("check"), F.lit(column).alias("column"), value.alias("value")) for check, column, value in found))


def broken(checked: DataFrame, longest_key: int = 64) -> DataFrame:
    """The rows of ``check_catalog`` that break a contract."""
    bad = F.col("check").isin("missing_column", "repeated_keys", "null_keys", "not_numeric") & (F.col("value") > 0)
    return checked.where(bad | ((F.col("check") == "present") & (F.col("value") == 0)) | ((F.col("check") == "longest_key") & (F.col("value") > longest_key)))
