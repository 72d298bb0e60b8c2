"""Reading tables under logical names, from files and with fallbacks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str, **options) -> DataFrame:
    """A CSV file or folder with header lines, also gzipped; columns go by name, in whatever order and case the header has them.

    Columns beyond those of ``schema`` are passed over, missing ones and files whose headers differ are errors, values that
    don't parse become null. With ``header=False`` columns go by place.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    options = {"header": True, "mode": "PERMISSIVE", **options}
    if str(options["header"]).lower() != "true":
        return spark.read.schema(wanted).options(**options).csv(path)
    named = [c.removeprefix("\ufeff") for c in spark.read.options(**options).csv(path).columns]
    types = {f.name.lower(): f.dataType for f in wanted}
    missing = types.keys() - {c.lower() for c in named}
    if missing:
        raise ValueError(f"{path} has no column {', '.join(sorted(missing))}; its header is {', '.join(named)}")
    found = T.StructType([T.StructField(c, types.get(c.lower(), T.StringType())) for c in named])
    return spark.read.schema(found).options(**{"enforceSchema": False, **options}).csv(path).select(*(F.col(f"`{f.name}`").alias(f.name) for f in wanted))


def scan_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One nested record per file; files that don't parse are left out."""
    read = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    return read.where("_bad IS NULL").drop("_bad")


def scan_table(df: DataFrame, columns: list[str], keys: DataFrame | None = None) -> DataFrame:
    """The ``columns`` of the rows whose key occurs in ``keys``."""
    kept = df if keys is None else df.join(keys, keys.columns, "left_semi")
    return kept.select(*columns)


@dataclass(frozen=True)
class Catalog:
    """Physical tables by logical name, with an expression for each logical column; ``overrides`` win, name by name."""

    tables: dict[str, tuple[str, dict[str, str]]]
    overrides: dict[str, tuple[str, dict[str, str]]] = field(default_factory=dict)

    def scan(self, spark: SparkSession, name: str, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
        physical, columns = self.tables[name]
        if name in self.overrides:
            physical, own = self.overrides[name]
            columns = {**columns, **own}
        return read(spark, physical).select(*(F.expr(e).alias(c) for c, e in columns.items()))


def scan_or_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """``primary``, or ``fallback`` if that has no rows; both empty is an error."""
    for df in (primary, fallback):
        if not df.isEmpty():
            return df
    raise ValueError("neither source has rows")


def load_timetable(df: DataFrame, key: str, actuals: list[str]) -> DataFrame:
    """The rows as planned: ``actuals`` are null and the key has no padding zeros; a key of zeros only keeps one."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = {c: F.lit(None).cast(types[c]) for c in actuals}
    return df.withColumns({key: F.regexp_replace(F.col(key).cast("string"), "^0+(?=.)", ""), **cols})


def day_profile(df: DataFrame, moment: str) -> DataFrame:
    """How many rows a staged file has and the time they span."""
    return df.agg(F.count("*").alias("n"), F.min(moment).alias("first"), F.max(moment).alias("last"))
