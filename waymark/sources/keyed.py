"""A table kept by key in Parquet: upserts and inserts by bucket, buckets that split as it grows, versions switched atomically.

Rows lie in buckets by hash of the keys. The buckets grow by linear hashing: with n buckets and m the largest power of two
not above n, a row is in bucket ``h mod 2m`` if that is below n, else in ``h mod m``; a new bucket takes its rows from one old
one, so growth moves a bucket's rows at a time and a bucket keeps about ``bucket_rows`` rows at any size of the table. A write reads
and writes the buckets of its own keys, and those that its rows make split.

A version is a small file that names, for each bucket that changed, the folders of its rows; every ``FULL_EVERY``-th names
all. It is renamed into place once its rows are written, which fails if another writer has taken the number. Until then, and
if a write breaks off, the version before is the table. Readers hold the folders of the version with which they began; ``vacuum``
deletes folders that no kept version names. The driver holds a few dozen bytes a bucket, nothing of its rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from waymark.sources import sinks

FULL_EVERY = 16
#: Folders of a bucket above which an insert writes it anew.
MOST_FOLDERS = 8
#: Rows that one task of a write takes where there are enough for all cores; it has whole buckets.
TASK_ROWS = 1_000_000


class ConcurrentWrite(RuntimeError):
    """Another writer has committed first; the write can be repeated."""


def addressed(h: Column, n: int) -> Column:
    """The bucket of a hash among ``n``."""
    m = 1 << (n.bit_length() - 1)
    wide = F.pmod(h, F.lit(2 * m))
    return F.when(wide < n, wide).otherwise(F.pmod(h, F.lit(m))).cast("int")


def parent(bucket: int, n: int) -> int:
    """The bucket among ``n`` from which a later ``bucket`` takes its rows."""
    while bucket >= n:
        bucket -= 1 << (bucket.bit_length() - 1)
    return bucket


class KeyedTable:
    """The table in folder ``path`` with one row for each value of ``keys``; null keys are keys like others."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], bucket_rows: int = 1_000_000):
        self.spark, self.path, self.keys, self.bucket_rows = spark, path.rstrip("/"), list(keys), bucket_rows
        self.schema = StructType([StructField(f.name, f.dataType, True) for f in schema.fields])
        self.names = self.schema.names
        jvm = spark._jvm
        self._paths = jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # versions

    def _version_path(self, version: int):
        return self._paths(f"{self.path}/versions/{version:012d}.json")

    def versions(self) -> list[int]:
        folder = self._paths(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:12]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def _load(self, version: int) -> dict:
        stream = self._fs.open(self._version_path(version))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def state(self, version: int | None = None) -> dict:
        """(version, n, buckets) with the folders and rows of each bucket; of the newest version, or of that named."""
        known = [v for v in self.versions() if version is None or v <= version]
        if not known or (version is not None and known[-1] != version):
            if version:
                raise ValueError(f"{self.path} has no version {version}")
            return {"version": 0, "n": 1, "buckets": {}}
        parts = []
        for v in reversed(known):
            parts.append(self._load(v))
            if parts[-1]["full"]:
                break
        buckets: dict[int, dict] = {}
        for p in reversed(parts):
            buckets |= {int(b): e for b, e in p["buckets"].items()}
        return {"version": known[-1], "n": parts[0]["n"], "buckets": {b: e for b, e in buckets.items() if e["rows"]}}

    def _commit(self, state: dict, n: int, changed: dict[int, dict]) -> int:
        version = state["version"] + 1
        full = version % FULL_EVERY == 1
        buckets = (state["buckets"] | changed) if full else changed
        body = json.dumps({"n": n, "full": full, "buckets": buckets}).encode()
        draft = self._paths(f"{self.path}/versions/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(body))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._version_path(version)), none)
        except Exception as error:
            self._fs.delete(draft, False)
            if version in self.versions():
                raise ConcurrentWrite(f"version {version} of {self.path} was committed by another writer") from error
            raise
        return version

    # rows

    def _files(self, entries: list[dict], columns: list[str] | None = None) -> DataFrame:
        folders = [f"{self.path}/data/{f}" for e in entries for f in e["folders"]]
        names = columns or self.names
        if not folders:
            return self.spark.createDataFrame([], self.schema).select(*names)
        return self.spark.read.schema(self.schema).parquet(*folders).select(*names)

    def read(self, version: int | None = None) -> DataFrame:
        return self._files(list(self.state(version)["buckets"].values()))

    def _arrived(self, new: DataFrame) -> DataFrame:
        """The rows of ``new``, written once as they come."""
        return sinks.written(new.select(*self.names), "keyed")

    def _arrivals(self, arrived: DataFrame, n: int) -> dict[int, int]:
        """How many rows arrived for each bucket of ``n``; no row is dealt for it."""
        found = arrived.groupBy(addressed(F.xxhash64(*self.keys), n).alias("bucket")).agg(F.count("*").alias("rows"))
        return {r["bucket"]: r["rows"] for r in found.collect()}  # no more than buckets

    def _keys(self, arrived: DataFrame, rows: int) -> int:
        """About how many keys the ``rows`` that arrived have, by a sketch; it tells only how many buckets they call for."""
        return min(rows, arrived.agg(F.approx_count_distinct(F.xxhash64(*self.keys), 0.01).alias("n")).first()["n"])

    def _placed(self, rows: DataFrame, n: int, buckets: int) -> DataFrame:
        """``rows`` dealt to their buckets among ``n``, a bucket to one task, and as many to each as make ``TASK_ROWS``.

        The more buckets a task takes, the larger are the blocks of the shuffle, which are compressed one by one.
        """
        placed = rows.withColumn("_bucket", addressed(F.xxhash64(*self.keys), n))
        tasks = max(self.spark.sparkContext.defaultParallelism * 2, -(-buckets * self.bucket_rows // TASK_ROWS))
        return placed.repartition(max(1, min(buckets, tasks)), "_bucket")

    def _first(self, old: DataFrame, arrived: DataFrame, newer: bool, order: list[Column], n: int, buckets: int) -> DataFrame:
        """The first row of each key by bucket, arrived ones (in ``order``) before those of the table if ``newer``, else after them.

        All rows are dealt by bucket alone, once, and sorted once: a key's rows meet in its bucket, whose task also writes it.
        ``_old`` tells the table's rows.
        """
        both = old.withColumn("_old", F.lit(True)).unionByName(arrived.withColumn("_old", F.lit(False)))
        rank = F.col("_old").asc() if newer else F.col("_old").desc()
        w = W.partitionBy("_bucket", *self.keys).orderBy(rank, *order)
        return self._placed(both, n, buckets).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def _write(self, placed: DataFrame) -> dict[int, dict]:
        """Writes ``placed`` rows by bucket; gives the folder and rows of each."""
        folder = uuid.uuid4().hex
        target = f"{self.path}/data/{folder}"
        placed.select(*self.names, "_bucket").write.partitionBy("_bucket").parquet(target)
        schema = StructType([*self.schema.fields, StructField("_bucket", IntegerType())])
        counts = self.spark.read.schema(schema).parquet(target).groupBy("_bucket").count().collect()  # a row per bucket
        return {r["_bucket"]: {"folders": [f"{folder}/_bucket={r['_bucket']}"], "rows": r["count"]} for r in counts}

    def _grown(self, state: dict, more: int) -> tuple[int, set[int]]:
        """The number of buckets that ``more`` rows call for, and the old ones from which the new ones take rows."""
        rows = sum(e["rows"] for e in state["buckets"].values()) + more
        n = max(state["n"], -(-rows // self.bucket_rows))
        return n, {parent(b, state["n"]) for b in range(state["n"], n)}

    def _entries(self, buckets: dict[int, dict], which: set[int]) -> list[dict]:
        return [buckets[b] for b in sorted(which & set(buckets))]

    def upsert(self, new: DataFrame, order: list[Column]) -> int:
        """Replaces the rows of the keys in ``new`` and adds new keys; gives the version. Repeating it leaves the same table."""
        state, arrived = self.state(), self._arrived(new)
        arrivals = self._arrivals(arrived, state["n"])
        version = state["version"]
        if arrivals:
            n, split = self._grown(state, self._keys(arrived, sum(arrivals.values())))
            sources = (set(arrivals) | split) & set(state["buckets"])
            old = self._files(self._entries(state["buckets"], sources))
            found = self._write(self._first(old, arrived, True, order, n, len(set(arrivals) | sources) + n - state["n"]))
            gone = {b: {"folders": [], "rows": 0} for b in sources if b not in found}
            version = self._commit(state, n, found | gone)
        sinks.drop_written(arrived)
        return version

    def insert(self, new: DataFrame, order: list[Column]) -> int:
        """Adds the rows of ``new`` whose keys the table lacks; only keys of their buckets are read. Repeating it adds nothing.

        The rows are written by the buckets that there are; those of buckets that split, or have got too many folders, are
        written once more, each by the task that reads it.
        """
        state, arrived = self.state(), self._arrived(new)
        arrivals = self._arrivals(arrived, state["n"])
        touched, version = set(arrivals), state["version"]
        if arrivals and not state["buckets"]:  # every key is new, so the growth is known before
            n, _ = self._grown(state, self._keys(arrived, sum(arrivals.values())))
            version = self._commit(state, n, self._write(self._first(self._files([]), arrived, False, order, n, n)))
            touched = set()
        if not touched:
            sinks.drop_written(arrived)
            return version
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name not in self.keys]
        known = self._files(self._entries(state["buckets"], touched), self.keys).select(*self.keys, *rest)
        fresh = self._write(self._first(known, arrived, False, order, state["n"], len(touched)).where("NOT _old"))
        count = sum(e["rows"] for e in fresh.values())
        if count:
            n, split = self._grown(state, count)
            full = {b for b in fresh if len(state["buckets"].get(b, {"folders": []})["folders"]) >= MOST_FOLDERS}
            anew = split | full
            found = {}
            for b in set(fresh) - anew:
                old = state["buckets"].get(b, {"folders": [], "rows": 0})
                found[b] = {"folders": [*old["folders"], *fresh[b]["folders"]], "rows": old["rows"] + fresh[b]["rows"]}
            if anew:
                moved = self._files([*self._entries(state["buckets"], anew), *self._entries(fresh, anew)])
                found |= self._write(moved.withColumn("_bucket", addressed(F.xxhash64(*self.keys), n)))
            gone = {b: {"folders": [], "rows": 0} for b in anew & set(state["buckets"]) if b not in found}
            version = self._commit(state, n, found | gone)
        sinks.drop_written(arrived)
        return version

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the folders that none of the newest ``keep`` versions names, those of broken writes among them; gives their number.

        Not to be run beside a writer, whose folders no version names yet.
        """
        versions = self.versions()
        named = {f for v in versions[-keep:] for e in self.state(v)["buckets"].values() for f in e["folders"]}
        tops = {f.split("/")[0] for f in named}
        data = self._paths(f"{self.path}/data")
        deleted = 0
        if not self._fs.exists(data):
            return 0
        for top in self._fs.listStatus(data):
            name = top.getPath().getName()
            if name not in tops:
                self._fs.delete(top.getPath(), True)
                deleted += 1
                continue
            for part in self._fs.listStatus(top.getPath()):
                if part.isDirectory() and f"{name}/{part.getPath().getName()}" not in named:
                    self._fs.delete(part.getPath(), True)
                    deleted += 1
        return deleted
