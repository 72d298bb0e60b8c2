"""What the text operators share: reading tables, written intermediate tables, file access."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes that may be broadcast at once; larger inputs go block by block.
BROADCAST_BYTES = 16 << 20


#: Bytes of an Arrow batch that a Python worker gets at once, where the session has Spark's default.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession | None = None) -> None:
    """Sets ``BATCH_BYTES`` for the session, unless it has a setting of its own: bounds a worker's memory when texts are long."""
    spark = spark or SparkSession.active()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or in local mode a fresh local one where it is unset."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/waymark/{label}-{uuid.uuid4().hex}"


_SCOPE: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("written tables of the open scope", default=None)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the ``written`` tables made inside, but for those given to the function that it yields."""
    tables: list[DataFrame] = []
    kept: set[str] = set()
    before = _SCOPE.set(tables)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._waymark_path)
        return df

    try:
        yield keep
    finally:
        _SCOPE.reset(before)
        for t in tables:
            if t._waymark_path not in kept:
                discard(t)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once in the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._waymark_path = path
    if (open_scope := _SCOPE.get()) is not None:
        open_scope.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``written`` table that no later step reads."""
    path = getattr(df, "_waymark_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
