"""Intermediate tables in a folder that driver and executors share: lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows up to which a measured side is broadcast; beyond it the join shuffles both sides.
BROADCAST_ROWS = 20_000
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
SHUFFLE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: set[str] = set()
#: Paths written since each open ``released`` block began, in this thread.
_open: contextvars.ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = contextvars.ContextVar("open", default=())


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only a local session without one gets its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/sievework-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str, batch: int = BATCH_ROWS) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    batch: rows of an Arrow batch on the way. The folder goes when the interpreter ends, or with the ``released`` block
    that is open.
    """
    spark = df.sparkSession
    path = _path(spark, name)
    with batches_of(spark, batch):
        df.write.parquet(path)
    return _back(spark, path, df.schema)


def gathered(name: str, parts: list[Callable[[], contextlib.AbstractContextManager[DataFrame]]]) -> DataFrame:
    """The rows of several tables of one schema, each opened, written and closed in turn.

    What a table cuts on its way goes with it, and so do the shuffles of its writes.
    """
    spark = SparkSession.active()
    path = _path(spark, name)
    with shuffles_freed(spark):
        for part in parts:
            with released(), part() as rows:
                rows.write.mode("append").option("compression", "zstd").parquet(path)
    return _back(spark, path, rows.schema)


def _path(spark: SparkSession, name: str) -> str:
    """A new folder for a table, that goes with the ``released`` block that is open or when the interpreter ends."""
    root = scratch_root(spark)
    if root not in _folders:
        _folders.add(root)
        atexit.register(_drop, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    for written in _open.get()[-1:]:
        written.append((spark, path))
    return path


def _back(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out._scratch = (spark, path)
    return out


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of writes inside go as each write ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CONF, "false")
    spark.conf.set(SHUFFLE_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CONF, before)


def free(df: DataFrame | None) -> None:
    """Delete a table that ``cut`` wrote, once nothing will read it any more."""
    if df is not None and hasattr(df, "_scratch"):
        _drop(*df._scratch)


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Tables cut inside are deleted at the end: only for results that are written by then and don't read them again."""
    written: list[tuple[SparkSession, str]] = []
    before = _open.set((*_open.get(), written))
    try:
        yield
    finally:
        _open.reset(before)
        for spark, path in written:
            _drop(spark, path)


@contextlib.contextmanager
def kept() -> Iterator[None]:
    """Tables cut inside outlive the ``released`` block around."""
    before = _open.set((*_open.get(), []))
    try:
        yield
    finally:
        _open.reset(before)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the actions inside: whole long texts then fit in a worker."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def _drop(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder, if the session still lives."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table if it has at most ``rows`` rows; else leave the join to shuffle (AQE splits skew)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
