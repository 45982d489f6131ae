"""Intermediate tables in the folder that all executors share, and what keeps workers small."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch of text: what a worker holds at once, besides a longer single row.
BATCH_BYTES = 4 << 20
#: Rows of numbers up to which a staged table is sent to every task; a larger one is joined by shuffles.
BROADCAST_ROWS = 100_000


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, which the driver and all executors see.

    Where it is unset, a session of one process (tests) gets a folder of its own; a cluster is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="docloom-")
    return _own[context.applicationId]


#: What this process has put into shared folders and not deleted yet.
_left: set[str] = set()


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/docloom-{label}-{uuid.uuid4().hex}"
    _left.add(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _left.discard(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Whatever is staged inside goes at the end: results are lazy, so write or collect them inside.

        with scratch(spark):
            link_documents(docs).write.parquet(path)
    """
    before = set(_left)
    try:
        yield
    finally:
        for path in _left - before:
            _delete(spark, path)


@atexit.register
def _delete_own() -> None:
    """The folders that sessions of one process got of their own go with the process."""
    for path in _own.values():
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


#: Where it is set while a table is staged, the shuffles behind the table go as soon as it is written.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: it cuts the lineage, and lost executors cost no recomputation.

    free: delete the shuffles that the write leaves, which nothing reads again.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(FREE_SHUFFLES, None)
    if free:
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(FREE_SHUFFLES, before) if before is not None else spark.conf.unset(FREE_SHUFFLES)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        if path:
            _delete(df.sparkSession, path)
            df._staged_path = None


def measured(df: DataFrame, label: str, **also: Column) -> tuple[DataFrame, dict]:
    """staged, with its number of rows n and other aggregates of it, found while it is written."""
    seen = Observation()
    out = staged(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in also.items()]), label)
    return out, seen.get


def sent(df: DataFrame, rows: int) -> DataFrame:
    """df as the side of a join: sent to every task if it has BROADCAST_ROWS at most, else left to shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def small_batches(spark: SparkSession) -> None:
    """Texts reach Python workers in batches of BATCH_BYTES, not of 10,000 rows however long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back to the system: workers live on, and each would keep its largest task's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None) -> Callable:
    """run for mapInArrow, which leaves nothing in the worker when its task ends. forget: drops what run keeps between batches."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            release()

    return wrapped
