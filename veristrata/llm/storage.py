"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[str, weakref.ref] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder in local mode only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="veristrata-")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def persist(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veristrata/{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _KEPT[path] = weakref.ref(spark)
    return spark.read.schema(df.schema).parquet(path)


def persist_by(df: DataFrame, tag: str, column: str, values: list[int]) -> dict[int, DataFrame]:
    """Write ``df`` once, split by an integer column; one table per value, each of which discard() can delete."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veristrata/{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").partitionBy(column).parquet(path)
    _KEPT[path] = weakref.ref(spark)
    schema = df.drop(column).schema
    out = {}
    for v in values:
        part = f"{path}/{column}={v}"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)
        there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        out[v] = spark.read.schema(schema).parquet(part) if there else spark.createDataFrame([], schema)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that persist() or persist_by() wrote and that no later step reads."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles():
        p = jvm.org.apache.hadoop.fs.Path(name)
        if "/veristrata/" in name:
            p.getFileSystem(conf).delete(p, False)


def release(spark: SparkSession) -> None:
    """Delete every table that persist() wrote in this process."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(_KEPT):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        del _KEPT[path]


def lean(run: Callable) -> Callable:
    """A mapInArrow function that gives its worker's free memory back when a task ends.

    Workers live from stage to stage; without this each keeps the most it ever used.
    """

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


#: Fixed values of mallopt: its two options, the largest block from the heap, and how much free memory stays on it.
_TRIM, _MMAP, HEAP_BLOCK, HEAP_FREE = -1, -3, 16 << 20, 64 << 20


def steady(run: Callable) -> Callable:
    """A lean() function whose arrays come and go many times a second: free memory stays with the worker until the task ends.

    Else the C library gives each larger array back to the system and takes new pages for the next.
    """

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        keep_free()
        yield from lean(run)(batches)

    return whole


def keep_free() -> None:
    import ctypes

    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(_MMAP, HEAP_BLOCK)
        libc.mallopt(_TRIM, HEAP_FREE)
    except (AttributeError, OSError):  # another C library
        return


def lean_group(run: Callable) -> Callable:
    """The same for a function of one group's table, after each group that is not small."""

    def whole(table):
        out = run(table)
        if table.nbytes > 1 << 20:
            give_back()
        return out

    return whole


def lean_cogroup(run: Callable) -> Callable:
    """The same for a function of two groups' tables."""

    def whole(left, right):
        out = run(left, right)
        if left.nbytes + right.nbytes > 1 << 20:
            give_back()
        return out

    return whole


def give_back() -> None:
    """Free memory of the allocators back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most ARROW_ROWS rows and about ARROW_BYTES: texts are long, and batches exist several times over."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(name)
        size = 0 if now.startswith("-") else spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now)
        if not 0 < size <= most:  # without a bound, or with a wider one
            spark.conf.set(name, str(most))


def parts_for(df: DataFrame, bytes_each: int, least: int = 12) -> int:
    """Number of hash parts for an input, by Catalyst's size estimate.

    Where Spark knows no size (local rows, cached plans), its shuffle partitions decide.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, size // bytes_each)


@atexit.register
def _at_exit() -> None:
    alive = {id(s): s for s in (ref() for ref in list(_KEPT.values())) if s is not None}
    for spark in alive.values():
        try:
            if spark.sparkContext._jsc is not None:
                release(spark)
        except Exception:  # the JVM may be gone already
            return
