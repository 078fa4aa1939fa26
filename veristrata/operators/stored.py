"""Tables between the passes of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[str, weakref.ref] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder in local mode only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="veristrata-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and read it back: lineage ends, and what it holds is settled."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/veristrata/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT[path] = weakref.ref(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows that a shuffle's partition should hold before AQE joins small ones.
TASK_ROWS = 200_000


@contextmanager
def wide_shuffles(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, shuffles have at least a partition for each TASK_ROWS of ``rows``, so that a task's memory does not grow with the input.

    What is written within counts; a plan that runs later has the session's own number.
    """
    name = "spark.sql.shuffle.partitions"
    own = spark.conf.get(name)
    spark.conf.set(name, str(max(int(own), -(-rows // TASK_ROWS))))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def dropped(df: DataFrame) -> None:
    """Delete a table of stored() that no later step reads."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for name in {f.rpartition("/")[0] for f in df.inputFiles() if "/veristrata/" in f}:
        p = jvm.org.apache.hadoop.fs.Path(name)
        p.getFileSystem(conf).delete(p, True)
        _KEPT.pop(name, None)


def release(spark: SparkSession) -> None:
    """Delete every table that stored() wrote in this process; results that still read one end here."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(_KEPT):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        del _KEPT[path]


@atexit.register
def _at_exit() -> None:
    alive = {id(s): s for s in (ref() for ref in list(_KEPT.values())) if s is not None}
    for spark in alive.values():
        try:
            if spark.sparkContext._jsc is not None:
                release(spark)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return
