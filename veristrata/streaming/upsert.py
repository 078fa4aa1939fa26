"""Keyed upsert of a stream into a stored table, with work in proportion to what arrives.

Each micro-batch leaves one sorted-out run of its own (newest row a key); runs are merged
like digits of a counter, a short one into the next that is not much longer, so a row is
rewritten a logarithmic number of times however large the table is.  A batch is named by
one commit record, which a replay of it finds; readers take the newest row a key over the
runs that the latest record names.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.methods import last_write_wins
from ..sources.commits import Ledger, numbered


def _union(spark: SparkSession, path: str, schema, folders: Sequence[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def merge(batch: DataFrame, epoch: int, path: str, key: Sequence[str], order: Sequence[str]) -> bool:
    """Take one batch into the table at ``path``; False if its epoch is there already.  ``order`` tells a key's rows apart."""
    spark = batch.sparkSession
    ledger = Ledger(spark, path)
    last, record = ledger.latest("epoch-")
    if last >= epoch:
        return False
    runs = list(record["runs"]) if record else []

    def write(df: DataFrame) -> dict:
        folder = f"run-{uuid.uuid4().hex}"
        last_write_wins(df, list(key), list(order)).write.parquet(f"{ledger.path}/{folder}")
        return {"folder": folder, "rows": _union(spark, ledger.path, batch.schema, [folder]).count()}

    new = write(batch)
    runs += [new] if new["rows"] else []
    made, rewritten = [new["folder"]], new["rows"]
    while len(runs) > 1 and 2 * runs[-1]["rows"] >= runs[-2]["rows"]:
        both = write(_union(spark, ledger.path, batch.schema, [r["folder"] for r in runs[-2:]]))
        runs[-2:] = [both]
        made.append(both["folder"])
        rewritten += both["rows"]
    kept = {r["folder"] for r in runs}
    stood = ledger.commit(numbered("epoch-", epoch), {"runs": runs, "written": rewritten, "rows": new["rows"]})
    for folder in made:
        if not stood or folder not in kept:
            ledger.delete(folder)
    return stood


def start(stream: DataFrame, path: str, key: Sequence[str], order: Sequence[str], checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the table at ``path`` up to date with the stream; to the end of what is there, unless another trigger is given."""
    writer = stream.writeStream.foreachBatch(lambda batch, epoch: merge(batch, epoch, path, key, order) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def table(spark: SparkSession, path: str, schema, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of every key."""
    _, record = Ledger(spark, path).latest("epoch-")
    runs = record["runs"] if record else []
    rows = _union(spark, path.rstrip("/"), schema, [r["folder"] for r in runs])
    return rows if len(runs) < 2 else last_write_wins(rows, list(key), list(order))


def history(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, rows, written, runs) of every batch: what came, what was written for it, how many runs stood after."""
    ledger = Ledger(spark, path)
    names = ledger.names("epoch-")
    schema = "rows long, written long, runs array<struct<folder:string,rows:long>>"
    r = spark.read.schema(schema).json([f"{ledger.path}/{n}" for n in names]) if names else spark.createDataFrame([], schema)
    return r.select(F.regexp_extract(F.input_file_name(), r"epoch-(\d+)$", 1).cast("long").alias("epoch"), "rows", "written", F.size("runs").alias("runs"))


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete runs that the latest record does not name; for when nobody reads an older one."""
    ledger = Ledger(spark, path)
    names = ledger.names("epoch-")
    alive = {r["folder"] for r in ledger.read(names[-1])["runs"]} if names else set()
    gone = sorted({r["folder"] for n in names for r in ledger.read(n)["runs"]} - alive)
    for folder in gone:
        ledger.delete(folder)
    return gone
