"""Freeze records: what a corpus, a split or a run's inputs were when they were fixed, and whether they still are.

A record holds the row count and fingerprint of each named table and the configuration; it
is committed once and never replaced.  Held-out work asks for it first.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import Ledger
from . import fingerprint

Tables = dict[str, tuple[DataFrame, Sequence[str]]]


class Unfrozen(PermissionError):
    """There is no freeze record, or what it speaks of has changed."""


def state(tables: Tables) -> DataFrame:
    """(name, n, fingerprint) of every table, all in one plan."""
    parts = None
    for name, (df, columns) in tables.items():
        one = fingerprint.partial(df, columns).withColumn("name", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    return fingerprint.whole(parts, ["name"])


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def freeze(spark: SparkSession, path: str, tables: Tables, config: dict | None = None, name: str = "freeze") -> dict:
    """Commit the record of these tables; a record that stands already must say the same."""
    now = {r["name"]: {"n": r["n"], "fingerprint": r["fingerprint"]} for r in state(tables).collect()}  # one row a table
    record = {"tables": now, "config": config_hash(config or {})}
    ledger = Ledger(spark, path)
    if not ledger.commit(name, record) and ledger.read(name) != record:
        raise Unfrozen(f"another freeze record stands at {path}")
    return record


def compared(spark: SparkSession, path: str, tables: Tables, name: str = "freeze") -> DataFrame:
    """(name, n, fingerprint, frozen_n, frozen_fingerprint, ok) of every table now or then."""
    record = Ledger(spark, path).read(name)
    if record is None:
        raise Unfrozen(f"no freeze record at {path}")
    then = spark.createDataFrame([(k, t["n"], t["fingerprint"]) for k, t in record["tables"].items()], "name string, frozen_n long, frozen_fingerprint string")
    return state(tables).join(then, "name", "full").withColumn("ok", F.col("fingerprint").eqNullSafe(F.col("frozen_fingerprint")))


def require(spark: SparkSession, path: str, tables: Tables, config: dict | None = None, name: str = "freeze") -> None:
    """Pass only if nothing has changed since the freeze: the gate of a held-out run."""
    bad = [r["name"] for r in compared(spark, path, tables, name).filter("not ok").select("name").collect()]
    if bad:
        raise Unfrozen(f"changed since the freeze: {', '.join(sorted(bad))}")
    if Ledger(spark, path).read(name)["config"] != config_hash(config or {}):
        raise Unfrozen("another configuration than the frozen one")
