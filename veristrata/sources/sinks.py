"""Sinks: prediction logs, whole-file replacement, nested bundles, run sidecars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, fingerprint


def append_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace(df: DataFrame, path: str) -> None:
    """All or nothing: written beside, then renamed; the old data goes when the new is in place."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    new, old, to = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new-{mark}", f"{path}.old-{mark}", path))
    df.write.json(new.toString())
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = fs.exists(to)
    if before and not fs.rename(to, old):
        raise OSError(f"cannot move {path}")
    if not fs.rename(new, to):
        if before:
            fs.rename(old, to)
        raise OSError(f"cannot replace {path}")
    if before:
        fs.delete(old, True)


def bundles(nested: DataFrame, path: str, ids: DataFrame) -> None:
    """Write and read back: every asked claim must be there."""
    nested.write.mode("overwrite").json(path)
    back = nested.sparkSession.read.schema("claim_id STRING").json(path)
    checks.require_empty(checks.missing(ids, back, "claim_id"))


def ok_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("execution_status", F.lit("ok")) == "ok")


def sidecar(rows: DataFrame, run_id: str, config_hash: str) -> DataFrame:
    """One row for a run; its ids go into a hash of partial sums, so they never meet in one row."""
    a = rows.agg(
        F.lit(run_id).alias("run_id"), F.lit(config_hash).alias("config_hash"), F.count("*").alias("n_rows"),
        F.count_if(F.coalesce("execution_status", F.lit("ok")) == "ok").alias("n_ok"),
        *fingerprint.sums(["claim_id"]),
    )
    ids = fingerprint.digest(F.col("n_rows"))
    return a.select("run_id", "config_hash", "n_rows", "n_ok", ids.alias("ids_fingerprint"))


def drop_failed(df: DataFrame, path: str) -> DataFrame:
    """The ok rows in place of a stored run, the whole run kept beside it; returns what was kept."""
    spark = df.sparkSession
    backup = f"{path}.before-{uuid.uuid4().hex}"
    df.write.json(backup)
    kept = spark.read.schema(df.schema).json(backup)
    replace(ok_rows(kept), path)
    return kept


def markdown(rows: list[dict]) -> str:
    """Small collected tables as Markdown."""
    if not rows:
        return ""
    names = list(rows[0])
    body = ["| " + " | ".join("" if r[n] is None else str(r[n]) for n in names) + " |" for r in rows]
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *body])
