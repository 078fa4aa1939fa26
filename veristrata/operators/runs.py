"""Runs over many items that can stop anywhere and go on: numbered parts, each committed once.

``plan`` numbers the items in asked order and stores them in parts; the plan is bound to
the items' fingerprint and the run's configuration, so a run never goes on over other
items.  ``advance`` works the parts that no commit names, several at a time: a part, or
some parts together, is written to a folder of its own, read back, compared with the plan
(each asked id once, nothing else), and then each part is named by a commit record.  A run that dies between the two leaves
a folder that nobody reads; two runs of one part leave one commit.  ``results`` reads the
committed parts alone and puts them in asked order.  Failed rows are results, never silently
run again: ``again`` opens a new generation for them and leaves the old rows where they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.commits import Ledger, numbered
from . import checks, fingerprint
from .ordered import running

Work = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Run:
    path: str
    folder: str
    parts: int
    rows: int
    fingerprint: str
    schema: str

    def ledger(self, spark: SparkSession) -> Ledger:
        return Ledger(spark, self.path)

    def items(self, spark: SparkSession) -> DataFrame:
        """Planned items with their place (``asked``) and part."""
        return spark.read.schema(StructType.fromJson(json.loads(self.schema))).parquet(f"{self.path}/{self.folder}")


def plan(items: DataFrame, path: str, order: Sequence[str], part_rows: int = 10_000, config: str = "") -> Run:
    """The run at ``path`` over ``items`` (claim_id, unique and not blank); made now, or found as it was left.

    Other items, another order of them or another ``config`` than the run began with are an error.
    """
    spark = items.sparkSession
    ledger = Ledger(spark, path)
    n, digest = fingerprint.of(items.withColumn("_config", F.lit(f"{config}|{','.join(order)}|{part_rows}")), [*sorted(items.columns), "_config"])
    found = ledger.read("plan")
    if found is None:
        checks.require_empty(checks.blank(items, "claim_id").unionByName(checks.duplicates(items, "claim_id")))
        folder = f"items-{uuid.uuid4().hex}"
        placed = running(items, [F.col(c) for c in [*order, "claim_id"]], {"asked": F.lit(1)}, tag="run-order")
        placed = placed.withColumn("part", F.floor(F.col("asked") / part_rows).cast("int"))
        placed.hint("rebalance", "part").write.partitionBy("part").parquet(f"{ledger.path}/{folder}")
        record = {"folder": folder, "parts": -(-n // part_rows), "rows": n, "fingerprint": digest, "schema": placed.schema.json()}
        if not ledger.commit("plan", record):
            ledger.delete(folder)
        found = ledger.read("plan")
    if found["fingerprint"] != digest:
        raise ValueError(f"the run at {path} was planned over other items or another configuration")
    return Run(ledger.path, **found)


def _name(part: int) -> str:
    return numbered("part-", part)


def missing(run: Run, spark: SparkSession) -> list[int]:
    done = set(run.ledger(spark).names("part-"))
    return [k for k in range(run.parts) if _name(k) not in done]


def advance(run: Run, spark: SparkSession, work: Work, lanes: int = 4, parts: Sequence[int] | None = None, tasks: int | None = None, together: int = 1) -> list[int]:
    """Work on the missing parts (of ``parts``, if given), ``lanes`` at a time; numbers of those committed by this call.

    ``work`` takes the items of a part, or of up to ``together`` parts, and returns one row a
    claim_id.  Where items cost little, many parts together save as many jobs; what a dead
    call loses is that much more.  A part that fails leaves the others to finish: parts whose
    job fails together are worked one by one.  The first error is raised at the end.
    """
    ledger, items = run.ledger(spark), run.items(spark)
    asked_for = None if parts is None else set(parts)
    todo = [k for k in missing(run, spark) if asked_for is None or k in asked_for]
    size = max(1, min(together, -(-len(todo) // max(1, lanes))))

    def some(group: list[int]) -> tuple[list[int], Exception | None]:
        """(parts committed, first error) of one write."""
        mine = items.filter(F.col("part").isin(group))
        rows = mine.drop("part", "asked")
        folder = f"rows/{group[0]:010d}-{uuid.uuid4().hex}"
        try:
            work(rows.repartition(tasks) if tasks else rows).write.parquet(f"{ledger.path}/{folder}")
            back = spark.read.parquet(f"{ledger.path}/{folder}")
            found = {r["part"]: r for r in _compared(mine.select("claim_id", "part"), back).collect()}  # one row a part
        except Exception as e:  # noqa: BLE001 - the other parts go on
            return one_by_one(group, folder) if len(group) > 1 else ([], e)
        if None in found and len(group) > 1:  # rows of other items: whose fault it is, only its own job tells
            return one_by_one(group, folder)
        won, named, error = [], False, None
        for k in group:
            r = found[k]
            if None in found or r["wrong"]:
                n = r["got"] + (found[None]["got"] if None in found else 0)
                error = error or ValueError(f"part {k}: {n} rows for {r['n']} items, or rows of other items")
            elif ledger.commit(_name(k), {"part": k, "folder": folder, "rows": r["n"], "failed": r["failed"], "ids": r["ids"]}):
                won.append(k)
                named = True
        if not named:
            ledger.delete(folder)
        return won, error

    def one_by_one(group: list[int], folder: str) -> tuple[list[int], Exception | None]:
        ledger.delete(folder)
        each = [some([k]) for k in group]
        return [k for won, _ in each for k in won], next((e for _, e in each if e), None)

    with ThreadPoolExecutor(max(1, lanes)) as pool:
        done = list(pool.map(some, [todo[i : i + size] for i in range(0, len(todo), size)]))
    for _, error in done:
        if error:
            raise error
    return [k for won, _ in done for k in won]


def _compared(asked: DataFrame, back: DataFrame) -> DataFrame:
    """(part, n, got, wrong, failed, ids): items of each part, rows that came for them, items without their one row; part null: rows of no item."""
    failed = F.count_if(F.col("execution_status") != "ok") if "execution_status" in back.columns else F.lit(0).cast("long")
    got = back.groupBy("claim_id").agg(F.count("*").alias("_got"), failed.alias("_failed")).withColumnRenamed("claim_id", "_id")
    j = asked.join(got, F.col("claim_id") == F.col("_id"), "full")
    n, wrong = F.coalesce("_got", F.lit(0)), F.coalesce(F.col("_got"), F.lit(0)) != 1
    per = j.groupBy("part").agg(
        F.count("claim_id").alias("n"), F.sum(n).alias("got"), F.count_if(wrong).alias("wrong"), F.sum(F.coalesce("_failed", F.lit(0))).alias("failed"), *fingerprint.sums(["claim_id"])
    )
    return per.select("part", "n", "got", "wrong", "failed", fingerprint.digest(F.col("n")).alias("ids"))


def commits(run: Run, spark: SparkSession) -> DataFrame:
    """(part, folder, rows, failed, ids) of the committed parts."""
    schema = "part int, folder string, rows long, failed long, ids string"
    names = run.ledger(spark).names("part-")
    return spark.read.schema(schema).json([f"{run.path}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def results(run: Run, spark: SparkSession, whole: bool = True) -> DataFrame:
    """Committed rows in asked order, each claim once; parts without a commit are an error unless ``whole`` is off."""
    if whole and (gone := missing(run, spark)):
        raise ValueError(f"{len(gone)} of {run.parts} parts are not committed, the first is {gone[0]}")
    named = commits(run, spark).select("part", F.col("folder").alias("_folder"))
    folders = sorted({f"{run.path}/{r['_folder']}" for r in named.collect()})  # one short row a part
    if not folders:
        return run.items(spark).limit(0).select("claim_id")
    rows = spark.read.parquet(*folders)
    names = rows.columns
    # a folder may hold parts that another call committed first, from a folder of its own
    rows = rows.withColumn("_from", F.regexp_extract(F.col("_metadata.file_path"), r"/(rows/[^/]+)/[^/]+$", 1))
    asked = run.items(spark).select("claim_id", "asked", "part").join(F.broadcast(named), "part")
    j = rows.join(asked, "claim_id").filter(F.col("_from") == F.col("_folder"))
    return j.orderBy("asked").select(*names)


def again(run: Run, spark: SparkSession, part_rows: int = 10_000) -> Run | None:
    """A generation of its own for the failed rows of a whole run, at ``<path>/again``; None without any."""
    bad = results(run, spark).filter("execution_status <> 'ok'").select("claim_id")
    if not bad.head(1):
        return None
    items = run.items(spark).drop("part").join(bad, "claim_id", "left_semi")
    return plan(items.withColumnRenamed("asked", "before"), f"{run.path}/again", ["before"], part_rows, run.fingerprint)


def latest(run: Run, spark: SparkSession) -> DataFrame:
    """Results with those of the generation after them in place of failed rows; the old rows stay stored."""
    first = results(run, spark)
    later = Ledger(spark, f"{run.path}/again")
    record = later.read("plan")
    if record is None:
        return first
    new = results(Run(later.path, **record), spark, whole=False)
    if "execution_status" not in new.columns:
        return first
    kept = first.join(new.select("claim_id"), "claim_id", "left_anti").unionByName(new, allowMissingColumns=True)
    return kept.join(run.items(spark).select("claim_id", "asked"), "claim_id").orderBy("asked").drop("asked")


def sidecar(run: Run, spark: SparkSession, config_hash: str = "") -> DataFrame:
    """One row for the run: rows, failures, parts, and a hash of the ids that no order of them changes."""
    ids = fingerprint.fingerprint(run.items(spark), ["claim_id"]).select(F.col("fingerprint").alias("ids_fingerprint"))
    c = commits(run, spark).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("failed"), F.lit(0)).alias("n_failed"), F.count("*").alias("n_committed"))
    return c.join(ids).select(F.lit(run.fingerprint).alias("run_id"), F.lit(config_hash).alias("config_hash"), F.lit(run.parts).alias("n_parts"), "n_committed", "n_rows", "n_failed", "ids_fingerprint")
