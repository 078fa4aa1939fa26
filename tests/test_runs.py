"""Runs with commit and resume, and the ledger and fingerprints below them."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veristrata.operators import fingerprint, methods, runs
from veristrata.sources.commits import Ledger

REPO = Path(__file__).resolve().parent.parent


def items(spark, n=95):
    return spark.range(n).select((F.lit(1000) - F.col("id")).alias("ord"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("claim_id"), F.lit("t").alias("claim"), F.lit("e").alias("evidence"))


def work(df):
    return methods.single_judge(df, "B1")


def test_ledger_keeps_the_first(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.read("a") is None and ledger.names() == [] and ledger.latest("v") == (-1, None)
    assert ledger.commit("a", {"x": "é"}) and not ledger.commit("a", {"x": 2})
    assert ledger.read("a") == {"x": "é"}
    assert ledger.commit("v0000000002", {"n": 2}) and ledger.commit("v0000000010", {"n": 10})
    assert ledger.latest("v") == (10, {"n": 10}) and ledger.names() == ["a", "v0000000002", "v0000000010"]
    assert not [p for p in os.listdir(tmp_path) if p.startswith(".a.") and not p.endswith(".crc")]


def test_fingerprint_of_content(spark):
    rows = [(1, "a"), (2, None), (2, ""), (3, "x,1:y")]
    df = spark.createDataFrame(rows, "k long, t string")
    a = fingerprint.of(df, ["k", "t"])
    assert a == fingerprint.of(df.repartition(7).orderBy(F.desc("t")), ["k", "t"])
    others = [rows[:3], [*rows, rows[0]], [(1, "a"), (2, None), (2, None), (3, "x,1:y")], [(1, "a"), (2, None), (2, ""), (3, "x,1:z")]]
    assert len({fingerprint.of(spark.createDataFrame(r, df.schema), ["k", "t"])[1] for r in others} | {a[1]}) == 5
    parts = fingerprint.partial(df, ["k", "t"], [(F.col("k") % 2).alias("b")])
    assert fingerprint.whole(parts).first()["fingerprint"] == a[1]
    assert fingerprint.of(df.limit(0), ["k", "t"])[0] == 0


def test_run_resumes_and_keeps_order(spark, tmp_path):
    run = runs.plan(items(spark), str(tmp_path / "r"), ["ord"], 10, "seed=7")
    assert (run.parts, run.rows) == (10, 95)
    assert runs.advance(run, spark, work, parts=[0, 3, 9]) == [0, 3, 9]
    with pytest.raises(ValueError, match="7 of 10 parts"):
        runs.results(run, spark)
    assert runs.results(run, spark, whole=False).count() == 25
    seen = []

    def counted(df):
        seen.extend(r.claim_id for r in df.select("claim_id").collect())
        return work(df)

    found = runs.plan(items(spark).repartition(3), str(tmp_path / "r"), ["ord"], 10, "seed=7")
    assert found == run
    assert len(runs.advance(found, spark, counted)) == 7 and len(seen) == 70  # the missing parts only
    assert runs.advance(found, spark, counted) == [] and len(seen) == 70
    got = [r.claim_id for r in runs.results(run, spark).collect()]
    assert got == [f"c{i}" for i in range(94, -1, -1)]  # asked order
    s = runs.sidecar(run, spark).first()
    assert (s.n_parts, s.n_committed, s.n_rows, s.n_failed) == (10, 10, 95, 0)


def test_run_is_bound_to_its_items(spark, tmp_path):
    path = str(tmp_path / "r")
    runs.plan(items(spark), path, ["ord"], 10, "seed=7")
    for df, config in ((items(spark, 94), "seed=7"), (items(spark), "seed=8"), (items(spark).withColumn("claim", F.lit("u")), "seed=7")):
        with pytest.raises(ValueError, match="other items"):
            runs.plan(df, path, ["ord"], 10, config)
    with pytest.raises(ValueError, match="duplicate claim_id"):
        runs.plan(items(spark).union(items(spark, 1)), str(tmp_path / "d"), ["ord"], 10)
    empty = runs.plan(items(spark, 0), str(tmp_path / "e"), ["ord"], 10)
    assert empty.parts == 0 and runs.advance(empty, spark, work) == [] and runs.results(empty, spark).count() == 0


def test_wrong_rows_are_not_committed(spark, tmp_path):
    run = runs.plan(items(spark, 30), str(tmp_path / "r"), ["ord"], 10)
    lose = lambda df: work(df.filter("claim_id <> 'c7'"))
    with pytest.raises(ValueError, match="9 rows for 10 items"):
        runs.advance(run, spark, lose)
    assert len(runs.missing(run, spark)) == 1  # the sound parts stand
    with pytest.raises(ValueError, match="other items"):
        runs.advance(run, spark, lambda df: work(df).withColumn("claim_id", F.lit("c")))
    assert runs.advance(run, spark, work) == [2]


def test_failed_rows_get_a_generation(spark, tmp_path):
    run = runs.plan(items(spark, 20), str(tmp_path / "r"), ["ord"], 5)
    bad = F.col("claim_id").isin("c3", "c11")
    runs.advance(run, spark, lambda df: work(df).withColumn("execution_status", F.when(bad, "failed").otherwise("ok")))
    assert runs.advance(run, spark, work) == []  # failed rows are results
    later = runs.again(run, spark)
    assert later.rows == 2
    runs.advance(later, spark, work)
    rows = runs.latest(run, spark).collect()
    assert [r.claim_id for r in rows] == [f"c{i}" for i in range(19, -1, -1)] and all(r.execution_status == "ok" for r in rows)
    assert runs.results(run, spark).filter("execution_status = 'failed'").count() == 2  # the old rows are kept


KILLED = """
import os, signal, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from veristrata.operators import runs
from veristrata.sources import commits
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.python.worker.reuse", "false").getOrCreate()
items = spark.range(40).select(F.col("id").alias("ord"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("claim_id"))
run = runs.plan(items, {path!r}, ["ord"], 10)
mark = {path!r} + "-killed"
def judged(batches):
    for b in batches:
        yield b.assign(execution_status="ok")
        if "c3" in set(b.claim_id) and not os.path.exists(mark):
            open(mark, "w").close()
            os.kill(os.getpid(), signal.SIGKILL)  # a task dies after it has written rows
work = lambda df: df.select("claim_id").mapInPandas(judged, "claim_id string, execution_status string")
commit = commits.Ledger.commit
def dying(self, name, record):
    if {die} and name.endswith("2"):
        os._exit(9)  # the driver dies between write and commit
    return commit(self, name, record)
commits.Ledger.commit = dying
print(*runs.advance(run, spark, work, lanes=1))
print(*sorted(r.claim_id for r in runs.results(run, spark).collect()))
print(len(os.listdir({path!r} + "/rows")))
"""


def test_killed_task_and_killed_driver(tmp_path):
    path = str(tmp_path / "run")
    code = [KILLED.format(repo=str(REPO), path=path, die=die) for die in (True, False)]
    first = subprocess.run([sys.executable, "-c", code[0]], capture_output=True, text=True)
    assert first.returncode == 9, first.stderr[-2000:]
    assert os.path.exists(path + "-killed")
    second = subprocess.run([sys.executable, "-c", code[1]], capture_output=True, text=True)
    assert second.returncode == 0, second.stderr[-2000:]
    worked, ids, folders = second.stdout.splitlines()[-3:]
    assert worked == "2 3"
    assert ids.split() == sorted(f"c{i}" for i in range(40))  # each claim once
    assert folders == "5"  # the lost part's first folder is there, and nobody reads it


def test_parts_together_are_one_job_and_commit_each(spark, tmp_path):
    run, calls = runs.plan(items(spark, 100), str(tmp_path / "r"), ["ord"], 10), []
    counted = lambda df: calls.append(1) or work(df)
    lose = lambda df: counted(df.filter("claim_id <> 'c7'"))
    with pytest.raises(ValueError, match="9 rows for 10 items"):
        runs.advance(run, spark, lose, lanes=1, together=5)
    assert len(calls) == 2 and len(runs.missing(run, spark)) == 1  # the sound parts of both writes stand
    other = runs.plan(items(spark, 100), str(tmp_path / "o"), ["ord"], 10)
    first = lambda df: runs.advance(other, spark, work, parts=[1]) and work(df)
    runs.advance(other, spark, lambda df: first(df) if not runs.commits(other, spark).count() else work(df), lanes=1, together=10)
    got = [r.claim_id for r in runs.results(other, spark).collect()]  # part 1 lies in two folders, one of which counts
    assert got == [f"c{i}" for i in range(99, -1, -1)]
    broken = lambda df: work(df).withColumn("claim_id", F.when(F.col("claim_id") == "c95", "x").otherwise(F.col("claim_id")))
    third = runs.plan(items(spark, 100), str(tmp_path / "t"), ["ord"], 10)
    with pytest.raises(ValueError, match="other items"):
        runs.advance(third, spark, broken, lanes=1, together=10)
    assert len(runs.missing(third, spark)) == 1
