"""Readers and sinks on awkward files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from veristrata.operators import ordered
from veristrata.sources import readers, sinks


def lines(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


def test_bad_line_is_an_error_whatever_is_read(spark, tmp_path):
    path = lines(tmp_path / "a.jsonl", {"claim_id": "scifact:1", "label": "NEI"}, "", '{"claim_id": "scif')
    ddl = "claim_id string, label string"
    for read in (lambda d: d.select("label").collect(), lambda d: d.count(), lambda d: d.collect()):
        with pytest.raises(Exception, match="bad JSON line"):
            read(readers.json_lines(spark, path, ddl))
    loose = readers.json_lines(spark, path, ddl, strict=False)
    assert loose.count() == 2 and loose.filter("_bad is not null").count() == 1
    good = lines(tmp_path / "b.jsonl", {"claim_id": "scifact:1"}, " ", {"claim_id": "scifact:2", "label": "SUPPORT", "more": 1})
    assert [tuple(r) for r in readers.json_lines(spark, good, ddl).collect()] == [("scifact:1", None), ("scifact:2", "SUPPORT")]


def test_last_line_of_a_claim_wins(spark, tmp_path):
    """Many small splits of one file: order is the place in the file."""
    path = lines(tmp_path / "p.jsonl", *[{"claim_id": f"scifact:{i % 50}", "label": f"L{i}"} for i in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r.claim_id: r.label for r in readers.checkpoint(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"scifact:{i}": f"L{2950 + i}" for i in range(50)}


def test_registry_by_whole_path(spark, tmp_path):
    for top in "ab":
        lines(tmp_path / top / "run1" / "predictions.jsonl", {"claim_id": f"scifact:{top}", "label": "NEI"})
    entries = [("one", "dev", "b2", f"{tmp_path}/a/run1"), ("two", "dev", "b2", f"{tmp_path}/b/run1/"), ("three", "dev", "b2", f"{tmp_path}/missing")]
    got = sorted((r.family, r.claim_id) for r in readers.registry(spark, entries).collect())
    assert got == [("one", "scifact:a"), ("two", "scifact:b")]
    assert readers.registry(spark, entries[2:]).count() == 0


def test_replace(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.replace(spark.range(3), path)
    sinks.replace(spark.read.schema("id long").json(path).filter("id > 0"), path)  # reads what it replaces
    assert sorted(r.id for r in spark.read.json(path).collect()) == [1, 2]
    with pytest.raises(Exception, match="stop"):
        sinks.replace(spark.range(1).select(F.raise_error(F.lit("stop")).cast("string").alias("id")), path)
    assert spark.read.json(path).count() == 2 and len(list(tmp_path.iterdir())) <= 2


def test_running_sums(spark):
    rows = [(k, i % 7, i, i % 5) for i, k in enumerate(["a"] * 300 + ["b"] * 3 + [None] * 20)]
    df = spark.createDataFrame(rows, "k string, o int, i int, v int").repartition(5)
    got = {(r.k, r.i): (r.n, r.s) for r in ordered.running(df, [-F.col("o"), F.col("i")], {"n": F.lit(1), "s": F.col("v")}, ["k"]).collect()}
    for key in ("a", "b", None):
        n = s = 0
        for _, _, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])):
            assert got[key, i] == (n, s)
            n, s = n + 1, s + v
    assert len(got) == len(rows) and ordered.running(df.limit(0), [F.col("i")], {"n": F.lit(1)}).count() == 0
