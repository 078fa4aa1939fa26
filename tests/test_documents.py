"""Configurations, samples, reports, gold maps and bundles from files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from veristrata.operators import sampling, selection, splits
from veristrata.sources import documents, readers

SCHEMA = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 1}, "name": {"type": "string"}}}


def put(at, value):
    at.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(at)


def test_config(spark, tmp_path):
    assert documents.config(spark, put(tmp_path / "a.json", {"k": 3}), SCHEMA) == {"k": 3}
    pytest.importorskip("yaml")
    assert documents.config(spark, put(tmp_path / "a.yaml", "k: 2\nname: x\n"), SCHEMA) == {"k": 2, "name": "x"}
    for bad, why in (("k: 0\n", "minimum"), ("k: 1\nother: 2\n", "additionalProperties"), ("name: x\n", "k: required"), ("- 1\n", "type")):
        with pytest.raises(ValueError, match=why):
            documents.config(spark, put(tmp_path / "b.yaml", bad), SCHEMA)


def test_samples(spark, tmp_path):
    ids = spark.createDataFrame([(0, 5), (1, 3)], "ord int, native_id long").withColumn("k", F.lit("s"))
    record = selection.sample_record(ids, ["k"], F.lit("development"), 7, "m").withColumnRenamed("k", "sample_id")
    documents.write_record(record, str(tmp_path / "r"), "sample.json")
    documents.write_record(record, str(tmp_path / "r"), "sample.json")
    with pytest.raises(ValueError, match="another record"):
        documents.write_record(record.withColumn("seed", F.lit(8)), str(tmp_path / "r"), "sample.json")
    with pytest.raises(ValueError, match="one row"):
        documents.write_record(record.union(record), str(tmp_path / "r"), "two.json")
    s = documents.frozen_sample(spark, str(tmp_path / "r" / "sample.json"))
    asked = selection.requested(spark, None, sample=s)
    assert [r.claim_id for r in asked.orderBy("ord").collect()] == ["scifact:5", "scifact:3"]
    value = json.loads((tmp_path / "r" / "sample.json").read_text())
    with pytest.raises(ValueError, match="hash does not match"):
        documents.frozen_sample(spark, put(tmp_path / "bad.json", {**value, "ids_sha256": "0"}))


def test_reports_and_gold(spark, tmp_path):
    assert [r.claim_id for r in documents.report_ids(spark, put(tmp_path / "a", {"claim_ids": ["b", "a"]})).orderBy("ord").collect()] == ["b", "a"]
    assert documents.report_ids(spark, put(tmp_path / "b", {"claims": [{"claim_id": "x", "label": 1}]})).first().claim_id == "x"
    for bad, why in (({"claim_ids": []}, "no claims"), ({}, "no claims"), ({"claim_ids": ["a", "a"]}, "duplicate"), ({"claim_ids": [" "]}, "blank")):
        with pytest.raises(ValueError, match=why):
            documents.report_ids(spark, put(tmp_path / "c", bad))
    assert {tuple(r) for r in documents.gold_map(spark, put(tmp_path / "g", {"a": "NEI", "b": "SUPPORT"})).collect()} == {("a", "NEI"), ("b", "SUPPORT")}
    with pytest.raises(ValueError, match="not a label"):
        documents.gold_map(spark, put(tmp_path / "g2", {"a": "maybe"}))


def test_bundles(spark, tmp_path):
    one = lambda c, *p, h="x": json.dumps({"claim_id": c, "query": "q", "corpus_hash": h, "passages": [{"doc_id": d, "rank": r, "score": s} for d, r, s in p]})
    good = put(tmp_path / "a", "\n".join([one("a", (1, 1, 2.0), (2, 2, 1.0)), one("b")]))
    assert documents.bundles(spark, good).count() == 2
    for lines, why in (([one("a", (1, 1, 1.0), (2, 3, 0.5))], "ranks"), ([one("a", (1, 1, 1.0), (2, 2, 3.0))], "ranks"), ([one("a"), one("a")], "duplicate"), ([one("a"), one("b", h="y")], "several corpus_hash")):
        with pytest.raises(ValueError, match=why):
            documents.bundles(spark, put(tmp_path / "b", "\n".join(lines)))
    with pytest.raises(ValueError, match="ranks"):
        documents.bundles(spark, good, 1)


def test_manifest_and_alignment(spark, tmp_path):
    m = {"manifest_id": "m", "role": "dev", "ids": [3, 1], "locked": True}
    assert [r.id for r in readers.manifest(spark, put(tmp_path / "m", m)).orderBy("ord").collect()] == [3, 1]
    for bad in ("x", 1.5, None):
        with pytest.raises(Exception, match="not a whole number"):
            readers.manifest(spark, put(tmp_path / "n", {**m, "ids": [3, bad]})).collect()
    a, b = (spark.createDataFrame([(k,) for k in ks], "claim_id string") for ks in ("abc", "bcd"))
    sampling.require_same(a, a.union(a), "claim_id")
    with pytest.raises(ValueError, match="only in the first: a; only in the second: d"):
        sampling.require_same(a, b, "claim_id")
    rows = a.withColumn("split", F.lit("x")).union(b.withColumn("split", F.lit("y")))
    splits.require(splits.smoke(rows, ["x", "y"], {"x": (3, None)}))
    with pytest.raises(ValueError, match="shared ids: 2, not 0"):
        splits.require(splits.smoke(rows, ["x", "y"], {}, [("x", "y")]))
