"""Records, responses and selections: what is refused."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from veristrata.operators import records, responses, selection


def test_requested(spark):
    manifest = spark.createDataFrame([(i, 10 + i) for i in range(9)], "ord int, id bigint")
    ids = lambda **k: [r.claim_id for r in selection.requested(spark, manifest, **k).orderBy("ord").collect()]
    assert ids() == [f"scifact:{10 + i}" for i in range(5)] and len(ids(limit=7)) == 7
    assert ids(ids=" scifact:3 , scifact:1", limit=1) == ["scifact:3"]
    sample = spark.createDataFrame([(["b", "a"],)], "claim_ids array<string>")
    assert ids(sample=sample) == ["b", "a"]
    for bad in ({"ids": "a,,b"}, {"ids": " "}, {"ids": ["a", "a"]}, {"ids": "a", "sample": sample}, {"limit": 0}, {"limit": True}):
        with pytest.raises(ValueError):
            selection.requested(spark, manifest, **bad)


def test_joins_refuse_gaps(spark):
    ids = spark.createDataFrame([(0, "b"), (1, "a")], "ord int, claim_id string")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "claim_id string, x int")
    assert [(r.claim_id, r.x) for r in selection.in_order(ids, rows).orderBy("ord").collect()] == [("b", 2), ("a", 1)]
    with pytest.raises(Exception, match="unknown claim: b"):
        selection.in_order(ids, rows.filter("x <> 2")).collect()
    other = spark.createDataFrame([(0, "p"), (1, "q")], "ord int, passages string")
    assert [(r.claim_id, r.passages) for r in selection.zipped(ids, other).orderBy("ord").collect()] == [("b", "p"), ("a", "q")]
    with pytest.raises(Exception, match="no partner for row 1"):
        selection.zipped(ids, other.limit(1)).collect()
    gold = spark.createDataFrame([("a", "NEI")], "claim_id string, gold string")
    r = rows.select("claim_id", F.lit(None).cast("string").alias("label_gold"), F.lit("ok").alias("execution_status"))
    for join in (lambda: selection.with_gold(r, gold, "calibration"), lambda: selection.with_report_gold(r, gold)):
        with pytest.raises(Exception, match="no gold label"):
            join().collect()
    for args in (("official_test_unlabeled",), ("unknown",), ("calibration", {"split": "development"}), ("calibration", {"corpus_hash": "x"}, "y")):
        with pytest.raises(ValueError):
            selection.with_gold(r, gold, *args)
    with pytest.raises(ValueError, match="no rows"):
        selection.arm_ids(r.limit(0))
    with pytest.raises(ValueError, match="duplicate"):
        selection.arm_ids(r.union(r))
    assert [x.claim_id for x in selection.arm_ids(r).collect()] == ["a", "b", "c"]


def test_sidecar(spark, tmp_path):
    def read(text):
        (tmp_path / "run.json").write_text(text)
        return tuple(selection.run_sidecar(spark, str(tmp_path / "run.json")).first())

    assert read(json.dumps({"run": {"run_id": "r1", "split": "development", "corpus_hash": "h"}})) == ("r1", "development", "h")
    assert read(json.dumps({"run": {"run_id": " "}, "run_id": "top"})) == ("top", None, None)
    for bad in ("[1]", "no json"):
        with pytest.raises(Exception, match="not a JSON object"):
            read(bad)


def test_sample_distribution(spark):
    n = spark.createDataFrame([("r", 5, 0), ("r", 3, 1)], "region string, native_id bigint, ord int")
    r = selection.sample_record(n, ["region"], F.lit("development"), 1, "m")
    assert r.first()["claim_ids"] == ["scifact:5", "scifact:3"]
    errors = {}
    for d in ({"SUPPORT": 1, "NEI": 1}, {"SUPPORT": 3}, {"other": 2}, {"SUPPORT": 3, "NEI": -1}):
        m = F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
        errors[str(d)] = r.select(selection.sample_error(m).alias("e")).first()["e"]
    assert list(errors.values()) == [None, "distribution does not add up", "unknown label in the distribution", "distribution does not add up"]


def test_audit_errors(spark):
    base = {"label": "supported", "cited_span_ids": ["s"]}
    bad = {
        "no JSON object": "nothing",
        "citations are no list": json.dumps(base | {"citations": "x"}),
        "rated a span that was not supplied": json.dumps(base | {"citations": [{"span_id": "t", "adequacy": "adequate"}]}),
        "adequacy outside the allowed set": json.dumps(base | {"citations": [{"span_id": "s", "adequacy": "fine"}]}),
        "uncertainty reasons are no list of strings": json.dumps(base | {"uncertainty_reasons": {"a": 1}}),
    }
    df = spark.createDataFrame([(k, v) for k, v in bad.items()], "want string, text string")
    for r in df.select("want", responses.audit_response(F.col("text"), F.array(F.lit("s"))).alias("a")).collect():
        assert r.a.error == r.want and r.a.label is None and r.a.rated is None
    ok = spark.createDataFrame([(json.dumps(base),)], "text string").select(responses.audit_response(F.col("text"), F.array(F.lit("s"))).alias("a")).first().a
    assert ok.error is None and ok.cited == ["s"] and ok.rated == {} and ok.rationale_codes == ["live_model"]


def test_span_texts_refuse_passages_without_span(spark):
    d = spark.createDataFrame([("a", None, "t")], "claim_id string, span_id string, text string")
    assert records.span_texts(d, d.limit(0)).count() == 0
    with pytest.raises(Exception, match="passage without a span"):
        records.span_texts(d.limit(0), d).collect()
