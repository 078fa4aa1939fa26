"""The chain of judgment: boundary, cards, budgets, reports and model-backed stages."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from veristrata.operators import judgment, live, methods, staged

CLAIM = "c string, claim_text string, neutral_question string, dependencies array<string>"


def _claims(spark, *rows):
    return spark.createDataFrame([(c, t, "What of treatment and survival?", d) for c, t, d in rows], CLAIM).withColumnRenamed("c", "claim_id")


def _passages(spark, *rows):
    return spark.createDataFrame(list(rows), "claim_id string, rank int, span_id string, text string")


def _citations(spark, *rows):
    return spark.createDataFrame([(*r, "D0") for r in rows], "claim_id string, ord int, span_id string, text string, provenance string, access_scope string")


def test_verdicts_and_card(spark):
    claims = _claims(spark, ("a", "treatment improved survival", []), ("b", "treatment improved survival", ["a"]), ("z", "treatment improved survival", None))
    p = _passages(spark, ("a", 3, "D1:1:0-9", "treatment improved survival"), ("a", 1, "D1:2:0-9", None), ("b", 1, "D1:3:0-9", "treatment reduced survival"))
    c = _citations(spark, ("a", 1, "D0:1:0-9", "treatment improved survival", "original"), ("b", 1, "D0:2:0-9", "weather", "original"), ("b", 2, None, "x", None))
    r = {x.claim_id: x for x in staged.verdicts(claims, c, p, "h").collect()}
    assert (r["a"].label, r["a"].link, r["a"].codes, r["a"].cited) == ("supported", "valid", ["labels_agree"], ["D0:1:0-9", "D1:1:0-9"])
    assert r["a"].card.split("\n") == [
        "Claim: treatment improved survival", "Evidence verdict: supported [D1:1:0-9].", "Why: treatment improved survival [D1:1:0-9]", "What is uncertain: None recorded.",
        "Search scope: corpus hash h; 2 independent passages; retrieval round 1.", "Original citations: adequate.",
        "Reconciler: D0 and D1 both assign supported, and no D0 versus D1 conflict is recorded [D0:1:0-9] [D1:1:0-9]. Inference link: valid.",
        "Next useful check: No further check is recorded on this claim.",
    ]
    assert (r["b"].d0_status, r["b"].d1_label, r["b"].link, r["b"].status) == ("failed", "contradicted", "unresolved", "failed")
    assert r["b"].codes == ["d0_d1_conflict", "d0_not_repaired_from_d1"]
    assert "What is uncertain: no_addressing_passage, missing_required_citation, missing_provenance." in r["b"].card
    assert (r["z"].d0_code, r["z"].d1_code, r["z"].adequacy) == ("missing_required_citation", "no_addressing_passage", "inadequate")
    assert "0 independent passages; retrieval round none." in r["z"].card and "missing_provenance" not in r["z"].card
    assert staged.verdicts(claims.limit(0), c, p).count() == 0


def test_boundary(spark):
    claims = _claims(spark, ("a", "treatment improved survival", []))
    p = _passages(spark, ("a", 1, "D1:1:0-9", "treatment improved survival"))
    sealed = judgment.read_evidence(claims.select("claim_id", "neutral_question"), p.select("claim_id", "span_id", "text"))
    assert staged.judge(claims, sealed, p).first().label == "supported"
    for bad, why in (
        (sealed.withColumn("answer", F.lit("other")), "seal is broken"), (sealed.filter("false"), "no sealed record"), (sealed.withColumn("neutral_question", F.lit("q")), "question is another"),
    ):
        with pytest.raises(Exception, match=why):
            staged.judge(claims, bad, p).collect()
    with pytest.raises(Exception, match="outside its passages"):
        staged.judge(claims, sealed, p.withColumn("span_id", F.lit("D1:7:0-9"))).collect()
    with pytest.raises(ValueError):
        staged.cap(p, 9)
    card = spark.createDataFrame(
        [("a", "see [D1:8:0-9]", "supported", ["D1:1:0-9"], [], {"D1:1:0-9": "x"}, [], [], "s", "adequate", "n", "valid")],
        "claim_id string, claim_text string, label string, cited array<string>, d0_cited array<string>, spans map<string,string>, uncertain array<string>, checks array<string>, scope string, adequacy string, note string, link string",
    )
    with pytest.raises(Exception, match="unknown span"):
        judgment.claim_cards(card).collect()


def test_reports(spark):
    rows = [("r", i, f"p{i}", f"scifact:{i}", ["p0", "else"] if i == 1 else [], f"s{i // 2}") for i in range(11)]
    c = spark.createDataFrame(rows, "report_id string, ord int, proposer_id string, claim_id string, dependencies array<string>, span string")
    kept, rest = staged.bound(c)
    assert [x.dependencies for x in kept.filter("turn = 2").collect()] == [["scifact:0", "else"]] and kept.count() == 8
    claims = kept.withColumn("claim_text", F.lit("treatment improved survival")).withColumn("neutral_question", F.lit("treatment survival"))
    r = staged.reports(kept, staged.report_verdicts(claims, _citations(spark), _passages(spark)), rest).first()
    assert (r.claims_in_report, r.claims_judged, r.partial, r.unchecked_spans, r.failed_closed) == (11, 8, True, ["s4", "s5"], True)
    assert len(r.outcomes) == 8 and r.explanation.count("Claim: ") == 8
    with pytest.raises(Exception, match="comes twice"):
        staged.bound(c.withColumn("claim_id", F.lit("scifact:1")))[0].collect()
    with pytest.raises(ValueError):
        staged.bound(c, 9)


def test_a_claim_of_two_reports(spark):
    rows = [("r1", 0, "a", "x", [], "s"), ("r2", 0, "b", "x", ["c"], "s"), ("r2", 1, "c", "y", [], "t")]
    c = spark.createDataFrame(rows, "report_id string, ord int, proposer_id string, claim_id string, dependencies array<string>, span string")
    kept, rest = staged.bound(c.withColumn("claim_text", F.lit("treatment improved survival")).withColumn("neutral_question", F.lit("treatment survival")))
    text = "treatment improved survival"
    cites = _citations(spark, *((k, 1, f"D0:{k}:0-9", text, "original") for k in "xy"))
    judged = staged.report_verdicts(kept, cites, _passages(spark, *((k, 1, f"D1:{k}:0-9", text) for k in "xy")))
    assert {(r.report_id, r.claim_id): r.link for r in judged.collect()} == {("r1", "x"): "valid", ("r2", "x"): "unresolved", ("r2", "y"): "valid"}
    assert {r.report_id: (r.n_valid, len(r.outcomes)) for r in staged.reports(kept, judged, rest).collect()} == {"r1": (1, 1), "r2": (1, 2)}
    twice = _claims(spark, ("a", text, []), ("a", "another text", []))
    with pytest.raises(Exception, match="a claim comes twice"):
        staged.verdicts(twice, _citations(spark), _passages(spark)).collect()


def test_same_evidence(spark):
    items = spark.createDataFrame([("a", "x"), ("b", "x")], "claim_id string, claim string")
    docs = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("c", 3), ("a", None)], "claim_id string, doc_id bigint")
    r = {x.claim_id: x for x in methods.same_evidence(items, docs, "What of {claim}?").collect()}
    assert sorted(r["a"].reader_cited) == [1, 2] and r["b"].reader_cited == [] and "no D0 abstracts" in r["b"].reader_answer
    with pytest.raises(Exception, match="needs claim text"):
        methods.same_evidence(items.withColumn("claim", F.lit(" ")), docs, "{claim}?").collect()


def _auditor():
    def call(prompt: str) -> str:
        r = json.loads(prompt)
        assert set(r) == {"claim_id", "normalized_claim", "passages"}
        if r["claim_id"] == "late":
            raise TimeoutError("late")
        first = r["passages"][0]["span_id"]
        return json.dumps({"label": "supported", "cited_span_ids": [first], "citations": [{"span_id": first, "adequacy": "adequate", "defects": []}]})

    return call


def test_live_audit(spark):
    claims = _claims(spark, *((c, "treatment improved survival", []) for c in ("a", "late", "none", "broken")))
    c = _citations(
        spark, ("a", 1, "D0:1:0-9", "x", "original"), ("a", 2, "D0:2:0-9", "y", "original"), ("late", 1, "D0:1:0-9", "x", "original"),
        ("broken", 1, "D0:1:0-9", "x", "original"), ("broken", 2, None, "x", None),
    )
    flags, judged = live.d0(claims, c, _auditor, backoff=0.0)
    j = {x.claim_id: (x.label, x.status, x.rationale_codes) for x in judged.collect()}
    assert j == {
        "a": ("supported", "completed", ["live_model"]), "late": ("unaddressed", "failed", ["live_timeout"]),
        "none": ("unaddressed", "failed", ["missing_required_citation"]), "broken": ("supported", "failed", ["live_model"]),
    }
    f = sorted((x.claim_id, x.span_id or "", x.adequacy, ",".join(x.defects)) for x in flags.collect())
    assert f == [
        ("a", "D0:1:0-9", "adequate", ""), ("a", "D0:2:0-9", "unverifiable", "citation_not_rated"), ("broken", "", "inadequate", "missing_required_citation,missing_provenance"),
        ("broken", "D0:1:0-9", "adequate", ""), ("late", "", "inadequate", "live_timeout"), ("none", "", "inadequate", "missing_required_citation"),
    ]


def test_a_claim_in_many_reports_is_judged_once(spark, monkeypatch):
    seen, judged = [], staged._judged
    monkeypatch.setattr(staged, "_judged", lambda c, *a: seen.append(c.count()) or judged(c, *a))
    text = "treatment improved survival"
    rows = [("r1", "c", text, "q of treatment survival", []), ("r2", "c", text, "q of treatment survival", ["x"]), ("r3", "c", "treatment reduced survival", "q of treatment survival", [])]
    claims = spark.createDataFrame(rows, "report_id string, claim_id string, claim_text string, neutral_question string, dependencies array<string>")
    cites = spark.createDataFrame([("c", 1, "D0:1:0-9", text, "original", "D0")], "claim_id string, ord int, span_id string, text string, provenance string, access_scope string")
    shown = spark.createDataFrame([("c", 1, "D1:1:0-9", text)], "claim_id string, rank int, span_id string, text string")
    got = {r.report_id: (r.claim_id, r.link, r.card.split("Inference link: ")[1].split(".")[0]) for r in staged.report_verdicts(claims, cites, shown).collect()}
    assert seen == [2] and got == {"r1": ("c", "valid", "valid"), "r2": ("c", "unresolved", "unresolved"), "r3": ("c", "invalid", "invalid")}


def test_live_steps_read_what_is_stored(spark):
    claims = spark.createDataFrame([("c", "treatment improved survival", "q")], "claim_id string, claim_text string, neutral_question string")
    shown = _passages(spark, ("c", 1, "D1:1:0-9", "treatment improved survival"))
    reply = lambda: lambda p: json.dumps({"answer": "a", "cited_span_ids": ["D1:1:0-9"], "label": "supported"})
    d = live.d1(claims, shown, reply, reply, backoff=0.0)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("from_json") == 1  # nothing is ranked or parsed again
    assert [(r.label, r.cited, r.status) for r in d.collect()] == [("supported", ["D1:1:0-9"], "completed")]


def test_verdicts_move_evidence_once(spark):
    claims = spark.createDataFrame([("c", "treatment improved survival", "treatment survival", [])], "claim_id string, claim_text string, neutral_question string, dependencies array<string>")
    cites = _citations(spark, ("c", 1, "D0:1:0-9", "treatment improved survival", "original"))
    v = staged.verdicts(claims, cites, _passages(spark, ("c", 1, "D1:1:0-9", "treatment improved survival")))
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "/veristrata/" not in "".join(v.inputFiles())
    assert v.first().link == "valid"
