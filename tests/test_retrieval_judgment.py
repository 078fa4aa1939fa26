"""Retrieval, label policy, audit, reconciliation, sources and streaming."""

import json
import os

import pytest
from pyspark.sql import functions as F

from veristrata.functions import labels as L
from veristrata.functions import text as T
from veristrata.operators import checks, decompose, judgment, methods, retrieval
from veristrata.plans import queries, views
from veristrata.sources import readers, sinks
from veristrata.streaming import ingest, upsert


def test_retrieval_caps_and_ranks(spark):
    docs = spark.createDataFrame([(i, f"alpha topic document {i}") for i in range(25)] + [(100 + i, f"other words {i}") for i in range(60)], "doc_id bigint, text string")
    claims = spark.createDataFrame([("scifact:1", "alpha topic")], "claim_id string, text string")
    hits, passages = retrieval.gather(claims, docs, retrieval.build_index(docs), forms=(("a", "{text}"), ("b", "{text} document"), ("c", "{text}?")))
    per = {r["form"]: r["n"] for r in hits.groupBy("form").agg(F.count("*").alias("n")).collect()}
    assert per == {"a": 20, "b": 20, "c": 20}
    got = passages.orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 9))
    best = hits.groupBy("doc_id").agg(F.max("score").alias("s"))
    assert passages.join(best, "doc_id").filter("score <> s").count() == 0


def test_dedupe_same_text(spark):
    docs = spark.createDataFrame([(1, "Zebraunique  kinase"), (2, "nothing here"), (3, "zebraunique kinase"), (4, "more of it"), (5, "yet more")], "doc_id bigint, text string")
    claims = spark.createDataFrame([("c", "zebraunique kinase")], "claim_id string, text string")
    hits, passages = retrieval.gather(claims, docs, retrieval.build_index(docs))
    assert [r["doc_id"] for r in passages.collect()] == [1]
    assert {r["doc_id"] for r in hits.collect()} == {1, 3}


def test_recall_and_jaccard(spark):
    d = spark.createDataFrame([([1, 2, 3], [3, 9])], "ids array<bigint>, gold array<bigint>")
    r = d.select(retrieval.recall_at_k(F.col("ids"), F.col("gold"), 2).alias("a"), retrieval.recall_at_k(F.col("ids"), F.col("gold"), 3).alias("b")).first()
    assert (r.a, r.b) == (0, 0.5)
    j = spark.createDataFrame([([1, 2], [2, 3])], "x array<int>, y array<int>").select(retrieval.jaccard(F.col("x"), F.col("y")).alias("j")).first()
    assert j.j == pytest.approx(1 / 3)


def test_gold_docs_are_all_that_contain(spark, tmp_path):
    passages = ["one two three four five six", " lead one two three four", "one two", "x", "tail a b c d\n", "five  six", "p q r s", "p q r s t", None]
    texts = ['say "one two three four five six"', "(one two three four five six)", "none two three four five sixth", "a lead one two three four b", "lead one two three four", "tail a b c d\nmore"]
    texts += ["five  six", "five six", "zp q r sz", "zp q r s tz", "", None, "p  q r s t", "one two three four five six"]
    spark.createDataFrame(list(enumerate(passages)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted((f"scifact:{i}", k) for i, p in enumerate(passages) for k, t in enumerate(texts) if p is not None and t is not None and p in t)
    assert sorted(tuple(r) for r in views.gold_docs(spark, str(tmp_path)).collect()) == want


CLAIM = "Compound MX-42 increased memory retention"
CASES = [
    (CLAIM, ["Compound MX-42 increased memory retention in mice"], "supported", "supporting_direction"),
    (CLAIM, ["Compound MX-42 decreased memory retention"], "contradicted", "contradicting_direction"),
    (CLAIM, ["Compound MX-42 did not increase memory retention"], "contradicted", "contradicting_direction"),
    (CLAIM, ["Plants grow in sunlight"], "unaddressed", "no_addressing_passage"),
    (CLAIM, ["Compound memory retention was measured"], "underdetermined", "inconclusive_relevant_evidence"),
    (CLAIM, ["Memory retention increased with compound", "Memory retention decreased with compound"], "underdetermined", "conflicting_results"),
    ("Compound MX-42 causes increased memory retention", ["Compound linked with increased memory retention"], "underdetermined", "causal_overreach"),
]


def test_label_policy(spark):
    rows = [(i, c, j, f"D1:{j}:0-9", p) for i, (c, ps, *_) in enumerate(CASES) for j, p in enumerate(ps)]
    df = judgment.with_stance(spark.createDataFrame(rows, "claim_id int, claim_text string, ord int, span_id string, text string"))
    got = {r["claim_id"]: (r["label"], r["code"]) for r in judgment.decide(df, ["claim_id"]).collect()}
    assert got == {i: (label, code) for i, (_, _, label, code) in enumerate(CASES)}


def test_audit(spark):
    claims = spark.createDataFrame([("a", CLAIM), ("b", CLAIM), ("c", CLAIM)], "claim_id string, claim_text string")
    good = CASES[0][1][0]
    rows = [("a", 0, "D0:1:0-9", good, "original", "D0"), ("c", 0, "D0:1:0-9", good, "original", "D0"), ("c", 1, None, None, "original", "D0")]
    flags, judged = judgment.audit(claims, spark.createDataFrame(rows, "claim_id string, ord int, span_id string, text string, provenance string, access_scope string"))
    got = {r["claim_id"]: (r["label"], r["status"]) for r in judged.collect()}
    assert got == {"a": ("supported", "completed"), "b": ("unaddressed", "failed"), "c": ("supported", "failed")}
    worst = {r["claim_id"]: r["adequacy"] for r in judgment.rollup_adequacy(flags).collect()}
    assert worst == {"a": "adequate", "b": "inadequate", "c": "inadequate"}


def test_reconcile(spark):
    ddl = "claim_id string, d0_label string, d1_label string, d0_status string, d1_status string, d0_code string, d1_code string, n_dependencies int"
    rows = [
        ("same", "supported", "supported", "completed", "completed", "", "", 0), ("conflict", "supported", "contradicted", "completed", "completed", "", "", 0),
        ("broken", "supported", "supported", "failed", "completed", "", "", 0), ("depends", "supported", "supported", "completed", "completed", "", "", 1),
    ]
    got = {r["claim_id"]: (r["label"], r["link"], r["status"]) for r in judgment.reconcile(spark.createDataFrame(rows, ddl)).collect()}
    assert got["same"] == ("supported", "valid", "completed") and got["conflict"] == ("underdetermined", "invalid", "completed")
    assert got["broken"] == ("underdetermined", "unresolved", "failed") and got["depends"] == ("supported", "unresolved", "completed")


def test_isolation(spark):
    with pytest.raises(ValueError, match="gold"):
        judgment.assert_isolated(spark.createDataFrame([(1, "x")], "id int, gold string"))


def test_labels(spark):
    d = spark.createDataFrame([([],), (["SUPPORT", "SUPPORT"],), (["CONTRADICT"],)], "x array<string>")
    assert [r[0] for r in d.select(L.uniform_claim_label(F.col("x"))).collect()] == ["NEI", "SUPPORT", "REFUTE"]
    mixed = spark.createDataFrame([(["SUPPORT", "CONTRADICT"],)], "x array<string>")
    assert mixed.select(L.contradict_wins(F.col("x")), L.mixed_is_nei(F.col("x"))).first()[:] == ("REFUTE", "NEI")
    with pytest.raises(Exception, match="mixed rationale"):
        mixed.select(L.uniform_claim_label(F.col("x"))).collect()


def test_votes(spark):
    v = spark.createDataFrame([("c", 1, "SUPPORT", "ok"), ("c", 2, "NEI", "ok"), ("c", 3, "NEI", "failed"), ("d", 1, "SUPPORT", "ok"), ("d", 2, "REFUTE", "ok"), ("d", 3, "NEI", "ok")], "claim_id string, seed_ord int, label string, status string")
    got = {r["claim_id"]: (r["label"], r["status"], r["votes"]) for r in methods.collapse(v, 3).collect()}
    assert got == {"c": ("NEI", "failed", "SUPPORT,NEI,NEI"), "d": ("NEI", "ok", "SUPPORT,REFUTE,NEI")}
    assert methods.choose_k(350, 100) == 4 and methods.choose_k(1, 0) == 1


def test_model_stage_fails_closed(spark):
    def client():
        def call(p):
            if p == "bad":
                raise ValueError("no")
            return 'said {"label": "contradict", "rationale": "r", "confidence": 0.4} '

        return call

    out = methods.model_stage(spark.createDataFrame([("a", "x"), ("b", "bad")], "claim_id string, prompt string"), client)
    rows = {r["claim_id"]: (r["execution_status"], r["j"]["label"], r["j"]["ok"]) for r in out.select("claim_id", "execution_status", methods.judge_response(F.col("reply")).alias("j")).collect()}
    assert rows == {"a": ("ok", "REFUTE", True), "b": ("failed", "NEI", False)}


def test_usage(spark):
    u = methods.usage(spark.createDataFrame([(1000, 250, 1.0), (3000, 750, 3.0)], "prompt_tokens bigint, completion_tokens bigint, latency double"), 2.0, 8.0).first()
    assert (u.prompt_tokens, u.completion_tokens, u.total_tokens, u.latency_sum, u.latency_p50) == (4000, 1000, 5000, 4.0, 2.0)


def test_spans_and_hashes(spark):
    import hashlib

    d = spark.createDataFrame([(["One.", "Two two.", "Ünï"], 7, None)], "abstract array<string>, doc_id bigint, title string")
    r = d.select(T.sentence_spans(F.col("abstract")).alias("s"), T.document_sha256(F.col("abstract"), F.col("doc_id"), F.lit(True), F.col("title")).alias("h")).first()
    assert [tuple(x) for x in r.s] == [(0, 4), (5, 13), (14, 17)]
    want = json.dumps({"abstract": ["One.", "Two two.", "Ünï"], "doc_id": 7, "structured": True, "title": None}, ensure_ascii=False, separators=(",", ":"))
    assert r.h == hashlib.sha256(want.encode()).hexdigest()


def test_spans_of_long_documents(spark, tmp_path):
    import random

    rng = random.Random(3)
    texts = {i: "\n".join("ü" * rng.randrange(9) for _ in range(n)) for i, n in enumerate((1, 2, 3, 50, 51, 64, 65, 3000))} | {8: "", 9: None}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for i, text in texts.items():
        at = 0
        for k, s in enumerate(text.split("\n") if text is not None else []):
            want.add((i, k, at, at + len(s)))
            at += len(s) + 1
    got = [tuple(r) for r in queries.QUERIES["span_offsets"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)
    odd = spark.createDataFrame([(0, ["a", None, "b"]), (1, []), (2, None)], "i int, a array<string>").select("i", T.sentence_spans(F.col("a")).alias("s"))
    assert {r["i"]: r["s"] and [tuple(x) for x in r["s"]] for r in odd.collect()} == {0: [(0, 1), (None, None), (None, None)], 1: [], 2: None}


def test_decompose(spark):
    c = decompose.claims_of("Drug A reduced pain by 20% in adult patients, and it was associated with lower cost. See e.g. Smith.")
    assert [x["sentence"] for x in c] == [0, 0, 1] and c[0]["units"] == "20%" and c[1]["modality"] == "association"
    many = ". ".join(f"Item {i} raised value {i}" for i in range(10))
    rows = decompose.decompose(spark.createDataFrame([("r", many), ("n", None)], "report_id string, conclusion string")).collect()
    assert sum(r["checked"] for r in rows) == 8 and len(rows) == 10


def test_decompose_preserves(spark):
    text = "In a randomized trial the drug may reduce pain by 20% in adult patients compared with placebo after 6 weeks, and it increased blood pressure."
    a, b = decompose.claims_of(text)
    for c in (a, b):
        for kept in ("in a randomized trial", "in adult patients", "compared with placebo", "after 6 weeks"):
            assert kept in c["normalized_claim"].lower()
        assert c["hedged"] and c["error"] is None and c["normalized_claim"] not in c["neutral_question"]
    assert b["time"] == "6 weeks" and "increased" not in b["neutral_question"] and "blood" in b["neutral_question"]
    mice, rats = decompose.claims_of("Drug A reduced pain in old mice, and it raised weight in young rats.")
    assert (mice["population"], rats["population"], rats["error"]) == ("old mice", "young rats", None)
    lost = decompose.claims_of("Drug A reduced pain in old mice, and it raised weight in young rats, and it was safe overall.")
    assert [c["error"] for c in lost] == [None, None, "population is one of several"]
    row = {"normalized_claim": "It causes 7 mg", "exact_source_span": "x", "neutral_question": "What of: It causes 7 mg?", "modality": "causal", "hedged": False}
    got = decompose.violations("It may be linked with 20% in mice", "another text", {"population": ["in mice"]}, [row])[0]
    for part in ("quantity '20%' was dropped", "quantity '7 mg' was added", "hedge 'may' was dropped", "the answer away", "no sentence of the source", "a cause was read into", "population 'in mice' was dropped"):
        assert part in got
    out = decompose.decompose(spark.createDataFrame([("r", text)], "report_id string, conclusion string")).collect()
    assert [r["error"] for r in out] == [None, None]


def test_sources(spark, tmp_path):
    p = tmp_path / "p.jsonl"
    p.write_text('{"claim_id":"a","label":"NEI"}\n\n{"claim_id":"b","label":"NEI"}\n')
    assert readers.predictions(spark, str(p)).count() == 2
    with p.open("a") as f:
        f.write('{"claim_id":"a","label":"SUPPORT"}\n')
    with pytest.raises(ValueError, match="duplicate claim_id: a"):
        readers.predictions(spark, str(p))
    assert {r["claim_id"]: r["label"] for r in readers.checkpoint(spark, str(p)).collect()} == {"a": "SUPPORT", "b": "NEI"}
    p.write_text("{broken\n")
    with pytest.raises(Exception, match="bad JSON line"):
        readers.json_lines(spark, str(p), "claim_id string").collect()
    assert readers.optional_predictions(spark, None)[0] == "pending"


def test_duplicate_keys(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5, 5)], "l_orderkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = queries.QUERIES["duplicate_keys"](spark, str(tmp_path)).collect()
    assert sorted((r["key"], r["n"]) for r in got) == [(2, 2), (3, 3), (4, 4), (5, 5)]
    bad = checks.duplicates(spark.read.parquet(str(tmp_path / "lineitem.parquet")), "l_orderkey").collect()
    assert sorted(tuple(r) for r in bad) == [("duplicate l_orderkey", k) for k in "2345"]


def test_split_and_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "t", ["A b.", "C d."], False), (2, "u", ["E."], False)], "doc_id bigint, title string, abstract array<string>, structured boolean")
    ev = {"1": [{"label": "SUPPORT", "sentences": [1]}]}
    claims = spark.createDataFrame([(5, "x", [1, 2], ev), (6, "y", [2], {})], "id bigint, claim string, cited_doc_ids array<bigint>, evidence map<string,array<struct<label:string,sentences:array<int>>>>")
    ids = spark.createDataFrame([(0, 6, "dev", True), (1, 5, "dev", True)], "ord int, id bigint, role string, locked boolean")
    out = readers.split(ids, claims, docs, "dev")
    assert [(r["claim_id"], r["gold"]) for r in out["gold_labels"].collect()] == [("scifact:6", "NEI"), ("scifact:5", "SUPPORT")]
    g = out["gold_evidence"].first()
    assert (g["text_span"], g["start"], g["end"]) == ("C d.", 5, 9)
    with pytest.raises(ValueError):
        readers.split(ids, claims, docs, "train")
    rows = spark.createDataFrame([("a", "ok"), ("b", None), ("c", "failed")], "claim_id string, execution_status string")
    sinks.replace(sinks.ok_rows(rows), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert sinks.sidecar(rows, "r", "h").first()["n_ok"] == 2


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"claim_id":"a","label":"NEI","n":1}\n{"claim_id":"a","label":"SUPPORT","n":2}\n{"claim_id":"b","label":"NEI","n":1}\n')
    stream = ingest.log_stream(spark, str(src), "claim_id string, label string, n int")
    upsert.start(stream, str(tmp_path / "t"), ["claim_id"], ["n"], str(tmp_path / "cp")).awaitTermination(120)
    got = {r["claim_id"]: r["label"] for r in upsert.table(spark, str(tmp_path / "t"), "claim_id string, label string, n int", ["claim_id"], ["n"]).collect()}
    assert got == {"a": "SUPPORT", "b": "NEI"}


def test_first_rows_expire(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("a", "2024-01-01T00:00:00", 1), ("a", "2024-01-01T01:00:00", 2), ("b", "2024-01-01T02:00:00", 3)]
    for i, (k, ts, n) in enumerate(rows):
        (src / f"{i}.json").write_text(f'{{"claim_id":"{k}","ts":"{ts}","n":{n}}}\n')
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files come by their time
    stream = ingest.log_stream(spark, str(src), "claim_id string, ts timestamp, n int", 1)
    q = ingest.first_rows(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3]


def test_negations_end_at_ascii_word_boundaries(spark):
    texts = ["noñ a", "ñno a", "no", "NOT so", "no_a", "know", "never.", "ánot", "nó", "sin"]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.negated(F.col("t")).alias("n")).collect()]
    assert got == [True, True, True, True, False, False, True, True, True, False]
    assert spark.createDataFrame([("It noñ improved",)], "t string").select(T.polarity(F.col("t")).alias("p")).first().p == "decrease"


def test_search_scans_texts_as_it_searches_postings(spark):
    """More hits than k in several tasks, ties, empty and null texts; neither path makes other rows, and the scan moves no postings."""
    words = ["alpha", "beta", "gamma", "delta"]
    docs = [(i, " ".join(words[j % 4] for j in range(i % 9)) + (" tail" if i % 3 else "")) for i in range(300)] + [(900, None), (901, "")] + [(1000 + i, f"filler{i}") for i in range(1000)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    q = spark.createDataFrame([("c1", 0, "Alpha beta alpha"), ("c2", 1, "tail delta"), ("c3", 2, "unknown"), ("c4", 3, "")], "claim_id string, form_ord int, query string")
    i = retrieval.build_index(docs)
    found = retrieval.search(q, i, ["claim_id", "form_ord"], 7)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    kept = retrieval.Index(i.postings, i.idf, i.stats)
    order = ["claim_id", "rank"]
    a, b = (x.select("claim_id", "form_ord", "doc_id", "rank", "score").orderBy(*order).collect() for x in (found, retrieval.search(q, kept, ["claim_id", "form_ord"], 7)))
    assert [r[:4] for r in a] == [r[:4] for r in b] and len(a) == 14
    assert all(abs(x.score - y.score) < 2e-9 for x, y in zip(a, b, strict=True))


def test_gold_passages_by_one_scan(spark, tmp_path):
    d = [(1, "x one two three y"), (2, "one\ttwo three"), (3, "one two three"), (4, None), (5, "pre-one two three-post"), (6, "single")]
    spark.createDataFrame(d, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "one two three"), (2, "single"), (3, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    g = views.gold_docs(spark, str(tmp_path))
    assert "Join" not in g._jdf.queryExecution().optimizedPlan().toString()
    want = {("scifact:1", 1), ("scifact:1", 3), ("scifact:1", 5), ("scifact:2", 6)}
    assert {tuple(r) for r in g.collect()} == want == {tuple(r) for r in views.many_gold_docs(spark, str(tmp_path)).collect()}


def test_cards_take_texts_beside_their_citations(spark):
    rows = [(1, i, f"D1:{i}:0-9", True, ("mixed", "support")[i % 2], False, False) for i in range(5)]
    s = spark.createDataFrame(rows, "claim_id int, ord int, span_id string, addresses boolean, stance string, claim_causal boolean, text_causal boolean")
    d = judgment.decide(s, ["claim_id"], shown="texts").first()
    assert d.cited == [f"D1:{i}:0-9" for i in range(5)] and d.texts == ["mixed", "support", "mixed", "support", "mixed"]
