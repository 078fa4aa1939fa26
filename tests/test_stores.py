"""Stored index with reuse, keyed upsert of a stream, and schema contracts."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from veristrata.operators import index_store, retrieval, schema_contract
from veristrata.sources.commits import Ledger
from veristrata.streaming import upsert

TEXTS = [f"word{i % 7} other{i % 3} common text {i}" for i in range(60)] + ["", None]


def corpus(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def tables(i):
    plain = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    return {t: sorted(repr(plain(r)) for r in getattr(i, t).select(*c).collect()) for t, c in (("postings", ["doc_id", "term", "tf", "dl"]), ("idf", ["term", "df", "idf"]), ("stats", ["n_docs", "avgdl"]))}


def test_index_is_reused_and_mended(spark, tmp_path):
    path = str(tmp_path / "ix")
    a = index_store.ensure(corpus(spark), path, buckets=8)
    assert a.version == 0 and a.rebuilt == list(range(8))
    want = tables(retrieval.build_index(corpus(spark)))
    assert tables(a.index) == want
    b = index_store.ensure(corpus(spark).repartition(5), path, buckets=8)
    assert (b.version, b.rebuilt, b.fingerprint) == (0, [], a.fingerprint) and tables(b.index) == want
    changed = list(TEXTS)
    changed[17] = "new words entirely"
    with pytest.raises(index_store.CorpusChanged):
        index_store.ensure(corpus(spark, changed), path, buckets=8, refuse=True)
    c = index_store.ensure(corpus(spark, changed), path, buckets=8)
    assert c.version == 1 and len(c.rebuilt) == 1 and c.fingerprint != a.fingerprint
    assert tables(c.index) == tables(retrieval.build_index(corpus(spark, changed)))
    assert tables(index_store._read(spark, path, Ledger(spark, path).read("index-0000000000"))) == want  # an older version stays readable
    d = index_store.ensure(corpus(spark, changed[:20]), path, buckets=8)  # documents go
    assert tables(d.index) == tables(retrieval.build_index(corpus(spark, changed[:20])))
    e = index_store.ensure(corpus(spark, changed[:20]), path, buckets=8, config=retrieval.Bm25(epsilon=0.5))
    assert e.rebuilt == sorted(int(k) for k in Ledger(spark, path).read("index-0000000003")["parts"])
    assert index_store.prune(spark, path) and tables(e.index) == tables(retrieval.build_index(corpus(spark, changed[:20]), config=retrieval.Bm25(epsilon=0.5)))
    assert Ledger(spark, path).names("index-") == ["index-0000000003"]


def test_index_of_nothing(spark, tmp_path):
    e = index_store.ensure(corpus(spark, []), str(tmp_path), buckets=4)
    assert e.index.postings.count() == 0 and e.index.stats.first()["n_docs"] == 0
    assert index_store.ensure(corpus(spark, []), str(tmp_path), buckets=4).version in (0, 1)
    assert index_store.ensure(corpus(spark, ["", None]), str(tmp_path), buckets=4).index.stats.first()["avgdl"] == 0.0


def test_stored_index_is_searched_by_document(spark, tmp_path, monkeypatch):
    odd = ["Na\u00efve word1 WORD1", "\u212aelvin \u0130x stra\u00dfe a\u00a0b", "x\x00y 9-9_9", "\u65e5\u672c 42"]
    docs = corpus(spark, [*TEXTS, *odd])
    plain = lambda df: sorted(map(tuple, df.collect()))
    want = retrieval.build_index(docs)
    i = index_store.ensure(docs, str(tmp_path), buckets=8).index
    assert plain(retrieval.from_counted(retrieval.counted(docs))) == plain(want.postings) == plain(i.postings)
    assert plain(i.counted.select("doc_id", "dl")) == plain(retrieval.doc_stats(docs))  # a row each, empty ones too
    many = spark.range(2500, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("a a "), (F.col("id") % 7).cast("string")).alias("text"))
    assert plain(retrieval.from_counted(retrieval.counted(many))) == plain(retrieval.full_postings(many))
    q = spark.createDataFrame([("a", "word1 common"), ("b", "other2 other2 text 5"), ("c", "nowhere"), ("d", "kelvin b 9 na 42")], "claim_id string, query string")
    hits = plain(retrieval.search(q, want, ["claim_id"], 8))
    assert hits and {h[0] for h in hits} == {"a", "b", "d"}
    with monkeypatch.context() as m:
        m.setattr(retrieval, "scores", None)  # no posting is joined or moved
        assert plain(retrieval.search(q, i, ["claim_id"], 8)) == hits
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 0)
    assert plain(retrieval.search(q, i, ["claim_id"], 8).select("claim_id", "doc_id", "score", "rank")) == hits


def test_hits_are_the_same_by_either_join(spark, monkeypatch):
    q = spark.createDataFrame([("a", "word1 common"), ("b", "other2 other2 text 5"), ("c", "nowhere")], "claim_id string, query string")
    i = retrieval.build_index(corpus(spark))
    few = retrieval.search(q, i, ["claim_id"]).orderBy("claim_id", "rank").collect()
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 0)
    assert retrieval.search(q, i, ["claim_id"]).orderBy("claim_id", "rank").collect() == few and len(few) > 20


# ------------------------------------------------------------------ upsert

SCHEMA = "k long, n long, v string"


def test_stream_upsert_restarted(spark, tmp_path):
    src, path, check = (str(tmp_path / x) for x in ("src", "t", "c"))
    rows = [(i % 37 if i % 50 else None, i, f"v{i}") for i in range(600)]
    new = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(src)
    for lo in range(0, 300, 50):
        new(rows[lo : lo + 50])
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(src)
    upsert.start(stream(), path, ["k"], ["n"], check).awaitTermination()
    assert upsert.history(spark, path).count() == 6
    for lo in range(300, 600, 50):
        new(list(reversed(rows[lo : lo + 50])))
    upsert.start(stream(), path, ["k"], ["n"], check).awaitTermination()  # restarted where it stopped
    want = {}
    for k, n, v in rows:
        want[k] = (k, n, v)
    got = [tuple(r) for r in upsert.table(spark, path, SCHEMA, ["k"], ["n"]).collect()]
    assert sorted(got, key=repr) == sorted(want.values(), key=repr)
    assert upsert.vacuum(spark, path) is not None and upsert.table(spark, path, SCHEMA, ["k"], ["n"]).count() == len(want)


def test_batch_is_taken_once_and_work_follows_the_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = lambda lo, n: spark.range(lo, lo + n).select(F.col("id").alias("k"), F.col("id").alias("n"), F.lit("v").alias("v"))
    assert upsert.merge(batch(0, 4000), 0, path, ["k"], ["n"])
    assert not upsert.merge(batch(0, 4000), 0, path, ["k"], ["n"])  # replayed
    for e in range(1, 17):
        assert upsert.merge(batch(4000 + 10 * e, 10), e, path, ["k"], ["n"])
    h = upsert.history(spark, path).orderBy("epoch").collect()
    assert sum(r.written for r in h[1:]) <= 10 * 16 * 6 and max(r.runs for r in h) <= 6  # the large run is never rewritten
    assert upsert.table(spark, path, SCHEMA, ["k"], ["n"]).count() == 4160
    left = [f for f in os.listdir(path) if f.startswith("run-")]
    assert len(left) >= h[-1].runs


# ---------------------------------------------------------------- contracts

CONTRACT = {
    "$schema": "x", "type": "object", "required": ["id", "label"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "minLength": 2, "pattern": "^c[0-9]+$"}, "label": {"enum": ["a", "b", None, 3]}, "score": {"type": ["number", "null"], "minimum": 0, "exclusiveMaximum": 1},
        "n": {"type": "integer"}, "parts": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"$ref": "#/$defs/part"}}, "x y": {"const": True},
        "any": {"anyOf": [{"type": "string"}, {"type": "object", "required": ["q"]}]}, "one": {"oneOf": [{"minimum": 1}, {"maximum": 5}]}, "map": {"additionalProperties": {"type": "string"}, "patternProperties": {"^n_": {"type": "integer"}}},
    },
    "allOf": [{"if": {"properties": {"label": {"const": "b"}}, "required": ["label"]}, "then": {"required": ["score"]}}],
    "$defs": {"part": {"type": "object", "required": ["t"], "additionalProperties": False, "properties": {"t": {"type": "string"}, "sub": {"type": "array", "items": {"type": "integer"}}}}},
}
CASES = [
    ({"id": "c1", "label": "a"}, []),
    ({"id": "c", "label": "z"}, ["$.id: minLength", "$.id: pattern", "$.label: enum"]),
    ({"label": None, "id": 5}, ["$.id: type"]),
    ({"id": "c1", "label": 3, "score": None, "n": 2.0}, []),
    ({"id": "c1", "label": "b"}, ["$.score: required"]),
    ({"id": "c1", "label": "b", "score": 1}, ["$.score: exclusiveMaximum"]),
    ({"id": "c1", "label": "a", "score": -0.5, "n": 1.5, "extra": 1, "other": 2}, ["$.extra: additionalProperties", "$.n: type", "$.other: additionalProperties", "$.score: minimum"]),
    ({"id": "c1", "label": "a", "parts": []}, ["$.parts: minItems"]),
    ({"id": "c1", "label": "a", "parts": [{"t": "x"}, {"t": 1, "sub": [1, "y"]}, {"u": 1}]}, ["$.parts[].sub[]: type", "$.parts[].t: required", "$.parts[].t: type", "$.parts[].u: additionalProperties"]),
    ({"id": "c1", "label": "a", "parts": [{"t": "x"}, {"t": "x"}]}, ["$.parts: uniqueItems"]),
    ({"id": "c1", "label": "a", "x y": False, "any": 3, "one": 3}, ["$.any: anyOf", "$.one: oneOf", "$.x y: const"]),
    ({"id": "c1", "label": "a", "x y": True, "any": {"q": 1}, "one": 9, "map": {"n_a": 1, "b": "t"}}, []),
    ({"id": "c1", "label": "a", "map": {"n_a": "1", "b": 2}}, ["$.map.*: type"]),
    ([1], ["$: type"]),
    ({}, ["$.id: required", "$.label: required"]),
]


def test_contract_errors(spark):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(CASES)] + [(100, "{bad"), (101, None), (102, '{"id":"c1","id":"c2","label":"a"}')]
    df = spark.createDataFrame(rows, "i long, r string")
    got = {r.i: r.e for r in df.select("i", schema_contract.errors(F.col("r"), CONTRACT).alias("e")).collect()}
    for i, (record, want) in enumerate(CASES):
        assert got[i] == want, record
    assert got[100] == got[102] == ["$: not JSON"] and got[101] == ["$: no record"]
    assert schema_contract.violations(df, "i", "r", CONTRACT).count() == sum(len(w) for _, w in CASES) + 3
    assert schema_contract.report(df, "r", CONTRACT).first() == (18, 3, sum(len(w) for _, w in CASES) + 3)


def test_contracts_that_cannot_be_compiled(spark):
    for schema, why in (({"dependentRequired": {}}, "not compiled"), ({"$ref": "#/$defs/a", "$defs": {"a": {"properties": {"b": {"$ref": "#/$defs/a"}}}}}, "back to itself"), ({"$ref": "http://x"}, "local")):
        with pytest.raises(ValueError, match=why):
            schema_contract.errors(F.lit("{}"), schema)


def test_schema_files_compile(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(CONTRACT, indent=1))
    assert schema_contract.read_schema(spark, str(tmp_path / "s.json")) == CONTRACT
