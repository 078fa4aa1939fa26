"""Jaccard join and pipeline against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from veristrata.llm import jaccard_join, packing
from veristrata.llm.storage import persist

LOW = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (i, *_), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return Counter((r[0], len(s), least.get(x, r[0]) if s else r[0]) for r, s, x in zip(rows, sets, label, strict=True))


def test_join(docs, rows, nothing):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.op8(docs).collect())
    assert got == brute([r[:2] for r in rows])
    assert jaccard_join.op8(nothing).count() == 0


def test_chains_and_passages(spark, monkeypatch):
    """Chains of near copies, groups over the chunk size, and passages that unrelated texts share."""
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", 7)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, n = [], 0
    w = [word() for _ in range(80)]
    for _ in range(40):  # each links to the next, far ones do not
        rows.append((n, " ".join(w)))
        at = rng.randrange(80)
        w = [*w]
        w[at] = word()
        n += 1
    passage = [word() for _ in range(60)]
    for k in range(60):
        own = [word() for _ in range(rng.choice([2, 10, 14, 16, 18, 60]))]
        rows.append((n, " ".join(passage + own if k % 2 else own + passage)))
        n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.op8(df).collect())
    assert got == brute(rows)


def test_many_rows_without_own_ids(spark):
    """Near copies among rows that have no id or one id for all, and a class with a third of all rows."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for doc_id in (None, 7, "own"):
        for _ in range(3):
            base = [word() for _ in range(60)]
            for k in range(25):
                w = [*base]
                w[rng.randrange(60)] = f"x{k}"
                rows.append((len(rows) + 1000 if doc_id == "own" else doc_id, " ".join(w)))
    hot = [word() for _ in range(300)]
    rows += [(5000 + k, " ".join([*hot[:k], f"y{k}", *hot[k + 1 :]])) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.op8(df).collect())
    assert got == brute(rows)


def test_hot_labels(spark, monkeypatch):
    """Joins by label give the same rows whether or not a label is dealt to parts."""
    big = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(3000)], "sig long, label long")
    small = spark.createDataFrame([(1, 10), (3, 30), (9999, 0)], "label long, root long")
    hot = jaccard_join._hot(big, 3000)
    assert [tuple(r) for r in hot.collect()] == [(1, 8)]
    got = sorted((r.sig, r.label, r.root or 0) for r in jaccard_join._by_label(big, small, hot, "sig").collect())
    assert got == sorted((r.sig, r.label, r.root or 0) for r in big.join(small, "label", "left").collect())


def test_close(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 60), (60, 100), (7, 7)]
    got = {r.node: r.root for r in jaccard_join.close(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 60: 50, 100: 50}
    assert jaccard_join.close(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(docs, rows):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    want = {i for (i, _, c), _ in brute([r[:2] for r in rows]).items() if i is not None and i == c}
    assert {i for i in ids if i is not None} == want and all(n == 1 for i, n in ids.items() if i is not None)


def test_one_row_of_each_class(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    near = lambda t: t + " more"
    rows = [(None, a), (None, a), (None, near(a))]  # no ids at all
    rows += [(7, b), (None, b), (None, near(b)), (9, near(b))]
    rows += [(5, c), (5, near(c)), (5, c), (5, d), (3, near(d)), (5, "lone row of five")]  # one id in several classes
    rows += [(1, ""), (1, ""), (1, "of one too"), (None, ""), (None, None)]
    kept = [tuple(r) for r in jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    text = lambda i: sorted(str(t) for j, t in kept if j == i)
    assert len(text(None)) == 3 and "" in text(None) and "None" in text(None) and len({a, near(a)} & set(text(None))) == 1
    assert text(7) == [b] and text(9) == [] and text(3) == [near(d)] and text(1) == ["", "of one too"]
    assert len(text(5)) == 2 and "lone row of five" in text(5) and len({c, near(c)} & set(text(5))) == 1


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def test_pipeline(spark, folder):
    cur = spark.read.parquet(f"{folder}/documents.parquet")
    columns, n = cur.columns, cur.count()
    for name, stage in corpus_pipeline.STAGES:
        nxt = persist(stage(spark, cur, folder), "test")
        if name != "packing":
            assert nxt.columns == columns
        if name in ("quality classifier", "language ID", "near duplicates"):
            assert nxt.count() <= n
        if name == "near duplicates":
            from pyspark.sql import functions as F

            comps = jaccard_join.op8(nxt).filter("n_shingles > 0 and doc_id is not null")
            assert comps.groupBy("component_id").count().filter(F.col("count") > 1).count() == 0
        n, cur = nxt.count(), nxt
    want = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in cur.collect())
    got = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want


def test_pipeline_empty(spark, folder):
    cur = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        cur = persist(stage(spark, cur, folder), "test")
        assert cur.count() == 0
    assert packing.MAX_LEN == 2048
