"""Golden cases of scoring, false endorsement, pairing and statistics."""

import pytest
from pyspark.sql import functions as F

from veristrata.operators import calibration, families, scoring, statistics
from veristrata.plans import queries, views

S, R, N = "SUPPORT", "REFUTE", "NEI"
ROWS = [
    ("1", S, None, S, None, "ok"), ("2", S, None, S, None, "ok"), ("3", S, None, R, None, "ok"), ("4", R, None, R, None, "ok"), ("5", R, None, N, None, "ok"),
    ("6", None, N, None, N, "ok"), ("7", N, None, S, None, "completed"), ("8", S, None, "CONTRADICT", None, "ok"), ("9", N, None, None, None, None), ("10", S, None, R, None, "fail"),
]
DDL = "claim_id string, label string, label_pred string, label_gold string, gold_label string, execution_status string"


@pytest.fixture(scope="module")
def report(spark):
    df = spark.createDataFrame(ROWS, DDL)
    return {(r["metric"], r["class"]): r["value"] for r in scoring.score_report(df).collect()}


def test_counts(spark):
    pairs = scoring.scored_pairs(spark.createDataFrame(ROWS, DDL)).filter("use = 'scored'")
    got = {r["class"]: (r["tp"], r["fp"], r["fn"]) for r in scoring.confusion(pairs).collect()}
    assert got == {S: (2, 2, 1), R: (1, 1, 2), N: (1, 1, 1)}


def test_report(report):
    assert report["precision", S] == 0.5 and round(report["recall", S], 4) == 0.6667 and round(report["f1", S], 4) == 0.5714
    assert (report["n_rows", ""], report["n_scored", ""], report["skipped_unlabeled", ""], report["skipped_not_ok", ""]) == (10, 8, 1, 1)
    assert report["micro_f1", ""] == 0.5


def test_all_failed_has_no_metrics(spark):
    df = spark.createDataFrame([("a", S, None, S, None, "failed")], DDL)
    assert {r["metric"] for r in scoring.score_report(df).collect()} == {"n_rows", "n_scored", "skipped_unlabeled", "skipped_not_ok"}
    kept = {(r["metric"], r["class"]): r["value"] for r in scoring.score_report(df, include_failed=True).collect()}
    assert kept["n_scored", ""] == 1


def test_false_endorsement(spark):
    rows = [("supported", "supported"), ("refuted", "supported"), ("unaddressed", "refuted"), ("underdetermined", "unaddressed"), ("supported", "refuted")]
    r = scoring.false_endorsement(spark.createDataFrame(rows, "gold string, pred string"), support="supported").first()
    assert (r.n_fe, r.n_gold_nonsup, r.n_pred_sup) == (1, 3, 2) and r.fe_gold == pytest.approx(1 / 3) and r.fe_pred == 0.5


def test_pairing_and_bootstrap(spark):
    ddl = "claim_id string, gold string, pred string, status string"
    a = spark.createDataFrame([("c1", N, S, "ok"), ("c2", N, S, "ok"), ("c3", N, N, "ok"), ("c4", N, N, "failed"), ("c5", N, N, "ok")], ddl)
    b = spark.createDataFrame([("c1", N, N, "ok"), ("c2", N, N, "ok"), ("c3", N, N, "ok"), ("c4", N, N, "ok")], ddl)
    p = statistics.pair(a, b)
    assert {r["reason"]: r["n"] for r in statistics.drops(p).collect()} == {"paired": 3, "not_ok": 1, "not_in_all": 1}
    fam = p.filter("drop is null").withColumn("family", F.when(F.col("claim_id") == "c3", "f2").otherwise("f1"))
    draws = statistics.bootstrap(statistics.family_totals(fam, {"a": "a", "b": "b"}), ["a", "b"], 50)
    assert draws.count() == 50 and draws.agg(F.max("b")).first()[0] == 0
    assert statistics.bootstrap(statistics.family_totals(fam, {"a": "a", "b": "b"}), ["a", "b"], 50).orderBy("r").collect() == draws.orderBy("r").collect()


def test_mcnemar(spark):
    assert statistics.mcnemar_p(2, 0) == pytest.approx(0.5) and statistics.mcnemar_p(0, 0) == 1.0
    assert statistics.least_discordant(0.05) == 6
    df = spark.createDataFrame([(2, 0), (0, 0), (10, 3)], "b bigint, c bigint")
    got = [r["p"] for r in statistics.mcnemar(df).collect()]
    assert got == pytest.approx([0.5, 1.0, statistics.mcnemar_p(10, 3)])


def test_mcnemar_long_and_whole(spark, tmp_path):
    df = spark.createDataFrame([(0, 5), (7, 7), (200_000, 201_000), (100_000, 99_000)], "b bigint, c bigint")
    got = [r["p"] for r in statistics.mcnemar(df).collect()]
    assert got == pytest.approx([statistics.mcnemar_p(b, c) for b, c in ((0, 5), (7, 7), (200_000, 201_000), (100_000, 99_000))], rel=1e-6)
    orders = spark.createDataFrame([(i, i % 7, "FOP"[i % 3]) for i in range(1, 400)], "o_orderkey bigint, o_custkey bigint, o_orderstatus string")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    want: dict = {}
    for r in views.preds(spark, str(tmp_path)).collect():
        if r["ok"]:
            n = want.setdefault(r["d0"], [0, 0])
            n[0] += r["b2"] == r["gold"] != r["v"]
            n[1] += r["v"] == r["gold"] != r["b2"]
    rows = queries.QUERIES["mcnemar_exact"](spark, str(tmp_path)).collect()
    assert {r["stratum"]: (r["b"], r["c"], r["p"]) for r in rows} == {k: (b, c, pytest.approx(statistics.mcnemar_p(b, c), abs=1e-6)) for k, (b, c) in want.items()}


def test_holm_and_p(spark):
    t = spark.createDataFrame([("fe_gold", 0.01), ("fe_pred", 0.04), ("macro_f1", 0.20)], "name string, p double")
    got = {r["name"]: (round(r["p_holm"], 6), r["reject"]) for r in statistics.holm(t).collect()}
    assert got == {"fe_gold": (0.03, True), "fe_pred": (0.08, False), "macro_f1": (0.2, False)}
    d = spark.createDataFrame([(x,) for x in (0.1, 0.2, -0.05, 0.4, -0.3)], "d double")
    assert statistics.two_sided_p(d, "d", F.lit(0.35)).first()["p"] == pytest.approx(2 / 6)
    assert statistics.two_sided_p(d, "d", F.lit(0.0)).first()["p"] == 1


def test_families(spark):
    c = spark.createDataFrame([("scifact:1", [10, 11]), ("scifact:2", [11]), ("scifact:3", [99]), ("scifact:4", [])], "claim_id string, cited_doc_ids array<bigint>")
    got = {r["claim_id"]: r["family"] for r in families.families(c).collect()}
    assert got == {"scifact:1": "cited:scifact:1", "scifact:2": "cited:scifact:1", "scifact:3": "cited:scifact:3", "scifact:4": "cited:scifact:4"}


def test_family_chain(spark):
    rows = [(f"c{i:03d}", d) for i in range(40) for d in (i, i + 1)]
    roots = families.components(spark.createDataFrame(rows, "claim string, doc bigint"))
    assert {r["root"] for r in roots.collect()} == {"c000"}


def test_components_of_the_whole_table(spark, tmp_path):
    import random

    rng = random.Random(5)
    giant = [(rng.randrange(1, 300), rng.randrange(1, 200)) for _ in range(900)]  # one component holds nearly all
    rows = [(o, p, q % 50 + 1) for q, (o, p) in enumerate([*giant, *giant[:20], (900, 900), (901, 900), (902, 901)])]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_quantity int").write.parquet(str(tmp_path / "lineitem.parquet"))
    top: dict = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for o, p, _ in rows:
        top[find(("o", o))] = find(("p", p))
    least: dict = {}
    for o in {r[0] for r in rows}:
        least.setdefault(find(("o", o)), []).append(f"scifact:{o}")
    want = {c: min(cs) for cs in least.values() for c in cs}
    got = queries.QUERIES["connected_components"](spark, str(tmp_path)).collect()
    assert {r["claim"]: r["root"] for r in got} == want and len(got) == len(want)


def test_selective(spark):
    df = spark.createDataFrame([(True, 0.9, 0), (True, 0.6, 1), (False, 0.8, 2)], "correct boolean, conf double, ord int")
    first = calibration.risk_coverage(df).orderBy("n").first()
    assert first["coverage"] == pytest.approx(1 / 3) and first["accuracy"] == 1
    s = calibration.selective(spark.createDataFrame([(True, 0.9), (False, 0.1)], "correct boolean, conf double"), 0.5).first()
    assert (s["coverage"], s["accuracy"]) == (0.5, 1.0)


def test_draws_in_blocks_are_those_of_each_slot(spark):
    """Several chunks of families, several blocks of slots; no row stands for a draw."""
    import hashlib

    import numpy as np

    from veristrata.operators import draws

    for r, first, last in ((1, 1, 120), (37, 990, 10_020), (2000, 99_999, 100_003)):
        got = np.concatenate(list(draws.heads(r, first, last))).tolist()
        assert got == [int(hashlib.md5(f"{r}:{s}".encode()).hexdigest()[:8], 16) for s in range(first, last + 1)]
    m = 2 * draws.CHUNK + 77
    families = spark.range(1, m + 1).select(F.col("id").alias("ord"), (F.col("id") % 7).alias("n_gold"), (F.col("id") % 3).alias("fe_a"))
    b = statistics.bootstrap(families, ["a"], 3)
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan
    got = {row.r: row.a for row in b.collect()}
    at = np.arange(m + 1)
    for r in (1, 2, 3):
        o = np.concatenate(list(draws.heads(r, 1, m))) % m + 1
        assert got[r] == (at % 3)[o].sum() / (at % 7)[o].sum()
    assert statistics.bootstrap(families.limit(0), ["a"], 3).count() == 0


def test_components_have_more_partitions_on_more_edges(spark, monkeypatch):
    from veristrata.operators import stored

    seen, write, name = [], families.stored, "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    monkeypatch.setattr(stored, "TASK_ROWS", 20)
    monkeypatch.setattr(families, "stored", lambda df, tag: seen.append(int(spark.conf.get(name))) or write(df, tag))
    edges = spark.range(200).selectExpr("cast(id as string) as claim", "id div 10 as doc")
    got = {r.claim: r.root for r in families.components(edges).collect()}
    assert set(seen) == {20} and spark.conf.get(name) == before
    assert got == {str(i): min(map(str, range(i // 10 * 10, i // 10 * 10 + 10))) for i in range(200)}
