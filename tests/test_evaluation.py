"""Bootstrap by weights, measures from one scan, splits, and the whole validator."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristrata.operators import fingerprint, measures, resampling, splits, statistics, validator

PAIRS = [(f"f{i % 13}", ("x", "y")[i % 2], ("SUPPORT", "REFUTE", "NEI")[i % 3], ("SUPPORT", "NEI")[i % 5 % 2], ("SUPPORT", "REFUTE")[i % 7 % 2]) for i in range(300)]


def pairs(spark):
    return spark.createDataFrame(PAIRS, "family string, cell string, gold string, a string, b string")


def test_poisson_weights(spark):
    assert resampling.POISSON[0] == "5e2d58d8" and len(resampling.POISSON) >= 10  # 2^32 / e
    h = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    w = h.select(F.explode(F.array(*[resampling.weight(F.col("h"), j) for j in range(8)])).alias("w")).toPandas()["w"]
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04 and abs((w == 0).mean() - np.exp(-1)) < 0.01


def test_cells_against_plain_python(spark):
    config = resampling.Config(resamples=50, seed="s")
    sums, metrics = resampling.endorsement({"a": "a", "b": "b"})
    got = {(r.cell, r.metric): r for r in resampling.intervals(pairs(spark), ["cell"], "family", sums, metrics, config).collect()}
    tot = defaultdict(lambda: np.zeros(3))
    for f, c, g, a, b in PAIRS:
        if g != "SUPPORT":
            tot[c, f] += (1, a == "SUPPORT", b == "SUPPORT")
    for cell in "xy":
        draws = []
        for r in range(50):
            s = np.zeros(3)
            for (c, f), v in tot.items():
                if c == cell:
                    d = hashlib.sha256(f"s:{f}:{r // 8}".encode()).hexdigest()[8 * (r % 8) :][:8]
                    s += v * sum(d >= t for t in resampling.POISSON)
            draws.append((s[1] / s[0], s[2] / s[0], s[2] / s[0] - s[1] / s[0]))
        for k, m in enumerate(("a", "b", "b-a")):
            low, high = np.percentile([d[k] for d in draws], [2.5, 97.5])
            assert (got[cell, m].ci_low, got[cell, m].ci_high) == pytest.approx((low, high))
        assert got[cell, "a"].n_clusters == 13 and got[cell, "b"].estimate == pytest.approx(sum(v[2] for (c, _), v in tot.items() if c == cell) / sum(v[0] for (c, _), v in tot.items() if c == cell))
    assert resampling.intervals(pairs(spark), [], "family", sums, metrics, config).count() == 3


def test_weights_and_drawn_rows_agree(spark):
    p = spark.range(4000).select((F.col("id") % 400).cast("string").alias("family"), F.lit("NEI").alias("gold"), F.when(F.xxhash64("id") % 4 == 0, "SUPPORT").otherwise("NEI").alias("a"))
    sums, metrics = resampling.endorsement({"a": "a"})
    one = resampling.intervals(p, [], "family", sums, metrics, resampling.Config(800)).first()
    two = statistics.interval(statistics.bootstrap(statistics.family_totals(p, {"a": "a"}), ["a"], 800), "a").first()
    assert abs(one.ci_low - two.ci_low) < 0.004 and abs(one.ci_high - two.ci_high) < 0.004


@pytest.mark.parametrize("bad", [{"resamples": 0}, {"resamples": True}, {"level": 1.0}, {"seed": "a:b"}])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        resampling.Config(**bad)


# ---------------------------------------------------------------- measures


def test_measures_from_one_exchange(spark):
    r = measures.scores(pred="a")
    m = r.measure(pairs(spark), ["micro_f1", "fe_gold", "n_rows", "recall_SUPPORT"], [(), ("cell",), ("gold", "cell")])
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan") == 1
    rows = {(x.cut, x.gold, x.cell, x.metric): x.value for x in m.collect()}
    assert len(rows) == 4 * (1 + 2 + 6)
    for cell in (None, "x", "y"):
        mine = [p for p in PAIRS if cell in (None, p[1])]
        right = sum(g == a for _, _, g, a, _ in mine)
        cut = "cell" if cell else ""
        assert rows[cut, None, cell, "micro_f1"] == pytest.approx(right / len(mine))
        assert rows[cut, None, cell, "fe_gold"] == pytest.approx(sum(g != "SUPPORT" and a == "SUPPORT" for _, _, g, a, _ in mine) / sum(g != "SUPPORT" for _, _, g, _, _ in mine))
    assert rows["cell,gold", "NEI", "x", "n_rows"] == Counter((p[2], p[1]) for p in PAIRS)["NEI", "x"]
    assert '"fe_gold":' in measures.report(m, ["gold", "cell"]).filter("cut = ''").first()["report"]


def test_registry_refuses(spark):
    r = measures.scores()
    for bad in (lambda: r.count("n_fe", F.lit(True)), lambda: r.formula("z", ["none"], F.lit(1)), lambda: r.measure(pairs(spark), ["none"])):
        with pytest.raises(ValueError):
            bad()
    used = measures.scores(pred="a", use=F.col("gold") == "none").measure(pairs(spark), ["micro_f1", "fe_gold", "coverage"]).collect()
    assert [x.value for x in used] == [0.0, 0.0, 0.0]


# ------------------------------------------------------------------ splits


def test_smoke_of_splits(spark, tmp_path):
    rows = [(f"c{i}", "dev") for i in range(10)] + [(f"c{i}", "test") for i in range(9, 14)] + [("c1", "dev"), (None, "dev"), ("c50", "other"), ("c60", None)] + [(f"c{i}", "copy") for i in range(10)]
    df = spark.createDataFrame(rows, "claim_id string, split string")
    want = fingerprint.of(spark.createDataFrame([(f"c{i}",) for i in range(10)], "claim_id string"), ["claim_id"])
    found = splits.smoke(df, ["dev", "test", "copy"], {"dev": want, "test": (5, "0")}, [("dev", "test"), ("test", "copy")], [("dev", "copy")])
    got = {r.check: (r.found, r.ok) for r in found.collect()}
    assert got["dev: repeated ids"] == ("1", False) and got["copy: repeated ids"] == ("0", True)
    assert got["dev: ids"] == ("10", True) and got["dev: fingerprint"][1] and got["test: ids"] == ("5", True) and not got["test: fingerprint"][1]
    assert got["dev, test: shared ids"] == ("1", False) and got["dev, copy: ids of one only"] == ("0", True)
    assert got["null id, and ids of no split"] == ("3", False)
    with pytest.raises(ValueError):
        splits.membership(df, ["dev", "dev"])
    seen = splits.written(df.filter("split = 'copy'"), str(tmp_path / "w"))
    assert seen == {"n": 10, "n_null": 0, "fingerprint": want[1]} and spark.read.parquet(str(tmp_path / "w")).count() == 10


# --------------------------------------------------------------- validator


def test_validator(spark):
    docs = spark.createDataFrame([(1, "aspirin treatment improved survival"), (2, "aspirin treatment reduced survival"), (3, "the weather"), (4, None), *((i, f"weather of day {i}") for i in range(5, 12))], "doc_id long, text string")
    claims = spark.createDataFrame([("a", "aspirin treatment improved survival"), ("b", "volcano eruption increased")], "claim_id string, text string")
    cites = spark.createDataFrame([("a", 1, 1, "original"), ("b", 1, 4, "original")], "claim_id string, ord int, doc_id long, provenance string")
    r = {x.claim_id: x for x in validator.rows(claims, docs, cites).collect()}
    assert (r["a"].d0_label_4way, r["a"].d1_label_4way, r["a"].label, r["a"].execution_status) == ("supported", "underdetermined", "NEI", "ok")
    assert (r["b"].execution_status, r["b"].rationale_codes) == ("failed", ["d0_d1_conflict", "d0_not_repaired_from_d1"]) or r["b"].d1_label_4way == "unaddressed"
    one = spark.createDataFrame([("a", 1, 1), ("z", 2, 1)], "claim_id string, doc_id long, rank int")
    s = {x.claim_id: x for x in validator.rows(claims, docs, cites, validator.fixed(one)).collect()}
    assert (s["a"].label, s["a"].rationale_codes) == ("SUPPORT", ["labels_agree"]) and s["b"].d1_label_4way == "unaddressed"
    with pytest.raises(Exception, match="no document 99"):
        validator.rows(claims, docs, cites.withColumn("doc_id", F.lit(99).cast("long"))).collect()


# ------------------------------------------------------------ tables, locks


def test_tables_of_the_library(spark):
    from veristrata.operators import families, reports

    run = lambda *labels: spark.createDataFrame([(f"c{i}", "NEI" if i else "SUPPORT", x) for i, x in enumerate(labels)], "claim_id string, gold string, label string")
    p = reports.panel({"m1": run("NEI", "NEI", "SUPPORT"), "m2": run("NEI", "SUPPORT", "SUPPORT", "NEI")})
    assert p.count() == 6
    got = {r.gold: tuple(r)[1:] for r in reports.consistency(p).collect()}
    assert got == {"SUPPORT": (1, 1, 0, 0, 1), "NEI": (2, 0, 1, 1, 1)}
    with pytest.raises(Exception, match="gold labels disagree"):
        reports.panel({"a": run("NEI"), "b": run("NEI").withColumn("gold", F.lit("NEI"))}).collect()
    arm = lambda *rows: spark.createDataFrame(list(rows), "claim_id string, cited_doc_ids array<long>")
    f = {r.claim_id: r.family for r in families.of_arms(arm(("a", [1]), ("b", [2])), arm(("c", [1, 2]), ("d", []), ("a", [1]))).collect()}
    assert f == {"a": "cited:a", "b": "cited:a", "c": "cited:a", "d": "cited:d"}


def test_freeze(spark, tmp_path):
    from veristrata.operators import locks

    path = str(tmp_path / "f")
    a, b = (spark.createDataFrame([(i, str(i % k)) for i in range(20)], "k long, v string") for k in (3, 4))
    with pytest.raises(locks.Unfrozen, match="no freeze"):
        locks.require(spark, path, {"a": (a, ["k", "v"])})
    tables = {"a": (a, ["k", "v"]), "b": (b, ["k"])}
    assert locks.freeze(spark, path, tables, {"seed": 1}) == locks.freeze(spark, path, tables, {"seed": 1})
    locks.require(spark, path, {"a": (a.repartition(5), ["k", "v"]), "b": (b.orderBy("v"), ["k"])}, {"seed": 1})
    for other, config, why in (({**tables, "a": (b, ["k", "v"])}, {"seed": 1}, "changed since the freeze: a"), ({"a": tables["a"]}, {"seed": 1}, "freeze: b"), (tables, {"seed": 2}, "another configuration")):
        with pytest.raises(locks.Unfrozen, match=why):
            locks.require(spark, path, other, config)
    with pytest.raises(locks.Unfrozen, match="another freeze record"):
        locks.freeze(spark, path, {"a": (b, ["k", "v"])}, {"seed": 1})


def test_files_are_counted_and_hashed_by_line(spark, tmp_path):
    from veristrata.sources import readers, sinks

    for name, text in (("a.jsonl", '{"x":1}\n\n{"x":2}\n'), ("b.jsonl", '{"x":2}\n{"x":1}'), ("c.jsonl", '{"x":3}\n')):
        (tmp_path / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1]: (r.n_records, r.fingerprint) for r in readers.file_prints(spark, str(tmp_path)).collect()}
    assert got["a.jsonl"] == got["b.jsonl"] != got["c.jsonl"] and got["a.jsonl"][0] == 2
    rows = spark.createDataFrame([("a", "ok"), ("b", "failed"), ("c", None)], "claim_id string, execution_status string")
    at = str(tmp_path / "run")
    rows.write.json(at)
    kept = sinks.drop_failed(spark.read.schema(rows.schema).json(at), at)
    assert {r.claim_id for r in spark.read.json(at).collect()} == {"a", "c"} and kept.count() == 3


def test_running_sums_by_either_way(spark, monkeypatch):
    from veristrata.operators import ordered

    df = spark.range(200).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 200).alias("o"), F.lit(2).alias("v"))
    one = ordered.running(df, [F.col("o")], {"s": F.col("v")}, ["g"]).orderBy("o").collect()
    monkeypatch.setattr(ordered, "FEW", 0)
    assert ordered.running(df, [F.col("o")], {"s": F.col("v")}, ["g"]).orderBy("o").collect() == one


def test_weights_are_made_once_for_the_cells_of_a_cluster(spark):
    """numpy's weights are those of the column; many cells, a null cluster and a full task give the same sums; no row stands for a block."""
    import numpy as np

    config = resampling.Config(resamples=21, seed="w")
    names = ["a", "", "ü:1"]
    h = spark.createDataFrame([(c, b) for c in names for b in range(config.blocks)], "c string, b int")
    h = h.withColumn("h", F.sha2(F.concat_ws(":", F.lit("w"), "c", F.col("b").cast("string")), 256))
    wide = h.select("c", "b", F.array(*[resampling.weight(F.col("h"), j) for j in range(8)]).alias("w")).orderBy("b").collect()
    want = np.array([np.concatenate([r.w for r in wide if r.c == c])[:21] for c in names])
    assert (resampling.weights(names, config) == want).all()
    rows = spark.createDataFrame([("x", "a", 1), ("x", "a", 2), ("y", "a", 5), ("y", None, 7), (None, "ü:1", 1 << 60)], "cell string, c string, n long")
    r = resampling.resamples(rows, ["cell"], "c", {"n": F.col("n")}, config)
    assert "explode" not in r._jdf.queryExecution().optimizedPlan().toString()
    got = {(x.cell, x.r): x.n for x in r.collect()}
    for i in range(21):
        if want[2, i] < 8:
            assert got[None, i] == int(want[2, i]) << 60
        assert got["x", i] == 3 * want[0, i] and got["y", i] == 5 * want[0, i] + 7 * want[1, i]
