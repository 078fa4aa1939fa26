from pyspark.sql import functions as F

from veristrata.operators import checks, reports, sampling

import pytest


def test_cells(spark):
    runs = spark.createDataFrame([("B2", True), ("V", True), ("O", False)], "method string, has_rows boolean")
    scored = spark.createDataFrame([("B2", 5, 0.2, 0.1), ("V", 0, 0.0, 0.0)], "method string, n_scored int, fe_gold double, fe_pred double")
    cells = reports.fe_cell(runs, scored)
    got = {r["method"]: (r["state"], r["fe_gold"]) for r in cells.collect()}
    assert got == {"B2": ("scored", 0.2), "V": ("skipped", None), "O": ("pending", None)}
    checks.require_empty(reports.cell_violations(cells))


def test_directions_and_costs(spark):
    m = spark.createDataFrame([("a", 0.8, 0.7, -0.2, -0.05), ("b", 0.6, 0.7, -0.1, 0.3), ("c", 0.6, 0.6, -0.1, 0.1)], "model string, b2 double, v double, ci_low double, ci_high double")
    got = {r["direction"]: (r["n"], r["n_excluding_zero"]) for r in reports.sweep_directions(m).collect()}
    assert got == {"down": (1, 1), "up": (1, 0), "equal": (1, 0)}
    c = spark.createDataFrame([("f", "B2", 0, 200, 10), ("f", "B2", 1, 200, 20), ("f", "B2", 2, 50, 1)], "family string, condition string, ord int, n_calls int, tokens int")
    assert [(r["n_calls"], r["tokens"]) for r in reports.measured_costs(c).collect()] == [(200, 10)]


def test_report_and_orders(spark):
    rows = [("r", 0, "c0", "supported", False, True), ("r", 1, "c1", "contradicted", True, True), ("r", 2, "c2", None, False, False), ("s", 0, "d0", "supported", False, True)]
    df = spark.createDataFrame(rows, "report_id string, ord int, claim_id string, label string, conflict boolean, checked boolean")
    got = {r["report_id"]: (r["n_claims"], r["n_checked"], r["n_conflicts"]) for r in reports.report_verdicts(df).collect()}
    assert got == {"r": (3, 2, 1), "s": (1, 1, 0)}
    assert {r["claim_id"] for r in reports.round_robin(df, 2).collect()} == {"c0", "d0"}
    a = spark.createDataFrame([(["x", "y", "z"],)], "a array<string>")
    one, two = (sorted(a.select(reports.seeded_order(F.col("a"), F.lit(s)).alias("o")).first().o) for s in (1, 2))
    assert one == two == ["x", "y", "z"]
    with pytest.raises(ValueError):
        reports.reciprocal_rank(df, ["report_id"])


def test_sampling(spark):
    df = spark.range(100).withColumn("label", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    s = sampling.stratified(df, "id", "label", 5, 1)
    assert {r["label"]: r["count"] for r in s.groupBy("label").count().collect()} == {"a": 5, "b": 5}
    assert sampling.seeded(df, "id", 7, 3).collect() == sampling.seeded(df.repartition(5), "id", 7, 3).collect()
    assert sampling.exact(list(range(10)), 3, 42) == sampling.exact(list(range(10)), 3, 42)
    with pytest.raises(PermissionError):
        sampling.assert_split_allowed("held_out", 1, 10)
    assert sampling.label_distribution(spark.createDataFrame([("a",), (None,)], "label string")).count() == 0


def test_endpoints():
    from veristrata.operators import endpoints

    assert endpoints.allowed("http://127.0.0.1:8000/v1") and endpoints.allowed("http://10.0.0.4/v1") and endpoints.allowed("http://localhost/v1")
    assert not endpoints.allowed("https://example.org") and not endpoints.allowed("http://8.8.8.8") and not endpoints.allowed("ftp://localhost")
    assert endpoints.allowed("https://api.openai.com/v1", True) and not endpoints.allowed("https://api.openai.com/v1")
    with pytest.raises(PermissionError):
        endpoints.check_redirect("http://10.0.0.4/v1", "https://api.openai.com/v1", True)


def test_sweep_is_the_consistency_of_a_panel(spark):
    rows = [("a", "S", 1, "NEI"), ("a", "S", 2, "NEI"), ("b", "S", 1, "S"), ("b", "S", 2, "NEI"), ("c", "N", 1, "S"), ("d", None, 1, "S"), ("d", None, 2, "S")]
    r = spark.createDataFrame(rows, "claim_id string, gold string, model int, label string")
    p = reports.panel({str(k): r.filter(F.col("model") == k) for k in (1, 2)})
    made = reports.sweep(r, 2)
    assert "collect" not in made._jdf.queryExecution().optimizedPlan().toString() + p._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, made.collect()), key=str)
    assert got == sorted(map(tuple, reports.consistency(p).collect()), key=str) == sorted([("S", 2, 1, 1, 0, 1), (None, 1, 0, 0, 1, 1)], key=str)
