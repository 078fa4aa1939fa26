"""Report tables over scored runs: cells, directions, costs, roll-ups and plot data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scoring import ratio


def fe_cell(runs: DataFrame, scored: DataFrame) -> DataFrame:
    """(method, has_rows) and false-endorsement rows -> cells with a state.

    ``pending``: no predictions yet; ``skipped``: predictions, none scored; ``scored``.
    Rates stay null unless scored; a missing rate is never 0.
    """
    j = runs.join(scored, "method", "left")
    on = F.coalesce(F.col("n_scored"), F.lit(0)) > 0
    state = F.when(~F.col("has_rows"), "pending").when(on, "scored").otherwise("skipped")
    return j.select("method", state.alias("state"), F.when(on, F.col("fe_gold")).alias("fe_gold"), F.when(on, F.col("fe_pred")).alias("fe_pred"), F.when(on, F.col("n_scored")).alias("n_scored"))


def cell_violations(cells: DataFrame) -> DataFrame:
    bad = (F.col("state") != "scored") & (F.col("fe_gold").isNotNull() | F.col("fe_pred").isNotNull())
    return cells.filter(bad).select(F.lit("rates on a cell that was not scored").alias("check"), F.col("method").alias("key"))


def direction(b2: Column, v: Column) -> Column:
    return F.when(v > b2, "up").when(v < b2, "down").otherwise("equal")


def sweep_directions(models: DataFrame) -> DataFrame:
    """(model, b2, v, ci_low, ci_high) -> counts by direction, intervals that exclude zero, range of the change."""
    d = models.withColumn("direction", direction(F.col("b2"), F.col("v")))
    zero = (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    return d.groupBy("direction").agg(F.count("*").alias("n"), F.count_if(zero).alias("n_excluding_zero"), F.min(F.col("v") - F.col("b2")).alias("least"), F.max(F.col("v") - F.col("b2")).alias("most"))


def consistency(votes: DataFrame) -> DataFrame:
    """(claim_id, gold, label), one row a model -> by gold class, how many claims all, some or no models withhold, and agree on."""
    nei = F.col("label") == "NEI"
    return _by_gold(votes.groupBy("claim_id", "gold").agg(F.bool_and(nei).alias("all"), F.bool_or(nei).alias("any"), (F.min("label") == F.max("label")).alias("agree")))


def _by_gold(c: DataFrame) -> DataFrame:
    return c.groupBy("gold").agg(
        F.count("*").alias("n"), F.count_if("all").alias("all_withheld"), F.count_if(F.col("any") & ~F.col("all")).alias("some_withheld"), F.count_if(~F.col("any")).alias("none_withheld"),
        F.count_if("agree").alias("agree"),
    )


def panel(runs: dict[str, DataFrame]) -> DataFrame:
    """Predictions (claim_id, gold, label) of several models over the claims that all of them have, one row a claim and model.

    One union, whole claims by aggregation; a claim with two gold labels is an error.
    """
    rows = None
    for name, r in runs.items():
        one = r.select("claim_id", "gold", F.lit(name).alias("model"), "label")
        rows = one if rows is None else rows.unionByName(one)
    each = rows.groupBy("claim_id", "model").agg(F.min("gold").alias("gold"), F.max("gold").alias("_g"))
    whole = each.groupBy("claim_id").agg(F.count("*").alias("_n"), F.min("gold").alias("gold"), F.max("_g").alias("_g")).filter(F.col("_n") == len(runs))
    return rows.drop("gold").join(whole.select("claim_id", _one_gold().alias("gold")), "claim_id").select("claim_id", "gold", "model", "label")


def _one_gold() -> Column:
    clash = F.raise_error(F.concat(F.lit("gold labels disagree: "), F.col("claim_id"))).cast("string")
    return F.when(F.col("gold") == F.col("_g"), F.col("gold")).otherwise(F.when(F.col("gold").isNotNull(), clash))


def sweep(rows: DataFrame, models: int) -> DataFrame:
    """consistency() of (claim_id, gold, model, label) over the claims that all ``models`` have (numbers from 1 to at most 63).

    What models of one table say of a claim is combined before it moves, and no list of
    them is kept.
    """
    nei = F.col("label") == "NEI"
    c = rows.groupBy("claim_id").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("model").cast("int") - 1)).alias("_m"), F.min("gold").alias("gold"), F.max("gold").alias("_g"),
        F.bool_and(nei).alias("all"), F.bool_or(nei).alias("any"), (F.min("label") == F.max("label")).alias("agree"),
    )
    c = c.filter(F.col("_m") == (1 << models) - 1)
    return _by_gold(c.withColumn("gold", _one_gold()))


def mechanism(rows: DataFrame, arms: dict[str, str]) -> DataFrame:
    """(d0, d1, gold, a column an arm) -> by how the scopes relate: claims, each arm's accuracy and withheld labels."""
    withheld = lambda c: F.col(c).isin("unaddressed", "underdetermined")
    scope = F.when(withheld("d0") & withheld("d1") & (F.col("d0") != F.col("d1")), "both_nei").when(F.col("d0") == F.col("d1"), "agree").otherwise("differ")
    each = [x for a, c in arms.items() for x in (F.avg((F.col(c) == F.col("gold")).cast("double")).alias(f"{a}_accuracy"), F.count_if(F.col(c) == "NEI").alias(f"{a}_nei"))]
    return rows.groupBy(scope.alias("scope")).agg(F.count("*").alias("n"), *each)


def first_cases(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(claim_id, gold, two arms) -> the first claim of each kind: right by both, by one, by neither."""
    x, y = F.col(a) == F.col("gold"), F.col(b) == F.col("gold")
    kind = F.when(x & ~y, f"only_{a}").when(~x & y, f"only_{b}").when(~x & ~y, "neither").otherwise("both")
    return rows.groupBy(kind.alias("kind")).agg(F.min("claim_id").alias("claim_id"))


def histogram(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows by one or more columns."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def confusion_table(pairs: DataFrame, keys: list[str], labels: Sequence[str], pred: str = "pred") -> DataFrame:
    """(gold, keys) by predicted label, a column each, every label present; one aggregation without a pivot's second pass."""
    return pairs.groupBy("gold", *keys).agg(*[F.count_if(F.col(pred) == x).alias(x) for x in labels])


def gained(pairs: DataFrame) -> DataFrame:
    """Claims that only one of two arms endorses rightly or wrongly."""
    s = lambda c: F.col(c) == "SUPPORT"
    g = F.col("gold") == "SUPPORT"
    return pairs.agg(
        F.count("*").alias("n"), F.count_if(s("a") & ~s("b") & g).alias("lost_right"), F.count_if(s("a") & ~s("b") & ~g).alias("lost_wrong"),
        F.count_if(~s("a") & s("b") & g).alias("gained_right"), F.count_if(~s("a") & s("b") & ~g).alias("gained_wrong"),
    )


def stability(pairs: DataFrame) -> DataFrame:
    """(gold, a, b) of two runs -> flip rate and failures by gold class."""
    return pairs.groupBy("gold").agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("flips"), ratio(F.count_if(F.col("a") != F.col("b")), F.count("*")).alias("flip_rate"))


def accuracy_cost(metrics: DataFrame, usage: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.join(usage, keys).select(*keys, "accuracy", "tokens_per_claim", "calls_per_claim")


def measured_costs(runs: DataFrame, least_calls: int = 100) -> DataFrame:
    """(family, condition, ord, n_calls, tokens) -> the run with most calls; the first wins a tie."""
    best = F.max_by(F.struct("ord", "n_calls", "tokens"), F.struct(F.col("n_calls"), -F.col("ord"))).alias("b")
    return runs.filter(F.col("n_calls") >= least_calls).groupBy("family", "condition").agg(best).select("family", "condition", "b.ord", "b.n_calls", "b.tokens")


def main_table(long: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return long.groupBy(*keys).pivot("metric", metrics).agg(F.first("value"))


def report_verdicts(claims: DataFrame) -> DataFrame:
    """(report_id, ord, claim_id, label, conflict, checked) -> coverage and outcome per report."""
    on = F.col("checked")
    item = F.struct("ord", "claim_id", "label")
    r = claims.groupBy("report_id").agg(
        F.count("*").alias("n_claims"), F.count_if(on).alias("n_checked"), F.count_if(on & F.col("conflict")).alias("n_conflicts"),
        F.sort_array(F.collect_list(F.when(on, item))).alias("verdicts"),
    )
    return r.withColumn("coverage", ratio(F.col("n_checked"), F.col("n_claims")))


def acceptance_score(method: Column, agree: Column, n_cited: Column, confidence: Column) -> Column:
    """What a method's rows are ranked by: agreement of scopes, a cited document, or stated confidence."""
    return F.when(method == "V", agree.cast("double")).when(method == "B2", (n_cited > 0).cast("double")).otherwise(F.coalesce(confidence, F.lit(0.0)))


def round_robin(rows: DataFrame, budget: int, group: str = "report_id", order: str = "ord") -> DataFrame:
    """First items of every report before second ones, up to a budget."""
    turn = F.row_number().over(W.partitionBy(group).orderBy(order))
    return rows.withColumn("_turn", turn).orderBy("_turn", group).limit(budget).drop("_turn")


def seeded_order(items: Column, seed: Column) -> Column:
    """Array of strings in a hash order of (seed, item)."""
    tagged = F.transform(items, lambda x: F.struct(F.sha2(F.concat(seed.cast("string"), F.lit("\n"), x), 256).alias("h"), x.alias("x")))
    return F.transform(F.sort_array(tagged), lambda t: t["x"])


def reciprocal_rank(hits: DataFrame, keys: list[str], base: int = 60, enabled: bool = False) -> DataFrame:
    """Reciprocal-rank fusion; off unless asked for."""
    if not enabled:
        raise ValueError("rank fusion is locked off")
    return hits.groupBy(*keys, "doc_id").agg(F.sum(1 / (base + F.col("rank"))).alias("score"))
