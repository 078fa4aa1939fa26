"""Confusion counts, precision / recall / F1, false endorsement and breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import NATIVE, NATIVE_TO_OFFICIAL, error_class, execution_ok, gold, mapped, normalize, predicted


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 if b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def scored_pairs(rows: DataFrame, include_failed: bool = False) -> DataFrame:
    """Prediction rows -> (keys..., gold, pred, use) where use says how a row counts."""
    names = set(rows.columns)
    p = predicted(*[c for c in ("label_pred", "predicted_label", "label") if c in names])
    g = gold(*[c for c in ("label_gold", "gold_label", "gold") if c in names])
    ok = execution_ok(F.col("execution_status")) if "execution_status" in names else F.lit(True)
    use = F.when(g.isNull(), "unlabeled").when(~ok & F.lit(not include_failed), "not_ok").otherwise("scored")
    if not include_failed:
        use = F.when(~ok, "not_ok").when(g.isNull(), "unlabeled").otherwise("scored")
    return rows.withColumn("gold", normalize(g)).withColumn("pred", normalize(p)).withColumn("use", use)


def confusion(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(gold, pred) -> (keys, class, tp, fp, fn), every class present.

    Each pair becomes at most two rows (its gold and its predicted class), so one
    aggregation counts all classes; absent classes come from a pivoted total.
    """
    keys = keys or []
    sums = [
        F.struct(
            F.lit(c).alias("class"),
            F.count_if((F.col("gold") == c) & (F.col("pred") == c)).alias("tp"),
            F.count_if((F.col("gold") != c) & (F.col("pred") == c)).alias("fp"),
            F.count_if((F.col("gold") == c) & (F.col("pred") != c)).alias("fn"),
        )
        for c in NATIVE
    ]
    one = pairs.groupBy(*keys).agg(F.array(*sums).alias("c")) if keys else pairs.agg(F.array(*sums).alias("c"))
    return one.select(*keys, F.explode("c").alias("c")).select(*keys, "c.class", "c.tp", "c.fp", "c.fn")


def prf(counts: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def micro_macro(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    a = prf(counts).groupBy(*keys).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("f1").alias("macro_f1"))
    micro = prf(a).withColumnsRenamed({"precision": "micro_precision", "recall": "micro_recall", "f1": "micro_f1"})
    return micro.select(*keys, "micro_precision", "micro_recall", "micro_f1", "macro_f1")


def false_endorsement(pairs: DataFrame, keys: list[str] | None = None, support: str = "SUPPORT") -> DataFrame:
    """Both denominators and the three counts; empty denominators give 0."""
    keys = keys or []
    fe = F.count_if((F.col("pred") == support) & (F.col("gold") != support))
    a = pairs.groupBy(*keys).agg(fe.alias("n_fe"), F.count_if(F.col("gold") != support).alias("n_gold_nonsup"), F.count_if(F.col("pred") == support).alias("n_pred_sup"))
    return a.select(*keys, "n_fe", "n_gold_nonsup", "n_pred_sup", ratio(F.col("n_fe"), F.col("n_gold_nonsup")).alias("fe_gold"), ratio(F.col("n_fe"), F.col("n_pred_sup")).alias("fe_pred"))


def score_report(rows: DataFrame, include_failed: bool = False) -> DataFrame:
    """Long metrics (metric, class, value); no metric row if nothing was scored, skips always."""
    pairs = scored_pairs(rows, include_failed)
    used = pairs.filter("use = 'scored'")
    c = prf(confusion(used))
    per = c.select(F.col("class"), F.expr("stack(3, 'precision', precision, 'recall', recall, 'f1', f1) as (metric, value)")).select("metric", "class", "value")
    whole = micro_macro(confusion(used)).select(
        F.expr("stack(4, 'micro_precision', micro_precision, 'micro_recall', micro_recall, 'micro_f1', micro_f1, 'macro_f1', macro_f1) as (metric, value)")
    )
    fe = false_endorsement(used).select(F.expr("stack(2, 'fe_gold', fe_gold, 'fe_pred', fe_pred) as (metric, value)"))
    metrics = per.unionByName(whole.unionByName(fe).select("metric", F.lit("").alias("class"), "value"))
    n = pairs.agg(
        F.count("*").cast("double").alias("n_rows"), F.count_if(F.col("use") == "scored").cast("double").alias("n_scored"),
        F.count_if(F.col("use") == "unlabeled").cast("double").alias("skipped_unlabeled"), F.count_if(F.col("use") == "not_ok").cast("double").alias("skipped_not_ok"),
    )
    counts = n.select(F.expr("stack(4, 'n_rows', n_rows, 'n_scored', n_scored, 'skipped_unlabeled', skipped_unlabeled, 'skipped_not_ok', skipped_not_ok) as (metric, value)"))
    any_scored = n.select((F.col("n_scored") > 0).alias("_any"))
    metrics = metrics.join(F.broadcast(any_scored)).filter("_any").drop("_any")
    return metrics.unionByName(counts.select("metric", F.lit("").alias("class"), "value"))


def official(pairs: DataFrame) -> DataFrame:
    """Label-only accuracy and recall per gold class, in the official label names."""
    o = pairs.select(mapped(F.col("gold"), NATIVE_TO_OFFICIAL).alias("gold"), mapped(F.col("pred"), NATIVE_TO_OFFICIAL).alias("pred"))
    right = F.count_if(F.col("gold") == F.col("pred"))
    return o.rollup("gold").agg(F.count("*").alias("n"), right.alias("n_right")).select(
        F.coalesce("gold", F.lit("all")).alias("gold"), "n", "n_right", ratio(F.col("n_right"), F.col("n")).alias("accuracy")
    )


def breakdown(rows: DataFrame, codes: str = "rationale_codes") -> DataFrame:
    """(kind, value, n): execution status, label, and each rationale code."""
    s = rows.groupBy(F.coalesce(F.lower(F.trim("execution_status")), F.lit("ok")).alias("value")).count().withColumn("kind", F.lit("status"))
    lab = rows.groupBy(F.col("label").alias("value")).count().withColumn("kind", F.lit("label"))
    c = rows.select(F.explode(codes).alias("value")).groupBy("value").count().withColumn("kind", F.lit("code"))
    return s.unionByName(lab).unionByName(c).select("kind", "value", F.col("count").alias("n"))


def failure_profile(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, kind, value, n): how often rows ran, what NEI stands for (withheld or failed), and the four-way labels behind it.

    ``rows``: label, execution_status, label_4way.  One pass.
    """
    ok, nei = execution_ok(F.col("execution_status")), F.col("label") == "NEI"
    said = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    each = F.array(
        said("status", F.when(ok, "ok").otherwise("failed")), F.when(nei, said("nei", F.when(ok, "withheld").otherwise("failed"))),
        said("four_way", F.coalesce("label_4way", F.lit("none"))), F.when(nei & ok, said("withheld_as", F.coalesce("label_4way", F.lit("none")))),
    )
    e = rows.select(*(keys or []), F.explode(F.array_compact(each)).alias("e"))
    return e.groupBy(*(keys or []), "e.kind", "e.value").agg(F.count("*").alias("n"))


def taxonomy(pairs: DataFrame, keys: list[str]) -> DataFrame:
    kinds = ["false_endorsement", "missed_support", "missed_contradiction", "other"]
    e = pairs.withColumn("error", error_class(F.col("pred"), F.col("gold")))
    return e.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col("error") == k).alias(k) for k in kinds])


def coverage_counts(rows: DataFrame, truth: str, kept: Column) -> DataFrame:
    """One row of how much was judged and how a decision to keep met the truth (1 or 0; null: not judged)."""
    good = F.col(truth) == 1
    return rows.agg(
        F.count("*").alias("n_rows"), F.count(truth).alias("n_scored"), F.count_if(F.col(truth).isNull()).alias("skipped_unlabeled"),
        F.count_if(good & kept).alias("tp"), F.count_if(~good & kept).alias("fp"), F.count_if(good & ~kept).alias("fn"),
    )
