"""Metrics as declared formulas over shared counts, all metrics and all cuts from one scan.

A count is a condition on a scored pair; a formula is an expression over counts.  Asked
metrics name the counts they need, and one aggregation over grouping sets (or several plain
keys) gives every cut; formulas are applied to its few rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import NATIVE
from .scoring import ratio


@dataclass
class Registry:
    """Counts by name, and formulas by name with the counts each reads."""

    counts: dict[str, Column] = field(default_factory=dict)
    formulas: dict[str, tuple[tuple[str, ...], Column]] = field(default_factory=dict)

    def count(self, name: str, condition: Column) -> None:
        if name in self.counts or name in self.formulas:
            raise ValueError(f"{name} is declared already")
        self.counts[name] = condition

    def formula(self, name: str, reads: Sequence[str], value: Column) -> None:
        if name in self.counts or name in self.formulas:
            raise ValueError(f"{name} is declared already")
        if lost := [r for r in reads if r not in self.counts]:
            raise ValueError(f"{name} reads counts that are not declared: {', '.join(lost)}")
        self.formulas[name] = (tuple(reads), value)

    def measure(self, pairs: DataFrame, metrics: Sequence[str], cuts: Sequence[Sequence[str]] = ((),)) -> DataFrame:
        """(cut, <keys>, metric, value): keys outside a cut are null, ``cut`` names those inside."""
        if lost := [m for m in metrics if m not in self.formulas and m not in self.counts]:
            raise ValueError(f"unknown metrics: {', '.join(lost)}")
        reads = list(dict.fromkeys(c for m in metrics for c in (self.formulas[m][0] if m in self.formulas else (m,))))
        keys = list(dict.fromkeys(k for cut in cuts for k in cut))
        sums = [F.count_if(self.counts[c]).alias(c) for c in reads]
        if keys:
            flags = [F.grouping(k).alias(f"_out_{k}") for k in keys]
            a = pairs.groupingSets([[F.col(k) for k in cut] for cut in cuts], *[F.col(k) for k in keys]).agg(*sums, *flags)
            inside = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_out_{k}") == 0, F.lit(k)) for k in keys])), ",")
        else:
            a, inside = pairs.agg(*sums), F.lit("")
        value = lambda m: (self.formulas[m][1] if m in self.formulas else F.col(m)).cast("double")
        named = F.array(*[F.struct(F.lit(m).alias("metric"), value(m).alias("value")) for m in metrics])
        return a.select(inside.alias("cut"), *keys, F.explode(named).alias("m")).select("cut", *keys, "m.metric", "m.value")


def scores(gold: str = "gold", pred: str = "pred", use: Column | None = None, failed: Column | None = None) -> Registry:
    """The scores of labelled predictions: per-class and mean P / R / F1, accuracy, both endorsement rates, coverage."""
    used = F.lit(True) if use is None else F.coalesce(use, F.lit(False))
    g, p = F.col(gold), F.col(pred)
    r = Registry()
    r.count("n_rows", F.lit(True))
    r.count("n_scored", used)
    r.count("n_failed", F.lit(False) if failed is None else F.coalesce(failed, F.lit(False)))
    r.count("n_right", used & (g == p))
    f1s = []
    for c in NATIVE:
        r.count(f"tp_{c}", used & (g == c) & (p == c))
        r.count(f"fp_{c}", used & (g != c) & (p == c))
        r.count(f"fn_{c}", used & (g == c) & (p != c))
        tp, fp, fn = (F.col(f"{k}_{c}") for k in ("tp", "fp", "fn"))
        reads = [f"{k}_{c}" for k in ("tp", "fp", "fn")]
        r.formula(f"precision_{c}", reads, ratio(tp, tp + fp))
        r.formula(f"recall_{c}", reads, ratio(tp, tp + fn))
        f1s.append(ratio(2 * tp, 2 * tp + fp + fn))
        r.formula(f"f1_{c}", reads, f1s[-1])
    every = [f"{k}_{c}" for c in NATIVE for k in ("tp", "fp", "fn")]
    total = {k: sum((F.col(f"{k}_{c}") for c in NATIVE), F.lit(0)) for k in ("tp", "fp", "fn")}
    r.formula("micro_f1", every, ratio(2 * total["tp"], 2 * total["tp"] + total["fp"] + total["fn"]))
    r.formula("macro_f1", every, sum(f1s, F.lit(0.0)) / len(NATIVE))
    r.formula("accuracy", ["n_right", "n_scored"], ratio(F.col("n_right"), F.col("n_scored")))
    r.formula("coverage", ["n_scored", "n_rows"], ratio(F.col("n_scored"), F.col("n_rows")))
    r.count("n_fe", used & (g != "SUPPORT") & (p == "SUPPORT"))
    r.count("n_gold_nonsup", used & (g != "SUPPORT"))
    r.count("n_pred_sup", used & (p == "SUPPORT"))
    r.formula("fe_gold", ["n_fe", "n_gold_nonsup"], ratio(F.col("n_fe"), F.col("n_gold_nonsup")))
    r.formula("fe_pred", ["n_fe", "n_pred_sup"], ratio(F.col("n_fe"), F.col("n_pred_sup")))
    return r


def points(measured: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """(cut, keys, x, y): two metrics of each cut side by side, as a plot takes them."""
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    return measured.groupBy("cut", *keys).agg(pick(x).alias("x"), pick(y).alias("y"))


def report(measured: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(cut, keys, report): the metrics of each cut as one JSON object, names in order."""
    entry = F.struct("metric", "value")
    return measured.groupBy("cut", *keys).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("report"))
