"""Probability quality, reliability, temperature and selective prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import NATIVE, execution_ok
from .ordered import running


def one_hot(label: Column) -> Column:
    return F.array(*[F.when(label == c, 1.0).otherwise(0.0) for c in NATIVE])


def verbalized(label: Column, confidence: Column) -> Column:
    """Confidence on the label, the rest shared by the other classes."""
    return F.array(*[F.when(label == c, confidence).otherwise((1 - confidence) / (len(NATIVE) - 1)) for c in NATIVE])


def softmax(logits: Column, temperature: Column) -> Column:
    scaled = F.transform(logits, lambda x: x / temperature)
    e = F.transform(scaled, lambda x: F.exp(x - F.array_max(scaled)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def at_temperature(probs: Column, temperature: Column) -> Column:
    """Softmax of log-probabilities at a temperature."""
    return softmax(F.transform(probs, lambda p: F.log(F.greatest(p, F.lit(1e-12)))), temperature)


def brier(probs: Column, gold: Column) -> Column:
    return F.aggregate(F.zip_with(probs, one_hot(gold), lambda p, y: (p - y) * (p - y)), F.lit(0.0), lambda a, x: a + x)


def nll(probs: Column, gold: Column, eps: float = 1e-12) -> Column:
    p = F.aggregate(F.zip_with(probs, one_hot(gold), lambda p, y: p * y), F.lit(0.0), lambda a, x: a + x)
    return -F.log(F.greatest(p, F.lit(eps)))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(conf, correct) -> non-empty bins (bin, n, conf, accuracy)."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("conf") * bins)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("conf"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def ece(binned: DataFrame) -> DataFrame:
    gap = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("conf")))
    return binned.agg(F.coalesce(F.try_divide(gap, F.sum("n").cast("double")), F.lit(0.0)).alias("ece"))


#: The temperatures that are tried: 0.1 to 10.0 by tenths.
GRID = tuple(k / 10 for k in range(1, 101))


def temperature_grid(rows: DataFrame, grid: Sequence[float] = GRID) -> DataFrame:
    """(probs, gold) -> (t, nll) for each temperature, from one pass.

    With logs of the probabilities shifted by their largest, the loss at t is the log of
    the summed exponentials over t less the gold class's share.  A row meets each t inside
    its task, and sums by t leave it; no array is built per t.
    """
    logs = F.transform("probs", lambda p: F.log(F.greatest(p, F.lit(1e-12))))
    r = rows.select(F.transform(logs, lambda x: x - F.array_max(logs)).alias("l"), F.array_position(F.array(*[F.lit(c) for c in NATIVE]), F.col("gold")).alias("g"))
    r = r.select(*[F.get("l", F.lit(i)).alias(f"l{i}") for i in range(len(NATIVE))], F.get("l", (F.col("g") - 1).cast("int")).alias("own"))
    r = r.select("*", F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("t"))
    total = sum((F.exp(F.col(f"l{i}") / F.col("t")) for i in range(1, len(NATIVE))), F.exp(F.col("l0") / F.col("t")))
    loss = -F.log(F.greatest(F.exp(F.col("own") / F.col("t")) / total, F.lit(1e-12)))
    return r.groupBy("t").agg(F.avg(loss).alias("nll"))


def fit_temperature(rows: DataFrame, grid: Sequence[float] = GRID) -> DataFrame:
    g = temperature_grid(rows, grid)
    return g.agg(F.min_by("t", F.struct(F.round("nll", 12), "t")).alias("t"), F.min("nll").alias("nll"))


def risk_coverage(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, conf, ord, correct) -> cumulative accuracy by falling confidence.

    Running sums over range partitions, so one method with all rows is spread too.
    """
    names, right = list(keys or []), F.col("correct").cast("int")
    r = running(rows, [-F.col("conf"), F.col("ord")], {"_n": F.lit(1), "_right": right}, names, "coverage")
    total = rows.groupBy(*names).agg(F.count("*").alias("_total"))
    r = r.join(F.broadcast(total), names) if names else r.join(F.broadcast(total))  # one row a method
    n = F.col("_n") + 1
    return r.select(*rows.columns, n.cast("int").alias("n"), (n / F.col("_total")).alias("coverage"), ((F.col("_right") + right) / n).alias("accuracy"))


def selective(rows: DataFrame, threshold: float) -> DataFrame:
    kept = F.col("conf") >= threshold
    return rows.agg(
        F.count_if(kept).alias("n"),
        F.avg(kept.cast("double")).alias("coverage"),
        F.coalesce(F.avg(F.when(kept, F.col("correct").cast("double"))), F.lit(0.0)).alias("accuracy"),
    )


def input_rows(rows: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Rows fit for calibration: they ran, have gold, and state a number as confidence."""
    c = F.col(confidence).cast("string").try_cast("double")
    return rows.withColumn("conf", c).filter(execution_ok(F.col("execution_status")) & F.col("gold").isNotNull() & c.isNotNull() & ~F.isnan(c))
