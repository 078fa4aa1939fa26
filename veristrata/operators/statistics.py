"""Paired comparison: pairing with drop accounting, McNemar, cluster bootstrap, Holm."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import execution_ok
from . import draws
from .ordered import running
from .scoring import ratio


def pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer pairing of (claim_id, gold, pred, status) by claim; ``drop`` is null for a usable pair."""
    x, y = (d.select("claim_id", *[F.col(c).alias(f"{c}_{s}") for c in ("gold", "pred", "status")], F.lit(True).alias(f"in_{s}")) for d, s in ((a, "a"), (b, "b")))
    j = x.join(y, "claim_id", "full")
    clash = F.raise_error(F.concat(F.lit("gold labels disagree: "), F.col("claim_id"))).cast("string")
    g = F.when(F.col("gold_a") != F.col("gold_b"), clash).otherwise(F.coalesce("gold_a", "gold_b"))
    drop = (
        F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), "not_in_all")
        .when(~execution_ok(F.col("status_a")) | ~execution_ok(F.col("status_b")), "not_ok")
        .when(F.col("gold_a").isNull() & F.col("gold_b").isNull(), "unlabeled")
    )
    return j.select("claim_id", g.alias("gold"), F.col("pred_a").alias("a"), F.col("pred_b").alias("b"), drop.alias("drop"))


def drops(paired: DataFrame) -> DataFrame:
    return paired.groupBy(F.coalesce("drop", F.lit("paired")).alias("reason")).agg(F.count("*").alias("n"))


def discordant(paired: DataFrame) -> DataFrame:
    """b: only a is right; c: only b is right."""
    ra, rb = F.col("a") == F.col("gold"), F.col("b") == F.col("gold")
    return paired.filter("drop is null").agg(F.count("*").alias("n"), F.count_if(ra & ~rb).alias("b"), F.count_if(~ra & rb).alias("c"))


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided McNemar p from the discordant counts."""
    n = b + c
    if not n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(min(b, c) + 1)]
    return min(1.0, 2 * sum(map(math.exp, logs)))


def mcnemar(counts: DataFrame) -> DataFrame:
    """p as a column: one pass over the binomial terms, each log term from the one before."""
    n, m = F.col("b") + F.col("c"), F.least("b", "c")
    none = -n * F.log(F.lit(2.0))  # log of the term of 0

    def add(s: Column, i: Column) -> Column:
        log = s["log"] + F.log((n - i + 1) / i)
        return F.when(i > m, s).otherwise(F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum")))

    first = F.struct(none.alias("log"), F.exp(none).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(m, F.lit(1)).cast("bigint")), first, add, lambda s: s["sum"])
    return counts.withColumn("p", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total)))


def least_discordant(alpha: float) -> int:
    n = 1
    while mcnemar_p(0, n) >= alpha:
        n += 1
    return n


def family_totals(paired: DataFrame, methods: dict[str, str]) -> DataFrame:
    """Sufficient statistics per family: (family, ord, n_gold, fe_<method>...)."""
    sums = [F.count_if((F.col(c) == "SUPPORT") & (F.col("gold") != "SUPPORT")).alias(f"fe_{m}") for m, c in methods.items()]
    f = paired.groupBy("family").agg(F.count_if(F.col("gold") != "SUPPORT").alias("n_gold"), *sums)
    return running(f, [F.col("family")], {"_before": F.lit(1)}, tag="families").withColumn("ord", F.col("_before") + 1).drop("_before")


def draw(resample: Column, slot: Column, n: Column) -> Column:
    """Family drawn for one slot of one resample, from an md5 of both (1-based)."""
    return F.conv(F.substring(F.md5(F.concat(resample.cast("string"), F.lit(":"), slot.cast("string"))), 1, 8), 16, 10).cast("bigint") % n + 1


#: Draws that one task makes, and resamples that meet a chunk of families in one group.
TASK_DRAWS, TOGETHER = 8_000_000, 250


def _packed(rows: pa.Table) -> pa.Table:
    """Totals of a chunk's families, a column of longs each, in the order of the families."""
    order = np.argsort(rows["ord"].to_numpy(), kind="stable")
    cols = [rows[c].to_numpy()[order].astype(np.int64).tobytes() for c in rows.column_names if c not in ("chunk", "ord")]
    return pa.table({"chunk": rows["chunk"].slice(0, 1), "totals": pa.array([b"".join(cols)])})


def _meet(sums: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Draws of some resamples and the totals of their chunk -> a partial sum per resample."""

    def run(drawn: pa.Table, packed: pa.Table) -> pa.Table:
        out = np.zeros((drawn.num_rows, len(sums)), np.int64)
        if drawn.num_rows:
            totals = np.frombuffer(packed["totals"][0].as_py(), np.int64).reshape(len(sums), -1)
            for i, x in enumerate(drawn["drawn"]):
                n = draws.counts(x.as_py()).astype(np.int64)
                out[i] = totals[:, : len(n)] @ n
        return pa.table({"r": drawn["r"], **{s: out[:, i] for i, s in enumerate(sums)}})

    return run


def bootstrap(families: DataFrame, methods: list[str], resamples: int) -> DataFrame:
    """False-endorsement rate of each method in each resample of families with replacement: draw() for every slot.

    Tasks draw whole blocks of slots and send on how often each family was drawn, a byte
    a family and compressed, by chunks of families; there they meet the totals of the
    chunk, and one row a resample and chunk is summed.  No draw is a row, nothing is
    broadcast, and a task holds a block of slots or a chunk of families.
    """
    spark = families.sparkSession
    sums = ["n_gold", *[f"fe_{x}" for x in methods]]
    units = families.count()
    blocks = max(1, -(-units // draws.BLOCK))
    deals = -(-resamples // TOGETHER)

    def draw_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                r, first = i // blocks + 1, i % blocks * draws.BLOCK + 1
                last = min(units, first + draws.BLOCK - 1)
                got = list(draws.drawn(r, first, last, units)) if first <= last else []
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c for c, _ in got], pa.int64()), "deal": pa.array([r % deals] * len(got), pa.int32()), "r": pa.array([r] * len(got), pa.int64()), "drawn": pa.array([x for _, x in got], pa.binary())})

    tasks = min(resamples * blocks, max(spark.sparkContext.defaultParallelism, -(-resamples * units // TASK_DRAWS)))
    drawn = spark.range(0, resamples * blocks, 1, tasks).mapInArrow(draw_blocks, "chunk long, deal int, r long, drawn binary")
    chunks = families.select(F.shiftright(F.col("ord").cast("long") - 1, draws.CHUNK.bit_length() - 1).alias("chunk"), "ord", *[F.col(c).cast("long").alias(c) for c in sums])
    packed = chunks.groupBy("chunk").applyInArrow(_packed, "chunk long, totals binary").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    part = drawn.groupBy("chunk", "deal").cogroup(packed.groupBy("chunk", "deal")).applyInArrow(_meet(sums), ", ".join(f"{c} long" for c in ["r", *sums]))
    hit = part.groupBy("r").agg(F.sum("n_gold").alias("n"), *[F.sum(f"fe_{x}").alias(x) for x in methods])
    return hit.select("r", *[ratio(F.col(x), F.col("n")).alias(x) for x in methods])


def interval(draws: DataFrame, column: str, low: float = 0.025, high: float = 0.975, keys: list[str] | None = None) -> DataFrame:
    ends = F.percentile(column, F.lit(low)).alias("ci_low"), F.percentile(column, F.lit(high)).alias("ci_high")
    return draws.groupBy(*(keys or [])).agg(*ends)


def two_sided_p(draws: DataFrame, column: str, observed: Column) -> DataFrame:
    """Share of draws at least as far from 0 as what was observed (a constant column); nothing observed gives 1."""
    hits = F.count_if(F.abs(F.col(column)) >= F.abs(observed))
    return draws.agg(F.max(observed).alias("observed"), F.when(F.max(observed) == 0, 1.0).otherwise((hits + 1) / (F.count("*") + 1)).alias("p"))


def holm(tests: DataFrame, alpha: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """(keys, name, p) -> adjusted p and rejection; ties rank by name."""
    w = W.partitionBy(*(keys or []))
    rank = F.row_number().over(w.orderBy("p", "name"))
    t = tests.withColumn("rank", rank).withColumn("m", F.count("*").over(w))
    upto = w.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("p_holm", F.max(F.least(F.lit(1.0), F.col("p") * (F.col("m") - F.col("rank") + 1))).over(upto))
    return t.withColumn("reject", F.bool_and(F.col("p_holm") <= alpha).over(upto)).drop("m")


def excludes_zero(low: Column, high: Column) -> Column:
    return (low > 0) | (high < 0)
