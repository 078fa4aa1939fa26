"""Seeded samples, prefix limits and split checks."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order_key(seed: int, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def seeded(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in hash order; equal seeds give equal samples."""
    return df.orderBy(order_key(seed, F.col(key)), key).limit(n)


def stratified(df: DataFrame, key: str, stratum: str, k: int, seed: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(order_key(seed, F.col(key)), key))
    return df.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def exact(ids: list[int], n: int, seed: int) -> list[int]:
    """Draw order of the standard generator, for small id lists on the driver."""
    return random.Random(seed).sample(ids, n)


def prefix(df: DataFrame, n: int, ord_column: str = "ord") -> DataFrame:
    return df.filter(F.col(ord_column) < n)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of both id sets, their intersection and union, from one full join."""
    x, y = (d.select(F.col(key).alias("k")).distinct().withColumn(n, F.lit(1)) for d, n in ((a, "x"), (b, "y")))
    j = x.join(y, "k", "full")
    return j.agg(F.count("x").alias("n_a"), F.count("y").alias("n_b"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n_both"), F.count("*").alias("n_any"))


def require_same(a: DataFrame, b: DataFrame, key: str) -> None:
    """Both sides have the same ids, or an error that says how many are on one side only and names a few."""
    from . import checks

    one = lambda x, y, side: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").select(F.lit(f"only in the {side}").alias("check"), F.col(key).cast("string").alias("key"))
    checks.require_empty(one(a, b, "first").unionByName(one(b, a, "second")))


def assert_split_allowed(split: str, limit: int | None, budget: int, frozen_hash: str | None = None, current_hash: str | None = None) -> None:
    """Held-out runs need a matching freeze; others stay inside their budget."""
    if split == "held_out" and (not frozen_hash or frozen_hash != current_hash):
        raise PermissionError("a held-out run needs a matching freeze record")
    if split != "held_out" and limit is not None and limit > budget:
        raise ValueError(f"limit {limit} exceeds the split's budget of {budget}")


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Counts, or nothing if any label is missing."""
    whole = df.agg(F.bool_and(F.col(label).isNotNull()).alias("_all"))
    return df.groupBy(label).agg(F.count("*").alias("n")).join(F.broadcast(whole)).filter("_all").drop("_all")
