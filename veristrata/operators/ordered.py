"""Running sums over a total order, without one task that holds the whole of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stored import dropped, stored

#: Rows that one task sums without moving them to others first.
FEW = 20_000


def running(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column], keys: Sequence[str] = (), tag: str = "running") -> DataFrame:
    """``rows`` with, per name of ``sums``, that column's sum over the rows before it in its key (0 at the first).

    Rows are dealt to range partitions by key and order, so a hot key spreads over many;
    what stands before a partition comes from one row per key and partition.  Up to FEW rows,
    counted where they are stored, go through one window instead.  ``order`` is ascending
    and should tell rows apart; rows that it does not share a partition.
    """
    keys = list(keys)
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    r = rows
    for i, c in enumerate(order):
        r = r.withColumn(f"_o{i}", c)
    for name, c in sums.items():
        r = r.withColumn(f"_v_{name}", c)
    up = [F.col(f"_o{i}") for i in range(len(order))]
    r = stored(r, tag)
    if r.count() <= FEW:
        upto = W.partitionBy(*keys).orderBy(*up).rowsBetween(W.unboundedPreceding, -1)
        return r.coalesce(1).select(*rows.columns, *[F.coalesce(F.sum(f"_v_{n}").over(upto), F.lit(0)).alias(n) for n in sums])
    first = r
    r = r.repartitionByRange(parts, *[F.col(k).asc_nulls_last() for k in keys], *up).withColumn("_part", F.spark_partition_id())
    r = stored(r, tag)
    dropped(first)
    total = r.groupBy(*keys, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    upto = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = total.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_t_{n}").over(upto), F.lit(0)).alias(f"_b_{n}") for n in sums]
    )
    inside = W.partitionBy(*keys, "_part").orderBy(*up).rowsBetween(W.unboundedPreceding, -1)
    r = r.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_i_{n}") for n in sums])
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    r = r.join(before, same)
    return r.select(*rows.columns, *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])
