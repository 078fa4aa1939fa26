"""Data-quality checks: each returns the violations as rows (check, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def failing(df: DataFrame, key: str, check: str, bad: Column) -> DataFrame:
    return df.filter(F.coalesce(bad, F.lit(False))).select(F.lit(check).alias("check"), F.col(key).cast("string").alias("key"))


def repeated(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of every key in more than one row."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return failing(repeated(df, key), key, f"duplicate {key}", F.lit(True))


def blank(df: DataFrame, key: str) -> DataFrame:
    return failing(df, key, f"blank {key}", F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == "")


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return failing(left.join(right.select(key).distinct(), key, "left_anti"), key, f"missing {key}", F.lit(True))


def ranks(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Ranks run 1..n without gaps, scores do not rise, and n keeps the limit."""
    w = W.partitionBy(*keys).orderBy("rank")
    d = df.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag("score").over(w))
    bad = (F.col("_n") != F.col("rank")) | (F.col("score") > F.col("_before")) | (F.col("rank") > limit)
    return failing(d, keys[0], "ranks", bad)


def same_value(df: DataFrame, column: str) -> DataFrame:
    """At most one distinct value that is not blank."""
    n = df.filter(F.trim(F.coalesce(column, F.lit(""))) != "").agg(F.count_distinct(column).alias("n"))
    return n.filter("n > 1").select(F.lit(f"several {column}").alias("check"), F.col("n").cast("string").alias("key"))


def require_empty(violations: DataFrame) -> None:
    """Raise with a few of the violations; only those reach the driver."""
    if some := violations.limit(5).collect():
        raise ValueError("; ".join(f"{r['check']}: {r['key']}" for r in some))
