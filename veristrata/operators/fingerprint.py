"""Content hashes of tables that no order of rows, files or partitions changes.

A row's text is the length and value of each column; 60-bit pieces of its SHA-256 are added
up, so partial sums combine in any order and shape (partitions, buckets, whole tables) and
repeated rows count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = 4


def row_text(columns: Sequence[str]) -> Column:
    """``length:value`` of each column as text, ``-`` for null, joined by commas."""
    one = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.concat_ws(",", *[one(c) for c in columns])


def sums(columns: Sequence[str]) -> list[Column]:
    """Aggregates s0..s3 of the rows' hashes."""
    digest = F.sha2(row_text(columns), 256)
    piece = lambda i: F.conv(F.substring(digest, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")
    return [F.coalesce(F.sum(piece(i)), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(PIECES)]


def partial(df: DataFrame, columns: Sequence[str], keys: Sequence[str | Column] = ()) -> DataFrame:
    """(keys, n, s0..s3): sums that whole() combines."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *sums(columns))


def whole(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, fingerprint) of partial() rows."""
    a = parts.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(f"s{i}"), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(PIECES)])
    return a.select(*keys, "n", digest(F.col("n")).alias("fingerprint"))


def digest(n: Column) -> Column:
    """Fingerprint of a row count and sums s0..s3."""
    return F.sha2(F.concat_ws(":", n.cast("string"), *[F.col(f"s{i}").cast("string") for i in range(PIECES)]), 256)


def fingerprint(df: DataFrame, columns: Sequence[str], keys: Sequence[str | Column] = ()) -> DataFrame:
    names = [k if isinstance(k, str) else f"_k{i}" for i, k in enumerate(keys)]
    named = [k if isinstance(k, str) else k.alias(n) for k, n in zip(keys, names, strict=True)]
    return whole(partial(df, columns, named), names)


def of(df: DataFrame, columns: Sequence[str]) -> tuple[int, str]:
    """(rows, fingerprint) of a whole table."""
    r = fingerprint(df, columns).first()
    return r["n"], r["fingerprint"]


def bucket(key: Column, buckets: int) -> Column:
    """Bucket of a row by the SHA-256 of its key, so that it never depends on the engine."""
    return (F.conv(F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")
