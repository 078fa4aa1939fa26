"""Checks of data splits from one scan: counts, hashes, repeats, disjointness, equality.

One aggregation by id turns each id into the set of splits that it stands in; a second, by
that set, leaves at most 2^splits rows, from which every count, fingerprint and overlap
follows.  Nothing is counted twice, and no split is read on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import fingerprint

MOST = 16


def membership(rows: DataFrame, splits: Sequence[str], key: str = "claim_id", split: str = "split") -> DataFrame:
    """(mask, ids, repeated, n, s0..s3): ids in exactly the splits of the mask's bits, with partial fingerprints.

    Null ids and splits that are not asked for are in none (mask 0).
    """
    if not 0 < len(splits) <= MOST or len(set(splits)) < len(splits):
        raise ValueError(f"from 1 to {MOST} different splits")
    bit = F.coalesce(sum((F.when(F.col(split) == s, 1 << i).otherwise(0) for i, s in enumerate(splits)), F.lit(0)), F.lit(0))
    one = rows.select(F.col(key).alias("key"), bit.alias("bit")).groupBy("key").agg(F.bit_or("bit").alias("mask"), *[F.count_if(F.col("bit") == 1 << i).alias(f"c{i}") for i in range(len(splits))])
    one = one.withColumn("mask", F.when(F.col("key").isNull(), 0).otherwise(F.col("mask")))
    again = F.array(*[F.count_if(F.col(f"c{i}") > 1) for i in range(len(splits))]).alias("repeated")
    return one.groupBy("mask").agg(again, F.count("*").alias("n"), *fingerprint.sums(["key"]))


def smoke(
    rows: DataFrame, splits: Sequence[str], expected: dict[str, tuple[int, str | None]], disjoint: Sequence[tuple[str, str]] = (), equal: Sequence[tuple[str, str]] = (),
    key: str = "claim_id", split: str = "split",
) -> DataFrame:
    """(check, found, wanted, ok): one row an assertion; ``expected`` gives a split's size and, if known, its fingerprint."""
    spark = rows.sparkSession
    m = membership(rows, splits, key, split).collect()  # at most 2^splits short rows
    at = {s: 1 << i for i, s in enumerate(splits)}
    has = lambda bits: [r for r in m if r["mask"] & bits == bits]
    size = lambda bits: sum(r["n"] for r in has(bits))
    sums = [r for s in splits for r in [(s, x["n"], *[x[f"s{i}"] for i in range(fingerprint.PIECES)]) for x in has(at[s])]]
    schema = "split string, n long, " + ", ".join(f"s{i} decimal(38,0)" for i in range(fingerprint.PIECES))
    prints = {r["split"]: r["fingerprint"] for r in fingerprint.whole(spark.createDataFrame(sums, schema), ["split"]).collect()}
    out = []
    for i, s in enumerate(splits):
        out.append((f"{s}: repeated ids", str(sum(r["repeated"][i] for r in m)), "0"))
        if s in expected:
            n, digest = expected[s]
            out.append((f"{s}: ids", str(size(at[s])), str(n)))
            if digest is not None:
                out.append((f"{s}: fingerprint", prints.get(s), digest))
    out += [(f"{a}, {b}: shared ids", str(size(at[a] | at[b])), "0") for a, b in disjoint]
    out += [(f"{a}, {b}: ids of one only", str(size(at[a]) + size(at[b]) - 2 * size(at[a] | at[b])), "0") for a, b in equal]
    out.append(("null id, and ids of no split", str(sum(r["n"] for r in m if not r["mask"])), "0"))
    found = spark.createDataFrame(out, "check string, found string, wanted string")
    return found.withColumn("ok", F.col("found").eqNullSafe(F.col("wanted")))


def require(found: DataFrame) -> None:
    """Pass only if every assertion of smoke() holds."""
    bad = [f"{r['check']}: {r['found']}, not {r['wanted']}" for r in found.filter("not ok").collect()]  # a few rows a split
    if bad:
        raise ValueError("; ".join(bad))


def written(df: DataFrame, path: str, key: str = "claim_id", **how) -> dict:
    """Write a split once and count it on the way: rows, ids that are null, and the fingerprint of the ids."""
    seen = Observation()
    named = fingerprint.sums([key])
    df.observe(seen, F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("n_null"), *named).write.parquet(path, **how)
    got = seen.get
    schema = "n long, " + ", ".join(f"s{i} decimal(38,0)" for i in range(fingerprint.PIECES))
    one = df.sparkSession.createDataFrame([(got["n"], *[got[f"s{i}"] for i in range(fingerprint.PIECES)])], schema)
    return {"n": got["n"], "n_null": got["n_null"], "fingerprint": fingerprint.whole(one).first()["fingerprint"]}
