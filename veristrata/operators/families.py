"""Claim families: connected components of the claim-document citation graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running
from .stored import dropped, stored, wide_shuffles


def components(edges: DataFrame) -> DataFrame:
    """(claim, doc) -> (claim, root), the root being the smallest claim id as a string.

    Star rounds on claims and documents as nodes of one graph: in each, a node's larger
    neighbours move to its smallest one, then the rest of a node's smaller ones do.  The
    edges end as stars around the smallest node of each component.  A claim comes before
    every document, so the root is a claim.  A node of many edges is an aggregation, and
    joins meet it with one row, which AQE may split; rounds go on until nothing changes.
    The number of partitions follows the number of edges, each of which is read from both
    ends.
    """
    own = edges.filter("claim is not null and doc is not null")
    with wide_shuffles(edges.sparkSession, 2 * own.count()):
        return _stars(own)


def _stars(edges: DataFrame) -> DataFrame:
    cited = stored(edges.select(F.col("claim").cast("string").alias("claim"), F.col("doc").cast("string").alias("doc")).distinct(), "families")
    # nodes as numbers, claims in the order of their ids and before all documents: rounds compare and hash longs
    claims = stored(running(cited.select("claim").distinct(), [F.col("claim")], {"b": F.lit(1).cast("long")}, tag="families"), "families")
    docs = stored(cited.select("doc").distinct().select("doc", (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("a")), "families")
    e = stored(cited.join(claims, "claim").join(docs, "doc").select("a", "b"), "families")
    before = None
    while True:
        # large star: (node, larger neighbour) -> (larger neighbour, least of the node's closed neighbourhood)
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node's smaller neighbours and itself -> the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = stored(small.filter("a <> b").distinct(), "families")
        dropped(e)
        e, mark = now, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = e.filter(F.col("a") < F.lit(1 << 62)).select(F.col("a").alias("b"), F.col("b").alias("_root"))
    named = claims.join(roots, "b", "left").select("claim", F.coalesce("_root", "b").alias("_root"))
    return stored(named.join(claims.select(F.col("claim").alias("root"), F.col("b").alias("_root")), "_root").select("claim", "root"), "families")


def families(claims: DataFrame) -> DataFrame:
    """(claim_id, cited_doc_ids) -> (claim_id, family); claims without citations stand alone."""
    edges = claims.select(F.col("claim_id").alias("claim"), F.explode("cited_doc_ids").alias("doc"))
    roots = components(edges)
    j = claims.select("claim_id").join(roots, F.col("claim_id") == F.col("claim"), "left")
    return j.select("claim_id", F.concat(F.lit("cited:"), F.coalesce("root", "claim_id")).alias("family"))


def of_arms(*arms: DataFrame) -> DataFrame:
    """(claim_id, family) over the citations of several arms at once: what one arm joins is joined in all."""
    claims = None
    for arm in arms:
        one = arm.select("claim_id", "cited_doc_ids")
        claims = one if claims is None else claims.unionByName(one)
    edges = claims.select(F.col("claim_id").alias("claim"), F.explode("cited_doc_ids").alias("doc"))
    j = claims.select("claim_id").distinct().join(components(edges), F.col("claim_id") == F.col("claim"), "left")
    return j.select("claim_id", F.concat(F.lit("cited:"), F.coalesce("root", "claim_id")).alias("family"))


def sizes(rows: DataFrame) -> DataFrame:
    """(family, n, first_claim)."""
    return rows.groupBy("family").agg(F.count("*").alias("n"), F.min("claim_id").alias("first_claim"))


def attach(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Keep a row's own family, else the found one; neither is an error."""
    j = rows.join(found.select("claim_id", F.col("family").alias("_f")), "claim_id", "left")
    missing = F.raise_error(F.concat(F.lit("no family for "), F.col("claim_id"))).cast("string")
    own = F.col("family") if "family" in rows.columns else F.lit(None).cast("string")
    return j.withColumn("family", F.coalesce(own, F.col("_f"), missing)).drop("_f")
