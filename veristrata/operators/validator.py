"""The whole validator: claims and documents in, prediction rows out.

``rows`` gathers passages for every claim, lets the chain of judgment read them beside the
original citations, and projects the reconciled records.  ``gather`` is a parameter, so
another retriever, or stored bundles, take its place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import records, retrieval, staged
from .stored import stored

#: (claims, docs) -> passages (claim_id, doc_id, rank).
Gather = Callable[[DataFrame, DataFrame], DataFrame]
QUESTION = "What is known of: {claim}?"


def bm25(index: retrieval.Index | None = None, limit: int = staged.PASSAGES) -> Gather:
    """Gather by BM25 over three query forms; over a stored index, if one is given."""

    def run(claims: DataFrame, docs: DataFrame) -> DataFrame:
        return retrieval.gather(claims, docs, index or retrieval.build_index(docs), limit=limit)[1].select("claim_id", "doc_id", "rank")

    return run


def fixed(bundles: DataFrame) -> Gather:
    """Gather from stored passages; a claim that is not in them has none."""
    return lambda claims, docs: bundles.select("claim_id", "doc_id", "rank").join(claims.select("claim_id"), "claim_id", "left_semi")


def spanned(passages: DataFrame, docs: DataFrame, scope: str) -> DataFrame:
    """Whole documents as spans: + span_id, text; a document that is not there is an error."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("_there"))
    j = passages.join(d, "doc_id", "left")
    lost = F.raise_error(F.concat(F.lit("no document "), F.col("doc_id").cast("string"))).cast("string")
    text = F.when(F.col("_there"), F.col("text")).otherwise(lost)
    return j.withColumn("text", text).drop("_there").withColumn("span_id", T.span_id(F.lit(scope), F.col("doc_id"), F.lit(0), F.length("text")))


def judged(claims: DataFrame, docs: DataFrame, citations: DataFrame, gather: Gather | None = None, template: str = QUESTION, corpus_hash: str = "") -> DataFrame:
    """verdicts() of (claim_id, text) over gathered passages (D1) and cited documents (D0).

    ``citations``: claim_id, ord, doc_id, provenance.
    """
    asked = claims.select("claim_id", F.col("text").alias("claim_text"), T.neutral_question(F.lit(template), F.col("text")).alias("neutral_question"), staged.none().alias("dependencies"))
    found = stored((gather or bm25())(claims, docs), "validator-passages")
    d1 = spanned(found, docs, "D1").select("claim_id", "rank", "span_id", "text")
    d0 = spanned(citations, docs, "D0").select("claim_id", "ord", "span_id", "text", "provenance", F.lit("D0").alias("access_scope"))
    return staged.verdicts(asked, d0, d1, corpus_hash)


def rows(claims: DataFrame, docs: DataFrame, citations: DataFrame, gather: Gather | None = None, mode: str = "offline", **how) -> DataFrame:
    """Prediction rows of method V, one a claim; failed scopes fail the row."""
    v = judged(claims, docs, citations, gather, **how)
    return records.prediction_rows(v.withColumnRenamed("codes", "rationale_codes"), mode)
