"""Model responses: parsed with their allowed spans, failing closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .records import SPACES

#: What a citation may be rated.
ADEQUACY = ("adequate", "inadequate", "unverifiable")
_READER = "answer string, cited_span_ids array<string>"
_JUDGE = "label string, cited_span_ids array<string>, rationale_codes array<string>, uncertainty_reasons array<string>"
_AUDIT = _JUDGE + ", citations array<struct<span_id:string, adequacy:string, defects:array<string>>>"


def _present(text: Column, name: str) -> Column:
    """Whether the object has a field that is not null, whatever its type."""
    return F.get_json_object(F.regexp_extract(text, r"(?s)(\{.*\})", 1), f"$.{name}").isNotNull()


def _outside(cited: Column, allowed: Column) -> Column:
    return F.size(F.array_except(cited, allowed)) > 0


def _reader_error(r: Column, allowed: Column) -> Column:
    return (
        F.when(r.isNull(), "no JSON object").when(F.trim(F.coalesce(r["answer"], F.lit(""))) == "", "missing answer")
        .when(r["cited_span_ids"].isNull() | F.exists(r["cited_span_ids"], lambda x: F.coalesce(x, F.lit("")) == ""), "cited spans are no list")
        .when(_outside(r["cited_span_ids"], allowed), "cited a span that was not supplied")
    )


def _read(r: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), F.trim(r["answer"])).alias("answer"), F.when(error.isNull(), r["cited_span_ids"]).alias("cited"), error.alias("error"))


def reader_response(text: Column, allowed: Column) -> Column:
    """struct(answer, cited, error): text and spans that were shown, or why not."""
    r = T.first_json_object(text, _READER)
    return _read(r, _reader_error(r, allowed))


def with_reader_response(rows: DataFrame, text: Column, allowed: Column, name: str) -> DataFrame:
    """reader_response() as a column of ``rows``, its JSON parsed once a row."""
    d = rows.withColumn("_json", T.first_json_object(text, _READER))
    d = d.withColumn("_error", _reader_error(F.col("_json"), allowed))
    return d.withColumn(name, _read(F.col("_json"), F.col("_error"))).drop("_json", "_error")


def _judge_error(r: Column, text: Column, allowed: Column) -> Column:
    bad = lambda c, ok: r[c].isNull() & _present(text, c) | F.coalesce(F.exists(r[c], lambda x: ~ok(x)), F.lit(False))
    return (
        F.when(r.isNull(), "no JSON object").when(r["label"].isNull(), "missing label")
        .when(~F.lower(F.trim(r["label"])).isin(*SPACES["mavs_four_way"]), "label outside the four-way set")
        .when(r["cited_span_ids"].isNull() | F.exists(r["cited_span_ids"], lambda x: x.isNull()), "cited spans are no list")
        .when(_outside(r["cited_span_ids"], allowed), "cited a span that was not supplied")
        .when(bad("rationale_codes", lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), "rationale codes are no list of strings")
        .when(bad("uncertainty_reasons", lambda x: x.isNotNull()), "uncertainty reasons are no list of strings")
    )


def _judged(r: Column, error: Column) -> list[Column]:
    kept = lambda c: F.when(error.isNull(), c)
    none = F.array().cast("array<string>")
    codes = F.transform(F.coalesce(r["rationale_codes"], none), lambda x: F.trim(x))
    reasons = F.filter(F.transform(F.coalesce(r["uncertainty_reasons"], none), lambda x: F.trim(x)), lambda x: x != "")
    return [
        kept(F.lower(F.trim(r["label"]))).alias("label"), kept(r["cited_span_ids"]).alias("cited"),
        kept(F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("live_model")))).alias("rationale_codes"), kept(reasons).alias("uncertainty"),
    ]


def judge_response(text: Column, allowed: Column) -> Column:
    """struct(label, cited, rationale_codes, uncertainty, error) of a four-way judgment."""
    r = T.first_json_object(text, _JUDGE)
    error = _judge_error(r, text, allowed)
    return F.struct(*_judged(r, error), error.alias("error"))


def with_judge_response(rows: DataFrame, text: Column, allowed: Column, name: str) -> DataFrame:
    """judge_response() as a column of ``rows``, its JSON parsed once a row."""
    d = rows.withColumn("_json", T.first_json_object(text, _JUDGE))
    d = d.withColumn("_error", _judge_error(F.col("_json"), text, allowed))
    return d.withColumn(name, F.struct(*_judged(F.col("_json"), F.col("_error")), F.col("_error").alias("error"))).drop("_json", "_error")


def audit_response(text: Column, allowed: Column) -> Column:
    """judge_response() with ``rated``, a map span -> (adequacy, defects); a later rating of a span wins."""
    r = T.first_json_object(text, _AUDIT)
    each = F.coalesce(r["citations"], F.array().cast("array<struct<span_id:string, adequacy:string, defects:array<string>>>"))
    error = (
        F.when(_judge_error(r, text, allowed).isNotNull(), _judge_error(r, text, allowed))
        .when(r["citations"].isNull() & _present(text, "citations"), "citations are no list")
        .when(F.exists(each, lambda x: ~F.coalesce(F.array_contains(allowed, x["span_id"]), F.lit(False))), "rated a span that was not supplied")
        .when(F.exists(each, lambda x: ~F.coalesce(x["adequacy"].isin(*ADEQUACY), F.lit(False))), "adequacy outside the allowed set")
    )
    clean = lambda x: F.filter(F.transform(F.coalesce(x["defects"], F.array().cast("array<string>")), lambda d: F.trim(d)), lambda d: d != "")
    spans = F.array_distinct(F.transform(each, lambda x: x["span_id"]))
    last = F.transform(spans, lambda s: F.element_at(F.filter(each, lambda x: x["span_id"] == s), -1))
    rated = F.map_from_arrays(spans, F.transform(last, lambda x: F.struct(x["adequacy"].alias("adequacy"), clean(x).alias("defects"))))
    return F.struct(*_judged(r, error), F.when(error.isNull(), rated).alias("rated"), error.alias("error"))


def rate_citations(citations: DataFrame, audits: DataFrame) -> DataFrame:
    """(claim_id, span_id) and (claim_id, rated map) -> adequacy and defects; an unrated citation is unverifiable."""
    j = citations.join(audits.select("claim_id", "rated"), "claim_id", "left")
    own = F.element_at("rated", F.col("span_id"))
    return j.select(
        *citations.columns, F.coalesce(own["adequacy"], F.lit("unverifiable")).alias("adequacy"),
        F.coalesce(own["defects"], F.array(F.lit("citation_not_rated"))).alias("defects"),
    )


def transport_failure(timed_out: Column) -> Column:
    """struct(status, reason) of a call that gave no response."""
    return F.struct(F.when(timed_out, "timeout").otherwise("failed").alias("status"), F.when(timed_out, "live_timeout").otherwise("live_endpoint_unavailable").alias("reason"))


def fail_closed(parsed: Column, timed_out: Column) -> Column:
    """A judgment struct that fails closed: no response and a bad one are ``unaddressed``, cite nothing and say why."""
    gone = transport_failure(timed_out)
    reason = F.when(timed_out.isNotNull(), gone["reason"]).when(parsed["error"].isNotNull(), F.lit("live_parse_failed"))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(reason.isNull(), parsed["label"]).otherwise("unaddressed").alias("label"),
        F.when(reason.isNull(), "completed").when(timed_out.isNotNull(), gone["status"]).otherwise("failed").alias("status"),
        F.when(reason.isNull(), parsed["cited"]).otherwise(none).alias("cited"),
        F.when(reason.isNull(), parsed["rationale_codes"]).otherwise(F.array(reason)).alias("rationale_codes"),
        F.when(reason.isNull(), parsed["uncertainty"]).otherwise(F.array(reason)).alias("uncertainty"),
    )
