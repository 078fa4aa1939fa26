"""The model-backed stages: requests of listed fields only, replies stored once, failures closed.

A client is a function that makes ``prompt -> reply`` in each task.  Replies are written
to the shared folder before they are parsed, so no plan calls a model twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import judgment, methods, responses, staged
from .stored import stored

Client = Callable[[], Callable[[str], str]]
#: What a reader record says when no answer was accepted.
NO_READER = "The evidence reader gave no accepted answer."


def _spans(passages: DataFrame, order: str) -> DataFrame:
    """(claim_id, shown): the passages of a claim in order."""
    p = F.struct(F.col(order).alias("o"), "span_id", "text")
    shown = F.transform(F.sort_array(F.collect_list(p)), lambda x: F.struct(x["span_id"].alias("span_id"), x["text"].alias("text")))
    return passages.groupBy("claim_id").agg(shown.alias("shown"))


def _replies(rows: DataFrame, request: Column, client: Client, tag: str, backoff: float) -> DataFrame:
    """(claim_id, reply, timed_out), the last null where a reply came."""
    sent = rows.select("claim_id", F.to_json(request, {"ignoreNullFields": "false"}).alias("prompt"))
    got = methods.model_stage(sent, client, backoff=backoff)
    late = F.when(F.col("execution_status") != "ok", F.col("reply").startswith("TimeoutError"))
    return stored(got.select("claim_id", "reply", late.alias("timed_out")), tag)


def _asked(rows: DataFrame, request: Column, client: Client, tag: str, backoff: float) -> DataFrame:
    """Rows with ``reply`` and ``timed_out``."""
    return rows.join(_replies(rows, request, client, tag, backoff), "claim_id")


def _ids(shown: Column) -> Column:
    return F.transform(shown, lambda x: x["span_id"])


def reader_request() -> Column:
    """Question and passages, in an order drawn from both; no claim."""
    keyed = F.transform("shown", lambda x: F.struct(F.sha2(F.concat_ws("\n", "neutral_question", x["span_id"]), 256).alias("o"), x.alias("x")))
    return F.struct("neutral_question", F.transform(F.sort_array(keyed), lambda k: k["x"]).alias("passages"))


def judge_request() -> Column:
    sealed = F.struct("answer", F.col("reader_cited").alias("cited_span_ids")).alias("sealed_reader")
    return F.struct("claim_id", F.col("claim_text").alias("normalized_claim"), "neutral_question", sealed, F.col("shown").alias("passages"))


def audit_request() -> Column:
    return F.struct("claim_id", F.col("claim_text").alias("normalized_claim"), F.col("shown").alias("passages"))


def d1(claims: DataFrame, passages: DataFrame, reader: Client, judge: Client, limit: int = staged.PASSAGES, backoff: float = 0.5) -> DataFrame:
    """Reader, seal, judge: one row per claim; a stage that fails leaves ``unaddressed`` and its reason.

    ``claims``: claim_id (unique), claim_text, neutral_question.  ``passages``: claim_id,
    rank, span_id, text.  The judge is only asked where the reader's answer was accepted.
    """
    shown = _spans(staged.cap(passages, limit), "rank")
    c = claims.select("claim_id", "claim_text", "neutral_question").join(shown, "claim_id", "left")
    # every step reads what the one before stored: nothing is ranked, joined or parsed again
    c = stored(c.withColumn("shown", F.coalesce("shown", F.array().cast(shown.schema["shown"].dataType))), "shown")
    r = responses.with_reader_response(_asked(c, reader_request(), reader, "reader-replies", backoff), F.col("reply"), _ids(F.col("shown")), "p")
    ok = F.col("timed_out").isNull() & F.col("p.error").isNull()
    r = r.withColumn("read", ok).withColumn("answer", F.when(F.col("read"), F.col("p.answer")).otherwise(NO_READER))
    r = r.withColumn("reader_cited", F.when(F.col("read"), F.col("p.cited")).otherwise(staged.none()))
    r = r.withColumn("seal", T.seal(F.col("neutral_question"), F.col("answer"), F.col("reader_cited")))
    kept = ["claim_id", "answer", "reader_cited", "seal"]
    r = stored(r.select(*kept, "claim_text", "neutral_question", "shown", "read", F.col("timed_out").alias("reader_late"), F.col("p.error").alias("reader_error")), "read")
    got = _replies(r.filter("read"), judge_request(), judge, "judge-replies", backoff)
    spans = r.select(*kept, _ids(F.col("shown")).alias("spans"), "read", "reader_late", "reader_error")
    j = responses.with_judge_response(spans.join(got, "claim_id", "left"), F.col("reply"), F.col("spans"), "p")
    # a reader that failed: its own reason, through the same rule
    unread = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("label", "string"), ("cited", "array<string>"), ("rationale_codes", "array<string>"), ("uncertainty", "array<string>"))], F.col("reader_error").alias("error"))
    parsed, late = F.when(F.col("read"), F.col("p")).otherwise(unread), F.when(F.col("read"), F.col("timed_out")).otherwise(F.col("reader_late"))
    j = j.withColumn("_parsed", parsed).withColumn("_late", late)
    return j.select(*kept, responses.fail_closed(F.col("_parsed"), F.col("_late")).alias("j")).select(*kept, "j.*")


def d0(claims: DataFrame, citations: DataFrame, client: Client, backoff: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Audit by a model: (flags per citation, judgment per claim), as judgment.audit() returns them.

    Citations with a structural defect are never sent; a claim without a sound one is not
    asked about and fails closed.  A sound citation of a failed call has no flag.
    """
    c = judgment.with_defects(claims.select("claim_id", "claim_text"), citations)
    sound = c.filter("usable")
    asked = _asked(claims.select("claim_id", "claim_text").join(_spans(sound, "ord"), "claim_id"), audit_request(), client, "audit-replies", backoff)
    allowed = _ids(F.col("shown"))
    a = asked.withColumn("p", responses.audit_response(F.col("reply"), allowed))
    a = a.withColumn("done", F.col("timed_out").isNull() & F.col("p.error").isNull()).withColumn("j", responses.fail_closed(F.col("p"), F.col("timed_out")))
    rated = responses.rate_citations(sound.select("claim_id", "ord", "span_id"), a.filter("done").select("claim_id", F.col("p.rated").alias("rated")))
    rated = rated.join(a.filter("done").select("claim_id"), "claim_id", "left_semi")
    broken = c.filter(~F.col("usable")).select("claim_id", "ord", "span_id", F.lit("inadequate").alias("adequacy"), "defects")
    bare = a.filter(~F.col("done")).join(broken.select("claim_id"), "claim_id", "left_anti")
    lost = bare.select("claim_id", F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("span_id"), F.lit("inadequate").alias("adequacy"), F.col("j.rationale_codes").alias("defects"))
    flags = rated.unionByName(broken).unionByName(lost)
    state = c.groupBy("claim_id").agg(F.bool_or(~F.col("usable")).alias("failed")).join(a.select("claim_id", "j"), "claim_id", "left")
    reason = F.array(F.lit("missing_required_citation"))
    return flags, state.select(
        "claim_id", F.lit("D0").alias("evidence_scope"), F.coalesce("j.label", F.lit("unaddressed")).alias("label"), F.coalesce("j.rationale_codes", reason).alias("rationale_codes"),
        F.coalesce("j.cited", staged.none()).alias("cited"), F.when(F.col("failed") | (F.col("j.status") != "completed"), "failed").otherwise("completed").alias("status"),
        F.coalesce("j.uncertainty", reason).alias("uncertainty"),
    )
