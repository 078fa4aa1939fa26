"""Judgment and prediction records: contracts as error columns, reconciled and failed rows, bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L

#: Label space -> its labels; execution states.
SPACES = {"mavs_four_way": ("supported", "contradicted", "unaddressed", "underdetermined"), "scifact_native": ("SUPPORT", "CONTRADICT")}
STATES = ("completed", "failed", "timeout")


def label_error(space: Column, label: Column) -> Column:
    """Why a label cannot stand in its space, or null: execution states are no labels, and spaces do not mix."""
    wrong = F.when(F.lower(label).isin(*STATES), "label is an execution status").when(F.coalesce(F.trim(label), F.lit("")) == "", "label is empty")
    for name, allowed in SPACES.items():
        wrong = wrong.when((space == name) & ~label.isin(*allowed), f"label outside {name}")
    return wrong.when(~F.coalesce(space.isin(*SPACES), F.lit(False)), "unknown label space")


def reconciled(pairs: DataFrame) -> DataFrame:
    """(claim_id, d0 and d1 structs of label, status, cited) -> what both scopes say together.

    Agreement of two completed judgments keeps their label; anything else is
    underdetermined, and a scope that did not complete fails the record.  Spans of the
    citations come first, each once.
    """
    done = [F.coalesce(F.col(f"{s}.status") == "completed", F.lit(False)) for s in ("d0", "d1")]
    agree = done[0] & done[1] & (F.col("d0.label") == F.col("d1.label"))
    none = F.array().cast("array<string>")
    codes = F.when(agree, F.array(F.lit("labels_agree"))).when(done[0], F.array(F.lit("d0_d1_conflict"))).otherwise(F.array(F.lit("d0_d1_conflict"), F.lit("d0_not_repaired_from_d1")))
    return pairs.select(
        "claim_id",
        F.when(agree, F.col("d0.label")).otherwise("underdetermined").alias("label"),
        F.when(done[0] & done[1], "completed").otherwise("failed").alias("status"),
        codes.alias("rationale_codes"),
        F.array_distinct(F.concat(F.coalesce("d0.cited", none), F.coalesce("d1.cited", none))).alias("cited"),
        F.when(agree, none).otherwise(F.array(F.lit("d0_d1_disagreement"))).alias("uncertainty"),
        F.col("d0.label").alias("d0_label"), F.col("d1.label").alias("d1_label"),
    )


def prediction_rows(records: DataFrame, mode: str, method: str = "V") -> DataFrame:
    """reconciled() records as prediction rows: the label native, the four-way token beside it."""
    return records.select(
        "claim_id", F.lit(method).alias("method_id"), L.four_way_to_native(F.col("label")).alias("label"), F.col("label").alias("label_4way"),
        F.col("d0_label").alias("d0_label_4way"), F.col("d1_label").alias("d1_label_4way"), "rationale_codes",
        F.when(F.col("status") == "completed", "ok").otherwise("failed").alias("execution_status"), F.lit(mode).alias("inference_mode"),
    )


def failed_rows(items: DataFrame, reason: Column, mode: str, method: str) -> DataFrame:
    """One fail-closed row an item: NEI, the reason behind a fixed prefix, nothing cited."""
    return items.select(
        "claim_id", F.lit("NEI").alias("label"), F.concat(F.lit("fail-closed: "), reason).alias("rationale"), F.lit(method).alias("adaptation"),
        F.array().cast("array<string>").alias("reader_cited_doc_ids"), F.lit(mode).alias("inference_mode"), F.lit("failed").alias("execution_status"),
    )


def bind(claims: DataFrame, bound: DataFrame) -> DataFrame:
    """Claims of a report under the ids they are retrieved by; dependencies follow, unknown ones stay.

    ``bound`` has (report_id, claim_id, retrieval_id); ``proposer_claim_id`` keeps an id that changed.
    """
    ids = bound.groupBy("report_id").agg(F.map_from_entries(F.collect_list(F.struct("claim_id", "retrieval_id"))).alias("_ids"))
    j = claims.join(ids, "report_id", "left").withColumn("_ids", F.coalesce("_ids", F.create_map().cast("map<string,string>")))
    new = F.coalesce(F.element_at("_ids", F.col("claim_id")), F.col("claim_id"))
    return j.select(
        "report_id", new.alias("claim_id"), F.when(new != F.col("claim_id"), F.col("claim_id")).alias("proposer_claim_id"),
        F.transform("dependencies", lambda d: F.coalesce(F.element_at("_ids", d), d)).alias("dependencies"),
    )


def uncertainty_line(d1_reasons: Column, defects: Column, d0_status: Column, d0_reasons: Column) -> Column:
    """Reasons in their order, each once; those of the citations' judgment only if it did not complete."""
    none = F.array().cast("array<string>")
    d0 = F.when(d0_status.isNotNull() & (d0_status != "completed"), d0_reasons)
    every = F.array_distinct(F.concat(F.coalesce(d1_reasons, none), F.coalesce(defects, none), F.coalesce(d0, none)))
    return F.when(F.size(every) == 0, "None recorded.").otherwise(F.concat(F.array_join(every, ", "), F.lit(".")))


def span_texts(d0: DataFrame, d1: DataFrame) -> DataFrame:
    """(claim_id, span_id, text) of both scopes -> (claim_id, spans map); a retrieved text wins, one without a span is an error."""
    lost = F.raise_error(F.concat(F.lit("passage without a span: "), F.col("claim_id"))).cast("string")
    a = d0.filter("span_id is not null").select("claim_id", "span_id", "text", F.lit(0).alias("o"))
    b = d1.select("claim_id", F.coalesce("span_id", lost).alias("span_id"), "text", F.lit(1).alias("o"))
    last = a.unionByName(b).groupBy("claim_id", "span_id").agg(F.max_by("text", "o").alias("text"))
    return last.groupBy("claim_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("span_id", "text")))).alias("spans"))
