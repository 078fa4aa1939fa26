"""Label domains, mappings and status predicates as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Native labels in their order, and the four-way labels.
NATIVE = ("SUPPORT", "REFUTE", "NEI")
FOUR_WAY = ("supported", "contradicted", "unaddressed", "underdetermined")
OK_TOKENS = ("ok", "completed", "success")
FOUR_TO_NATIVE = {"supported": "SUPPORT", "contradicted": "REFUTE", "unaddressed": "NEI", "underdetermined": "NEI"}
NATIVE_TO_OFFICIAL = {"SUPPORT": "SUPPORT", "REFUTE": "CONTRADICT", "NEI": "NOT ENOUGH INFO"}


def mapped(column: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())]), column)


def normalize(raw: Column, strict: bool = True) -> Column:
    """Trimmed capitals with CONTRADICT as REFUTE; anything else is an error, or null."""
    t = F.upper(F.trim(raw))
    known = F.when(t == "CONTRADICT", "REFUTE").when(t.isin(*NATIVE), t)
    bad = F.raise_error(F.concat(F.lit("unknown label: "), t)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(t.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(known, bad))


def four_way_to_native(label: Column, strict: bool = True) -> Column:
    known = mapped(label, FOUR_TO_NATIVE)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown four-way label: "), label)).cast("string") if strict else F.lit("NEI"))


def execution_ok(status: Column) -> Column:
    """A missing status counts as ok."""
    return F.coalesce(F.lower(F.trim(status)), F.lit("ok")).isin(*OK_TOKENS)


def exactly_ok(status: Column) -> Column:
    return F.coalesce(status == "ok", F.lit(False))


def null_or_ok(status: Column) -> Column:
    return status.isNull() | (status == "ok")


def uniform_claim_label(labels: Column) -> Column:
    """No label: NEI; one kind: that; several kinds: an error."""
    s = F.array_distinct(F.transform(labels, lambda x: normalize(x)))
    return F.when(F.size(s) == 0, "NEI").when(F.size(s) == 1, F.get(s, F.lit(0))).otherwise(F.raise_error(F.lit("mixed rationale labels")).cast("string"))


def contradict_wins(labels: Column) -> Column:
    return F.when(F.array_contains(labels, "CONTRADICT"), "REFUTE").when(F.array_contains(labels, "SUPPORT"), "SUPPORT").otherwise("NEI")


def mixed_is_nei(labels: Column) -> Column:
    s = F.array_distinct(labels)
    return F.when(F.size(s) != 1, "NEI").when(F.get(s, F.lit(0)) == "SUPPORT", "SUPPORT").otherwise("REFUTE")


def predicted(*columns: str) -> Column:
    return F.coalesce(*[F.col(c) for c in columns or ("label_pred", "predicted_label", "label")])


def gold(*columns: str) -> Column:
    return F.coalesce(*[F.col(c) for c in columns or ("label_gold", "gold_label", "gold")])


def error_class(pred: Column, gold_label: Column) -> Column:
    """Kind of a wrong row, in order of precedence; null for a right one."""
    return (
        F.when(pred == gold_label, F.lit(None).cast("string"))
        .when((pred == "SUPPORT") & (gold_label != "SUPPORT"), "false_endorsement")
        .when(gold_label == "SUPPORT", "missed_support")
        .when(gold_label == "REFUTE", "missed_contradiction")
        .otherwise("other")
    )
