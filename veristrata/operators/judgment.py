"""Staged judgment over two evidence scopes, all claims at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def with_stance(passages: DataFrame) -> DataFrame:
    """(claim_text, text) -> + addresses, stance, and causal flags, row by row.

    Tokens and polarities are columns of their own first, so each is worked out once a row.
    """
    claim, text = F.col("claim_text"), F.col("text")
    p = passages.withColumn("addresses", F.size(F.array_intersect(T.content_tokens(claim), T.content_tokens(text))) >= 2)
    p = p.withColumns({"_c": T.raw_tokens(claim), "_t": T.raw_tokens(text)})
    p = p.withColumns({"_cp": T.polarity_of(F.col("_c"), claim), "_tp": T.polarity_of(F.col("_t"), text)})
    causal = T.words(T.CAUSAL)
    p = p.withColumns({"stance": T.stance(F.col("_cp"), F.col("_tp")), "claim_causal": F.arrays_overlap("_c", causal), "text_causal": F.arrays_overlap("_t", causal)})
    return p.drop("_c", "_t", "_cp", "_tp")


def decide(stances: DataFrame, keys: list[str], *more: Column, shown: str | None = None) -> DataFrame:
    """(keys, ord, span_id, addresses, stance, claim_causal, text_causal) -> (keys, label, code, cited).

    ``more``: further aggregates of a key, kept beside these.  ``shown``: a column of stances
    beside ``cited``, in its order.

    Order of the rules: nothing addresses the claim; conflict; no direction; a
    supported causal claim on evidence without causal words; else support or
    contradiction, citing the decisive passages only.
    """
    a = stances.groupBy(*keys).agg(*decision_parts(F.col("addresses")), *more)
    a = a.withColumn("code", code_of())
    label, cited = label_of(F.col("code")), chosen_of(F.col("code"), "span_id")
    beside = [chosen_of(F.col("code"), "stance").alias(shown)] if shown else []
    kept = [c for c in a.columns if c not in {*keys, "any", "mixed", "sup", "con", "causal", "shown", "spans", "code"}]
    return a.select(*keys, label.alias("label"), "code", cited.alias("cited"), *beside, *kept)


def decision_parts(on: Column, prefix: str = "") -> list[Column]:
    """Aggregates that decide() rests on, over the rows where ``on``."""
    has = lambda s: F.coalesce(F.bool_or(on & (F.col("stance") == s)), F.lit(False))
    parts = {
        "any": F.coalesce(F.bool_or(on), F.lit(False)), "mixed": has("mixed"), "sup": has("support"), "con": has("contradict"),
        "causal": F.coalesce(F.bool_or(F.col("claim_causal")), F.lit(False)), "shown": F.coalesce(F.bool_or(on & F.col("text_causal")), F.lit(False)),
        "spans": F.sort_array(F.collect_list(F.when(on, F.struct("ord", "span_id", "stance")))),
    }
    return [c.alias(prefix + name) for name, c in parts.items()]


def code_of(prefix: str = "") -> Column:
    """The code that decision_parts() lead to."""
    c = lambda name: F.col(prefix + name)
    return (
        F.when(~c("any"), "no_addressing_passage")
        .when(c("mixed") | (c("sup") & c("con")), "conflicting_results")
        .when(~c("sup") & ~c("con"), "inconclusive_relevant_evidence")
        .when(c("sup") & c("causal") & ~c("shown"), "causal_overreach")
        .when(c("sup"), "supporting_direction")
        .otherwise("contradicting_direction")
    )


def label_of(code: Column) -> Column:
    return (
        F.when(code == "no_addressing_passage", "unaddressed")
        .when(code == "supporting_direction", "supported")
        .when(code == "contradicting_direction", "contradicted")
        .otherwise("underdetermined")
    )


def chosen_of(code: Column, field: str, prefix: str = "") -> Column:
    """A field of the passages that a code rests on: the decisive ones, or all that address the claim."""
    decisive = F.when(code.isin("supporting_direction", "causal_overreach"), "support").when(code == "contradicting_direction", "contradict")
    return F.transform(F.filter(F.col(prefix + "spans"), lambda s: decisive.isNull() | (s["stance"] == decisive)), lambda s: s[field])


def with_defects(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Claims beside their D0 citations, with ``defects`` of each and whether it is ``usable``.

    A claim without citations keeps one row, which misses its citation.
    """
    c = claims.join(citations.withColumn("access_scope", d0_only()).withColumn("_cited", F.lit(True)), "claim_id", "left")
    return c.withColumn("defects", defects_of(F.col("_cited"))).withColumn("usable", F.size("defects") == 0).drop("_cited")


def d0_only() -> Column:
    """access_scope; another one than D0 is an error."""
    return F.when(F.col("access_scope") != "D0", F.raise_error(F.lit("the audit reads D0 evidence only")).cast("string")).otherwise(F.col("access_scope"))


def defects_of(cited: Column) -> Column:
    """What a row of a citation (span_id, text, provenance) lacks; where not ``cited``, it is none."""
    defects = F.array(
        F.when(F.col("span_id").isNull() | (F.coalesce("text", F.lit("")) == ""), "missing_required_citation"),
        F.when(cited & (F.coalesce("provenance", F.lit("")) != "original"), "missing_provenance"),
    )
    return F.filter(defects, lambda d: d.isNotNull())


def audit(claims: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D0 audit: (claim_id, claim_text) and (claim_id, ord, span_id, text, provenance, access_scope).

    Returns a flag per citation and a judgment per claim; a claim without citations
    fails closed.
    """
    c = with_stance(with_defects(claims, citations))
    return flags_of(c), judged_of(c)


def flags_of(c: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Rows of with_stance(with_defects()) -> a flag each, ``more`` columns beside it: the label policy on that citation alone."""
    on, kind = F.coalesce("addresses", F.lit(False)), F.col("stance")
    code = (
        F.when(~on, "no_addressing_passage")
        .when(kind == "mixed", "conflicting_results")
        .when(~F.coalesce(kind.isin("support", "contradict"), F.lit(False)), "inconclusive_relevant_evidence")
        .when((kind == "support") & F.coalesce("claim_causal", F.lit(False)) & ~F.coalesce("text_causal", F.lit(False)), "causal_overreach")
        .when(kind == "support", "supporting_direction")
        .otherwise("contradicting_direction")
    )
    f = c.withColumn("_code", code)
    adequacy = (
        F.when(~F.col("usable") | F.col("_code").isin("no_addressing_passage", "contradicting_direction"), "inadequate")
        .when(F.col("_code") == "supporting_direction", "adequate")
        .otherwise("unverifiable")
    )
    found = F.when(~F.col("usable"), F.col("defects")).when(F.col("_code") == "supporting_direction", F.array().cast("array<string>")).otherwise(F.array("_code"))
    return f.select("claim_id", "ord", "span_id", adequacy.alias("adequacy"), found.alias("defects"), *more)


def judged_of(c: DataFrame) -> DataFrame:
    """Rows of with_stance(with_defects()) -> one judgment per claim; unusable citations do not count but fail it."""
    usable = F.col("usable")
    whole = decide(c.withColumn("addresses", F.col("addresses") & usable), ["claim_id"], F.bool_or(~usable).alias("failed"), F.bool_or(usable).alias("some"))
    return whole.select(
        "claim_id",
        F.lit("D0").alias("evidence_scope"),
        F.when(F.col("some"), F.col("label")).otherwise("unaddressed").alias("label"),
        F.when(F.col("some"), F.col("code")).otherwise("missing_required_citation").alias("code"),
        "cited",
        F.when(F.col("failed"), "failed").otherwise("completed").alias("status"),
    )


def worst_of(adequacy: Column) -> Column:
    """Worst adequacy of a group."""
    level = F.when(adequacy == "inadequate", 2).when(adequacy == "unverifiable", 1).when(adequacy.isNotNull(), 0)
    return F.element_at(F.array(F.lit("adequate"), F.lit("unverifiable"), F.lit("inadequate")), F.coalesce(F.max(level), F.lit(2)) + 1)


def rollup_adequacy(flags: DataFrame) -> DataFrame:
    """Worst flag of a claim."""
    return flags.groupBy("claim_id").agg(worst_of(F.coalesce("adequacy", F.lit("adequate"))).alias("adequacy"))


def agree(d0: Column, d1: Column, s0: Column, s1: Column) -> Column:
    return (d0 == d1) & (s0 == "completed") & (s1 == "completed")


def reconciled() -> list[Column]:
    """note, link, label and status over d0_label, d1_label, d0_status, d1_status, d0_code, d1_code, n_dependencies.

    The D1 label never replaces the D0 label.
    """
    d0, d1 = F.col("d0_label"), F.col("d1_label")
    done = (F.col("d0_status") == "completed") & (F.col("d1_status") == "completed")
    same = agree(d0, d1, F.col("d0_status"), F.col("d1_status"))
    overreach = (F.col("d0_code") == "causal_overreach") | (F.col("d1_code") == "causal_overreach")
    opposite = ((d0 == "supported") & (d1 == "contradicted")) | ((d0 == "contradicted") & (d1 == "supported"))
    link = (
        F.when(~done | (F.col("n_dependencies") > 0), "unresolved")
        .when(overreach | opposite, "invalid")
        .when((d0 != d1) | d0.isin("unaddressed", "underdetermined"), "unresolved")
        .when(d0 == "contradicted", "invalid")
        .otherwise("valid")
    )
    return [
        F.when(same, "labels_agree").otherwise("d0_d1_conflict").alias("note"),
        link.alias("link"),
        F.when(same, d0).otherwise("underdetermined").alias("label"),
        F.when(done, "completed").otherwise("failed").alias("status"),
    ]


def reconcile(j: DataFrame) -> DataFrame:
    """reconciled() per claim_id."""
    return j.select("claim_id", *reconciled())


RULES = ("agree", "d0", "d1", "fallback")


def reconcile_rules(rows: DataFrame) -> DataFrame:
    """Native labels under four alternative rules: (…, rule, pred), one row per rule.

    ``fallback`` takes D0 unless it is NEI.
    """
    d0, d1 = F.col("d0"), F.col("d1")
    made = {"agree": F.when(d0 == d1, d0).otherwise("NEI"), "d0": d0, "d1": d1, "fallback": F.when(d0 != "NEI", d0).otherwise(d1)}
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), made[r].alias("pred")) for r in RULES])
    return rows.select("*", F.explode(rules).alias("_r")).select(*rows.columns, "_r.rule", "_r.pred")


#: Columns that must never reach retrieval or the evidence reader.
FORBIDDEN = {"claim", "normalized_claim", "asserted_answer", "frozen_conclusion", "label", "gold", "label_gold", "gold_label", "evidence"}


def field_names(schema) -> set[str]:
    out: set[str] = set()
    for f in schema.fields:
        out.add(f.name)
        kind = f.dataType
        while hasattr(kind, "elementType") or hasattr(kind, "valueType"):
            kind = kind.elementType if hasattr(kind, "elementType") else kind.valueType
        if hasattr(kind, "fields"):
            out |= field_names(kind)
    return out


def assert_isolated(df: DataFrame, forbidden: set[str] = FORBIDDEN) -> DataFrame:
    """Plan-time check of a reader's input: no forbidden field at any depth."""
    leaked = sorted(field_names(df.schema) & forbidden)
    if leaked:
        raise ValueError("fields must not reach the reader: " + ", ".join(leaked))
    return df


#: Fixed value: what a reader says that found nothing to quote.
NO_ANSWER = "No reviewed passage shares content terms with the neutral question."


def read_evidence(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """Sealed evidence-only answers: (claim_id, neutral_question) and (claim_id, span_id, text).

    Passages come in an order drawn from the question and span ids (a hash order, so it
    needs no driver state); those with two shared content words are quoted.
    """
    q = assert_isolated(questions).join(assert_isolated(passages), "claim_id", "left")
    a = q.groupBy("claim_id", "neutral_question").agg(quoted(F.lit(True)))
    return sealed_of(a).select("claim_id", "neutral_question", "answer", "cited", "seal")


def quoted(on: Column) -> Column:
    """Aggregate ``p`` of sealed_of(): passages where ``on`` that share two content words with the question."""
    shared = F.size(F.array_intersect(T.content_tokens(F.col("neutral_question")), T.content_tokens(F.col("text")))) >= 2
    item = F.struct(F.sha2(F.concat_ws("\n", "neutral_question", "span_id"), 256).alias("o"), "span_id", "text")
    return F.sort_array(F.collect_list(F.when(on & shared, item))).alias("p")


def sealed_of(a: DataFrame) -> DataFrame:
    """Rows with neutral_question and the quoted passages ``p`` -> + answer, cited, seal."""
    said = F.array_join(F.transform("p", lambda x: F.concat(x["text"], F.lit(" ["), x["span_id"], F.lit("]"))), " ")
    a = a.withColumn("answer", F.when(F.size("p") > 0, said).otherwise(NO_ANSWER)).withColumn("cited", F.transform("p", lambda x: x["span_id"]))
    return a.withColumn("seal", T.seal(F.col("neutral_question"), F.col("answer"), F.col("cited"))).drop("p")


# What a card advises next, by the first reason that is known.
NEXT_CHECK = {
    "missing_required_citation": "Attach the original cited spans. The citation audit has no D0 passage to check.",
    "missing_provenance": "Record original-citation provenance. The citation audit cannot verify this span.",
    "conflicting_results": "Compare the cited passages that disagree.",
    "inconclusive_relevant_evidence": "The cited passages address the claim without a resolved direction.",
    "causal_overreach": "Separate association from causation using the cited passages.",
    "no_addressing_passage": "No cited passage addresses the claim in this record.",
    "citation_not_addressing": "The original citation does not address the claim.",
}
NO_CHECK = "No further check is recorded on this claim."


def next_check(reasons: Column) -> Column:
    """The advice of the first reason in order that has one."""
    known = F.create_map(*[F.lit(x) for kv in NEXT_CHECK.items() for x in kv])
    said = F.filter(F.transform(reasons, lambda r: F.element_at(known, r)), lambda a: a.isNotNull())
    return F.coalesce(F.get(said, F.lit(0)), F.lit(NO_CHECK))


def reconciler_note(j0: Column, s0: Column, j1: Column, s1: Column) -> Column:
    """The sentence on both labels, without its full stop."""
    # fixed values: the sentences of a card
    same = F.concat(F.lit("D0 and D1 both assign "), j0, F.lit(", and no D0 versus D1 conflict is recorded"))
    apart = F.concat(
        F.lit("D0 assigns "), j0, F.lit(" ("), s0, F.lit(") and D1 assigns "), j1, F.lit(" ("), s1,
        F.lit("), and independent evidence is not used to repair the original citation"),
    )
    return F.when(agree(j0, j1, s0, s1), same).otherwise(apart)


def card(texts: Column | None = None) -> Column:
    """The text of a claim's card; a span that is not on record is an error.

    ``texts``: those of the cited spans, in their order, where they are at hand; else each
    is looked for in ``spans``, which takes as many steps as there are spans.

    Columns: claim_text, label and cited (of D1), d0_cited, spans (map span
    id -> text), uncertain and checks (reasons, in order), scope, adequacy, note, link.
    """
    marks = lambda c: F.transform(c, lambda x: F.concat(F.lit("["), x, F.lit("]")))
    cites = F.concat(marks("d0_cited"), marks("cited"))
    spaced = lambda c: F.when(F.size(c) > 0, F.concat(F.lit(" "), F.array_join(c, " "))).otherwise("")
    doubts = F.array_join(F.array_distinct("uncertain"), ", ")
    looked_up = F.transform("cited", lambda c: F.element_at("spans", c))
    # fixed values: the headings of a card
    lines = F.concat(
        F.array(F.concat(F.lit("Claim: "), F.col("claim_text")), F.concat(F.lit("Evidence verdict: "), F.col("label"), spaced(marks("cited")), F.lit("."))),
        F.zip_with("cited", looked_up if texts is None else texts, lambda c, t: F.concat(F.lit("Why: "), t, F.lit(" ["), c, F.lit("]"))),
        F.array(
            F.concat(F.lit("What is uncertain: "), F.when(doubts == "", "None recorded").otherwise(doubts), F.lit(".")),
            F.concat(F.lit("Search scope: "), F.col("scope"), F.lit(".")),
            F.concat(F.lit("Original citations: "), F.col("adequacy"), F.lit(".")),
            F.concat(F.lit("Reconciler: "), F.col("note"), spaced(cites), F.lit(". Inference link: "), F.col("link"), F.lit(".")),
            F.concat(F.lit("Next useful check: "), next_check(F.col("checks"))),
        ),
    )
    text = F.array_join(lines, "\n")
    unknown = F.size(F.array_except(F.concat("d0_cited", "cited", T.span_ids(text)), F.map_keys("spans"))) > 0
    return F.when(unknown, F.raise_error(F.lit("card cites an unknown span")).cast("string")).otherwise(text)


def claim_cards(rows: DataFrame) -> DataFrame:
    """card() per claim_id; ``texts``, if there, are the texts of ``cited``."""
    return rows.select("claim_id", card(F.col("texts") if "texts" in rows.columns else None).alias("card"))
