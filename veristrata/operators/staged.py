"""The whole chain over many claims: read, judge, audit, reconcile, render; and reports of claims.

Every stage is a plan over all claims at once.  The reader sees the neutral question and
the passages, the judge the sealed answer as well, the audit the original citations alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import judgment
from .stored import stored

#: Most passages a judge sees, most claims judged in a report.
PASSAGES = 8
CLAIMS = 8
_NONE = "array<string>"


def _budget(value: int, most: int, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
        raise ValueError(f"the {what} budget must be from 1 to {most}")
    return value


def none() -> Column:
    return F.array().cast(_NONE)


def cap(passages: DataFrame, limit: int = PASSAGES) -> DataFrame:
    """The best ``limit`` passages of each claim, ranks renewed from 1."""
    rank = F.row_number().over(W.partitionBy("claim_id").orderBy("rank", "span_id"))
    return passages.withColumn("rank", rank).filter(F.col("rank") <= _budget(limit, PASSAGES, "passage"))


def boundary_error(question: Column, sealed: Column, spans: Column) -> Column:
    """Why a judge must not see a sealed record (struct question, answer, cited, seal), or null."""
    own = T.seal(sealed["question"], sealed["answer"], sealed["cited"])
    return (
        F.when(sealed["seal"].isNull(), "no sealed record")
        .when(~question.eqNullSafe(sealed["question"]), "the sealed question is another one")
        .when(sealed["seal"] != own, "the seal is broken")
        .when(F.size(F.array_except(sealed["cited"], spans)) > 0, "the reader quotes spans outside its passages")
    )


def together(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of equal claim_id side by side, all those of the first part; a claim that comes twice in a part is an error.

    One union and one aggregation: as joins, each part would hold two sorters of its own
    in every task.
    """
    rows = None
    for name, part in parts.items():
        columns = [c for c in part.columns if c != "claim_id"]
        p = part.select("claim_id", F.struct(*columns).alias(name))
        rows = p if rows is None else rows.unionByName(p, allowMissingColumns=True)
    g = rows.groupBy("claim_id").agg(*[F.any_value(name, F.lit(True)).alias(name) for name in parts], F.greatest(F.lit(0), *[F.count(name) for name in parts]).alias("_most"))
    twice = F.raise_error(F.concat(F.lit("a claim comes twice: "), F.coalesce("claim_id", F.lit("null")))).cast("boolean")
    g = g.filter(F.when(F.col("_most") > 1, twice).otherwise(F.lit(True)))
    return g.filter(F.col(next(iter(parts))).isNotNull()).select("claim_id", *[f"{name}.*" for name in parts])


def judge(claims: DataFrame, sealed: DataFrame, passages: DataFrame) -> DataFrame:
    """(claim_id, label, code, cited) on D1, behind the boundary check; no passage leaves a claim unaddressed.

    ``claims``: claim_id, claim_text, neutral_question.  ``sealed``: rows of
    read_evidence().  ``passages``: claim_id, rank, span_id, text.
    """
    record = F.struct(F.col("neutral_question").alias("question"), "answer", "cited", "seal")
    spans = passages.groupBy("claim_id").agg(F.collect_set("span_id").alias("spans"))
    s = together({"c": claims.select("claim_id", "claim_text", "neutral_question"), "r": sealed.select("claim_id", record.alias("r")), "s": spans})
    why = boundary_error(F.col("neutral_question"), F.col("r"), F.coalesce("spans", none()))
    refused = F.raise_error(F.concat(F.col("claim_id"), F.lit(": "), why)).cast("string")
    checked = s.select("claim_id", F.when(why.isNull(), F.col("claim_text")).otherwise(refused).alias("claim_text"))
    seen = checked.join(passages.select("claim_id", F.col("rank").alias("ord"), "span_id", "text"), "claim_id", "left")
    return judgment.decide(judgment.with_stance(seen), ["claim_id"])


def reasons(code: Column) -> Column:
    """What a judgment is uncertain about: its code, unless the evidence shows a direction."""
    return F.when(code.isin("supporting_direction", "contradicting_direction"), none()).otherwise(F.array(code))


def span_texts(citations: DataFrame, passages: DataFrame) -> DataFrame:
    """(claim_id, spans): span id -> text; a later passage wins, D1 over D0."""
    d0 = citations.filter("span_id is not null").select("claim_id", "span_id", "text", F.lit(0).alias("scope"), F.col("ord").cast("bigint").alias("ord"))
    d1 = passages.select("claim_id", "span_id", "text", F.lit(1).alias("scope"), F.col("rank").cast("bigint").alias("ord"))
    # inside a struct: a null text is a text too
    last = d0.unionByName(d1).groupBy("claim_id", "span_id").agg(F.max_by(F.struct("text"), F.struct("scope", "ord")).alias("t"))
    return last.groupBy("claim_id").agg(F.map_from_entries(F.collect_list(F.struct("span_id", "t.text"))).alias("spans"))


def verdicts(claims: DataFrame, citations: DataFrame, passages: DataFrame, corpus_hash: str = "", limit: int = PASSAGES) -> DataFrame:
    """One row per claim with its D0, D1 and reconciled judgment, sealed answer and card.

    ``claims``: claim_id, claim_text, neutral_question, dependencies (array).
    ``citations``: claim_id, ord, span_id, text, provenance, access_scope.
    ``passages``: claim_id, rank, span_id, text.  A claim comes once and may lack either kind.
    """
    n = F.greatest(F.size("dependencies"), F.lit(0)).alias("n_dependencies")
    return _rendered(_judged(claims.select("claim_id", "claim_text", "neutral_question", n), citations, passages, limit), corpus_hash)


def _judged(claims: DataFrame, citations: DataFrame, passages: DataFrame, limit: int) -> DataFrame:
    """Claims (claim_id, claim_text, neutral_question and others) beside all that their evidence says, before reconciliation.

    Passages (scope 1) and citations (scope 0) meet their claims once and are read once, in one
    aggregation, which nothing is stored for: an aggregate of one scope takes no row of the other.
    """
    _budget(limit, PASSAGES, "passage")
    judgment.assert_isolated(claims.select("claim_id", "neutral_question"))
    judgment.assert_isolated(passages.select("claim_id", "span_id", "text"))
    none_yet = F.lit(None).cast("string").alias("provenance")
    d1 = passages.select("claim_id", F.lit(1).alias("scope"), F.col("rank").cast("bigint").alias("ord"), "span_id", "text", none_yet, F.lit("D0").alias("access_scope"))
    d0 = citations.select("claim_id", F.lit(0).alias("scope"), F.col("ord").cast("bigint").alias("ord"), "span_id", "text", "provenance", "access_scope")
    one = F.row_number().over(W.partitionBy("claim_id").orderBy(F.desc("scope"), "ord", "span_id"))
    rows = d1.unionByName(d0).withColumn("_n", one).filter((F.col("scope") == 0) | (F.col("_n") <= limit))
    # ranks from 1, as cap() renews them; a citation keeps its place
    rows = rows.withColumn("ord", F.when(F.col("scope") == 1, F.col("_n").cast("bigint")).otherwise(F.col("ord"))).drop("_n")
    again = F.count("*").over(W.partitionBy("claim_id"))
    e = claims.withColumn("_times", again).join(rows.withColumn("access_scope", judgment.d0_only()), "claim_id", "left")
    e = judgment.with_stance(e.withColumn("defects", judgment.defects_of(F.lit(True))))
    e = e.withColumn("usable", (F.size("defects") == 0) & (F.col("scope") == 0))
    own = [c for c in claims.columns if c != "claim_id"]
    f = judgment.flags_of(e, [*own, "_times", "scope", "text", "addresses", "usable", "stance", "claim_causal", "text_causal"])
    in0, in1 = F.coalesce(F.col("scope") == 0, F.lit(False)), F.coalesce(F.col("scope") == 1, F.lit(False))
    on = F.coalesce("addresses", F.lit(False))
    entry = F.when((in0 & F.col("span_id").isNotNull()) | in1, F.struct("span_id", "scope", "ord", "text"))
    g = f.groupBy("claim_id").agg(
        *[F.first(c).alias(c) for c in own], F.max("_times").alias("_times"), F.count_if(in0).alias("_n0"), F.count_if(in1).alias("n_passages"),
        *judgment.decision_parts(on & in0 & F.col("usable"), "d0_"), *judgment.decision_parts(on & in1, "d1_"),
        F.coalesce(F.bool_or(in0 & F.col("usable")), F.lit(False)).alias("_some"), F.coalesce(F.bool_or(in0 & ~F.col("usable")), F.lit(False)).alias("_failed"),
        judgment.worst_of(F.when(in0, F.col("adequacy"))).alias("adequacy"), F.sort_array(F.collect_list(F.when(in0, F.struct("ord", "defects")))).alias("_defects"),
        judgment.quoted(in1), F.collect_set(F.when(in1, F.col("span_id"))).alias("_shown"), F.sort_array(F.collect_list(entry)).alias("_texts"),
    )
    twice = F.raise_error(F.concat(F.lit("a claim comes twice: "), F.coalesce("claim_id", F.lit("null")))).cast("boolean")
    g = g.filter(F.when(F.col("_times") > 1, twice).otherwise(F.lit(True)))
    g = judgment.sealed_of(g.withColumn("d0_code", judgment.code_of("d0_")).withColumn("d1_code", judgment.code_of("d1_")))
    # the judge sees the sealed record behind the boundary check
    why = boundary_error(F.col("neutral_question"), F.struct(F.col("neutral_question").alias("question"), "answer", "cited", "seal"), F.col("_shown"))
    refused = F.raise_error(F.concat(F.col("claim_id"), F.lit(": "), why)).cast("string")
    # a later passage wins, D1 over D0: of equal spans, the last of the sorted entries
    last = F.filter("_texts", lambda x, i: ~F.coalesce(F.get("_texts", i + 1)["span_id"] == x["span_id"], F.lit(False)))
    bare = F.col("_n0") == 0
    return g.select(
        "claim_id", *[c for c in own if c != "neutral_question"],
        F.when(F.col("_some"), judgment.label_of(F.col("d0_code"))).otherwise("unaddressed").alias("d0_label"),
        F.when(F.col("_some"), F.col("d0_code")).otherwise("missing_required_citation").alias("d0_code"), judgment.chosen_of(F.col("d0_code"), "span_id", "d0_").alias("d0_cited"),
        F.when(bare | F.col("_failed"), "failed").otherwise("completed").alias("d0_status"),
        F.when(why.isNull(), judgment.label_of(F.col("d1_code"))).otherwise(refused).alias("d1_label"), "d1_code", judgment.chosen_of(F.col("d1_code"), "span_id", "d1_").alias("d1_cited"),
        "answer", "seal", "adequacy", F.when(bare, F.array(F.lit("missing_required_citation"))).otherwise(F.flatten(F.transform("_defects", lambda x: x["defects"]))).alias("defects"),
        "n_passages", F.map_from_entries(F.transform(last, lambda x: F.struct(x["span_id"], x["text"]))).alias("spans"),
    )


def _rendered(j: DataFrame, corpus_hash: str, *more: str) -> DataFrame:
    """Rows of _judged() with n_dependencies -> verdicts, ``more`` columns beside them."""
    j = j.withColumn("d1_status", F.lit("completed"))
    j = j.select("*", *judgment.reconciled())
    both = F.col("d0_status") == "completed"
    lost = F.when(both, none()).otherwise(F.array(F.lit("d0_not_repaired_from_d1")))
    codes = F.when(F.col("note") == "labels_agree", F.array("note")).otherwise(F.concat(F.array("note"), lost))
    n = F.coalesce("n_passages", F.lit(0))
    d0_reasons, d1_reasons = reasons(F.col("d0_code")), reasons(F.col("d1_code"))
    scope = F.concat(F.lit(f"corpus hash {corpus_hash}; "), n.cast("string"), F.lit(" independent passages; retrieval round "), F.when(n > 0, "1").otherwise("none"))
    note = judgment.reconciler_note(F.col("d0_label"), F.col("d0_status"), F.col("d1_label"), F.col("d1_status"))
    kept = [*more, "claim_id", "d0_label", "d0_code", "d0_cited", "d0_status", "d1_label", "d1_code", "d1_cited", "d1_status", "answer", "seal", "adequacy", "link", "status"]
    to_render = {
        "claim_text": F.col("claim_text"), "label": F.col("d1_label"), "cited": F.col("d1_cited"), "spans": F.coalesce("spans", F.map_from_arrays(none(), none())),
        "uncertain": F.concat(d1_reasons, "defects", F.when(both, none()).otherwise(d0_reasons)), "checks": F.concat(d1_reasons, d0_reasons, "defects"), "scope": scope, "note": note,
    }
    union = F.array_distinct(F.concat("d0_cited", "d1_cited"))
    r = j.select(*kept, F.col("label").alias("_label"), codes.alias("codes"), union.alias("_cited"), *[x.alias(name) for name, x in to_render.items()])
    return r.select(*kept, "codes", F.col("_label").alias("label"), F.col("_cited").alias("cited"), judgment.card().alias("card"))


def bound(claims: DataFrame, budget: int = CLAIMS) -> tuple[DataFrame, DataFrame]:
    """(claims to judge, claims beyond the budget) of all reports.

    ``claims``: report_id, ord, proposer_id, claim_id (the retrieval id), dependencies
    (proposer ids).  Dependencies become retrieval ids where the report judges them; a
    retrieval id that comes twice in a report is an error.
    """
    w = W.partitionBy("report_id")
    turn = F.row_number().over(w.orderBy("ord", "proposer_id"))
    c = claims.withColumn("turn", turn)
    kept = c.filter(F.col("turn") <= _budget(budget, CLAIMS, "claim"))
    again = F.raise_error(F.concat(F.lit("retrieval id comes twice: "), F.col("claim_id"))).cast("string")
    n = F.count("*").over(W.partitionBy("report_id", "claim_id"))
    kept = kept.withColumn("claim_id", F.when(n == 1, F.col("claim_id")).otherwise(again))
    ids = kept.groupBy("report_id").agg(F.map_from_entries(F.collect_list(F.struct("proposer_id", "claim_id"))).alias("ids"))  # at most ``budget`` a report
    kept = kept.join(ids, "report_id").withColumn("dependencies", F.transform("dependencies", lambda d: F.coalesce(F.element_at("ids", d), d)))
    return kept.drop("ids"), c.filter(F.col("turn") > budget)


def report_verdicts(claims: DataFrame, citations: DataFrame, passages: DataFrame, corpus_hash: str = "", limit: int = PASSAGES) -> DataFrame:
    """verdicts() of every (report_id, claim_id): reports may share a claim, each with dependencies of its own.

    ``claims`` are those of verdicts() and their report_id; a claim comes once in a report.
    A claim of one text and question is judged once, whatever reports it stands in;
    reconciliation and card are those of the report.
    """
    text = ["claim_id", "claim_text", "neutral_question"]
    own = claims.select(*text).distinct()
    n = F.row_number().over(W.partitionBy("claim_id").orderBy("claim_text", "neutral_question"))
    own = stored(own.withColumn("_case", F.concat_ws(":", n.cast("string"), "claim_id")), "cases")
    under = own.select("claim_id", "_case")
    renamed = lambda df: df.join(under, "claim_id").drop("claim_id").withColumnRenamed("_case", "claim_id")
    j = _judged(own.select(F.col("_case").alias("claim_id"), "claim_text", "neutral_question"), renamed(citations), renamed(passages), limit).withColumnRenamed("claim_id", "_case")
    twice = F.raise_error(F.concat(F.lit("a claim comes twice: "), F.coalesce("claim_id", F.lit("null")))).cast("int")
    again = F.count("*").over(W.partitionBy("report_id", "claim_id"))
    c = claims.select("report_id", *text, F.greatest(F.size("dependencies"), F.lit(0)).alias("_deps")).withColumn("n_dependencies", F.when(again > 1, twice).otherwise(F.col("_deps")))
    same = F.lit(True)
    for x in text:
        same &= F.col(f"c.{x}").eqNullSafe(F.col(f"o.{x}"))
    c = c.alias("c").join(own.alias("o"), same).select("c.report_id", "c.claim_id", "c.n_dependencies", "o._case")
    return _rendered(j.join(c, "_case").drop("_case"), corpus_hash, "report_id")


def reports(claims: DataFrame, judged: DataFrame, unchecked: DataFrame) -> DataFrame:
    """One row per report: coverage, outcomes, links, conflicts, unchecked spans and the cards.

    ``claims`` and ``unchecked`` come from bound(), ``judged`` from report_verdicts(); spans
    are listed once each, in order.
    """
    j = claims.select("report_id", "turn", "claim_id").join(judged, ["report_id", "claim_id"])
    row = F.struct("turn", "claim_id", "d0_label", "d1_label", "label", "link", "card")
    differ = F.col("codes")[0] == "d0_d1_conflict"
    a = j.groupBy("report_id").agg(
        F.count("*").alias("claims_judged"), F.count_if(differ).alias("n_conflicts"), F.count_if(F.col("link") == "valid").alias("n_valid"),
        F.bool_or(F.col("d0_status") != "completed").alias("failed_closed"), F.sort_array(F.collect_list(row)).alias("v"),
    )
    first = unchecked.groupBy("report_id", "span").agg(F.min("turn").alias("turn"))
    rest = first.groupBy("report_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "span"))), lambda x: x["span"]).alias("unchecked_spans"))
    n = unchecked.groupBy("report_id").agg(F.count("*").alias("n_rest"))  # equal spans count each
    a = a.join(rest, "report_id", "left").join(n, "report_id", "left").withColumn("unchecked_spans", F.coalesce("unchecked_spans", none()))
    outcomes = F.transform("v", lambda x: F.struct(x["claim_id"].alias("claim_id"), x["d0_label"].alias("d0"), x["d1_label"].alias("d1"), x["label"].alias("reconciled"), x["link"].alias("link")))
    return a.select(
        "report_id", (F.col("claims_judged") + F.coalesce("n_rest", F.lit(0))).alias("claims_in_report"), "claims_judged", F.col("n_rest").isNotNull().alias("partial"), "unchecked_spans",
        outcomes.alias("outcomes"), "n_conflicts", "n_valid", "failed_closed", F.array_join(F.transform("v", lambda x: x["card"]), "\n\n").alias("explanation"),
    )
