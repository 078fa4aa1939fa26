"""Queries over the whole chain of judgment, each with its SQL; registered by ``queries``.

Claims are orders, their passages (D1) the parts and their citations (D0) the suppliers of
their lines; six short texts stand for every stance, so the SQL tells cases by number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import live, methods, staged
from . import views as V
from .contracts import query

TEXTS = [
    "the treatment improved survival in patients", "treatment reduced survival", "treatment and survival were measured",
    "weather report from the coast", "treatment improved then reduced survival", "treatment causes improved survival",
]
QUESTION = "What is known of treatment and survival?"
_TEXT = "['" + "', '".join(TEXTS) + "']"


def _text(n):
    return F.element_at(F.array(*[F.lit(t) for t in TEXTS]), (n % len(TEXTS) + 1).cast("int"))


def _lines(spark, sf, column: str) -> DataFrame:
    """(claim_id, n): parts or suppliers of each order that is there, once each."""
    o = V.table(spark, sf, "orders").select("o_orderkey")
    x = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col(column).alias("n"))
    # the join's exchange serves the distinct rows too
    return x.join(o, "o_orderkey", "left_semi").distinct().select(T.claim_id(F.col("o_orderkey")).alias("claim_id"), "n")


def _passages(spark, sf) -> DataFrame:
    n = F.col("n")
    return _lines(spark, sf, "l_partkey").select("claim_id", n.alias("rank"), T.span_id(F.lit("D1"), n, F.lit(0), F.lit(9)).alias("span_id"), _text(n).alias("text"))


def _citations(spark, sf) -> DataFrame:
    n = F.col("n")
    origin = F.when(n % 11 == 0, "copied").otherwise("original")
    return _lines(spark, sf, "l_suppkey").select("claim_id", n.alias("ord"), T.span_id(F.lit("D0"), n, F.lit(0), F.lit(9)).alias("span_id"), _text(n).alias("text"), origin.alias("provenance"), F.lit("D0").alias("access_scope"))


def _asked(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    claim = F.when(k % 3 == 0, "treatment causes improved survival").otherwise("treatment improved survival")
    return V.table(spark, sf, "orders").select(k, "o_custkey", T.claim_id(k).alias("claim_id"), claim.alias("claim_text"), F.lit(QUESTION).alias("neutral_question"))


def _code(a: str) -> str:
    return f"""case when not coalesce({a}.addr, false) then 'no_addressing_passage' when {a}.mx or ({a}.sup and {a}.con) then 'conflicting_results' when not {a}.sup and not {a}.con then 'inconclusive_relevant_evidence'
 when {a}.sup and k % 3 = 0 and not {a}.tc then 'causal_overreach' when {a}.sup then 'supporting_direction' else 'contradicting_direction' end"""


_AGG = "bool_or(m <> 3) as addr, bool_or(m = 4) as mx, bool_or(m in (0, 5)) as sup, bool_or(m = 1) as con, bool_or(m = 5) as tc"
_LABEL = "case {0} when 'no_addressing_passage' then 'unaddressed' when 'missing_required_citation' then 'unaddressed' when 'supporting_direction' then 'supported' when 'contradicting_direction' then 'contradicted' else 'underdetermined' end"
_CITES = "(({0} in ('conflicting_results', 'inconclusive_relevant_evidence') and m <> 3) or ({0} in ('supporting_direction', 'causal_overreach') and m in (0, 5)) or ({0} = 'contradicting_direction' and m = 1))"


def _chain(dep: str) -> str:
    """CTEs up to ``cv``: one judged claim per order, with dependencies where ``dep`` holds."""
    return f"""p as (select *, d % 6 as m from (select k, d, row_number() over (partition by k order by d) as r from (select distinct l_orderkey as k, l_partkey as d from lineitem)) where r <= 8),
c as (select k, d, d % 6 as m, d % 11 <> 0 as usable from (select distinct l_orderkey as k, l_suppkey as d from lineitem)),
a1 as (select k, {_AGG} from p group by k), a0 as (select k, {_AGG} from c where usable group by k),
ad as (select k, bool_or(not usable) as broken, max(case when not usable or m in (1, 3) then 2 when m in (2, 4) or (m = 0 and k % 3 = 0) then 1 else 0 end) as bad from c group by k),
j as (select o_orderkey as k, o_custkey as cust, {_code("a1").replace("k % 3", "o_orderkey % 3")} as d1_code, case when a0.k is null then 'missing_required_citation' else {_code("a0").replace("k % 3", "o_orderkey % 3")} end as d0_code,
  case when coalesce(broken, true) then 'failed' else 'completed' end as d0_status, coalesce(bad, 2) as bad from orders left join a1 on a1.k = o_orderkey left join a0 on a0.k = o_orderkey left join ad on ad.k = o_orderkey),
l as (select *, {_LABEL.format("d0_code")} as d0_label, {_LABEL.format("d1_code")} as d1_label from j),
cv as (select *, 'scifact:' || cast(k as varchar) as claim_id, case bad when 2 then 'inadequate' when 1 then 'unverifiable' else 'adequate' end as adequacy, d0_label = d1_label and d0_status = 'completed' as same,
  case when d0_status <> 'completed' or {dep} then 'unresolved' when d0_code = 'causal_overreach' or d1_code = 'causal_overreach' or (d0_label = 'supported' and d1_label = 'contradicted') or (d0_label = 'contradicted' and d1_label = 'supported') then 'invalid'
  when d0_label <> d1_label or d0_label in ('unaddressed', 'underdetermined') then 'unresolved' when d0_label = 'contradicted' then 'invalid' else 'valid' end as link from l)"""


@query(
    f"""with {_chain("k % 7 = 0")}, s1 as (select k, string_agg('D1:' || d || ':0-9', ',' order by r) as s from p join cv using (k) where {_CITES.format("d1_code")} group by k),
s0 as (select k, string_agg('D0:' || c.d || ':0-9', ',' order by c.d) as s from c join cv using (k) where usable and {_CITES.format("d0_code")} group by k),
rd as (select k, string_agg({_TEXT}[m + 1] || ' [D1:' || d || ':0-9]', ' ' order by sha256('{QUESTION}' || chr(10) || 'D1:' || d || ':0-9')) as answer,
  string_agg('"D1:' || d || ':0-9"', ',' order by sha256('{QUESTION}' || chr(10) || 'D1:' || d || ':0-9')) as cited from p where m <> 3 group by k)
select claim_id, d0_label, d0_code, d0_status, d1_label, d1_code, adequacy, link, case when same then d0_label else 'underdetermined' end as label, d0_status as status,
case when same then 'labels_agree' when d0_status = 'completed' then 'd0_d1_conflict' else 'd0_d1_conflict,d0_not_repaired_from_d1' end as codes, concat_ws(',', s0.s, s1.s) as cited,
coalesce(answer, 'No reviewed passage shares content terms with the neutral question.') as answer,
sha256('{{"answer":"' || coalesce(answer, 'No reviewed passage shares content terms with the neutral question.') || '","cited_span_ids":[' || coalesce(rd.cited, '') || '],"neutral_question":"{QUESTION}"}}') as seal
from cv left join s0 using (k) left join s1 using (k) left join rd using (k)"""
)
def staged_verdicts(spark, sf):
    claims = _asked(spark, sf).withColumn("dependencies", F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("x"))).otherwise(staged.none()))
    v = staged.verdicts(claims, _citations(spark, sf), _passages(spark, sf), "h")
    names = ["claim_id", "d0_label", "d0_code", "d0_status", "d1_label", "d1_code", "adequacy", "link", "label", "status", "answer", "seal"]
    return v.select(*names, F.array_join("codes", ",").alias("codes"), F.array_join("cited", ",").alias("cited"))


def _report_claims(spark, sf):
    k = F.col("o_orderkey")
    deps = F.when(k % 4 == 0, F.array(F.concat(F.lit("c:"), k.cast("string")), F.lit("other"))).when(k % 4 == 1, F.array(F.lit("other"))).otherwise(staged.none())
    c = _asked(spark, sf)
    return c.select(F.col("o_custkey").alias("report_id"), k.alias("ord"), F.concat(F.lit("c:"), k.cast("string")).alias("proposer_id"), "claim_id", "claim_text", "neutral_question", deps.alias("dependencies"), F.concat(F.lit("span "), (k % 5).cast("string")).alias("span"))


_TURN = "t as (select o_custkey as report_id, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) as turn from orders)"


@query(
    f"""with {_TURN} select report_id, turn, 'scifact:' || cast(k as varchar) as claim_id, case k % 4 when 0 then 'scifact:' || cast(k as varchar) || ',other' when 1 then 'other' else '' end as dependencies from t where turn <= 8"""
)
def bound_claims(spark, sf):
    kept, _ = staged.bound(_report_claims(spark, sf))
    return kept.select("report_id", "turn", "claim_id", F.array_join("dependencies", ",").alias("dependencies"))


@query(
    f"""with {_chain("k % 4 in (0, 1)")}, {_TURN}, g as (select report_id, count(*) as claims_judged, count(*) filter (not same) as n_conflicts, count(*) filter (link = 'valid') as n_valid, bool_or(d0_status <> 'completed') as failed_closed
from t join cv using (k) where turn <= 8 group by 1), f as (select report_id, k % 5 as s, min(turn) as turn, count(*) as n from t where turn > 8 group by 1, 2),
u as (select report_id, string_agg('span ' || s, ',' order by turn) as unchecked, cast(sum(n) as bigint) as n from f group by 1)
select report_id, claims_judged + coalesce(u.n, 0) as claims_in_report, claims_judged, u.n is not null as partial, coalesce(unchecked, '') as unchecked, n_conflicts, n_valid, failed_closed from g left join u using (report_id)"""
)
def report_chain(spark, sf):
    kept, rest = staged.bound(_report_claims(spark, sf))
    judged = staged.report_verdicts(kept, _citations(spark, sf), _passages(spark, sf))
    r = staged.reports(kept, judged, rest)
    return r.select("report_id", "claims_in_report", "claims_judged", "partial", F.array_join("unchecked_spans", ",").alias("unchecked"), "n_conflicts", "n_valid", "failed_closed")


@query(
    f"""with {_chain("false")}, r as (select *, 'few:' || k // 7 as report_id, k % 4 = 2 as dep from cv union all select *, 'one:' || k, k % 4 <> 2 from cv)
select report_id, claim_id, case when dep then 'unresolved' else link end as link from r"""
)
def shared_claim_links(spark, sf):
    """Every claim stands in two reports, with dependencies in one of them only: its link is that of the report."""
    k = F.col("o_orderkey")
    c = _asked(spark, sf)
    deps = lambda has: F.when(has, F.array(F.lit("other"))).otherwise(staged.none())
    few = c.select("*", F.concat(F.lit("few:"), F.floor(k / 7).cast("string")).alias("report_id"), deps(k % 4 == 2).alias("dependencies"))
    one = c.select("*", F.concat(F.lit("one:"), k.cast("string")).alias("report_id"), deps(k % 4 != 2).alias("dependencies"))
    return staged.report_verdicts(few.unionByName(one), _citations(spark, sf), _passages(spark, sf)).select("report_id", "claim_id", "link")


@query(
    """with i as (select o_orderkey as k, 'scifact:' || cast(o_orderkey as varchar) as claim_id, 'orders of status ' || o_orderstatus || ' cost more' as claim from orders),
q as (select *, 'What does the evidence show about: ' || claim || '?' as question from i), d as (select distinct l_orderkey as k, l_partkey as p from lineitem),
s as (select q.claim_id, string_agg(cast(p as varchar), ',' order by sha256('7:' || q.claim_id || ':' || cast(p as varchar))) as ids, count(*) as n from d join q using (k) group by 1),
r as (select q.*, coalesce(ids, '') as ids, case when n > 0 then 'mock-reader: evidence-only notes; n_docs=' || n || '; digest=' else 'mock-reader: no D0 abstracts were attached; digest=' end
  || substr(sha256('7' || chr(10) || question || chr(10) || coalesce(ids, '')), 1, 12) as answer from q left join s using (claim_id)),
h as (select *, cast('0x' || substr(sha256('7' || chr(10) || claim_id || chr(10) || question || chr(10) || claim || chr(10) || answer || chr(10) || ids), 1, 2) as int) % 3 as x from r)
select claim_id, case x when 0 then 'SUPPORT' when 1 then 'REFUTE' else 'NEI' end as label, answer as reader_answer, ids as reader_cited from h"""
)
def same_evidence_b2(spark, sf):
    o = V.table(spark, sf, "orders")
    items = o.select(T.claim_id(F.col("o_orderkey")).alias("claim_id"), F.concat(F.lit("orders of status "), "o_orderstatus", F.lit(" cost more")).alias("claim"))
    docs = _lines(spark, sf, "l_partkey").select("claim_id", F.col("n").alias("doc_id"))
    b = methods.same_evidence(items, docs, "What does the evidence show about: {claim}?")
    return b.select("claim_id", "label", "reader_answer", F.array_join(F.transform("reader_cited", lambda x: x.cast("string")), ",").alias("reader_cited"))


def _reader():
    """Quotes the first span by id; six passages time out, seven break the format."""
    import json

    def call(prompt: str) -> str:
        spans = sorted(p["span_id"] for p in json.loads(prompt)["passages"])
        if len(spans) == 6:
            raise TimeoutError("late")
        return "sorry" if len(spans) == 7 else json.dumps({"answer": f"{len(spans)} passages", "cited_span_ids": spans[:1]})

    return call


def _judge():
    """Labels by the number of passages; five cite what was not shown, three find no host."""
    import json

    def call(prompt: str) -> str:
        r = json.loads(prompt)
        n = len(r["passages"])
        if n == 3:
            raise ConnectionRefusedError("no host")
        cited = ["D1:none:0-9"] if n == 5 else r["sealed_reader"]["cited_span_ids"]
        return "Label: " + json.dumps({"label": "Supported" if n % 2 else "contradicted", "cited_span_ids": cited, "rationale_codes": [f"n{n}"]})

    return call


@query(
    """with p as (select l_orderkey as k, least(count(distinct l_partkey), 8) as n, min('D1:' || l_partkey || ':0-9') as lo from lineitem group by 1),
s as (select l_orderkey as k, l_partkey as d, row_number() over (partition by l_orderkey order by l_partkey) as r from (select distinct l_orderkey, l_partkey from lineitem)),
f as (select k, min('D1:' || d || ':0-9') as first from s where r <= 8 group by k),
x as (select 'scifact:' || cast(o_orderkey as varchar) as claim_id, coalesce(n, 0) as n, first from orders left join p on p.k = o_orderkey left join f on f.k = o_orderkey)
select claim_id, case when n in (3, 5, 6, 7) then 'unaddressed' when n % 2 = 1 then 'supported' else 'contradicted' end as label, case when n = 6 then 'timeout' when n in (3, 5, 7) then 'failed' else 'completed' end as status,
case n when 6 then 'live_timeout' when 3 then 'live_endpoint_unavailable' when 5 then 'live_parse_failed' when 7 then 'live_parse_failed' else 'n' || n end as codes, case when n in (0, 3, 5, 6, 7) then '' else first end as cited,
case when n in (6, 7) then 'The evidence reader gave no accepted answer.' else n || ' passages' end as answer from x"""
)
def live_judgment(spark, sf):
    claims = _asked(spark, sf)
    d = live.d1(claims, _passages(spark, sf), _reader, _judge, backoff=0.0)
    return d.select("claim_id", "label", "status", F.array_join("rationale_codes", ",").alias("codes"), F.array_join("cited", ",").alias("cited"), "answer")
