"""Queries from documents to verdicts, and over cells of an evaluation, each with its SQL; registered by ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fingerprint, measures, resampling, splits, validator
from . import views as V
from .contracts import query
from .durable import _field, _print_sql

# ------------------------------------------------------ documents to verdicts

# what documents and claims say, so that directions, negations and causes occur
_SAYS = ("", " It improved.", " Reduced values.", " It never increased.", " Causes higher and lower values.", " Not lower.")
_ASKS = (" improved", " causes increases", " without direction")


def _docs(spark, sf):
    n = F.col("doc_id") % len(_SAYS) + 1
    said = F.element_at(F.array(*[F.lit(s) for s in _SAYS]), n.cast("int"))
    return V.table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), said).alias("text"))


def _claims(spark, sf):
    n = F.col("item_id") % len(_ASKS) + 1
    return V.table(spark, sf, "benchmark").select(T.claim_id(F.col("item_id")).alias("claim_id"), F.concat("text", F.element_at(F.array(*[F.lit(s) for s in _ASKS]), n.cast("int"))).alias("text"))


def _citations(spark, sf):
    """Every claim cites the five documents at five times its number, copied ones among them."""
    d, b = V.table(spark, sf, "documents").select("doc_id"), V.table(spark, sf, "benchmark").select("item_id")
    c = d.withColumn("item_id", F.floor(F.col("doc_id") / 5)).join(b, "item_id")
    return c.select(T.claim_id(F.col("item_id")).alias("claim_id"), F.col("doc_id").alias("ord"), "doc_id", F.when(F.col("doc_id") % 11 == 0, "copied").otherwise("original").alias("provenance"))


def _rows(spark, sf):
    return validator.rows(_claims(spark, sf), _docs(spark, sf), _citations(spark, sf))


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


_CONTENT = _list([*T.STOPWORDS, *T.INCREASE, *T.DECREASE])
_TOKENS = lambda t: f"list_distinct(regexp_extract_all(replace(lower({t}), 'ß', 'ss'), '[a-z0-9]+'))"
_TURN = lambda t, a, b: f"case when regexp_matches(replace(lower({t}), 'ß', 'ss'), '{T.NEGATION}') then '{b}' else '{a}' end"


def _polarity(w: str, t: str) -> str:
    up, down = f"list_has_any({w}, {_list(T.INCREASE)})", f"list_has_any({w}, {_list(T.DECREASE)})"
    return f"case when {up} and {down} then 'mixed' when {up} then {_TURN(t, 'increase', 'decrease')} when {down} then {_TURN(t, 'decrease', 'increase')} end"


_FORMS = """forms as (select claim_id, form, form_ord, replace(template, '{text}', text) as query from cl, (values (0, 'original', '{text}'),
  (1, 'question', 'What evidence addresses the following: {text}'), (2, 'evidence', 'evidence results {text}')) f(form_ord, form, template))"""
_CODE = """case when not coalesce(bool_or(addr{0}), false) then 'no_addressing_passage' when coalesce(bool_or(addr{0} and st = 'mixed'), false) or (coalesce(bool_or(addr{0} and st = 'support'), false) and coalesce(bool_or(addr{0} and st = 'contradict'), false)) then 'conflicting_results'
 when not coalesce(bool_or(addr{0} and st in ('support', 'contradict')), false) then 'inconclusive_relevant_evidence' when bool_or(addr{0} and st = 'support') and bool_or(cc) and not coalesce(bool_or(addr{0} and tc), false) then 'causal_overreach'
 when bool_or(addr{0} and st = 'support') then 'supporting_direction' else 'contradicting_direction' end"""
_LABEL = "case {0} when 'no_addressing_passage' then 'unaddressed' when 'missing_required_citation' then 'unaddressed' when 'supporting_direction' then 'supported' when 'contradicting_direction' then 'contradicted' else 'underdetermined' end"
_N4 = "case {0} when 'supported' then 'SUPPORT' when 'contradicted' then 'REFUTE' else 'NEI' end"
_V_SQL = f"""d as (select doc_id, coalesce(text, '') || {_list(_SAYS)}[doc_id % {len(_SAYS)} + 1] as text from documents),
cl as (select item_id, 'scifact:' || item_id as claim_id, text || {_list(_ASKS)}[item_id % {len(_ASKS)} + 1] as text from benchmark),
{V.BM25.replace("from documents", "from d")}, {_FORMS}, {V.bm25_hits("forms", "claim_id, form, form_ord")},
best as (select claim_id, doc_id, max(score) as score from hits group by 1, 2),
norm as (select doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) as same from d),
ded as (select * from (select b.*, row_number() over (partition by claim_id, same order by score desc, doc_id) as n from best b join norm using (doc_id)) where n = 1),
pas as (select * from (select claim_id, doc_id, row_number() over (partition by claim_id order by score desc, doc_id) as rank from ded) where rank <= 8),
ev as (select 1 as scope, claim_id, doc_id, true as usable from pas union all select 0, claim_id, doc_id, doc_id % 11 <> 0 from cl join d on doc_id // 5 = item_id),
tx as (select ev.*, cl.text as c, d.text as t, {_TOKENS("cl.text")} as cw, {_TOKENS("d.text")} as tw from ev join cl using (claim_id) join d using (doc_id)),
po as (select *, {_polarity("cw", "c")} as cp, {_polarity("tw", "t")} as tp, len(list_filter(list_intersect(cw, tw), lambda x: len(x) > 2 and not list_contains({_CONTENT}, x))) >= 2 as addr,
  list_has_any(cw, {_list(T.CAUSAL)}) as cc, list_has_any(tw, {_list(T.CAUSAL)}) as tc from tx),
sn as (select *, case when cp = 'mixed' or tp = 'mixed' then 'mixed' when cp is null or tp is null then 'neutral' when cp = tp then 'support' else 'contradict' end as st from po),
a1 as (select claim_id, {_CODE.format("")} as code from sn where scope = 1 group by 1),
a0 as (select claim_id, {_CODE.format(" and usable")} as code, bool_or(not usable) as broken, bool_or(usable) as some from sn where scope = 0 group by 1),
vd as (select cl.claim_id, item_id, case when a0.some then a0.code else 'missing_required_citation' end as c0, coalesce(a1.code, 'no_addressing_passage') as c1, coalesce(a0.broken, true) as failed from cl left join a0 using (claim_id) left join a1 using (claim_id)),
vl as (select *, {_LABEL.format("c0")} as l0, {_LABEL.format("c1")} as l1 from vd),
vr as (select *, l0 = l1 and not failed as same, case when l0 = l1 and not failed then l0 else 'underdetermined' end as label4 from vl)"""


@query(
    f"""with {_V_SQL} select claim_id, 'V' as method_id, {_N4.format("label4")} as label, label4 as label_4way, l0 as d0_label_4way, l1 as d1_label_4way,
case when same then 'labels_agree' when failed then 'd0_d1_conflict,d0_not_repaired_from_d1' else 'd0_d1_conflict' end as codes, case when failed then 'failed' else 'ok' end as execution_status, 'offline' as inference_mode from vr"""
)
def validator_rows(spark, sf):
    """Documents and claims in, prediction rows out: gather, read, judge, audit, reconcile, project."""
    return _rows(spark, sf).withColumn("codes", F.array_join("rationale_codes", ",")).drop("rationale_codes")


_GOLD = "case item_id % 3 when 0 then 'SUPPORT' when 1 then 'REFUTE' else 'NEI' end"


@query(
    f"""with {_V_SQL}, s as (select {_GOLD} as gold, {_N4.format("label4")} as pred, not failed as ok from vr),
c as (select ok, count(*) as n, count(*) filter (gold = pred) as n_right, count(*) filter (gold <> 'SUPPORT' and pred = 'SUPPORT') as n_fe, count(*) filter (gold <> 'SUPPORT') as n_base from s group by grouping sets ((), (ok)))
select coalesce(cast(ok as varchar), 'all') as ok, metric, round(value, 6) as value from (select ok, unnest(['n_rows', 'accuracy', 'fe_gold']) as metric, unnest([n, n_right / cast(n as double), coalesce(n_fe / nullif(cast(n_base as double), 0), 0)]) as value from c)"""
)
def validator_scores(spark, sf):
    k = T.native_id(F.col("claim_id")) % 3
    gold = F.when(k == 0, "SUPPORT").when(k == 1, "REFUTE").otherwise("NEI")
    pairs = _rows(spark, sf).select(gold.alias("gold"), F.col("label").alias("pred"), (F.col("execution_status") == "ok").alias("ok"))
    m = measures.scores().measure(pairs, ["n_rows", "accuracy", "fe_gold"], [(), ("ok",)])
    return m.select(F.coalesce(F.col("ok").cast("string"), F.lit("all")).alias("ok"), "metric", F.round("value", 6).alias("value"))


# ----------------------------------------------------------------- bootstrap

_CONFIG = resampling.Config(resamples=401, seed="cells")
_WEIGHT = lambda j: " + ".join(f"(substr(h, {8 * j + 1}, 8) >= '{t}')::int" for t in resampling.POISSON)


@query(
    f"""with {V.PREDS}, p as (select d0 as model, d1 as split, fam, gold <> 'SUPPORT' as base, b2 = 'SUPPORT' as b, v = 'SUPPORT' as w from preds where ok),
t as (select model, split, fam, count(*) filter (base) as n, count(*) filter (base and b) as fb, count(*) filter (base and w) as fv from p group by all),
e as (select *, sha256('cells:' || fam || ':' || blk) as h from t, range({_CONFIG.blocks}) x(blk)),
u as (select model, split, n, fb, fv, blk * 8 + j as r, case j {" ".join(f"when {j} then {_WEIGHT(j)}" for j in range(8))} end as k from e, range(8) y(j) where blk * 8 + j < {_CONFIG.resamples}),
s as (select model, split, r, sum(n * k) as n, sum(fb * k) as fb, sum(fv * k) as fv from u group by all),
m as (select model, split, unnest(['b2', 'v', 'v-b2']) as metric, unnest([coalesce(fb / nullif(n::double, 0), 0), coalesce(fv / nullif(n::double, 0), 0), coalesce(fv / nullif(n::double, 0), 0) - coalesce(fb / nullif(n::double, 0), 0)]) as value from s),
o as (select model, split, count(distinct fam) as n_clusters, sum(n) as n, sum(fb) as fb, sum(fv) as fv from t group by all),
q as (select model, split, n_clusters, unnest(['b2', 'v', 'v-b2']) as metric, unnest([coalesce(fb / nullif(n::double, 0), 0), coalesce(fv / nullif(n::double, 0), 0), coalesce(fv / nullif(n::double, 0), 0) - coalesce(fb / nullif(n::double, 0), 0)]) as estimate from o)
select model, split, metric, round(any_value(estimate), 6) as estimate, round(quantile_cont(value, 0.025), 6) as ci_low, round(quantile_cont(value, 0.975), 6) as ci_high, any_value(n_clusters) as n_clusters from m join q using (model, split, metric) group by all"""
)
def bootstrap_cells(spark, sf):
    """Intervals of three rates in sixteen cells of model and split, all in one job."""
    p = V.preds(spark, sf).filter("ok").withColumnsRenamed({"d0": "model", "d1": "split"})
    sums, metrics = resampling.endorsement({"b2": "b2", "v": "v"})
    r = resampling.intervals(p, ["model", "split"], "fam", sums, metrics, _CONFIG)
    return r.select("model", "split", "metric", *[F.round(c, 6).alias(c) for c in ("estimate", "ci_low", "ci_high")], "n_clusters")


# ------------------------------------------------------------------ measures

_F1 = lambda c: f"coalesce(2 * tp_{c} / nullif(cast(2 * tp_{c} + fp_{c} + fn_{c} as double), 0), 0)"
_CLASSES = ("SUPPORT", "REFUTE", "NEI")
_TPS = ", ".join(f"count(*) filter (ok and gold = '{c}' and b2 = '{c}') as tp_{c}, count(*) filter (ok and gold <> '{c}' and b2 = '{c}') as fp_{c}, count(*) filter (ok and gold = '{c}' and b2 <> '{c}') as fn_{c}" for c in _CLASSES)
_SUM = lambda k: "(" + " + ".join(f"{k}_{c}" for c in _CLASSES) + ")"


@query(
    f"""with {V.PREDS}, c as (select case when grouping(d0) = 0 then 'd0' when grouping(gold) = 0 then 'gold' else '' end as cut, d0, gold, {_TPS}, count(*) as n_rows, count(*) filter (ok) as n_scored, count(*) filter (ok and gold = b2) as n_right,
count(*) filter (ok and gold <> 'SUPPORT' and b2 = 'SUPPORT') as n_fe, count(*) filter (ok and gold <> 'SUPPORT') as n_base from preds group by grouping sets ((), (d0), (gold)))
select cut, d0, gold, metric, round(value, 6) as value from (select cut, d0, gold, unnest(['micro_f1', 'macro_f1', 'accuracy', 'coverage', 'fe_gold', 'f1_SUPPORT']) as metric,
unnest([coalesce(2 * {_SUM("tp")} / nullif(cast(2 * {_SUM("tp")} + {_SUM("fp")} + {_SUM("fn")} as double), 0), 0), ({" + ".join(_F1(c) for c in _CLASSES)}) / 3, coalesce(n_right / nullif(cast(n_scored as double), 0), 0),
coalesce(n_scored / nullif(cast(n_rows as double), 0), 0), coalesce(n_fe / nullif(cast(n_base as double), 0), 0), {_F1("SUPPORT")}]) as value from c)"""
)
def metric_cells(spark, sf):
    """Six metrics in three cuts from one aggregation."""
    r = measures.scores(pred="b2", use=F.col("ok"))
    m = r.measure(V.preds(spark, sf), ["micro_f1", "macro_f1", "accuracy", "coverage", "fe_gold", "f1_SUPPORT"], [(), ("d0",), ("gold",)])
    return m.withColumn("value", F.round("value", 6))


@query(
    f"""with {V.PREDS} select 'fam' as cut, fam, round(coalesce(count(*) filter (ok and gold = b2) / nullif(cast(count(*) filter (ok) as double), 0), 0), 6) as x,
round(coalesce(count(*) filter (ok and gold <> 'SUPPORT' and b2 = 'SUPPORT') / nullif(cast(count(*) filter (ok and gold <> 'SUPPORT') as double), 0), 0), 6) as y from preds group by fam"""
)
def plot_points(spark, sf):
    m = measures.scores(pred="b2", use=F.col("ok")).measure(V.preds(spark, sf), ["accuracy", "fe_gold"], [("fam",)])
    return measures.points(m, "accuracy", "fe_gold", ["fam"]).select("cut", "fam", *[F.round(c, 6).alias(c) for c in ("x", "y")])


# -------------------------------------------------------------------- splits

_ID = f"concat({_field('claim_id')})"


@query(
    f"""with {V.PREDS}, r as (select claim_id, 'train' as split from preds where d0 <> 'supported' union all select claim_id, 'dev' from preds where d0 = 'supported' union all select claim_id, 'test' from preds where d1 = 'supported'
union all select claim_id, 'frozen' from preds where d0 = 'supported' union all select claim_id, 'dev' from preds where d0 = 'supported' and claim_id like '%7' union all select claim_id, 'stray' from preds where d0 = 'contradicted' and d1 = 'contradicted' and claim_id not in (select claim_id from preds where d0 <> 'supported')),
i as (select distinct claim_id, split from r), n as (select split, count(*) as n from i group by 1), f as ({_print_sql(_ID, "split,", "i")} group by split),
sh as (select (select count(*) from i a join i b using (claim_id) where a.split = 'train' and b.split = 'dev') as td, (select count(*) from i a join i b using (claim_id) where a.split = 'train' and b.split = 'test') as tt,
  (select count(*) from i a join i b using (claim_id) where a.split = 'dev' and b.split = 'frozen') as df),
c as (select 'train: repeated ids' as "check", '0' as found, '0' as wanted union all select 'dev: repeated ids', cast(count(*) as varchar), '0' from (select claim_id from r where split = 'dev' group by 1 having count(*) > 1)
 union all select 'test: repeated ids', '0', '0' union all select 'frozen: repeated ids', '0', '0' union all select 'train: ids', cast(n as varchar), '1' from n where split = 'train'
 union all select 'dev: ids', cast(n as varchar), cast((select n from n where split = 'frozen') as varchar) from n where split = 'dev' union all select 'dev: fingerprint', fingerprint, (select fingerprint from f where split = 'frozen') from f where split = 'dev'
 union all select 'train, dev: shared ids', cast(td as varchar), '0' from sh union all select 'train, test: shared ids', cast(tt as varchar), '0' from sh
 union all select 'dev, frozen: ids of one only', cast((select n from n where split = 'dev') + (select n from n where split = 'frozen') - 2 * df as varchar), '0' from sh union all select 'null id, and ids of no split', '0', '0')
select "check", found, wanted, found is not distinct from wanted as ok from c"""
)
def split_smoke(spark, sf):
    """Sizes, hashes, repeats and overlaps of four splits from one scan; the frozen split says what dev should be."""
    p = V.preds(spark, sf).select("claim_id", "d0", "d1")
    in_split = F.array_compact(F.array(F.when(F.col("d0") != "supported", "train").otherwise("dev"), F.when(F.col("d1") == "supported", "test"), F.when(F.col("d0") == "supported", "frozen"), F.when((F.col("d0") == "supported") & F.col("claim_id").endswith("7"), "dev")))
    rows = p.select("claim_id", F.explode(in_split).alias("split"))
    frozen = fingerprint.of(rows.filter("split = 'frozen'"), ["claim_id"])
    expected = {"train": (1, None), "dev": frozen}
    return splits.smoke(rows, ["train", "dev", "test", "frozen"], expected, [("train", "dev"), ("train", "test")], [("dev", "frozen")])
