"""Queries over records, responses and selections, each with its SQL; registered by ``queries``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import calibration, records, reports, responses, selection
from . import views as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_K = "cast(substr(claim_id, 9) as bigint)"


def query(sql: str):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries of one name: {f.__name__}")
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _claims(spark, sf):
    return V.preds(spark, sf).withColumn("k", T.native_id(F.col("claim_id")))


def _line(c: Column, by: str = ",") -> Column:
    return F.array_join(c, by)


@query(
    f"""with {V.PREDS}, j as (select case when k % 9 = 8 then 'other' when k % 2 = 0 then 'mavs_four_way' else 'scifact_native' end as space,
  case k % 5 when 0 then d0 when 1 then 'SUPPORT' when 2 then 'Timeout' when 3 then '' else gold end as label from (select *, {_K} as k from preds))
select space, label, case when lower(label) in ('completed', 'failed', 'timeout') then 'label is an execution status' when label = '' then 'label is empty'
  when space = 'mavs_four_way' and label not in ('supported', 'contradicted', 'unaddressed', 'underdetermined') then 'label outside mavs_four_way'
  when space = 'scifact_native' and label not in ('SUPPORT', 'CONTRADICT') then 'label outside scifact_native' when space = 'other' then 'unknown label space' end as error, count(*) as n
from j group by all"""
)
def judgment_contract(spark, sf):
    k = F.col("k")
    space = F.when(k % 9 == 8, "other").when(k % 2 == 0, "mavs_four_way").otherwise("scifact_native")
    label = F.when(k % 5 == 0, F.col("d0")).when(k % 5 == 1, "SUPPORT").when(k % 5 == 2, "Timeout").when(k % 5 == 3, "").otherwise(F.col("gold"))
    j = _claims(spark, sf).select(space.alias("space"), label.alias("label"))
    return j.withColumn("error", records.label_error(F.col("space"), F.col("label"))).groupBy("space", "label", "error").agg(F.count("*").alias("n"))


_REC = f"""sc as (select claim_id, d0, d1, case when {_K} % 7 = 0 then 'failed' else 'completed' end as s0, case when {_K} % 11 = 0 then 'timeout' else 'completed' end as s1, {_K} as k from preds),
rec as (select claim_id, d0, d1, case when s0 = 'completed' and s1 = 'completed' and d0 = d1 then d0 else 'underdetermined' end as label,
  case when s0 = 'completed' and s1 = 'completed' then 'completed' else 'failed' end as status,
  case when s0 = 'completed' and s1 = 'completed' and d0 = d1 then 'labels_agree' when s0 = 'completed' then 'd0_d1_conflict' else 'd0_d1_conflict,d0_not_repaired_from_d1' end as codes,
  'D0:' || k % 3 || ',X,D1:' || k % 2 as cited from sc)"""


def _reconciled(spark, sf):
    k = F.col("k")
    side = lambda s, bad, mod, cited: F.struct(F.col(s).alias("label"), F.when(k % mod == 0, bad).otherwise("completed").alias("status"), cited.alias("cited")).alias(s)
    one, two = F.concat(F.lit("D0:"), (k % 3).cast("string")), F.concat(F.lit("D1:"), (k % 2).cast("string"))
    c = _claims(spark, sf).select("claim_id", side("d0", "failed", 7, F.array(one, F.lit("X"))), side("d1", "timeout", 11, F.array(F.lit("X"), two)))
    return records.reconciled(c)


@query(f"with {V.PREDS}, {_REC} select claim_id, label, status, codes, cited, case when codes = 'labels_agree' then '' else 'd0_d1_disagreement' end as uncertainty from rec")
def reconciled_records(spark, sf):
    r = _reconciled(spark, sf)
    return r.select("claim_id", "label", "status", _line(F.col("rationale_codes")).alias("codes"), _line(F.col("cited")).alias("cited"), _line(F.col("uncertainty")).alias("uncertainty"))


@query(
    f"""with {V.PREDS}, {_REC} select claim_id, 'V' as method_id, case label when 'supported' then 'SUPPORT' when 'contradicted' then 'REFUTE' else 'NEI' end as label, label as label_4way,
d0 as d0_label_4way, d1 as d1_label_4way, codes, case when status = 'completed' then 'ok' else 'failed' end as execution_status, 'mock' as inference_mode from rec"""
)
def prediction_records(spark, sf):
    r = records.prediction_rows(_reconciled(spark, sf), "mock")
    return r.withColumn("codes", _line(F.col("rationale_codes"))).drop("rationale_codes")


@query(f"with {V.PREDS} select claim_id, 'NEI' as label, 'fail-closed: ' || d0 as rationale, 'B2' as adaptation, 'live' as inference_mode, 'failed' as execution_status, 0 as n_cited from preds where not ok")
def failed_records(spark, sf):
    r = records.failed_rows(V.preds(spark, sf).filter("not ok"), F.col("d0"), "live", "B2")
    return r.withColumn("n_cited", F.size("reader_cited_doc_ids")).drop("reader_cited_doc_ids")


@query(
    """with c as (select distinct cast(conv_id as varchar) as report_id, turn from conversations where conv_id is not null and turn is not null)
select report_id, case when turn % 2 = 0 then 'scifact:' || report_id || turn else 'c' || turn end as claim_id, case when turn % 2 = 0 then 'c' || turn end as proposer_claim_id,
coalesce(case when turn % 2 = 1 and exists (select 1 from c e where e.report_id = c.report_id and e.turn = c.turn - 1) then 'scifact:' || report_id || (turn - 1) end, 'c' || (turn - 1)) || ',z' as dependencies from c"""
)
def bound_records(spark, sf):
    t = F.col("turn")
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    c = V.table(spark, sf, "conversations").filter("conv_id is not null and turn is not null").select(F.col("conv_id").cast("string").alias("report_id"), "turn").distinct()
    bound = c.filter(t % 2 == 0).select("report_id", name(t).alias("claim_id"), F.concat(F.lit("scifact:"), "report_id", t.cast("string")).alias("retrieval_id"))
    claims = c.select("report_id", name(t).alias("claim_id"), F.array(name(t - 1), F.lit("z")).alias("dependencies"))
    return records.bind(claims, bound).withColumn("dependencies", _line(F.col("dependencies")))


@query(
    f"""with {V.PREDS}, u as (select case when k % 2 = 0 then 'a' else '' end as r, case k % 3 when 0 then 'b,a' when 1 then 'b' else '' end as f, case when k % 5 = 0 then 'c' else '' end as z from (select {_K} as k from preds)),
l as (select list_filter([r, case when f = 'b,a' or f = 'b' then 'b' end, case when f = 'b,a' and r = '' then 'a' end, z], lambda x: x is not null and x <> '') as w from u)
select case when len(w) = 0 then 'None recorded.' else array_to_string(w, ', ') || '.' end as line, count(*) as n from l group by 1"""
)
def uncertainty_lines(spark, sf):
    k = F.col("k")
    none = F.array().cast("array<string>")
    a = F.when(k % 2 == 0, F.array(F.lit("a"))).otherwise(none)
    f = F.when(k % 3 == 0, F.array(F.lit("b"), F.lit("a"))).when(k % 3 == 1, F.array(F.lit("b"))).otherwise(none)
    line = records.uncertainty_line(a, f, F.when(k % 5 == 0, "failed").otherwise("completed"), F.array(F.lit("c")))
    return _claims(spark, sf).groupBy(line.alias("line")).agg(F.count("*").alias("n"))


@query(
    f"""with {V.PREDS} select claim_id, '{{"D0:' || k % 3 || '":"' || d0 || '",' || case when k % 2 = 0 then '"S":"' || d1 || '"' else '"S":"old","T":"' || d1 || '"' end || '}}' as spans
from (select *, {_K} as k from preds)"""
)
def span_text_map(spark, sf):
    c, k = _claims(spark, sf), F.col("k")
    own = c.select("claim_id", F.concat(F.lit("D0:"), (k % 3).cast("string")).alias("span_id"), F.col("d0").alias("text"))
    same = c.select("claim_id", F.lit("S").alias("span_id"), F.lit("old").alias("text"))
    lost = c.select("claim_id", F.lit(None).cast("string").alias("span_id"), F.lit("not citable").alias("text"))
    d1 = c.select("claim_id", F.when(k % 2 == 0, "S").otherwise("T").alias("span_id"), F.col("d1").alias("text"))
    return records.span_texts(own.unionByName(same).unionByName(lost), d1).select("claim_id", F.to_json("spans").alias("spans"))


_KINDS = """(values (0, 'supported', null, 1), (1, 'contradicted', null, 1), (2, null, 'label outside the four-way set', 0), (3, null, 'cited a span that was not supplied', 0),
  (4, null, 'cited spans are no list', 0), (5, null, 'no JSON object', 0), (6, null, 'rationale codes are no list of strings', 0), (7, 'underdetermined', null, 1)) t(kind, label, error, n_cited)"""


def _replies(spark, sf):
    """Model replies, good and bad, one an event."""
    k = F.col("event_id")
    span = F.concat(F.lit('["D1:'), (k % 3).cast("string"), F.lit(':0-9"]'))
    whole = lambda label, more="": F.concat(F.lit(f'{{"label":"{label}","cited_span_ids":'), span, F.lit(more + "}"))
    kinds = [
        whole("Supported"), F.concat(F.lit("My answer: "), whole(" contradicted ")), whole("maybe"), F.lit('{"label":"supported","cited_span_ids":["D1:99:0-9"]}'),
        F.lit('{"label":"supported"}'), F.lit("no object here"), whole("supported", ',"rationale_codes":"text"'),
        whole("underdetermined", ',"rationale_codes":[" strong "],"uncertainty_reasons":[" x ",""]'),
    ]
    text = F.element_at(F.array(*kinds), (k % 8 + 1).cast("int"))
    allowed = F.array(*[F.lit(f"D1:{i}:0-9") for i in range(3)])
    return V.table(spark, sf, "events").select("event_id", responses.judge_response(text, allowed).alias("j"))


@query(f"select label, error, case when kind = 7 then 'strong' when error is null then 'live_model' end as codes, case when kind = 7 then 'x' when error is null then '' end as reasons, count(*) as n, cast(sum(n_cited) as bigint) as n_cited from events join {_KINDS} on event_id % 8 = kind group by all")
def judge_responses(spark, sf):
    r = _replies(spark, sf).select("j.label", "j.error", _line(F.col("j.rationale_codes")).alias("codes"), _line(F.col("j.uncertainty")).alias("reasons"), F.coalesce(F.size("j.cited"), F.lit(0)).alias("c"))
    return r.groupBy("label", "error", "codes", "reasons").agg(F.count("*").alias("n"), F.sum(F.greatest("c", F.lit(0))).alias("n_cited"))


@query(
    f"""with e as (select *, case when event_id % 5 = 0 then event_id % 2 = 0 end as late from events join {_KINDS} on event_id % 8 = kind)
select case when late is null and error is null then label else 'unaddressed' end as label, case when late then 'timeout' when late is not null or error is not null then 'failed' else 'completed' end as status,
case when late then 'live_timeout' when late is not null then 'live_endpoint_unavailable' when error is not null then 'live_parse_failed' when kind = 7 then 'strong' else 'live_model' end as codes, count(*) as n from e group by all"""
)
def fail_closed_judgments(spark, sf):
    late = F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 2 == 0)
    r = _replies(spark, sf).select(responses.fail_closed(F.col("j"), late).alias("f"))
    return r.groupBy("f.label", "f.status", _line(F.col("f.rationale_codes")).alias("codes")).agg(F.count("*").alias("n"))


@query("select answer, error, count(*) as n from events join (values (0, 'yes', null), (1, null, 'missing answer'), (2, null, 'cited spans are no list'), (3, null, 'cited a span that was not supplied'), (4, null, 'no JSON object')) t(kind, answer, error) on event_id % 5 = kind group by all")
def reader_responses(spark, sf):
    kinds = ['So: {"answer":" yes ","cited_span_ids":["s"]} done', '{"answer":" ","cited_span_ids":[]}', '{"answer":"yes","cited_span_ids":"s"}', '{"answer":"yes","cited_span_ids":["s","t"]}', "yes"]
    text = F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("event_id") % 5 + 1).cast("int"))
    r = V.table(spark, sf, "events").select(responses.reader_response(text, F.array(F.lit("s"))).alias("r"))
    return r.groupBy("r.answer", "r.error").agg(F.count("*").alias("n"))


@query(
    """with c as (select event_id as k, unnest([0, 1, 2]) as j from events)
select case when j <> k % 3 then 'unverifiable' when k % 2 = 1 then 'inadequate' else 'adequate' end as adequacy, case when j <> k % 3 then 'citation_not_rated' when k % 2 = 1 then '' else 'd' end as defects, count(*) as n from c group by all"""
)
def audit_ratings(spark, sf):
    e, k = V.table(spark, sf, "events").withColumn("claim_id", F.col("event_id").cast("string")), F.col("event_id")
    one = lambda how, defects: F.concat(F.lit('{"span_id":"D0:'), (k % 3).cast("string"), F.lit(f'","adequacy":"{how}","defects":{defects}}}'))
    rated = F.concat_ws(",", one("adequate", '[" d ",""]'), F.when(k % 2 == 1, one("inadequate", "[]")))
    text = F.concat(F.lit('{"label":"supported","cited_span_ids":[],"citations":['), rated, F.lit("]}"))
    spans = F.array(*[F.lit(f"D0:{i}") for i in range(3)])
    audits = e.select("claim_id", responses.audit_response(text, spans).alias("a")).select("claim_id", "a.rated")
    r = responses.rate_citations(e.select("claim_id", F.explode(spans).alias("span_id")), audits)
    return r.groupBy("adequacy", _line(F.col("defects")).alias("defects")).agg(F.count("*").alias("n"))


@query("select ord, 'scifact:' || item_id as claim_id, text from (select cast(row_number() over (order by item_id) - 1 as integer) as ord, item_id, text from benchmark) where ord < 25")
def claim_requests(spark, sf):
    b = V.table(spark, sf, "benchmark")
    first = b.agg(F.sort_array(F.collect_list("item_id")).alias("ids")).select(F.posexplode("ids").alias("ord", "id"))  # a manifest is one record
    return selection.in_order(selection.requested(spark, first, limit=25), V.claims(spark, sf)).select("ord", "claim_id", "text")


@query(
    """with s as (select n_regionkey as region, count(*) as n, sha256(string_agg(cast(n_nationkey as varchar), chr(10) order by n_nationkey) || chr(10)) as h from nation group by 1)
select region, cast(n + case when region = 2 then 1 else 0 end as integer) as n_ids, case when region = 3 then 'x' else h end as ids_sha256,
case region when 1 then 'unknown role' when 2 then 'n_ids and lists disagree' when 3 then 'hash does not match' end as error from s"""
)
def sample_records(spark, sf):
    """Locked samples of nations by region; three of them are tampered with."""
    n = V.table(spark, sf, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").cast("bigint").alias("native_id"), F.col("n_nationkey").alias("ord"))
    r, at = selection.sample_record(n, ["region"], F.lit("calibration"), 7, "nation"), F.col("region")
    r = r.withColumn("split_role", F.when(at == 1, "test").otherwise(F.col("split_role"))).withColumn("n_ids", F.col("n_ids") + F.when(at == 2, 1).otherwise(0))
    r = r.withColumn("ids_sha256", F.when(at == 3, "x").otherwise(F.col("ids_sha256")))
    return r.select("region", "n_ids", "ids_sha256", selection.sample_error().alias("error"))


@query(
    """with g as (select user_id, count(distinct case when event_id % 4 > 0 then event_type end) as n, max(case when event_id % 4 > 0 then event_type end) as own from events group by 1)
select user_id, case when user_id % 3 = 0 then 'given' when user_id % 3 = 1 then 'side' when n = 1 then own end as run_id,
case when user_id % 3 < 2 or n = 1 then null when n > 1 then 'several run ids' else 'no run id' end as error from g"""
)
def run_id_resolution(spark, sf):
    e = V.table(spark, sf, "events").withColumn("run_id", F.when(F.col("event_id") % 4 > 0, F.col("event_type")).otherwise(" "))
    u = F.col("user_id")
    return selection.run_ids(e, ["user_id"], F.when(u % 3 == 0, " given "), F.when(u % 3 == 1, "side").otherwise(" "))


@query(f"with {V.PREDS} select case when {_K} % 4 = 0 then 'prediction_row' else 'split' end as gold_source, case when {_K} % 4 = 0 then 'NEI' else gold end as label_gold, count(*) as n from preds group by all")
def gold_join_report(spark, sf):
    c = _claims(spark, sf)
    rows = c.select("claim_id", F.when(F.col("k") % 4 == 0, "NEI").otherwise(" ").alias("label_gold"))
    j = selection.with_gold(rows, c.select("claim_id", "gold"), "development", {"split": "development"}, "any")
    return j.groupBy("gold_source", "label_gold").agg(F.count("*").alias("n"))


@query(f"with {V.PREDS} select case when {_K} % 10 = 0 then null else gold end as label_gold, case when {_K} % 10 = 0 then 'failed' else 'ok' end as execution_status, count(*) as n from preds group by all")
def report_gold_join(spark, sf):
    c = _claims(spark, sf)
    rows = c.select("claim_id", F.when(F.col("k") % 10 == 0, "failed").otherwise("ok").alias("execution_status"))
    j = selection.with_report_gold(rows, c.filter("k % 10 <> 0").select("claim_id", "gold"))
    return j.groupBy("label_gold", "execution_status").agg(F.count("*").alias("n"))


@query(f"with {V.PREDS}, {V.VOTES} select cast(seed_ord as integer) as seed_ord, count(*) as n, count(*) filter (status = 'ok') as n_ok, count(*) >= 100 and bool_and(status = 'ok') as complete from votes group by 1")
def run_completeness(spark, sf):
    v = V.votes(V.preds(spark, sf)).withColumnRenamed("status", "execution_status")
    return selection.completeness(v, ["seed_ord"], 100)


@query("with o as (select l_orderkey, bool_and(l_linenumber % 3 <> 0) as eligible from lineitem group by 1) select eligible, count(*) as n from o group by 1")
def nei_eligible_claims(spark, sf):
    docs = F.collect_list(F.struct(F.col("l_partkey").cast("bigint").alias("doc_id"), (F.col("l_linenumber") % 3 == 0).cast("int").alias("rationales")))
    o = V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(docs.alias("evidence"))
    return o.groupBy(selection.nei_eligible(F.col("evidence")).alias("eligible")).agg(F.count("*").alias("n"))


@query("select 'corpus hashes disagree' as check, n_name as key from nation where n_nationkey % 3 > 0")
def corpus_lock_violations(spark, sf):
    k, own = F.col("n_nationkey"), F.sha2("n_name", 256)
    pins = V.table(spark, sf, "nation").select(F.col("n_name").alias("name"), own.alias("file_hash"), F.when(k % 3 != 1, own).otherwise("x").alias("config_hash"), F.when(k % 3 != 2, own).alias("contract_hash"))
    return selection.corpus_lock(pins)


@query(f"with {V.PREDS} select gold, count(*) as n, round(avg(conf), 6) as conf from preds where ok and {_K} % 5 > 0 group by 1")
def calibration_inputs(spark, sf):
    c = _claims(spark, sf).withColumn("execution_status", F.when(F.col("ok"), "ok").otherwise("failed"))
    c = c.select("claim_id", "gold", "execution_status", F.when(F.col("k") % 5 == 0, "high").otherwise(F.col("conf").cast("string")).alias("confidence"))
    return calibration.input_rows(c).groupBy("gold").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("conf"))


@query(
    f"""with {V.PREDS}, a as (select claim_id, 'V' as method, case when d0 = d1 then 1.0 else 0.0 end as s, v = gold as r from preds where ok union all
select claim_id, 'B2', case when {_K} % 3 > 0 then 1.0 else 0.0 end, b2 = gold from preds where ok union all select claim_id, 'B1', conf, b2 = gold from preds where ok)
select method, claim_id, cast(row_number() over w as integer) as n, round(sum(case when r then 1 else 0 end) over (partition by method order by s desc, claim_id rows unbounded preceding) / cast(row_number() over w as double), 6) as accuracy
from a window w as (partition by method order by s desc, claim_id)"""
)
def acceptance_curves(spark, sf):
    c = _claims(spark, sf).filter("ok")
    rows = c.select("claim_id", "gold", "d0", "d1", "conf", "k", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(p).alias("pred")) for m, p in (("V", "v"), ("B2", "b2"), ("B1", "b2"))])).alias("m"))
    score = reports.acceptance_score(F.col("m.method"), F.col("d0") == F.col("d1"), F.col("k") % 3, F.col("conf"))
    r = rows.select("claim_id", "m.method", score.alias("conf"), F.col("claim_id").alias("ord"), (F.col("m.pred") == F.col("gold")).alias("correct"))
    return calibration.risk_coverage(r, ["method"]).select("method", "claim_id", "n", F.round("accuracy", 6).alias("accuracy"))
