"""Queries over runs, stored indexes, upserted streams and record contracts, each with its SQL; registered by ``queries``.

What they store lies in folders of their own below the shared one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fingerprint, index_store, locks, methods, paced, retrieval, runs, schema_contract
from ..operators.stored import shared_folder, stored
from ..streaming import upsert
from . import views as V
from .contracts import query


def _place(spark, tag: str) -> str:
    return f"{shared_folder(spark)}/veristrata/{tag}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------------- runs


@query(
    f"""with {V.PREDS}, m as (select claim_id, cast(substr(claim_id, 9) as bigint) as k, sha256(concat_ws(chr(10), '7', claim_id, 'B1', fam, gold, '')) as s from preds)
select claim_id, case cast('0x' || substr(s, 1, 2) as bigint) % 3 when 0 then 'SUPPORT' when 1 then 'REFUTE' else 'NEI' end as label,
cast(row_number() over (order by k desc) - 1 as bigint) as place, cast((row_number() over (order by k desc) - 1) // 4096 % 2 as integer) as first_call from m"""
)
def resumed_run(spark, sf):
    """A run over all orders, latest order first: one call commits the even parts, the next call the rest."""
    p = V.preds(spark, sf)
    items = p.select("claim_id", F.substring("claim_id", 9, 20).cast("long").alias("k"), F.col("fam").alias("claim"), F.col("gold").alias("evidence")).withColumn("k", -F.col("k"))
    run = runs.plan(items, _place(spark, "run"), ["k"], 4096, "B1:7")
    work = lambda df: methods.single_judge(df, "B1", 7)
    runs.advance(run, spark, work, parts=range(0, run.parts, 2), together=256)
    first = runs.commits(run, spark).select("part", F.lit(0).alias("first_call"))
    first = spark.createDataFrame(first.collect(), first.schema)  # one short row a part, as the first call left them
    runs.advance(run, spark, work, together=256)
    asked = run.items(spark).select("claim_id", F.col("asked").alias("place"), "part").join(F.broadcast(first), "part", "left")
    return runs.results(run, spark).join(asked, "claim_id").select("claim_id", "label", "place", F.coalesce("first_call", F.lit(1)).alias("first_call"))


def _print_sql(text: str, keys: str, source: str) -> str:
    """SQL of fingerprint(): ``text`` is the row's text, ``keys`` a list with its comma."""
    pieces = " || ':' || ".join(f"cast(coalesce(sum(cast(cast('0x' || substr(h, {15 * i + 1}, 15) as bigint) as hugeint)), 0) as varchar)" for i in range(fingerprint.PIECES))
    return f"select {keys} count(*) as n, sha256(cast(count(*) as varchar) || ':' || {pieces}) as fingerprint from (select *, sha256({text}) as h from {source})"


def _field(c: str) -> str:
    return f"coalesce(length(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"


_EVENT = ", ',', ".join(_field(c) for c in ("event_id", "user_id", "event_type"))


@query(f"{_print_sql(f'concat({_EVENT})', 'event_type,', 'events')} group by event_type")
def table_fingerprints(spark, sf):
    return fingerprint.fingerprint(V.table(spark, sf, "events"), ["event_id", "user_id", "event_type"], ["event_type"])


# --------------------------------------------------------------------- index

_BUCKETS = 16
_CHANGED = "changed as (select doc_id, case when doc_id = (select min(doc_id) from documents) then coalesce(text, '') || ' zygote afterword' else text end as text from documents)"
_BUCKET = f"cast(cast('0x' || substr(sha256(cast(doc_id as varchar)), 1, 8) as bigint) % {_BUCKETS} as integer)"
_DOC = f"concat({_field('doc_id')}, ',', {_field('text')})"


def _changed(docs: DataFrame) -> DataFrame:
    first = docs.agg(F.min("doc_id").alias("_first"))
    d = docs.select("doc_id", "text").join(F.broadcast(first))
    return d.select("doc_id", F.when(F.col("doc_id") == F.col("_first"), F.concat(F.coalesce("text", F.lit("")), F.lit(" zygote afterword"))).otherwise(F.col("text")).alias("text"))


@query(
    f"""with {_CHANGED}, b as (select {_BUCKET} as bucket, * from changed), f as ({_print_sql(_DOC, 'bucket,', 'b')} group by bucket)
select bucket, n, fingerprint, bucket = (select {_BUCKET} from documents order by doc_id limit 1) as again from f"""
)
def index_reuse(spark, sf):
    """The buckets of an index after three calls: built, reused, and brought up to date after one text changed."""
    docs = V.table(spark, sf, "documents").select("doc_id", "text")
    path = _place(spark, "index")
    built = index_store.ensure(docs, path, buckets=_BUCKETS)
    if (reused := index_store.ensure(docs, path, buckets=_BUCKETS)).rebuilt or reused.version != built.version:
        raise AssertionError("an unchanged corpus was indexed again")
    new = _changed(docs)
    mended = index_store.ensure(new, path, buckets=_BUCKETS)
    return index_store.prints(new, _BUCKETS).select("bucket", "n", "fingerprint", F.col("bucket").isin(mended.rebuilt).alias("again"))


@query(f"with {_CHANGED}, {V.BM25.replace('from documents', 'from changed')} select term, df, round(idf, 6) as idf from idf")
def index_terms_after_change(spark, sf):
    """Term statistics of an index of which one bucket was written anew."""
    docs = V.table(spark, sf, "documents").select("doc_id", "text")
    path = _place(spark, "index")
    index_store.ensure(docs, path, buckets=_BUCKETS)
    return index_store.ensure(_changed(docs), path, buckets=_BUCKETS).index.idf.select("term", "df", F.round("idf", 6).alias("idf"))


# -------------------------------------------------------------------- stream


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1")
def stream_upsert(spark, sf):
    """Events arrive in files out of order; the stream stops halfway and starts again from its checkpoint."""
    key, order = ["user_id", "event_type"], ["ts", "event_id"]
    e = V.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    source, path, check = (_place(spark, t) for t in ("events", "upsert", "upsert-check"))
    stream = lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for half in (1, 0):
        e.filter(F.col("event_id") % 2 == half).repartition(3, F.col("event_id")).write.mode("append").parquet(source)
        q = upsert.start(stream(), path, key, order, check)
        q.awaitTermination()
    return upsert.table(spark, path, e.schema, key, order).select("user_id", "event_type", "event_id", "value")


# ----------------------------------------------------------------- contracts

#: A contract for documents as records: closed, nested, with patterns, ranges and a condition.
RECORD = {
    "type": "object", "required": ["id", "lang", "source", "lines"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 0}, "lang": {"type": "string", "enum": ["de", "en", "es"]}, "source": {"type": ["string", "null"], "pattern": "^src[0-9]$"},
        "lines": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["n", "chars"], "additionalProperties": False, "properties": {"n": {"type": "integer"}, "chars": {"type": "integer", "maximum": 900}}}},
        "note": {"type": "string", "minLength": 3},
    },
    "allOf": [{"if": {"properties": {"lang": {"const": "es"}}, "required": ["lang"]}, "then": {"required": ["note"]}}],
}


@query(
    """with d as (select doc_id, lang, source, doc_id % 7 as k, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x)) as c from documents),
e as (select unnest(list_concat(
  case when k = 5 then ['$: not JSON'] else list_filter([
    case when k = 0 then '$.lang: required' when lang is null then '$.lang: type' when lang not in ('de', 'en', 'es') then '$.lang: enum' end, case when k <> 0 and lang is null then '$.lang: enum' end,
    case when source is not null and not regexp_matches(source, '^src[0-9]$') then '$.source: pattern' end, case when k = 1 then '$.id: type' end, case when k = 2 then '$.extra: additionalProperties' end,
    case when k = 3 then '$.lines[].chars: required' end, case when k = 3 then '$.lines[].size: additionalProperties' end, case when k <> 3 and list_max(c) > 900 then '$.lines[].chars: maximum' end,
    case when k <> 0 and lang = 'es' and doc_id % 2 = 1 then '$.note: required' end, case when k = 4 and doc_id % 2 = 0 then '$.note: minLength' end], lambda x: x is not null) end, [])) as "check" from d)
select "check", count(*) as n from e group by 1"""
)
def record_contract(spark, sf):
    """Violations of RECORD by kind, over every document as a record; each seventh record breaks it in a way of its own."""
    k, even = F.col("doc_id") % 7, F.col("doc_id") % 2 == 0
    chars = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.length(x).cast("string"))
    line = F.transform(chars, lambda x, i: F.concat(F.lit('{"n":'), i.cast("string"), F.when(k == 3, F.lit(',"size":')).otherwise(F.lit(',"chars":')), x, F.lit("}")))
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    note = F.when(k == 4, F.lit('"x"')).otherwise(F.lit('"a note"'))
    fields = F.array(
        field("id", F.when(k == 1, quoted(F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))), F.when(k != 0, field("lang", quoted(F.col("lang")))), field("source", quoted(F.col("source"))),
        field("lines", F.concat(F.lit("["), F.array_join(line, ","), F.lit("]"))), F.when(even, field("note", note)), F.when(k == 2, F.lit('"extra":1')),
    )
    text = F.concat(F.lit("{"), F.array_join(F.array_compact(fields), ","), F.when(k == 5, F.lit("")).otherwise("}"))
    r = V.table(spark, sf, "documents").select("doc_id", text.alias("record"))
    return schema_contract.violations(r, "doc_id", "record", RECORD).groupBy("check").agg(F.count("*").alias("n"))


# ------------------------------------------------- passages and paced calls


@query(
    f"""with {V.BM25}, claims as (select 'scifact:' || cast(item_id as varchar) as claim_id, text from benchmark), q as (select claim_id, text as query from claims), {V.bm25_hits('q', 'claim_id')}
select claim_id, cast(rank as integer) as rank, case when rank = 8 then 'document is not in the index' when doc_id % 5 = 0 then 'text is not what was indexed' end as error from hits where rank <= 8"""
)
def passage_integrity(spark, sf):
    """Top passages against the index: one in five texts was changed after indexing, the last document is unknown."""
    docs = V.table(spark, sf, "documents").select("doc_id", "text")
    path = _place(spark, "index")
    index = index_store.ensure(docs, path, buckets=_BUCKETS).index
    hits = stored(retrieval.search(V.claims(spark, sf).withColumnRenamed("text", "query"), index, ["claim_id"], 8), "integrity-hits")
    p = hits.join(docs, "doc_id").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    p = p.withColumn("doc_id", F.when(F.col("rank") == 8, -1 - F.col("doc_id")).otherwise(F.col("doc_id")))
    return index_store.checked(p.select("claim_id", "rank", "doc_id", "text"), path).select("claim_id", "rank", "error")


def _shaky():
    """Answers by the prompt's hash; every third kind is busy once, every seventh refuses."""
    import hashlib

    seen: set[str] = set()

    def ask(prompt: str) -> str:
        byte = hashlib.sha256(prompt.encode()).digest()[0]
        if byte % 7 == 0:
            raise paced.TransportError(400)
        if byte % 3 == 0 and prompt not in seen:
            seen.add(prompt)
            raise paced.TransportError(503)
        return str(byte)

    return ask


@query(
    """with b as (select o_orderkey, cast('0x' || substr(sha256('order ' || o_orderkey), 1, 2) as bigint) as b from orders)
select o_orderkey, case when b % 7 = 0 then 'failed' else 'ok' end as execution_status, cast(case when b % 7 > 0 and b % 3 = 0 then 2 else 1 end as integer) as attempts, case when b % 7 = 0 then 'TransportError: HTTP 400' else cast(b as varchar) end as reply from b"""
)
def paced_calls(spark, sf):
    items = V.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("prompt"))
    pace = paced.Pace(per_second=1_000_000, tasks=8, in_flight=1, backoff=0.0)
    return paced.stage(items, _shaky, pace).select("o_orderkey", "execution_status", "attempts", "reply")


# -------------------------------------------------------------------- freezes

_FROZEN = {"labels": ("doc_id", "quality", "toxic"), "benchmark": ("item_id", "text"), "events": ("event_id", "user_id", "event_type"), "conversations": ("conv_id", "turn", "role", "text")}
_ROW = lambda columns: "concat(" + ", ',', ".join(map(_field, columns)) + ")"
_FREEZE_SQL = " union all ".join(f"select '{name}' as name, * from ({_print_sql(_ROW(columns), '', name)})" for name, columns in _FROZEN.items())


@query(f"with f as ({_FREEZE_SQL}) select name, n as frozen_n, fingerprint as frozen_fingerprint, case when name = 'labels' then n - 1 else n end as n, name <> 'labels' as ok from f")
def frozen_tables(spark, sf):
    """Four tables frozen, then looked at again when one of them has lost its first row."""
    path = _place(spark, "freeze")
    tables = {name: (V.table(spark, sf, name), list(columns)) for name, columns in _FROZEN.items()}
    locks.freeze(spark, path, tables)
    labels = tables["labels"][0]
    first = labels.agg(F.min("doc_id").alias("_first"))
    tables["labels"] = (labels.join(F.broadcast(first), F.col("doc_id") > F.col("_first")), tables["labels"][1])
    return locks.compared(spark, path, tables).select("name", "frozen_n", "frozen_fingerprint", "n", "ok")
