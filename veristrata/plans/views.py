"""Views over the driver's tables that stand in for claims, predictions and run logs."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def h(text: Column) -> Column:
    """First 32 bits of an md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, fam, gold, b2, v, ok, conf, d0, d1 (four-way), from ``orders``."""
    k = F.col("o_orderkey").cast("string")
    o = table(spark, sf_dir, "orders").select(
        k.alias("k"), F.col("o_custkey").cast("string").alias("c"),
        F.when(F.col("o_orderstatus") == "F", "SUPPORT").when(F.col("o_orderstatus") == "O", "REFUTE").otherwise("NEI").alias("gold"),
        *[h(F.concat(F.lit(p), k)).alias(n) for p, n in (("B2:", "h1"), ("V:", "h2"), ("S:", "h3"), ("D0:", "h4"), ("D1:", "h5"))],
    )
    four = lambda c: F.element_at(F.array(*[F.lit(x) for x in ("supported", "contradicted", "unaddressed", "underdetermined")]), (F.col(c) % 4 + 1).cast("int"))
    return o.select(
        F.concat(F.lit("scifact:"), "k").alias("claim_id"), F.concat(F.lit("cited:"), "c").alias("fam"), "gold",
        F.when(F.col("h1") % 10 < 7, F.col("gold")).when(F.col("h1") % 3 == 0, "SUPPORT").when(F.col("h1") % 3 == 1, "REFUTE").otherwise("NEI").alias("b2"),
        F.when(F.col("h2") % 10 < 6, F.col("gold")).when(F.col("h2") % 5 == 0, "SUPPORT").otherwise("NEI").alias("v"),
        (F.col("h3") % 20 != 0).alias("ok"), ((F.col("h1") % 101).cast("double") / 100.0).alias("conf"), four("h4").alias("d0"), four("h5").alias("d1"),
    )


def _h(text: str) -> str:
    return f"cast(('0x' || substr(md5({text}), 1, 8)) as bigint)"


def _four(c: str) -> str:
    return f"case {c} % 4 when 0 then 'supported' when 1 then 'contradicted' when 2 then 'unaddressed' else 'underdetermined' end"


PREDS = f"""orders_h as (select cast(o_orderkey as varchar) as k, cast(o_custkey as varchar) as c,
  case o_orderstatus when 'F' then 'SUPPORT' when 'O' then 'REFUTE' else 'NEI' end as gold, {_h("'B2:' || cast(o_orderkey as varchar)")} as h1,
  {_h("'V:' || cast(o_orderkey as varchar)")} as h2, {_h("'S:' || cast(o_orderkey as varchar)")} as h3,
  {_h("'D0:' || cast(o_orderkey as varchar)")} as h4, {_h("'D1:' || cast(o_orderkey as varchar)")} as h5 from orders),
preds as (select 'scifact:' || k as claim_id, 'cited:' || c as fam, gold,
  case when h1 % 10 < 7 then gold when h1 % 3 = 0 then 'SUPPORT' when h1 % 3 = 1 then 'REFUTE' else 'NEI' end as b2,
  case when h2 % 10 < 6 then gold when h2 % 5 = 0 then 'SUPPORT' else 'NEI' end as v, h3 % 20 <> 0 as ok,
  cast(h1 % 101 as double) / 100.0 as conf, {_four("h4")} as d0, {_four("h5")} as d1 from orders_h)"""


def votes(p: DataFrame, seeds: int = 5, more: Sequence[str] = ()) -> DataFrame:
    """(claim_id, seed_ord, label, status): hashed runs of one method over several seeds; ``more`` columns of ``p`` beside them."""
    e = p.select("claim_id", "gold", F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("seed_ord"))
    x = h(F.concat(F.lit("seed:"), F.col("seed_ord").cast("string"), F.lit(":"), F.col("claim_id")))
    label = F.when(x % 10 < 5, F.col("gold")).when(x % 3 == 0, "SUPPORT").when(x % 3 == 1, "REFUTE").otherwise("NEI")
    return e.select("claim_id", "seed_ord", label.alias("label"), F.when(x % 40 == 7, "failed").otherwise("ok").alias("status"), *more)


VOTES = f"""vh as (select claim_id, gold, s as seed_ord, {_h("'seed:' || cast(s as varchar) || ':' || claim_id")} as x from preds, range(1, 6) t(s)),
votes as (select claim_id, seed_ord, case when x % 10 < 5 then gold when x % 3 = 0 then 'SUPPORT' when x % 3 = 1 then 'REFUTE' else 'NEI' end as label,
  case when x % 40 = 7 then 'failed' else 'ok' end as status from vh)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as retrieval queries."""
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("scifact:"), F.col("item_id").cast("string")).alias("claim_id"), "text")


#: Passages and words that are sent to every task; a benchmark beyond them is joined by shuffle.
FEW_PASSAGES, FEW_WORDS = 20_000, 1_000_000


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def _inner(passage: str) -> list[str]:
    """The words that white space bounds wherever the passage stands."""
    return _SPACE.split(passage)[1:-1]


def _holds(shared):
    """(doc_id, text) -> (claim_id, doc_id) of the passages a text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, short = shared.value
        words = by.keys()
        for batch in batches:
            found, docs = [], []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = words & set(_SPACE.split(text))
                mine = [c for w in own for c, passage in by[w] if passage in text] + [c for c, passage in short if passage in text]
                found += mine
                docs += [doc] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(docs, batch.schema.field(0).type)], names=["claim_id", "doc_id"])

    return run


def gold_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(claim_id, doc_id): documents that hold a benchmark passage word for word.

    Up to FEW_PASSAGES passages go to every task, under one inner word each: the texts are
    read once and do not move, and containment is tested where that word occurs.
    """
    b = claims(spark, sf_dir).filter("claim_id is not null and text is not null")
    rows = b.limit(FEW_PASSAGES + 1).collect()
    if len(rows) > FEW_PASSAGES:
        return many_gold_docs(spark, sf_dir)
    by: dict[str, list] = {}
    short = []
    for claim, passage in rows:
        inner = _inner(passage)
        (by.setdefault(max(inner, key=len), []) if inner else short).append((claim, passage))
    d = table(spark, sf_dir, "documents").select("doc_id", "text").filter("text is not null")
    schema = StructType([StructField("claim_id", StringType()), d.schema["doc_id"]])
    return d.mapInArrow(_holds(spark.sparkContext.broadcast((by, short))), schema).distinct()


def many_gold_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gold_docs() of any number of passages.

    White space bounds the inner words of a passage wherever it stands.  A first pass
    counts, over all documents, those words only; a passage is looked up by its rarest
    one, and the containment test runs on the documents that have it.  A passage without an
    inner word is tested against every document.
    """
    b = claims(spark, sf_dir).withColumnRenamed("text", "passage").withColumn("w", F.split("passage", r"\s+"))
    inner = b.select("claim_id", "passage", F.array_distinct(F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0)))).alias("inner"))
    long, short = inner.filter(F.size("inner") > 0), inner.filter(F.size("inner") == 0).select("claim_id", "passage")
    words = long.select("claim_id", "passage", F.explode("inner").alias("word"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = d.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    df = own.join(_small(words.select("word").distinct(), FEW_WORDS), "word").groupBy("word").agg(F.count("*").alias("df"))
    key = words.join(df, "word").groupBy("claim_id", "passage").agg(F.min_by("word", F.struct("df", "word")).alias("word"))
    cand = own.join(_small(key, FEW_PASSAGES), "word").select("claim_id", "passage", "doc_id")
    found = cand.join(d, "doc_id").filter(F.contains("text", "passage")).select("claim_id", "doc_id")
    if short.head(1):
        found = found.unionByName(d.join(_small(short, FEW_PASSAGES), F.contains("text", "passage")).select("claim_id", "doc_id"))
    return found.distinct()


BM25 = r"""tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents),
post as (select doc_id, term, count(*) as tf from tok group by all),
dls as (select doc_id, cast(coalesce(len(regexp_extract_all(lower(text), '[a-z0-9]+')), 0) as bigint) as dl from documents),
st as (select count(*) as n_docs, avg(dl) as avgdl from dls),
dfs as (select term, count(*) as df from post group by term),
raw as (select term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) as raw from dfs, st),
idf as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw)"""


def bm25_hits(queries: str, keys: str) -> str:
    """CTEs that rank documents for ``queries(keys, query)``."""
    return f"""qt as (select {keys}, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) as term from {queries}),
sc as (select {keys}, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) as score
  from qt join idf using (term) join post using (term) join dls using (doc_id), st group by {keys}, doc_id),
hits as (select * from (select *, row_number() over (partition by {keys} order by score desc, doc_id) as rank from sc) where rank <= 20 and score > 0)"""
