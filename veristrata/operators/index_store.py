"""A stored BM25 index that knows the corpus it was built from, and re-indexes only what changed.

Documents fall into buckets by a hash of their id, and each is one row: its length, its
terms with their frequencies, and the hash of its text.  A version of the index is one
commit record: the fingerprint and the folder of every bucket, and the folder of the term
statistics.  ``ensure`` compares the corpus's fingerprints with those of the latest
version: equal means reuse without reading a posting, else the changed buckets alone are
tokenized and written, and a new version names the old folders of all others.  A version
appears whole or not at all, and older ones stay readable until ``prune``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import Ledger, numbered
from . import checks, fingerprint, retrieval
from .stored import stored

_ROWS = "doc_id long, dl long, terms array<string>, tfs array<long>"
_HASHES = "doc_id long, sha256 string"


@dataclass(frozen=True)
class Stored:
    index: retrieval.Index
    version: int
    fingerprint: str
    rebuilt: list[int]


class CorpusChanged(ValueError):
    """The stored index belongs to another corpus or configuration."""


def prints(docs: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """(bucket, n, fingerprint) of the documents, in any order of rows and files."""
    return fingerprint.fingerprint(docs, ["doc_id", text], [fingerprint.bucket(F.col("doc_id"), buckets)]).withColumnRenamed("_k0", "bucket")


def _read(spark: SparkSession, path: str, record: dict) -> retrieval.Index:
    rows = _rows(spark, path, record["parts"])
    terms = spark.read.schema("term string, df long, idf double").parquet(f"{path}/{record['terms']}")
    n, total = record["n_docs"], record["n_tokens"]
    stats = spark.createDataFrame([(n, total / n if n else None)], "n_docs long, avgdl double")
    return retrieval.Index(retrieval.from_counted(rows), terms, stats, counted=rows)


def _rows(spark: SparkSession, path: str, parts: dict) -> DataFrame:
    folders = [f"{path}/{p['folder']}/bucket={k}" for k, p in parts.items()]
    return spark.read.schema(_ROWS).parquet(*folders) if folders else spark.createDataFrame([], _ROWS)


def ensure(docs: DataFrame, path: str, text: str = "text", buckets: int = 64, config: retrieval.Bm25 = retrieval.Bm25(), refuse: bool = False) -> Stored:
    """The index of ``docs`` (doc_id unique) at ``path``: reused, brought up to date, or made.

    With ``refuse``, a stored index of another corpus or configuration is an error instead.
    """
    spark = docs.sparkSession
    ledger = Ledger(spark, path)
    now = {str(r["bucket"]): r for r in prints(docs, buckets, text).collect()}  # one row a bucket
    said = {**asdict(config), "buckets": buckets, "text": text, "rows": "documents"}
    version, record = ledger.latest("index-")
    old = record["parts"] if record and record["config"] == said else {}
    if record and refuse and (not old or {k: p["fingerprint"] for k, p in old.items()} != {k: r["fingerprint"] for k, r in now.items()}):
        raise CorpusChanged(f"the index at {path} was built from another corpus or configuration")
    changed = sorted(int(k) for k, r in now.items() if k not in old or old[k]["fingerprint"] != r["fingerprint"])
    if record and old and not changed and old.keys() == now.keys():
        return Stored(_read(spark, ledger.path, record), version, record["fingerprint"], [])
    parts = {k: old[k] for k in now if int(k) not in set(changed)}
    folder = f"postings-{uuid.uuid4().hex}"
    if changed:
        mine = docs.select("doc_id", F.col(text).alias("text"), _sha(F.col(text)).alias("sha256"), fingerprint.bucket(F.col("doc_id"), buckets).alias("bucket"))
        rows = retrieval.counted(mine.filter(F.col("bucket").isin(changed)), ["sha256", "bucket"])
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{ledger.path}/{folder}")  # few files a bucket, large ones split
        back = spark.read.schema("dl long, bucket int").parquet(f"{ledger.path}/{folder}")
        tokens = {str(r["bucket"]): r["t"] for r in back.groupBy("bucket").agg(F.sum("dl").alias("t")).collect()}
        for k in map(str, changed):
            parts[k] = {"n": now[k]["n"], "fingerprint": now[k]["fingerprint"], "tokens": tokens[k], "folder": folder}
    whole = spark.createDataFrame([(int(k), p["n"], p["fingerprint"]) for k, p in parts.items()], "bucket int, n long, fingerprint string")
    new = {
        "config": said, "parts": parts, "terms": f"terms-{uuid.uuid4().hex}", "n_docs": sum(p["n"] for p in parts.values()), "n_tokens": sum(p["tokens"] for p in parts.values()),
        "fingerprint": fingerprint.of(whole, ["bucket", "n", "fingerprint"])[1],
    }
    terms = _rows(spark, ledger.path, parts).select(F.explode("terms").alias("term"))
    stats = spark.createDataFrame([(new["n_docs"],)], "n_docs long")
    retrieval.idf(terms, stats, config.epsilon).sortWithinPartitions("term").write.parquet(f"{ledger.path}/{new['terms']}")
    if not ledger.commit(numbered("index-", version + 1), new):
        for lost in (folder, new["terms"]):
            ledger.delete(lost)
        return ensure(docs, path, text, buckets, config, refuse)  # another writer was first
    return Stored(_read(spark, ledger.path, new), version + 1, new["fingerprint"], changed)


def _sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def text_hashes(spark: SparkSession, path: str, only: Sequence[int] | None = None) -> DataFrame:
    """(doc_id, sha256) of the texts as the latest version indexed them, of some buckets or all."""
    ledger = Ledger(spark, path)
    parts = ledger.latest("index-")[1]["parts"]
    folders = [f"{ledger.path}/{p['folder']}/bucket={k}" for k, p in parts.items() if only is None or int(k) in set(only)]
    return spark.read.schema(_HASHES).parquet(*folders) if folders else spark.createDataFrame([], _HASHES)


def checked(passages: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Passages (doc_id, text as it was read, ...) with ``error``: null where the index was built from that very text.

    Only the buckets that were hit are read, and of those the hashes alone.
    """
    spark = passages.sparkSession
    record = Ledger(spark, path).latest("index-")[1]
    if record is None:
        raise CorpusChanged(f"no index at {path}")
    at = fingerprint.bucket(F.col("doc_id"), record["config"]["buckets"])
    ids = stored(passages.select("doc_id").distinct(), "passage-ids")
    hit = [r["b"] for r in ids.select(at.alias("b")).distinct().collect()]  # at most one a bucket
    h = text_hashes(spark, path, hit).withColumnRenamed("sha256", "_sha256").join(ids, "doc_id", "left_semi")
    j = passages.join(h, "doc_id", "left")
    error = F.when(F.col("_sha256").isNull(), "document is not in the index").when(F.col("_sha256") != _sha(F.col(text)), "text is not what was indexed")
    return j.select(*passages.columns, error.alias("error"))


def write_bundles(passages: DataFrame, path: str, index: str, limit: int = 8, buckets: int = 64) -> DataFrame:
    """Store the bundles of claims whose passages all pass, by claim bucket; (check, key) of what did not.

    ``passages``: claim_id, doc_id, rank, score, text.  A passage must be what was indexed,
    and a claim's ranks must run from 1 without gaps, by falling score, within the limit.
    """
    c = stored(checked(passages, index), "bundle-passages")
    wrong = checks.failing(c, "claim_id", "passage", F.col("error").isNotNull()).unionByName(checks.ranks(c, ["claim_id"], limit)).distinct()
    wrong = stored(wrong, "bundle-faults")
    good = c.join(wrong.select(F.col("key").alias("claim_id")).distinct(), "claim_id", "left_anti").drop("error")
    good.withColumn("bucket", fingerprint.bucket(F.col("claim_id"), buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
    return wrong


def read_bundles(spark: SparkSession, path: str, schema, claims: Sequence[str] | None = None, buckets: int = 64) -> DataFrame:
    """Stored passages, of the buckets of some claims or all."""
    df = spark.read.schema(f"{schema}, bucket int").parquet(path)
    if claims is not None:
        ids = spark.createDataFrame([(c,) for c in claims], "claim_id string")
        at = sorted({r["b"] for r in ids.select(fingerprint.bucket(F.col("claim_id"), buckets).alias("b")).collect()})
        df = df.filter(F.col("bucket").isin(at)).join(F.broadcast(ids), "claim_id", "left_semi")
    return df.drop("bucket")


def prune(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete the folders that only versions before the last ``keep`` name; their names."""
    ledger = Ledger(spark, path)
    names = ledger.names("index-")
    records = {n: ledger.read(n) for n in names}
    of = lambda r: {r["terms"], *(p[c] for p in r["parts"].values() for c in ("folder", "texts") if c in p)} - {""}
    alive = set().union(*[of(records[n]) for n in names[-keep:]]) if names else set()
    gone = sorted(set().union(*[of(r) for r in records.values()], set()) - alive)
    for name in names[:-keep]:
        ledger.delete(name)
    for folder in gone:
        ledger.delete(folder)
    return gone
