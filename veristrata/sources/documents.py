"""Small whole documents: configurations with a closed schema, frozen samples, reports, gold maps, bundles.

Each is read through Spark, so it may lie in any store, and is checked before anything is
built on it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import NATIVE
from ..operators import checks, schema_contract, selection
from . import schemas
from .commits import Ledger


def text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).head()[0]


def config(spark: SparkSession, path: str, schema: dict) -> dict:
    """A JSON or YAML file that keeps a contract; a schema that closes its objects makes unknown fields an error.

    YAML needs its library; without it, a file that is not JSON is an error.
    """
    said = text(spark, path)
    try:
        value = json.loads(said)
    except json.JSONDecodeError as e:
        try:
            import yaml
        except ImportError:
            raise ValueError(f"{path} is not JSON, and no YAML library is there") from e
        value = yaml.safe_load(said)
    row = spark.createDataFrame([(json.dumps(value),)], "value string")
    if wrong := row.select(schema_contract.errors(F.col("value"), schema)).head()[0]:
        raise ValueError(f"{path}: {'; '.join(wrong)}")
    return value


def frozen_sample(spark: SparkSession, path: str) -> DataFrame:
    """A sample record (one row), consistent in counts, ids and hash, or an error."""
    record = spark.read.schema(schemas.SAMPLE).option("multiLine", True).json(path)
    wrong = record.select(selection.sample_error(F.col("label_distribution")).alias("check"), F.coalesce("sample_id", F.lit(path)).alias("key"))
    checks.require_empty(wrong.filter("check is not null"))
    return record


def write_record(record: DataFrame, folder: str, name: str) -> dict:
    """Commit a record of one row as JSON; one that stands under the name already must say the same."""
    rows = record.toJSON().take(2)
    if len(rows) != 1:
        raise ValueError("a record has one row")
    value = json.loads(rows[0])
    ledger = Ledger(record.sparkSession, folder)
    if not ledger.commit(name, value) and ledger.read(name) != value:
        raise ValueError(f"another record stands at {folder}/{name}")
    return value


def report_ids(spark: SparkSession, path: str) -> DataFrame:
    """(ord, claim_id) of a stored report, by its list of ids or of claims; none, blank and repeated ids are errors."""
    v = spark.read.text(path, wholetext=True).select(F.from_json("value", "claim_ids ARRAY<STRING>, claims ARRAY<STRUCT<claim_id:STRING>>").alias("r"))
    ids = v.select(F.posexplode(F.coalesce("r.claim_ids", F.transform("r.claims", lambda c: c["claim_id"]))).alias("ord", "claim_id"))
    if not ids.head(1):
        raise ValueError(f"{path} lists no claims")
    checks.require_empty(checks.blank(ids, "claim_id").unionByName(checks.duplicates(ids, "claim_id")))
    return ids


def gold_map(spark: SparkSession, path: str) -> DataFrame:
    """(claim_id, gold) of an object id -> label; a label that is none is an error."""
    v = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("claim_id", "gold"))
    checks.require_empty(checks.failing(v, "claim_id", "not a label", ~F.coalesce(F.col("gold").isin(*NATIVE), F.lit(False))))
    return v


def bundles(spark: SparkSession, path: str, limit: int = 8) -> DataFrame:
    """(claim_id, query, corpus_hash, doc_id, rank, score) of stored bundles, one line each.

    A claim comes once, all are of one corpus, and ranks run from 1 by falling score within
    the limit; a bundle without passages has no row.
    """
    from .readers import json_lines

    b = json_lines(spark, path, schemas.BUNDLE)
    checks.require_empty(checks.blank(b, "claim_id").unionByName(checks.duplicates(b, "claim_id")).unionByName(checks.same_value(b, "corpus_hash")))
    p = b.select("claim_id", "query", "corpus_hash", F.explode("passages").alias("p")).select("claim_id", "query", "corpus_hash", "p.doc_id", "p.rank", "p.score")
    checks.require_empty(checks.ranks(p, ["claim_id"], limit))
    return p
