"""Which claims a run covers: id lists, frozen samples, run ids, joins with gold, completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import schemas
from . import checks

#: Roles of a split; those without gold; labels of a distribution.
ROLES = ("development", "calibration", "held_out_local_eval", "official_test_unlabeled")
NO_GOLD = ("official_test_unlabeled",)
DISTRIBUTION = ("SUPPORT", "CONTRADICT", "NEI")


def ids_of(text: str) -> list[str]:
    """A comma-separated id list; an empty one or an empty id is an error."""
    parts = [p.strip() for p in text.split(",")]
    if not text.strip() or "" in parts:
        raise ValueError(f"empty id in {text!r}")
    return parts


def requested(
    spark: SparkSession, manifest: DataFrame, ids: str | Sequence[str] | None = None, sample: DataFrame | None = None, limit: int | None = None, default: int = 5
) -> DataFrame:
    """(ord, claim_id) asked for: a list, a frozen sample, or else the first of the manifest; only one source, no id twice."""
    if limit is not None and (isinstance(limit, bool) or limit < 1):
        raise ValueError("the limit must be a positive number")
    if ids is not None and sample is not None:
        raise ValueError("give a list of ids or a sample, not both")
    if ids is not None:
        listed = ids_of(ids) if isinstance(ids, str) else list(ids)
        if len(listed) != len(set(listed)) or not listed:
            raise ValueError("ids are empty or come twice")
        out = spark.createDataFrame(list(enumerate(listed)), "ord int, claim_id string")
    elif sample is not None:
        out = sample.select(F.posexplode("claim_ids").alias("ord", "claim_id"))
    else:
        out = manifest.select("ord", T.claim_id(F.col("id")).alias("claim_id"))
        limit = limit or default
    return out if limit is None else out.filter(F.col("ord") < limit)


def in_order(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the ids asked for, with ``ord``; an id without a row is an error."""
    lost = F.raise_error(F.concat(F.lit("unknown claim: "), F.col("claim_id"))).cast("int")
    j = ids.join(rows.withColumn("_in", F.lit(True)), "claim_id", "left")
    return j.withColumn("ord", F.when(F.col("_in"), F.col("ord")).otherwise(lost)).drop("_in")


def zipped(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of equal ``ord`` side by side; different lengths are an error."""
    lost = F.raise_error(F.concat(F.lit("no partner for row "), F.col("ord").cast("string"))).cast("boolean")
    j = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), "ord", "full")
    return j.filter(F.when(F.col("_a").isNull() | F.col("_b").isNull(), lost).otherwise(F.lit(True))).drop("_a", "_b")


def sample_record(ids: DataFrame, keys: list[str], role: Column, seed: int, source: str) -> DataFrame:
    """(keys, ord, native_id) -> one locked record a key: ids in order, their count and hash."""
    g = ids.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", "native_id"))).alias("_i"))
    native = F.transform("_i", lambda x: x["native_id"])
    return g.select(
        *keys, role.alias("split_role"), F.lit(seed).alias("seed"), F.size("_i").alias("n_ids"), T.ids_sha256(native).alias("ids_sha256"),
        F.transform(native, lambda x: T.claim_id(x)).alias("claim_ids"), native.alias("native_ids"), F.lit(source).alias("source_manifest"),
    )


def sample_error(distribution: Column | None = None) -> Column:
    """Why a sample record is not consistent, or null."""
    ids, native = F.col("claim_ids"), F.col("native_ids")
    wrong = (
        F.when(~F.coalesce(F.col("split_role").isin(*ROLES), F.lit(False)), "unknown role")
        .when((F.col("n_ids") != F.size(ids)) | (F.col("n_ids") != F.size(native)), "n_ids and lists disagree")
        .when((F.size(F.array_distinct(ids)) != F.size(ids)) | (F.size(F.array_distinct(native)) != F.size(native)), "ids come twice")
        .when(F.transform(native, lambda x: T.claim_id(x)) != ids, "claim ids do not follow native ids")
        .when(T.ids_sha256(native) != F.col("ids_sha256"), "hash does not match")
    )
    if distribution is not None:
        total = F.aggregate(F.map_values(distribution), F.lit(0).cast("bigint"), lambda a, x: a + x)
        wrong = wrong.when(F.size(F.array_except(F.map_keys(distribution), F.array(*[F.lit(x) for x in DISTRIBUTION]))) > 0, "unknown label in the distribution")
        wrong = wrong.when(F.exists(F.map_values(distribution), lambda x: x < 0) | (total != F.col("n_ids")), "distribution does not add up")
    return wrong


def run_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """One row (run_id, split, corpus_hash) of a run's record; a file that is no JSON object is an error."""
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.RUN).alias("s"), F.col("value").alias("v"))
    bad = F.raise_error(F.lit(f"{path}: not a JSON object")).cast("boolean")
    d = d.filter(F.when(~F.coalesce(F.trim("v").startswith("{"), F.lit(False)) | F.col("s").isNull(), bad).otherwise(F.lit(True)))
    named = lambda c: F.when(F.trim(c) != "", c)
    return d.select(F.coalesce(named(F.col("s.run.run_id")), named(F.col("s.run_id"))).alias("run_id"), F.col("s.run.split").alias("split"), F.col("s.run.corpus_hash").alias("corpus_hash"))


def run_ids(rows: DataFrame, keys: list[str], given: Column, sidecar: Column) -> DataFrame:
    """Per key the run id: one that is given, else the sidecar's, else the only one of the rows; ``error`` says why there is none."""
    named = lambda c: F.when(F.trim(c) != "", c)
    own = F.collect_set(named(F.col("run_id")))
    g = rows.groupBy(*keys).agg(F.max(F.trim(named(given))).alias("_g"), F.max(named(sidecar)).alias("_s"), own.alias("_o"))
    only = F.when(F.size("_o") == 1, F.get("_o", F.lit(0)))
    found = F.coalesce("_g", "_s", only)
    error = F.when(found.isNull() & (F.size("_o") > 1), "several run ids").when(found.isNull(), "no run id")
    return g.select(*keys, found.alias("run_id"), error.alias("error"))


def with_gold(rows: DataFrame, gold: DataFrame, split: str, sidecar: dict | None = None, corpus_hash: str | None = None) -> DataFrame:
    """Rows with ``label_gold`` and ``gold_source``: a row's own gold stays, else the split's, else an error.

    A split without gold, and a sidecar of another split or corpus, are refused.
    """
    if split in NO_GOLD or split not in ROLES:
        raise ValueError(f"{split} has no gold labels")
    for name, want in (("split", split), ("corpus_hash", corpus_hash)):
        if sidecar and want is not None and sidecar.get(name) not in (None, want):
            raise ValueError(f"the sidecar's {name} is not {want!r}")
    j = rows.join(gold.select("claim_id", F.col("gold").alias("_g")), "claim_id", "left")
    own = F.when(F.trim("label_gold") != "", F.col("label_gold"))
    lost = F.raise_error(F.concat(F.lit("no gold label for "), F.col("claim_id"))).cast("string")
    source = F.when(own.isNotNull(), "prediction_row").otherwise("split")
    return j.withColumn("gold_source", source).withColumn("label_gold", F.coalesce(own, "_g", lost)).drop("_g")


def with_report_gold(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """Synthetic gold: a row that ran must have one, a failed row may miss it."""
    j = rows.join(gold.select("claim_id", F.col("gold").alias("_g")), "claim_id", "left")
    lost = F.raise_error(F.concat(F.lit("no gold label for "), F.col("claim_id"))).cast("string")
    return j.withColumn("label_gold", F.when(F.col("_g").isNull() & (F.coalesce("execution_status", F.lit("ok")) == "ok"), lost).otherwise(F.col("_g"))).drop("_g")


def arm_ids(rows: DataFrame) -> DataFrame:
    """Claim ids of one arm; none, a blank or a repeated one is an error."""
    if not rows.head(1):
        raise ValueError("the arm has no rows")
    checks.require_empty(checks.blank(rows, "claim_id").unionByName(checks.duplicates(rows, "claim_id")))
    return rows.select("claim_id").orderBy("claim_id")


def completeness(runs: DataFrame, keys: list[str], wanted: int) -> DataFrame:
    """Per run: rows, rows that ran, and whether it is complete (all there, all ran)."""
    ok = F.coalesce("execution_status", F.lit("ok")) == "ok"
    g = runs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"))
    return g.withColumn("complete", (F.col("n") >= wanted) & (F.col("n") == F.col("n_ok")))


def nei_eligible(evidence: Column) -> Column:
    """No cited document has a rationale."""
    return F.forall(F.coalesce(evidence, F.array().cast("array<struct<doc_id:bigint,rationales:int>>")), lambda d: F.coalesce(d["rationales"], F.lit(0)) == 0)


def corpus_lock(pins: DataFrame) -> DataFrame:
    """(name, file_hash, config_hash, contract_hash) of corpora -> those whose hashes are not one, as check rows."""
    one = (F.col("file_hash") == F.col("config_hash")) & (F.col("file_hash") == F.col("contract_hash"))
    return checks.failing(pins, "name", "corpus hashes disagree", ~F.coalesce(one, F.lit(False)))
