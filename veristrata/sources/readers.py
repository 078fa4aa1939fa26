"""Typed sources: JSON lines, manifests, locked splits, checkpoints, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.labels import uniform_claim_label
from ..operators import checks, fingerprint
from . import schemas


def json_lines(spark: SparkSession, path: str, ddl: str, strict: bool = True) -> DataFrame:
    """One typed record a line; blank lines are skipped, bad lines are an error (or ``_bad``)."""
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    lines = spark.read.text(path).filter(F.trim("value") != "")
    df = lines.select(F.from_json("value", f"{ddl}, _bad STRING", how).alias("r")).select("r.*")
    if not strict:
        return df
    bad = F.raise_error(F.concat(F.lit(f"bad JSON line in {path}: "), F.substring("_bad", 1, 80))).cast("boolean")
    # a predicate: whatever columns are asked for, every line is checked
    return df.filter(F.when(F.col("_bad").isNotNull(), bad).otherwise(F.lit(True))).drop("_bad")


def json_object(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, role, locked)."""
    m = json_object(spark, path, schemas.MANIFEST.replace("ids ARRAY<BIGINT>", "ids ARRAY<STRING>"))
    odd = F.raise_error(F.concat(F.lit(f"{path}: not a whole number: "), F.coalesce("_id", F.lit("null")))).cast("bigint")
    whole = F.when(F.col("_id").rlike(r"^-?\d+$"), F.col("_id").try_cast("bigint"))
    return m.select(F.posexplode("ids").alias("ord", "_id"), "role", "locked").select("ord", F.coalesce(whole, odd).alias("id"), "role", "locked")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    df = json_lines(spark, path, schemas.CORPUS)
    checks.require_empty(checks.duplicates(df, "doc_id"))
    return df


def native_claims(spark: SparkSession, path: str) -> DataFrame:
    df = json_lines(spark, path, schemas.NATIVE_CLAIM)
    checks.require_empty(checks.duplicates(df, "id"))
    return df


def claim_texts(spark: SparkSession, path: str) -> DataFrame:
    """Only id and claim: columns of gold are never read."""
    return json_lines(spark, path, "id BIGINT, claim STRING").select(T.claim_id(F.col("id")).alias("claim_id"), F.col("claim").alias("text"))


def split(ids: DataFrame, claims: DataFrame, docs: DataFrame, role: str) -> dict[str, DataFrame]:
    """A locked split in manifest order as three tables: same_evidence, gold_evidence, gold_labels."""
    wrong = ids.filter((F.col("role") != role) | ~F.coalesce("locked", F.lit(False))).limit(1)
    checks.require_empty(wrong.select(F.lit(f"manifest is not the locked {role} split").alias("check"), F.col("id").cast("string").alias("key")))
    checks.require_empty(checks.missing(ids, claims, "id"))
    c = ids.select("ord", "id").join(claims, "id").withColumn("claim_id", T.claim_id(F.col("id")))
    checks.require_empty(checks.failing(c, "claim_id", "no citations", F.coalesce(F.size("cited_doc_ids"), F.lit(0)) < 1))
    cited = c.select("ord", "claim_id", F.posexplode("cited_doc_ids").alias("doc_ord", "doc_id"))
    checks.require_empty(checks.missing(cited, docs, "doc_id"))
    same = cited.join(docs, "doc_id").withColumn("text", T.abstract_text(F.col("abstract")))
    e = c.select("ord", "claim_id", "cited_doc_ids", F.explode("evidence").alias("d", "rationales"))
    e = e.select("ord", "claim_id", "cited_doc_ids", F.col("d").cast("bigint").alias("doc_id"), F.posexplode("rationales").alias("rationale", "r"))
    outside = e.filter(~F.array_contains("cited_doc_ids", F.col("doc_id")))
    checks.require_empty(checks.failing(outside, "claim_id", "evidence outside the citations", F.lit(True)))
    g = e.join(docs, "doc_id")
    span = T.sentence_spans(F.col("abstract"))
    picked = F.transform("r.sentences", lambda i: F.coalesce(F.get("abstract", i), F.raise_error(F.lit("sentence index out of range")).cast("string")))
    g = g.select(
        "ord", "claim_id", "doc_id", "rationale", "r.label", F.array_join(picked, " ").alias("text_span"),
        F.array_min(F.transform("r.sentences", lambda i: F.get(span, i)["start"])).alias("start"),
        F.array_max(F.transform("r.sentences", lambda i: F.get(span, i)["end"])).alias("end"),
    )
    labels = F.flatten(F.transform(F.map_values("evidence"), lambda rs: F.transform(rs, lambda x: x["label"])))
    gold = c.select("ord", "claim_id", uniform_claim_label(F.coalesce(labels, F.array().cast("array<string>"))).alias("gold"))
    return {"same_evidence": same.orderBy("ord", "doc_ord"), "gold_evidence": g.orderBy("ord", "doc_id", "rationale"), "gold_labels": gold.orderBy("ord")}


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """At least one row; claim ids unique and not blank."""
    df = json_lines(spark, path, schemas.PREDICTION)
    if not df.head(1):
        raise ValueError(f"no prediction rows in {path}")
    checks.require_empty(checks.blank(df, "claim_id").unionByName(checks.duplicates(df, "claim_id")))
    return df


def optional_predictions(spark: SparkSession, path: str | None) -> tuple[str, DataFrame]:
    """('pending', empty) without a path or for an empty file; a missing file is an error."""
    if path is None:
        return "pending", spark.createDataFrame([], schemas.PREDICTION)
    df = json_lines(spark, path, schemas.PREDICTION)
    return ("scored" if df.head(1) else "pending"), df


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Stored rows, the last line of a claim winning (by file and position in it)."""
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("line"))
    raw = spark.read.text(path).select(F.col("value"), at.alias("at"))  # a block is read by one task, in its order
    rows = raw.filter(F.trim("value") != "").select("at", F.from_json("value", schemas.PREDICTION).alias("r"))
    return rows.groupBy("r.claim_id").agg(F.max_by("r", "at").alias("row")).select("row.*")


def registry(spark: SparkSession, entries: list[tuple[str, str, str, str]]) -> DataFrame:
    """(family, split, condition, path) of many runs read as one scan, joined on the whole path; runs without a file are skipped."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = []
    for family, split_name, condition, path in entries:
        p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/predictions.jsonl")
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            there.append((family, split_name, condition, fs.makeQualified(p).toString()))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    table = spark.createDataFrame(there, "family string, split string, condition string, _path string").withColumn("_path", plain("_path"))
    if not there:
        return spark.createDataFrame([], schemas.PREDICTION).join(table.drop("_path"))
    rows = spark.read.schema(schemas.PREDICTION).json([p for *_, p in there]).select("*", plain(F.col("_metadata.file_path")).alias("_path"))
    return rows.join(F.broadcast(table), "_path").drop("_path")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def file_prints(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_records, fingerprint) of line files: records counted and hashed line by line, so that a file may be of any size.

    Blank lines are no records; the fingerprint does not depend on the order of lines.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").filter(F.trim("value") != "")
    return fingerprint.fingerprint(lines, ["value"], ["path"]).withColumnRenamed("n", "n_records")


def gold_join(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """A row's own gold label, else the split's; neither is an error."""
    j = rows.join(gold.select("claim_id", F.col("gold").alias("_g")), "claim_id", "left")
    own = F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in ("label_gold", "gold_label", "gold") if c in rows.columns], F.lit(None).cast("string"))
    lost = F.raise_error(F.concat(F.lit("no gold label for "), F.col("claim_id"))).cast("string")
    return j.withColumn("joined_gold", F.coalesce(own, "_g", lost)).drop("_g")
