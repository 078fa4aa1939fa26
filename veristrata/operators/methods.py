"""Prediction methods: offline twins, voting, derived runs, and a pluggable model stage."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.labels import NATIVE, execution_ok, four_way_to_native


def native_at(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in NATIVE]), (index + 1).cast("int"))


def hash_label(material: Column) -> Column:
    """Deterministic label: the first byte of a SHA-256, modulo the labels."""
    return native_at(T.hash_bucket(material) % len(NATIVE))


def hash_confidence(material: Column) -> Column:
    return (T.hash_bucket(material, 3) % 100) / F.lit(100.0)


def material(seed: int, adaptation: str, prompt: str = "") -> Column:
    parts = [F.lit(str(seed)), F.col("claim_id"), F.lit(adaptation), F.col("claim"), F.coalesce("evidence", F.lit("")), F.lit(prompt[:24])]
    return F.concat_ws("\n", *parts)


def single_judge(items: DataFrame, adaptation: str, seed: int = 7) -> DataFrame:
    """(claim_id, claim, evidence) -> offline B0 / B1 / B3 / O prediction rows."""
    m = material(seed, adaptation)
    return items.select(
        "claim_id", hash_label(m).alias("label"), hash_confidence(m).alias("confidence"), F.lit(adaptation).alias("method_id"),
        F.lit("ok").alias("execution_status"), F.length(F.coalesce("evidence", F.lit(""))).alias("n_evidence_chars"),
    )


def same_evidence(items: DataFrame, docs: DataFrame, template: str, seed: int = 7) -> DataFrame:
    """Offline three-stage method B2: question, isolated reader, comparison; all claims at once.

    ``items``: claim_id, claim.  ``docs``: claim_id, doc_id, the D0 documents, which the
    reader sees in an order drawn from the seed (a hash order); repeated rows count once.
    A claim without documents is read all the same; an empty claim is an error.
    """
    q = items.select("claim_id", "claim", T.neutral_question(F.lit(template), F.col("claim")).alias("question"))
    own = F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), "claim_id", F.col("doc_id").cast("string")), 256).alias("o"), "doc_id")
    seen = docs.filter("doc_id is not null").groupBy("claim_id").agg(F.transform(F.sort_array(F.collect_set(own)), lambda x: x["doc_id"]).alias("ids"))
    j = q.join(seen, "claim_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast(seen.schema["ids"].dataType)))
    listed = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    digest = F.substring(F.sha2(F.concat_ws("\n", F.lit(str(seed)), "question", listed), 256), 1, 12)
    # fixed values: what the offline reader answers
    notes = F.concat(F.lit("mock-reader: evidence-only notes; n_docs="), F.size("ids").cast("string"), F.lit("; digest="), digest)
    bare = F.concat(F.lit("mock-reader: no D0 abstracts were attached; digest="), digest)
    j = j.withColumn("answer", F.when(F.size("ids") > 0, notes).otherwise(bare))
    label = hash_label(F.concat_ws("\n", F.lit(str(seed)), "claim_id", "question", "claim", "answer", listed))
    return j.select(
        "claim_id", label.alias("label"), F.lit("B2").alias("method_id"), F.col("question").alias("neutral_question"), F.col("answer").alias("reader_answer"),
        F.col("ids").alias("reader_cited"), F.lit("mock").alias("inference_mode"), F.lit("ok").alias("execution_status"),
    )


def evidence_text(parts: DataFrame) -> DataFrame:
    """(claim_id, ord, text) -> evidence of a claim, parts in order, a blank line between."""
    a = parts.groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("p"))
    return a.select("claim_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("evidence"))


def majority(votes: DataFrame) -> DataFrame:
    """(claim_id, label) -> most frequent label; ties go NEI, REFUTE, SUPPORT."""
    tie = F.when(F.col("label") == "NEI", 0).when(F.col("label") == "REFUTE", 1).otherwise(2)
    n = votes.groupBy("claim_id", "label").agg(F.count("*").alias("n"))
    best = F.row_number().over(W.partitionBy("claim_id").orderBy(F.desc("n"), tie))
    return n.withColumn("_r", best).filter("_r = 1").select("claim_id", "label", "n")


def collapse(votes: DataFrame, k: int) -> DataFrame:
    """(claim_id, seed_ord, label, status) -> label of the first k seeds, ok only if all are."""
    first = votes.filter(F.col("seed_ord") <= k)
    state = first.groupBy("claim_id").agg(
        F.bool_and(execution_ok(F.col("status"))).alias("ok"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seed_ord", "label"))), lambda x: x["label"]), ",").alias("votes"),
    )
    return state.join(majority(first), "claim_id").select("claim_id", "label", F.when(F.col("ok"), "ok").otherwise("failed").alias("status"), "votes")


def choose_k(v_tokens: float, b2_tokens: float) -> int:
    return max(1, -int(-v_tokens // b2_tokens)) if b2_tokens > 0 else 1


def vd1(rows: DataFrame) -> DataFrame:
    """V rows -> rows of its D1 arm; failed rows stay failed, a missing D1 label of an ok row is an error."""
    ok = execution_ok(F.col("execution_status"))
    lost = F.raise_error(F.concat(F.lit("no D1 label: "), F.col("claim_id"))).cast("string")
    native = F.when(~ok, "NEI").when(F.col("d1_label_4way").isNull(), lost).otherwise(four_way_to_native(F.coalesce("d1_label_4way", F.lit("unaddressed"))))
    return rows.select("claim_id", native.alias("label"), "execution_status", F.lit("V-D1").alias("method_id"))


def judge_response(raw: Column) -> Column:
    """Model text -> struct(label, rationale, confidence, ok), failing closed."""
    j = T.first_json_object(raw, "label string, rationale string, confidence double")
    label = F.upper(F.trim(j["label"]))
    label = F.when(label == "CONTRADICT", "REFUTE").otherwise(label)
    ok = label.isin(*NATIVE) & (F.trim(j["rationale"]) != "") & (j["confidence"].isNull() | j["confidence"].between(0, 1))
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(F.when(ok, label).otherwise("NEI").alias("label"), j["rationale"].alias("rationale"), F.when(ok, j["confidence"]).alias("confidence"), ok.alias("ok"))


def with_retry(call: Callable[[str], str], retries: int = 2, backoff: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    def run(prompt: str) -> str:
        for attempt in range(retries + 1):
            try:
                return call(prompt)
            except (ConnectionError, TimeoutError):
                if attempt == retries:
                    raise
                sleep(backoff * 2**attempt)
        raise AssertionError

    return run


def model_stage(items: DataFrame, client: Callable[[], Callable[[str], str]], prompt: str = "prompt", backoff: float = 0.5) -> DataFrame:
    """Add the model's reply, status and latency; the client is made once per task.

    An error becomes a failed row, never a failed job.
    """
    schema = f"{items._jdf.schema().toDDL()}, reply string, execution_status string, latency double"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retry(client(), backoff=backoff)
        for batch in batches:
            replies, states, spent = [], [], []
            for text in batch[prompt]:
                began = time.perf_counter()
                try:
                    replies.append(call(text))
                    states.append("ok")
                except Exception as e:  # noqa: BLE001 - any client error fails the row closed
                    replies.append(f"{type(e).__name__}: {e}"[:200])
                    states.append("failed")
                spent.append(time.perf_counter() - began)
            yield batch.assign(reply=replies, execution_status=states, latency=spent)

    return items.mapInPandas(run, schema)


def pending(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items without a stored row; a failed row counts as done."""
    return items.join(done.select("claim_id").distinct(), "claim_id", "left_anti")


def last_write_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Newest row per key, as one aggregation (no sort of a key's rows)."""
    newest = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row")
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(newest).select("row.*")


def usage(rows: DataFrame, prompt_rate: float | None = None, completion_rate: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, prompt_tokens, completion_tokens, latency) -> totals, exact median and p95, one row a key (or one in all)."""
    a = rows.groupBy(*(keys or [])).agg(
        F.count("*").alias("n_calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.sum("latency").alias("latency_sum"),
        F.avg("latency").alias("latency_mean"), F.percentile("latency", F.lit(0.5)).alias("latency_p50"), F.percentile("latency", F.lit(0.95)).alias("latency_p95"),
    )
    if prompt_rate is None or completion_rate is None:
        return a
    return a.withColumn("cost_usd", (F.col("prompt_tokens") * prompt_rate + F.col("completion_tokens") * completion_rate) / 1e6)


def usage_tokens(payload: Column) -> Column:
    """Tokens of a response in either spelling; bad or negative values are 0."""

    def pick(*paths: str) -> Column:
        return F.greatest(F.coalesce(*[F.get_json_object(payload, f"$.usage.{p}").try_cast("bigint") for p in paths], F.lit(0)), F.lit(0))

    return F.struct(pick("prompt_tokens", "input_tokens").alias("prompt_tokens"), pick("completion_tokens", "output_tokens").alias("completion_tokens"))
