"""Bounded training samples and held-out folds shared by the learned operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import discard, lean, persist, small_batches


def remainder(doc_id: Column, mod: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


#: Bounds of a sample besides its rows: classes learned (the most frequent, ties by value) and bytes of all texts.
MOST_CLASSES, MOST_BYTES = 256, 128 << 20


def sample(
    docs: DataFrame, labelled: DataFrame, label: str, bound: int, mod: int = 4, held: int = 2, seed: int = 5,
    values: tuple | None = None, most_classes: int = MOST_CLASSES, most_bytes: int = MOST_BYTES,
) -> list[tuple[str, object]]:
    """At most ``bound`` (text, label) rows per class, for the driver; the size does not grow with the input.

    Rows of the held-out remainder, null labels and null ids take no part; ``values``, if
    given, are the labels that do.  A class is never too small: one row of it is learned
    from.  Only beyond ``most_classes`` labels do the least frequent stay out.  An id with
    several labels has the smallest.  Equal rows (id and text) count once.  Rows come in the
    order of a hash of id and text until a class has ``bound`` rows or its share of
    ``most_bytes``; the text that passes the share is the last.  Reruns agree.
    ``labelled`` may be ``docs`` itself.
    """
    ids = labelled.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), mod) != held))
    if values is not None:
        ids = ids.filter(F.col(label).isin(*values))
    ids = ids.groupBy("doc_id").agg(F.min(label).alias("_label"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("_t"), F.octet_length(text).cast("long").alias("_size")).distinct().join(ids, "doc_id")
    rows = rows.withColumn("_u", F.shiftrightunsigned(F.xxhash64("doc_id", "_t", F.lit(seed)), 11) / F.lit(float(1 << 53)))
    rows = persist(rows, "sample-rows")
    n = rows.groupBy("_label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_label").limit(most_classes)
    sizes = {r["_label"]: r["n"] for r in n.collect()}  # one row a class, at most most_classes of them
    # enough for ``bound`` rows with near certainty, and about 1.1 * bound + 30 at most
    share = [(value, min(1.0, (1.1 * bound + 30) / n)) for value, n in sizes.items()]
    share = docs.sparkSession.createDataFrame(share, T.StructType([T.StructField("_label", rows.schema["_label"].dataType), T.StructField("_share", T.DoubleType())]))
    order = W.partitionBy("_label").orderBy("_u", "_t", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    few = rows.join(F.broadcast(share), "_label").filter("_u < _share").withColumn("_before", F.coalesce(F.sum("_size").over(order), F.lit(0))).withColumn("_n", F.count("*").over(order))
    few = few.filter((F.col("_n") < bound) & (F.col("_before") < most_bytes // max(1, len(sizes)))).select("doc_id", "_t", "_u", "_label", "_n")
    # at most bound * most_classes short rows, so the broadcast is bounded
    found = docs.select("doc_id", F.xxhash64(text).alias("_t"), text.alias("text")).join(F.broadcast(few), ["doc_id", "_t"])
    found = found.dropDuplicates(["_label", "_n"]).select("_u", "_t", "text", "_label").toArrow()
    texts, labels = found["text"].to_pylist(), found["_label"].to_pylist()
    order = np.lexsort((found["_t"].to_numpy(), found["_u"].to_numpy())) if found.num_rows else []
    discard(rows)
    return [(texts[i], labels[i]) for i in order]


def apply_scores(docs: DataFrame, model, mod: int, held: int, schema: str, rows: Callable[[object, pa.Array], list[pa.Array]]) -> DataFrame:
    """doc_id, held_out and the columns that ``rows(model, texts)`` gives, for every row of ``docs``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows(shared.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], names=names)

    schema = "doc_id long, held_out boolean, " + schema
    names = [f.split()[0] for f in schema.split(", ")]
    held_out = F.coalesce(remainder(F.col("doc_id"), mod) == held, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held_out, F.col("text").cast("string")).mapInArrow(run, schema)


def keep_rows(docs: DataFrame, model, keep: Callable[[object, pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose text ``keep(model, texts)`` accepts, with all their columns."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(shared.value, batch.column(at))))

    return docs.mapInArrow(run, docs.schema)
