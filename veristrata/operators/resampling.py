"""Cluster bootstrap of many cells at once, by weights instead of drawn rows.

A cluster's weight in a resample is Poisson(1), read off a hash of the seed, cluster and
resample (a SHA-256 gives eight), so no list of slots and no join exists.  The cells of a
cluster lie side by side in one task, which makes the cluster's weights once, multiplies
them with the totals of each cell, and hands on one row a cell and resample; one
aggregation adds these up.  Every cell is done in the same job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .scoring import ratio

BLOCK = 8


def _poisson(least: int = 2) -> tuple[str, ...]:
    """The cumulative distribution of Poisson(1) in 32-bit steps, as hexadecimal digits, to the last step but ``least``."""
    out, total, k = [], Fraction(0), 0
    e = sum(Fraction(1, factorial(i)) for i in range(40))
    while (step := int((total := total + 1 / (e * factorial(k))) * 2**32)) <= 2**32 - least:
        out.append(f"{step:08x}")
        k += 1
    return tuple(out)


#: A weight is the number of these that its eight hexadecimal digits reach.
POISSON = _poisson()


@dataclass(frozen=True)
class Config:
    """How to resample; anything out of range is an error when it is made."""

    resamples: int = 2000
    level: float = 0.95
    seed: str = "0"

    def __post_init__(self) -> None:
        if isinstance(self.resamples, bool) or not isinstance(self.resamples, int) or self.resamples < 1:
            raise ValueError("resamples must be a positive integer")
        if not 0 < self.level < 1:
            raise ValueError("level must lie between 0 and 1")
        if ":" in self.seed:
            raise ValueError("a seed holds no colon")

    @property
    def blocks(self) -> int:
        return -(-self.resamples // BLOCK)


def weight(digest: Column, j: int) -> Column:
    """Weight j (0 to 7) of a block: Poisson(1) by its 32 bits of the digest."""
    h = F.substring(digest, 8 * j + 1, 8)
    return sum(((h >= t).cast("long") for t in POISSON), F.lit(0).cast("long"))


_STEPS = np.array([int(t, 16) for t in POISSON], np.uint32)
#: Sums that a task holds before it hands them on, and clusters whose weights are made together.
HELD, CLUSTERS = 4_000_000, 2_000


def weights(clusters: Sequence[str], config: Config) -> np.ndarray:
    """weight() of each cluster (row) in each resample (column)."""
    ends = [f":{b}".encode() for b in range(config.blocks)]
    digests = bytearray()
    for c in clusters:
        head = hashlib.sha256(f"{config.seed}:{c}".encode())
        for e in ends:
            h = head.copy()
            h.update(e)
            digests += h.digest()
    h = np.frombuffer(digests, ">u4").astype(np.uint32).reshape(len(clusters), BLOCK * config.blocks)[:, : config.resamples]
    out = np.zeros(h.shape, np.uint8)
    for step in _STEPS:
        out += h >= step
    return out


def _weighed(keys: int, sums: int, schema: pa.Schema, config: Config) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Totals (keys, cluster, sums) -> a task's sums per cell and resample; a cluster's weights are made once for its cells."""

    def flush(held: dict) -> pa.RecordBatch:
        values = np.stack(list(held.values()))  # cells x sums x resamples
        cells, n = list(held), config.resamples
        cols = [pa.array([c[i] for c in cells for _ in range(n)], schema.field(i).type) for i in range(keys)]
        cols += [pa.array(np.tile(np.arange(n), len(cells)), schema.field(keys).type), *[pa.array(values[:, i].ravel()) for i in range(sums)]]
        held.clear()
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, CLUSTERS):
                batch = whole.slice(at, CLUSTERS)
                named = batch.column(keys).dictionary_encode()
                w, of = weights(named.dictionary.to_pylist(), config), named.indices.to_numpy()
                total = np.stack([batch.column(keys + 1 + i).to_numpy() for i in range(sums)])
                rows: dict[tuple, list[int]] = {}
                for i, cell in enumerate(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True) if keys else [()] * batch.num_rows):
                    rows.setdefault(cell, []).append(i)
                exact = np.float64 if np.abs(total.astype(np.float64)).sum() * len(POISSON) < 2**53 else np.int64
                w, total = w.astype(exact), total.astype(exact)
                for cell, mine in rows.items():
                    part = (total[:, mine] @ w[of[mine]]).astype(np.int64)
                    if cell in held:
                        held[cell] += part
                    else:
                        held[cell] = part
                if len(held) * sums * config.resamples > HELD:
                    yield flush(held)
        if held:
            yield flush(held)

    return run


def resamples(rows: DataFrame, keys: Sequence[str], cluster: str, sums: dict[str, Column], config: Config = Config()) -> DataFrame:
    """(keys, r, <sums>): each sum over one resample of a cell's clusters; r from 0."""
    name = F.coalesce(F.col(cluster).cast("string"), F.lit(""))
    total = rows.groupBy(*keys, name.alias("_cluster")).agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"_s_{n}") for n, c in sums.items()])
    total = total.repartition("_cluster").sortWithinPartitions("_cluster")  # the cells of a cluster side by side
    fields = [*[total.schema[k] for k in keys], *[StructField(n, LongType()) for n in ("r", *sums)]]
    schema = StructType([StructField(f.name, f.dataType) for f in fields])
    part = total.mapInArrow(_weighed(len(keys), len(sums), to_arrow_schema(schema), config), schema)
    return part.groupBy(*keys, "r").agg(*[F.sum(n).alias(n) for n in sums])


def intervals(rows: DataFrame, keys: Sequence[str], cluster: str, sums: dict[str, Column], metrics: dict[str, Column], config: Config = Config()) -> DataFrame:
    """(keys, metric, estimate, ci_low, ci_high, n_clusters) of every cell; ``metrics`` are formulas over the sums."""
    named = F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in metrics.items()])
    long = lambda df: df.select(*keys, F.explode(named).alias("m")).select(*keys, "m.metric", "m.value")
    tail = (1 - config.level) / 2
    ci = long(resamples(rows, keys, cluster, sums, config)).groupBy(*keys, "metric").agg(F.percentile("value", F.lit(tail)).alias("ci_low"), F.percentile("value", F.lit(1 - tail)).alias("ci_high"))
    n = rows.groupBy(*keys).agg(F.count_distinct(F.coalesce(F.col(cluster).cast("string"), F.lit(""))).alias("n_clusters"), *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(s) for s, c in sums.items()])
    point = n.select(*keys, "n_clusters", F.explode(named).alias("m")).select(*keys, "n_clusters", "m.metric", F.col("m.value").alias("estimate"))
    if not keys:
        return point.join(ci, "metric").select("metric", "estimate", "ci_low", "ci_high", "n_clusters")
    return point.join(ci, [*keys, "metric"]).select(*keys, "metric", "estimate", "ci_low", "ci_high", "n_clusters")


def endorsement(arms: dict[str, str], gold: str = "gold", support: str = "SUPPORT") -> tuple[dict[str, Column], dict[str, Column]]:
    """(sums, metrics) of the false-endorsement rates of two or more arms and of each against the first."""
    base = F.col(gold) != support
    sums = {"n_gold": base, **{f"fe_{a}": base & (F.col(c) == support) for a, c in arms.items()}}
    rate = {a: ratio(F.col(f"fe_{a}"), F.col("n_gold")) for a in arms}
    first, *others = arms
    return sums, rate | {f"{a}-{first}": rate[a] - rate[first] for a in others}
