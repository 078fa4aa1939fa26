"""Operator 3 - exact top-k inner-product search by the threshold algorithm.

Vectors become integers floor(256 x).  Candidates are split into blocks by a hash, each
with a sorted list per dimension, made once; queries into blocks of their own.  A task
searches a run of candidate blocks for one block of queries: a query reads each list
from the end its own sign favours, the rows met are scored (each once, for all queries
still searching), and it stops as soon as its kth score beats the bound of the last
values read, which no unseen row can pass.  The kth score is carried from block to
block, so later blocks can stop at once.  Per query the best of all tasks win.

Scores are exact at every size: where doubles could round, the bound and the choice of
candidates allow for the error, and the candidates left are scored in Python integers.

Defined results: vectors that are null or hold a null or non-finite component, and
rows without an id, take no part; only vectors of the query's dimension are its
candidates; rows with the query's own id are not; every query row is a query of its own, so
an id that comes twice gets ranks 1 to k twice; a score beyond the range of a long is
the nearest long; ties, such ones included, go to the smaller id; with fewer than k
candidates all are returned; equal rows are equal candidates; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import lean, lean_group, persist

SCALE, BLOCK_ROWS, BLOCK_QUERIES, RUN = 256, 4096, 2048, 8
LONG = 1 << 63


def valid(e: Column) -> Column:
    ok = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.isNotNull() & ok


_BLOCK = "dim int, block int, ids binary, x binary, lists binary"


def _pack(with_lists: bool):
    """A block as one row: ids ascending, the integer matrix row by row, and per dimension the rows by falling value."""

    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        dim = table["dim"][0].as_py()
        flat = np.asarray(table["e"].combine_chunks().flatten()).astype(np.float64).reshape(len(ids), dim)
        with np.errstate(over="ignore"):
            x = np.floor(SCALE * flat)[order]
        x = np.clip(x, -np.finfo(float).max, np.finfo(float).max)
        lists = np.argsort(-x, axis=0, kind="stable").astype(np.uint32).tobytes() if with_lists else b""
        out = {"dim": [dim], "block": [table["block"][0].as_py()], "ids": [ids[order].tobytes()], "x": [_narrow(x)], "lists": [lists]}
        return pa.table(out, schema=pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("lists", pa.binary())]))

    return lean_group(run)


def _narrow(x: np.ndarray) -> bytes:
    """Four bytes a value if all fit, else eight."""
    small = np.abs(x).max(initial=0) < 2.0**31
    return np.ascontiguousarray(x, np.int32 if small else np.float64).tobytes()


def _wide(b: bytes, n: int, dim: int) -> np.ndarray:
    kind = np.int32 if len(b) == 4 * n * dim else np.float64
    return np.frombuffer(b, kind).reshape(n, dim).astype(np.float64)


def _fitted(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """q and x in a scale without overflow, the error of a score per query (0: none), and the scaled end of the longs."""
    dim = max(1, x.shape[1])
    big_q, big_x = float(np.abs(q).max(initial=0)), float(np.abs(x).max(initial=0))
    if big_q == 0 or big_x == 0 or np.log2(big_q) + np.log2(big_x) + np.log2(dim) < 53:
        return q, x, np.zeros(len(q)), np.inf  # every partial sum is an exact integer
    e_q, e_x = (int(np.ceil(np.log2(v))) for v in (big_q, big_x))
    q, x = np.ldexp(q, -e_q), np.ldexp(x, -e_x)
    error = np.abs(q).sum(1) * dim * 2.0**-51 + dim * 2.0**-1000
    return q, x, error, float(np.ldexp(1.0, max(-1000, 63 - e_q - e_x)))


def threshold_search(
    q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, lists: np.ndarray | None = None, floors: list[list[int]] | None = None
) -> list[tuple[np.ndarray, list[int]]]:
    """Per query, rows and scores of its k best in a block (ids ascending), best first.

    ``floors`` has each query's best scores of other blocks, at most k, and is brought up
    to date; rows that cannot be among the best of both may be missing.
    """
    m, n, dim = len(q), len(x), x.shape[1]
    floors = [[] for _ in range(m)] if floors is None else floors
    lists = np.argsort(-x, axis=0, kind="stable") if lists is None else lists
    fq, fx, error, most = _fitted(q, x)
    unit = 1.0 if not error.any() else most / 2.0**63  # of a score
    values = np.take_along_axis(fx, lists.astype(np.int64), 0)
    score = np.full((m, n), -np.inf)
    scored = np.zeros(n, bool)
    floor = np.array([f[-1] * unit if len(f) == k else -np.inf for f in floors])
    kth, to, step = floor.copy(), 0, max(8, n // 64)
    active = np.arange(m) if n else np.zeros(0, np.int64)
    while len(active):
        depth, to = to, min(n, to + step)
        mine = fq[active]
        fresh = np.zeros(n, bool)
        for d in range(dim):
            if (mine[:, d] > 0).any():
                fresh[lists[depth:to, d]] = True
            if (mine[:, d] < 0).any():
                fresh[lists[n - to : n - depth, d]] = True
        if to == n:
            fresh[:] = True
        new = np.flatnonzero(fresh & ~scored)
        scored[new] = True
        got = np.clip(mine @ fx[new].T, -most, most)
        got[ids[new][None, :] == q_ids[active][:, None]] = -np.inf
        score[np.ix_(active, new)] = got
        if to < n and scored.sum() > k:
            kth[active] = np.maximum(floor[active], np.partition(score[active], n - k, axis=1)[:, n - k])
        bound = np.minimum(np.where(mine > 0, mine * values[to - 1], mine * values[n - to]).sum(1), most)
        active = active[(kth[active] - 2 * error[active] <= bound + error[active]) & (to < n)]
        step *= 2
    out = []
    for i in range(m):
        able = np.flatnonzero(np.isfinite(score[i]))
        if len(able) > k:
            low = max(floor[i], np.partition(score[i][able], len(able) - k)[len(able) - k]) - 2 * error[i]
            able = able[score[i][able] >= low]
        if error[i]:
            own = [int(v) for v in q[i]]
            exact = [sum(a * int(b) for a, b in zip(own, x[r].tolist(), strict=True)) for r in able]
            exact = [max(-LONG, min(LONG - 1, v)) for v in exact]
        else:
            exact = [int(v) for v in score[i][able]]
        best = sorted(range(len(able)), key=lambda j: (-exact[j], ids[able[j]]))[:k]
        out.append((able[best], [exact[j] for j in best]))
        floors[i] = sorted([*floors[i], *out[-1][1]], reverse=True)[:k]
    return out


def _search(k: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, floors = None, []
        for batch in batches:
            for dim, block, qi, qx, ci, cx, cl in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                q_ids, ids = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
                if at != (dim, block):
                    at, floors = (dim, block), [[] for _ in q_ids]
                q, x = _wide(qx, len(q_ids), dim), _wide(cx, len(ids), dim)
                lists = np.frombuffer(cl, np.uint32).reshape(len(ids), dim)
                for lo in range(0, len(q_ids), 256):
                    part = slice(lo, lo + 256)
                    mine = floors[part]
                    found = threshold_search(q[part], q_ids[part], x, ids, k, lists, mine)
                    floors[part] = mine
                    size = [len(r) for r, _ in found]
                    row = (block << 32) + lo + np.repeat(np.arange(len(found)), size)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row),
                            pa.array(np.repeat(q_ids[part], size)),
                            pa.array(ids[np.concatenate([r for r, _ in found]).astype(np.int64)] if sum(size) else np.zeros(0, np.int64)),
                            pa.array([v for _, s in found for v in s], pa.int64()),
                        ],
                        names=["row", "query_id", "vec_id", "score"],
                    )

    return run


def search(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(vec_id, embedding) against (vec_id, embedding): query_id, rank, vec_id, score."""

    def blocks(df: DataFrame, size: int, tag: str, with_lists: bool) -> tuple[DataFrame, int]:
        d = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
        d = d.filter(F.col("id").isNotNull() & valid(F.col("e"))).withColumn("dim", F.size("e"))
        n = max(1, -(-d.count() // size))
        # equal rows go to different blocks too
        d = d.withColumn("block", F.pmod(F.xxhash64("id", "e", F.monotonically_increasing_id()), F.lit(n)).cast("int"))
        return persist(d.groupBy("dim", "block").applyInArrow(_pack(with_lists), _BLOCK), tag), n

    c, n_c = blocks(rows, BLOCK_ROWS, "topk-rows", True)
    q, n_q = blocks(queries, BLOCK_QUERIES, "topk-queries", False)
    # a run of candidate blocks meets a block of queries in one task: the query set is met by all rows, in blocks
    runs = max(1, -(-n_c // RUN))
    c = c.select("dim", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), F.pmod("block", F.lit(runs)).alias("run"), F.col("ids").alias("c_ids"), F.col("x").alias("c_x"), "lists")
    q = q.select("dim", F.col("block").alias("qb"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    pairs = c.join(q, ["dim", "qb"]).repartition(runs * n_q, "qb", "run").sortWithinPartitions("dim", "qb", "run")
    pairs = pairs.select("dim", "qb", "q_ids", "q_x", "c_ids", "c_x", "lists")
    found = pairs.mapInArrow(_search(k), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("row", "query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(vectors: DataFrame) -> DataFrame:
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


SQL = """
with v as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.rid, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by rid order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
