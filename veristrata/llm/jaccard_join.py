"""Operator 8 - n-gram Jaccard join by a token-group matrix.

Two documents link when the Jaccard similarity of their sets of five-word shingles is
at least 0.75; a document's class is its component of links.  The join is exact on
64-bit shingle hashes and never lists the pairs inside a group of copies:

1. One pass over the texts hashes shingles.  Documents with equal sets are one *set*
   from then on.  Each batch of documents sends every hash once, to the bucket of that
   hash; a bucket answers how many of a set's shingles some other set has too.  A set
   can only link if at least 75 % of its shingles are shared, so most sets end here.
2. The remaining sets are partitioned into groups of similar sets (equal smallest
   hash, split to a bounded size) and linked inside each group against an inverted
   index.  Then one representative of each class goes through the same with other hash
   orders, until classes stop meeting: ever fewer rows, and no pairs of members.
3. What remains are links between different classes; shingles of one class only cannot
   carry one and drop out.  Sets are grouped anew by the shingles left, and the
   token-group matrix holds, per shingle, the groups whose token union has it.  A set queries the groups
   that share one of its rarest shingles (with overlap t = 75 % of n, one of any
   n - t + 1 shingles must be shared) with a larger class, is bounded against the
   group's token union, and only then opens the group and is compared exactly.
4. The links found between classes are closed by min-label rounds.

Defined results: null or empty texts, and texts of white space, have no shingle, are
their own component and link with nothing; with fewer than five words the whole
sequence is one shingle; equal rows link (two rows of one doc_id are two documents
that may share a class); a null doc_id is an id that sorts last; a very long text is one
set, whatever its size; the smallest id of a class is its name (ties need no rule); an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import discard, lean, lean_cogroup, lean_group, parts_for, persist, small_batches
from .textkernel import U64, Words, mix, text_blocks, word_hashes

NUM, DEN, WIDTH = 75, 100, 5
GROUP_SETS, ROUNDS = 400, 4
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], U64)


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), sorted and distinct, of every shingle of a block."""
    w = Words(buf, offs)
    h = word_hashes(buf, w)
    counts = w.counts()
    rows, hashes = [], []
    k = len(h) - WIDTH + 1
    if k > 0:
        v = h[:k] * _MULT[0]
        for j in range(1, WIDTH):
            v += h[j : j + k] * _MULT[j]
        ok = w.row[:k] == w.row[WIDTH - 1 :]
        rows.append(w.row[:k][ok])
        hashes.append(mix(v[ok]))
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(short):
        at = w.first[:-1][short]
        v = np.zeros(len(short), U64)
        for j in range(WIDTH - 1):
            on = counts[short] > j
            v[on] += h[at[on] + j] * _MULT[j]
        rows.append(short)
        hashes.append(mix(v + counts[short].astype(U64) * _MULT[4]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    row, sh = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((sh, row))
    row, sh = row[order], sh[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (sh[1:] != sh[:-1])
    return row[keep], sh[keep]


def _signatures(row: np.ndarray, sh: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size and 64-bit signature of each row's set (0 for an empty set)."""
    n = np.bincount(row, minlength=n_rows)
    sig = np.zeros(n_rows, U64)
    some = np.flatnonzero(n)
    if len(some):
        start = np.cumsum(n)[some] - n[some]
        sig[some] = mix(np.add.reduceat(mix(sh + U64(11)), start) + n[some].astype(U64) * _MULT[1])
        sig[some[sig[some] == 0]] = U64(1)
    return n, sig


def _bin(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


#: The scan sends 32 bits of a hash within its bucket; buckets grow with the input, so
#: a false match stays as rare, and can only let a set pass that a later step drops.
_SCAN = "bucket int, kind int, seg long, a binary, b binary, c binary, d binary"
SCAN_BYTES = 6 << 20


def _scan(buckets: int):
    """Per segment: the rows' sets (kind 0), shared counts known here (1), hashes by bucket (2)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seg = TaskContext.get().partitionId() << 24
        for batch in batches:
            for lo, hi, buf, offs in text_blocks(batch.column(1), SCAN_BYTES):
                yield _segment(seg, batch.column(0)[lo:hi], buf, offs, buckets)
                seg += 1

    return run


def _segment(seg: int, ids: pa.Array, buf: np.ndarray, offs: np.ndarray, buckets: int) -> pa.RecordBatch:
    row, sh = shingle_sets(buf, offs)
    n, sig = _signatures(row, sh, len(ids))
    num = np.asarray(ids.fill_null(0)).astype(np.int64)
    out = [(seg % buckets, 0, seg, _bin(num), _bin(np.asarray(ids.is_null())), _bin(n.astype(np.int64)), _bin(sig))]
    # equal sets of the segment count once
    once = np.zeros(len(sig), bool)
    once[np.unique(sig, return_index=True)[1]] = True
    on = once[row]
    row, sh = row[on], sh[on]
    order = np.argsort(sh, kind="stable")
    row, sh = row[order], sh[order]
    new = np.ones(len(sh), bool)
    new[1:] = sh[1:] != sh[:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(sh)))
    known = np.bincount(row[np.repeat(size > 1, size)], minlength=len(sig))
    k = np.flatnonzero(known)
    if len(k):
        out.append((seg % buckets, 1, seg, _bin(sig[k]), _bin(n[k].astype(np.int64)), _bin(known[k].astype(np.int64)), b""))
    # each distinct hash once; an owner of -1 says that it is shared already
    h, owner = sh[new], np.where(size > 1, -1, row[new])
    v = mix(h)
    b = (v >> U64(32)) % U64(buckets)
    order = np.lexsort((v & U64(0xFFFFFFFF), b))
    h, owner, b = (v[order] & U64(0xFFFFFFFF)).astype(np.uint32), owner[order], b[order]
    cut = np.searchsorted(b, np.arange(buckets + 1, dtype=U64))
    for j in np.flatnonzero(np.diff(cut)).tolist():
        part = slice(cut[j], cut[j + 1])
        who, idx = np.unique(owner[part], return_inverse=True)
        wide = np.uint16 if len(who) < 65536 else np.uint32
        mine = np.maximum(who, 0)
        out.append((j, 2, seg, _bin(h[part]), _bin(idx.astype(wide)), _bin(np.where(who < 0, U64(0), sig[mine])), _bin(np.where(who < 0, 0, n[mine]).astype(np.int64))))
    return _batch(out, _SCAN)


def _batch(rows: list[tuple], spec: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in spec.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])


_COUNT = "kind int, part int, a binary, b binary, c binary, d binary"


def _count(buckets: int):
    """Per bucket: how many of its hashes each set shares with another set, by segment, by part of the signature."""

    def run(table: pa.Table) -> pa.Table:
        kind, segs = table["kind"].to_numpy(), table["seg"].to_numpy()
        cols = {c: table[c].to_pylist() for c in "abcd"}
        out = [(0, 0, *(cols[c][i] for c in "abcd")) for i in np.flatnonzero(kind == 0)]
        sig, size, shared, of = [], [], [], []
        for i in np.flatnonzero(kind == 1):
            sig.append(np.frombuffer(cols["a"][i], U64))
            size.append(np.frombuffer(cols["b"][i], np.int64))
            shared.append(np.frombuffer(cols["c"][i], np.int64))
            of.append(np.full(len(sig[-1]), segs[i]))
        hs, owners, own_sig, own_n, own_seg, base = [], [], [], [], [], 0
        for i in np.flatnonzero(kind == 2):
            h, t = np.frombuffer(cols["a"][i], np.uint32), np.frombuffer(cols["c"][i], U64)
            o = np.frombuffer(cols["b"][i], np.uint16 if len(cols["b"][i]) == 2 * len(h) else np.uint32)
            hs.append(h)
            owners.append(o.astype(np.int32) + base)
            own_sig.append(t)
            own_n.append(np.frombuffer(cols["d"][i], np.int64))
            own_seg.append(np.full(len(t), segs[i]))
            base += len(t)
        if hs:
            h, owner, osig = np.concatenate(hs), np.concatenate(owners), np.concatenate(own_sig)
            del hs, owners
            who = np.unique(osig, return_inverse=True)[1].astype(np.int32)  # the same set may come from several segments
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            start = np.flatnonzero(new)
            w = who[owner]
            several = np.minimum.reduceat(w, start) != np.maximum.reduceat(w, start)
            hit = np.repeat(several, np.diff(np.append(start, len(h))))  # a mark (signature 0) differs from any set
            per = np.bincount(owner[hit], minlength=len(osig))
            k = np.flatnonzero((per > 0) & (osig != 0))
            sig.append(osig[k])
            size.append(np.concatenate(own_n)[k])
            shared.append(per[k].astype(np.int64))
            of.append(np.concatenate(own_seg)[k])
        if sig:
            s, z, c, g = (np.concatenate(x) for x in (sig, size, shared, of))
            part = (s >> U64(8)) % U64(buckets)
            for p in np.unique(part):
                i = part == p
                out.append((1, int(p), _bin(s[i]), _bin(z[i]), _bin(c[i]), _bin(g[i])))
        return pa.Table.from_batches([_batch(out, _COUNT)])

    return run


def _needed(n: np.ndarray) -> np.ndarray:
    """Least overlap of a set of n shingles with any set that it links to."""
    return -(-n * NUM // DEN)


def _candidates(table: pa.Table) -> pa.Table:
    """Per part of the signatures: sets of which enough shingles are shared, as counted in any segment."""
    s = np.concatenate([np.frombuffer(x, U64) for x in table["a"].to_pylist()])
    z, c, g = (np.concatenate([np.frombuffer(x, np.int64) for x in table[k].to_pylist()]) for k in "bcd")
    order = np.lexsort((g, s))
    s, z, c, g = s[order], z[order], c[order], g[order]
    start = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (g[1:] != g[:-1])])
    total = np.add.reduceat(c, start)
    ok = start[total >= _needed(z[start])]
    u, first = np.unique(s[ok], return_index=True)
    return pa.table({"sig": pa.array(u.view(np.int64)), "n": pa.array(z[ok][first])})


@lean
def _unpack_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, c, d in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            ids = pa.array(np.frombuffer(a, np.int64), mask=np.frombuffer(b, bool))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.frombuffer(c, np.int64)), pa.array(np.frombuffer(d, U64).view(np.int64))], names=["doc_id", "n", "sig"]
            )


@lean
def _token_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of candidate sets again, as (sig, n, toks): sorted little-endian 64-bit hashes."""
    for batch in batches:
        for lo, hi, buf, offs in text_blocks(batch.column(0)):
            row, sh = shingle_sets(buf, offs)
            n, sig = _signatures(row, sh, hi - lo)
            want = np.asarray(batch.column(1))[lo:hi]
            end = np.cumsum(n)
            some = np.flatnonzero(sig.view(np.int64) == want)
            yield pa.RecordBatch.from_arrays(
                [pa.array(want[some]), pa.array(n[some].astype(np.int64)), pa.array([_bin(sh[end[i] - n[i] : end[i]]) for i in some], pa.binary())],
                names=["sig", "n", "toks"],
            )


def _smallest(perm: int):
    """Group key of each set: its smallest hash in one of several hash orders."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [int(mix(np.frombuffer(t, U64) ^ mix(np.array([perm], U64))[0]).min().view(np.int64)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=["sig", "n", "toks", "key"])

    return run


class Index:
    """Inverted index over the token sets of a group."""

    def __init__(self, toks: list[np.ndarray]):
        self.n = np.array([len(t) for t in toks], np.int64)
        flat = np.concatenate(toks) if toks else np.zeros(0, U64)
        who = np.repeat(np.arange(len(toks)), self.n)
        order = np.argsort(flat, kind="stable")
        flat, self.who = flat[order], who[order]
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        self.start = np.append(np.flatnonzero(new), len(flat))
        self.union = flat[new]  # the group's row of the token-group matrix

    def links(self, toks: np.ndarray) -> np.ndarray:
        """Members that link with a set; the group is opened only if its union can hold enough."""
        at = np.searchsorted(self.union, toks)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == toks] if len(self.union) else at[:0]
        need = int(_needed(np.array([len(toks)]))[0])
        if len(at) < need:
            return np.zeros(0, np.int64)
        lo, hi = self.start[at], self.start[at + 1]
        size = hi - lo
        idx = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        common = np.bincount(self.who[idx], minlength=len(self.n))
        return np.flatnonzero((DEN * common >= NUM * (len(toks) + self.n - common)) & (common > 0))


def _link_group(table: pa.Table) -> pa.Table:
    """Classes inside one group of bounded size: (sig, root), the root a best-connected member."""
    sig = table["sig"].to_numpy()
    toks = [np.frombuffer(t, U64) for t in table["toks"].to_pylist()]
    order = np.argsort(sig, kind="stable")
    sig, toks = sig[order], [toks[i] for i in order]
    index = Index(toks)
    label = np.arange(len(sig))
    degree = np.zeros(len(sig), np.int64)
    for i, t in enumerate(toks):
        near = index.links(t)
        degree[i] = len(near)
        for old in np.unique(label[near]):
            label[label == old] = label[i]
    root = np.empty(len(sig), np.int64)
    for c in np.unique(label):
        members = np.flatnonzero(label == c)
        root[members] = sig[members[degree[members].argmax()]]
    return pa.table({"sig": pa.array(sig), "root": pa.array(root)})


def _round(sets: DataFrame, perm: int) -> DataFrame:
    """(sig, root) after linking groups of equal smallest hash, split to bounded size."""
    keyed = sets.mapInArrow(_smallest(perm), "sig long, n long, toks binary, key long")
    sizes = keyed.groupBy("key").count().withColumn("parts", F.ceil(F.col("count") / GROUP_SETS).cast("int")).select("key", "parts")
    # sets of a key stay sorted by size into parts only by hash: equal sets are one row already
    parts = keyed.join(sizes, "key").withColumn("salt", F.pmod(F.xxhash64("sig", F.lit(perm)), F.col("parts")).cast("int"))
    parts = parts.select("sig", "toks", F.xxhash64("key", "salt").alias("grp"))
    return parts.groupBy("grp").applyInArrow(lean_group(_link_group), "sig long, root long")


@lean
def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, n, toks, label) -> one row per shingle."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            toks = [np.frombuffer(t, np.int64) for t in part.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(toks)), [len(t) for t in toks]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(1).take(at), part.column(3).take(at), pa.array(np.concatenate(toks) if toks else np.zeros(0, np.int64))],
                names=["sig", "n", "label", "tok"],
            )


def _open(groups: pa.Table, queries: pa.Table) -> pa.Table:
    """Exact links between the queries of a group and its members: (a, b) class labels."""
    index = Index([np.frombuffer(t, U64) for t in groups["toks"].to_pylist()])
    own = groups["label"].to_numpy()
    a, b = [], []
    for t, label in zip(queries["q_toks"].to_pylist(), queries["q_of"].to_pylist(), strict=True):
        for other in np.unique(own[index.links(np.frombuffer(t, U64))]):
            if other != label:
                a.append(label)
                b.append(int(other))
    pairs = sorted(set(zip(a, b, strict=True)))
    return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})


def _hot(labels: DataFrame, total: int) -> DataFrame:
    """Labels of many rows and the number of parts that each is dealt to; 10,000 rows at most."""
    least = max(256, total // 10_000)
    n = labels.groupBy("label").agg(F.count("*").alias("members"))
    return n.filter(F.col("members") >= least).select("label", F.ceil(F.col("members") / least).cast("int").alias("_parts"))


def _by_label(big: DataFrame, small: DataFrame, hot: DataFrame, spread: str) -> DataFrame:
    """Left join on label of many rows a label with one; a hot label's rows meet copies of it in several parts."""
    parts = F.coalesce("_parts", F.lit(1))
    big = big.join(F.broadcast(hot), "label", "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    small = small.join(F.broadcast(hot), "label", "left")
    small = small.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return big.join(small, ["label", "_part"], "left").drop("_part")


def _between(sets: DataFrame, labels: DataFrame, hot: DataFrame) -> DataFrame:
    """Links between different classes, each class pair at most a few times: (a, b).

    A set asks the groups that hold, on one of its rarest shingles, a member of a larger
    class; of two classes the smaller one asks.
    """
    size = labels.groupBy("label").agg(F.count("*").alias("members"))
    s = sets.join(labels, "sig").select("sig", "n", "toks", "label")
    toks = s.mapInArrow(_explode, "sig long, n long, label long, tok long")
    cross = toks.groupBy("tok").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("df"))
    cross = cross.filter("lo <> hi").select("tok", "df")
    hits = persist(toks.join(cross, "tok"), "join-cross")
    need = F.ceil(F.col("n") * NUM / DEN)
    # groups of the matrix: sets that agree on the smallest of the shingles in play, split to a bounded size
    able = hits.groupBy("sig", "n", "label").agg(F.count("*").alias("shared"), F.min(F.xxhash64("tok")).alias("key"))
    able = persist(able.filter(F.col("shared") >= need), "join-shared")
    parts = able.groupBy("key").agg(F.ceil(F.count("*") / GROUP_SETS).alias("parts"))
    able = _by_label(able.join(parts, "key"), size, hot, "sig")
    grp = F.xxhash64("key", F.pmod(F.xxhash64("sig"), F.col("parts"))).alias("grp")
    able = persist(able.select("sig", "n", "shared", grp, F.struct("members", "label").alias("class")), "join-able")
    rank = F.row_number().over(W.partitionBy("sig").orderBy("df", "tok"))
    probes = hits.select("sig", "tok", "df").join(able, "sig").withColumn("_r", rank)
    # the n - shared shingles of no other class lead the order
    probes = probes.filter(F.col("_r") <= F.col("shared") - need + 1).select("tok", "sig", "n", "class", "grp")
    probes = persist(probes, "join-probes")
    matrix = probes.groupBy("tok", F.col("grp").alias("g")).agg(F.max("class").alias("top"), F.min("n").alias("g_min"), F.max("n").alias("g_max"))
    matrix = matrix.withColumnRenamed("tok", "g_tok")
    fits = (DEN * F.col("n") >= NUM * F.col("g_min")) & (NUM * F.col("n") <= DEN * F.col("g_max"))
    asks = probes.join(matrix, (F.col("tok") == F.col("g_tok")) & (F.col("class") < F.col("top")) & fits)
    asks = persist(asks.select("sig", F.col("class.label").alias("label"), "g").distinct(), "join-asks")
    load = asks.groupBy("g").agg(F.ceil(F.count("*") / (4 * GROUP_SETS)).cast("int").alias("parts"))
    queries = asks.join(load, "g").withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))
    queries = queries.join(sets.select("sig", "toks"), "sig")
    queries = queries.select(F.col("g").alias("q_g"), F.col("part").alias("q_part"), F.col("label").alias("q_of"), F.col("toks").alias("q_toks"))
    members = able.select("sig", F.col("class.label").alias("label"), F.col("grp").alias("g")).join(load, "g")
    members = members.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(sets.select("sig", "toks"), "sig")
    opened = members.select("g", "part", "label", "toks").groupBy("g", "part").cogroup(queries.groupBy("q_g", "q_part"))
    return opened.applyInArrow(lean_cogroup(_open), "a long, b long").distinct()


def close(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): smallest node of each component, by star rounds over stored tables to the fixed point."""
    e = persist(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "close")
    before = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now["n"]:
            break
        before = now
        # large star: larger neighbours to the smallest; small star: the rest of a node's smaller ones
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        old, e = e, persist(small.filter("a <> b").distinct(), "close")
        discard(old)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _texts(d: DataFrame, rows: DataFrame, able: DataFrame) -> DataFrame:
    """(text, sig): one text for each candidate set.

    A text is found by its id; where no row of a set has an id of its own, rows without an
    id or with a repeated one are signed again and found by their set.
    """
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("k"), F.min("sig").alias("sig"))
    ids = persist(ids, "join-ids")
    own = ids.filter("k = 1 and doc_id is not null")
    stands = persist(own.join(able.select("sig"), "sig").groupBy("sig").agg(F.min("doc_id").alias("_stand")), "join-stands")
    found = d.join(stands.hint("shuffle_hash"), d["doc_id"] == stands["_stand"]).select("text", "sig")
    left = persist(able.select("sig").join(stands, "sig", "left_anti"), "join-left")
    if not left.head(1):
        return found
    odd = d.join(ids.filter("k > 1 and doc_id is not null").select("doc_id"), "doc_id", "left_semi").union(d.filter("doc_id is null"))
    signed = odd.select("doc_id", "text", F.col("text").alias("_again")).mapInArrow(_sign, "doc_id long, text string, __join_sig long")
    signed = signed.filter("__join_sig <> 0").groupBy(F.col("__join_sig").alias("sig")).agg(F.min("text").alias("text"))
    return found.unionByName(signed.join(left, "sig").select("text", "sig"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``, and the set's signature."""
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    buckets = parts_for(d, 8 << 20)
    scan = d.mapInArrow(_scan(buckets), _SCAN)
    counted = persist(scan.groupBy("bucket").applyInArrow(lean_group(_count(buckets)), _COUNT), "join-counts")
    rows = persist(counted.filter("kind = 0").select("a", "b", "c", "d").mapInArrow(_unpack_sets, "doc_id long, n long, sig long"), "join-sets")
    able = counted.filter("kind = 1").select("part", "a", "b", "c", "d").groupBy("part").applyInArrow(lean_group(_candidates), "sig long, n long")
    able = persist(able, "join-candidates")
    discard(counted)
    sets = _texts(d, rows, able).mapInArrow(_token_sets, "sig long, n long, toks binary").dropDuplicates(["sig"])
    sets = persist(sets, "join-tokens")
    labels = persist(_round(sets, 0).select("sig", F.col("root").alias("label")), "join-labels")
    total = labels.count()
    for perm in range(1, ROUNDS):
        heads = sets.join(labels.select(F.col("label").alias("sig")).distinct(), "sig", "left_semi")
        move = _round(heads, perm).filter("sig <> root").select(F.col("sig").alias("label"), "root")
        labels = persist(_by_label(labels, move, _hot(labels, total), "sig").select("sig", F.coalesce("root", "label").alias("label")), "join-labels")
    hot = persist(_hot(labels, total), "join-hot")
    merged = close(_between(sets, labels, hot)).withColumnRenamed("node", "label")
    labels = persist(_by_label(labels, merged, hot, "sig").select("sig", F.coalesce("root", "label").alias("label")), "join-labels")
    out = rows.filter("n > 0").join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    out = persist(out.withColumn("_row", F.monotonically_increasing_id()), "join-out")
    least = out.groupBy("label").agg(F.min("doc_id").alias("least"))
    out = _by_label(out, least, _hot(out, out.count()), "_row")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "sig", "label")
    empty = rows.filter("n = 0")
    return out.unionByName(empty.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "sig", F.lit(None).cast("long").alias("label")))


@lean
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the signature of their last column, a text, in its place."""
    for batch in batches:
        last = batch.num_columns - 1
        for lo, hi, buf, offs in text_blocks(batch.column(last)):
            sig = _signatures(*shingle_sets(buf, offs), hi - lo)[1]
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(sig.view(np.int64))], names=[*batch.schema.names[:last], "__join_sig"])


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class stays: one whose id is the class's smallest, ids before none.

    A row of an id of its own is known by the id; rows without an id or with a repeated one
    are known by id and signature.  Rows without shingles are in no class: they stay, of
    equal ones of one id one.
    """
    c = persist(components(docs).select("doc_id", "n_shingles", "sig", "label"), "join-classes")
    least = c.filter("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sig")).alias("b"))
    chosen = persist(least.select(F.col("b.doc_id").alias("__join_of"), F.col("b.sig").alias("__join_set")), "join-chosen")
    stands = chosen.filter("__join_of is not null").select(F.col("__join_of").alias("__join_id"), F.lit(True).alias("in")).distinct()
    ids = c.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__join_id")).agg(
        (F.count("*") > 1).alias("__join_many"), F.max(F.col("n_shingles") == 0).alias("empty")
    )
    ids = ids.join(stands, "__join_id", "left").filter("__join_many or not (empty or in is not null)")
    ids = persist(ids.select("__join_id", "__join_many"), "join-dropped")
    marked = docs.filter("doc_id is not null").join(ids, F.col("doc_id") == F.col("__join_id"), "left")
    single = marked.filter("__join_id is null").select(*docs.columns)
    several = marked.filter("__join_many").select(*docs.columns).unionByName(docs.filter("doc_id is null"))
    signed = several.select("*", F.col("text").cast("string").alias("__join_text"))
    signed = signed.mapInArrow(_sign, T.StructType([*docs.schema.fields, T.StructField("__join_sig", T.LongType())]))
    empty = signed.filter("__join_sig = 0").select(*docs.columns)
    own = signed.filter("__join_sig <> 0").join(chosen, F.col("doc_id").eqNullSafe(F.col("__join_of")) & (F.col("__join_sig") == F.col("__join_set")))
    own = own.groupBy("__join_of", "__join_set").agg(F.min_by(F.struct(*docs.columns), "text").alias("r")).select("r.*")
    return (
        single.unionByName(own).unionByName(empty.filter("doc_id is not null").dropDuplicates(["doc_id", "text"])).unionByName(empty.filter("doc_id is null"))
    )


def op8(docs: DataFrame) -> DataFrame:
    return components(docs).select("doc_id", "n_shingles", "component_id")


SQL = r"""
with recursive t as (select row_number() over () as rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct rid, array_to_string(w[i:i + 4], ' ') as x from (select rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from t where len(w) > 0)),
n as (select rid, count(*) as n from s group by rid),
p as (select a.rid as a, b.rid as b, count(*) as k from s a join s b on a.x = b.x and a.rid <> b.rid group by 1, 2),
e as (select p.a, p.b from p join n x on x.rid = p.a join n y on y.rid = p.b where 100 * k >= 75 * (x.n + y.n - k)),
r(rid, root) as (select rid, rid from t union select e.b, r.root from r join e on e.a = r.rid),
c as (select r.rid, min(d.doc_id) as least from r join t d on d.rid = r.root group by 1)
select t.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(c.least, t.doc_id) as component_id from t left join n using (rid) left join c using (rid)
"""
