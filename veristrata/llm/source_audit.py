"""Operator 11 - source divergence audit over a byte-level tokenizer.

1. ``term_counts``: a task lays its texts end to end as one UTF-8 buffer.  A lookup table
   over byte values finds the boundaries of terms; slices of one length are hashed
   together by xxHash64 in numpy, grouped by hash, and compared byte by byte with the
   first slice of their group (slices that only share a hash are told apart by their
   bytes).  Documents x terms is a CSR matrix; ``reduceat`` over rows of one (lang,
   source) gives occurrences and documents.  What a task sends has one row a (lang,
   term), so no key ever has more rows than there are tasks.
2. ``kept_counts``: one exchange by (lang, term) serves document frequencies, the filter
   and the sums by source.
3. ``audit``: kept terms are dealt to blocks of about BLOCK_ROWS rows.  A block is a CSR
   matrix sources x terms; for each source, ``reduceat`` over the rows of all others
   gives the block's part of every divergence.  Terms that neither source has add a
   constant each, so they are counted and never listed.  From TILE sources of a language
   up, pairs of source tiles are blocks of their own.

Defined results: null text, lang and source are ''; a document without terms still makes
its (lang, source) group occur; repeated rows count each time, as documents of their own;
texts are never cut; equal values rank by UTF-8 bytes of the item; an empty table gives no
row; extra columns are ignored, whatever their names.  Arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import give_back, lean, persist, small_batches
from .textkernel import U64, Words, text_blocks

BLOCK_ROWS = 200_000
TILE = 512
SALTS = 256
TASK_ROWS = 1_000_000

_OTHER = np.ones(256, bool)
_OTHER[0x41:0x5B] = _OTHER[0x61:0x7B] = _OTHER[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

# The five primes of the public xxHash64 definition.
_P1, _P2, _P3, _P4, _P5 = (U64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def xxh64(rows: np.ndarray) -> np.ndarray:
    """xxHash64 (seed 0) of every row of a matrix of bytes."""
    n, size = rows.shape
    if size >= 32:
        return np.fromiter((xxhash.xxh64_intdigest(r.tobytes()) for r in rows), U64, n)
    h = np.full(n, _P5 + U64(size), U64)
    at = 0
    while size - at >= 8:
        lane = np.ascontiguousarray(rows[:, at : at + 8]).view("<u8")[:, 0]
        h = _turn(h ^ (_turn(lane * _P2, 31) * _P1), 27) * _P1 + _P4
        at += 8
    if size - at >= 4:
        lane = np.ascontiguousarray(rows[:, at : at + 4]).view("<u4")[:, 0].astype(U64)
        h = _turn(h ^ (lane * _P1), 23) * _P2 + _P3
        at += 4
    for k in range(at, size):
        h = _turn(h ^ (rows[:, k].astype(U64) * _P5), 11) * _P1
    h = (h ^ (h >> U64(33))) * _P2
    h = (h ^ (h >> U64(29))) * _P3
    return h ^ (h >> U64(32))


def group_slices(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed=xxh64) -> tuple[np.ndarray, pa.Array]:
    """Number of each slice's term, and the terms (A-Z lower-cased), exact whatever ``hashed`` returns."""
    lens = ends - starts
    ids = np.zeros(len(starts), np.int64)
    found: list[np.ndarray] = []
    sizes: list[int] = []
    n = 0
    by_size = np.argsort(lens, kind="stable")
    edges = np.flatnonzero(np.diff(lens[by_size], prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        at = by_size[lo:hi]
        size = int(lens[at[0]])
        rows = _LOWER[buf[starts[at][:, None] + np.arange(size)]]
        _, first, inverse = np.unique(hashed(rows), return_index=True, return_inverse=True)
        if (rows[first[inverse]] != rows).any():  # one hash, other bytes
            whole = np.ascontiguousarray(rows).view(f"V{size}")[:, 0]
            _, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
        ids[at] = inverse + n
        n += len(first)
        found.append(rows[first].ravel())
        sizes += [size] * len(first)
    data = np.concatenate(found) if found else np.zeros(0, np.uint8)
    offs = np.zeros(n + 1, np.int64)
    np.cumsum(sizes, out=offs[1:])
    terms = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data.tobytes())])
    return ids, terms


def _counted(buf: np.ndarray, offs: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of a block of documents."""
    words = Words(buf, offs, _OTHER)
    ids, terms = group_slices(buf, words.starts, words.ends)
    width = max(1, len(terms))
    cells, data = np.unique(words.row * width + ids, return_counts=True)  # CSR: documents x terms
    doc, index = cells // width, cells % width
    key = group[doc] * width + index
    order = np.argsort(key, kind="stable")
    key, data = key[order], data[order]
    cut = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.add.reduceat(data, cut) if len(cut) else data
    return key[cut] // width, terms.take(pa.array(key[cut] % width)), n, np.diff(cut, append=len(key))


COUNTS = "lang string, term string, df long, sources array<string>, ns array<long>"


def _merged(parts: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("df", "sum")])
    return t.rename_columns(["lang", "source", "term", "n", "df"])


def _rows(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """One row a (lang, term), its sources and their counts side by side."""
    t = t.sort_by([("lang", "ascending"), ("term", "ascending")]).combine_chunks()
    if not t.num_rows:
        return
    code = [pc.fill_null(t[c].combine_chunks(), "").dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in ("lang", "term")]
    cut = np.flatnonzero((np.diff(code[0], prepend=-1) != 0) | (np.diff(code[1], prepend=-1) != 0))
    ends = np.append(cut, t.num_rows).astype(np.int32)
    one = t.take(pa.array(cut))
    df = np.add.reduceat(t["df"].to_numpy(), cut)
    lists = [pa.ListArray.from_arrays(pa.array(ends), t[c].combine_chunks().cast(kind)) for c, kind in (("source", pa.string()), ("n", pa.int64()))]
    whole = pa.table([one["lang"].cast(pa.string()), one["term"].cast(pa.string()), pa.array(df, pa.int64()), *lists], names=["lang", "term", "df", "sources", "ns"])
    yield from whole.to_batches(max_chunksize=20_000)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, df, sources, ns): what each task has counted, a row a (lang, term) and task."""
    small_batches(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        rows = 0
        for batch in batches:
            groups = pa.table({"lang": batch.column(0), "source": batch.column(1), "at": pa.array(np.arange(batch.num_rows))})
            pairs = groups.group_by(["lang", "source"]).aggregate([("at", "min")])
            joined = groups.join(pairs, ["lang", "source"]).sort_by("at")
            _, group = np.unique(joined["at_min"].to_numpy(), return_inverse=True)
            first = np.unique(joined["at_min"].to_numpy())
            for lo, hi, buf, offs in text_blocks(batch.column(2), 4 << 20):
                g, term, n, df = _counted(buf, offs, group[lo:hi])
                at = pa.array(first[g])
                parts.append(pa.table({"lang": batch.column(0).take(at), "source": batch.column(1).take(at), "term": term, "n": n, "df": df}))
                rows += len(n)
            if rows > TASK_ROWS:
                parts = [_merged(parts)]
                rows = parts[0].num_rows
                if rows > TASK_ROWS // 2:
                    yield from _rows(parts[0])
                    parts, rows = [], 0
                    give_back()
        if parts:
            yield from _rows(_merged(parts))

    said = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*said).mapInArrow(run, COUNTS)


def kept_counts(counts: DataFrame, least: int = 30) -> DataFrame:
    """(lang, source, term, n, total, leads) of the terms in at least ``least`` documents of their language.

    ``total`` is the language's count of the term; ``leads`` marks one row of each term.
    """
    key = W.partitionBy("lang", "term")
    c = counts.repartition("lang", "term").withColumn("df", F.sum("df").over(key)).filter(F.col("df") >= least)
    c = c.select("lang", "term", F.explode(F.arrays_zip("sources", "ns")).alias("x"))
    c = c.groupBy("lang", "term", F.col("x.sources").alias("source")).agg(F.sum("x.ns").alias("n"))
    return c.select("lang", "source", "term", "n", F.sum("n").over(key).alias("total"), (F.col("source") == F.min("source").over(key)).alias("leads"))


def parts_per_billion(count: np.ndarray, total: np.ndarray, kinds: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / (total + 5 * kinds)), exact; 0 if nothing is counted."""
    a, b = np.broadcast_arrays(np.asarray(count) + 5, np.asarray(total) + 5 * kinds)
    if not kinds:
        return np.zeros(a.shape, np.int64)
    if b.size and int(b.max()) >= (1 << 63) // 1000:
        a, b = a.astype(object), b.astype(object)
    out = np.zeros_like(a)
    for _ in range(3):  # three digits at a time stay within 64 bits
        out, a = out * 1000 + a * 1000 // b, a * 1000 % b
    return (out + 1).astype(np.int64)


BLOCK = "lang string, part string, source string, item string, value long, listed long, rest long, kinds long"


def _divergences(indptr: np.ndarray, index: np.ndarray, p: np.ndarray, p0: np.ndarray, width: int, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of ``left``: the rows of ``right`` after it (all, if they are others), summed differences and listed terms."""
    sizes = np.diff(indptr)
    full = np.flatnonzero(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)

    def by_row(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes), np.int64)
        if len(full):
            out[full] = np.add.reduceat(x, indptr[full])
        return out

    same = left is right
    for a in left.tolist():
        mine, have = index[indptr[a] : indptr[a + 1]], p[indptr[a] : indptr[a + 1]]
        dense = np.full(width, p0[a], np.int64)
        dense[mine] = have
        held = np.zeros(width, np.int64)
        held[mine] = 1
        theirs = by_row(np.abs(dense[index] - p))
        shared = held[index]
        both = by_row(shared * np.abs(dense[index] - p0[owner]))
        ordered = np.sort(have)
        upto = np.append(0, np.cumsum(ordered))
        k = np.searchsorted(ordered, p0)
        alone = p0 * k - upto[k] + (upto[-1] - upto[k]) - p0 * (len(ordered) - k)  # sum of |have - p0| for every row's p0
        value, listed = theirs + alone - both, sizes + len(mine) - by_row(shared)
        with_ = right[right > a] if same else right
        yield a, with_, value[with_], listed[with_]


def _block(table: pa.Table, top: int) -> pa.Table:
    """Parts of one block: rows with a term are counts, rows without are the sources it has to answer for."""
    lang = table["lang"][0].as_py()
    heads = table.filter(pc.is_null(table["term"])).sort_by("source")
    cells = table.filter(pc.is_valid(table["term"]))
    kinds = heads["kinds"][0].as_py()
    names = heads["source"].combine_chunks()
    terms = pc.unique(cells["term"].combine_chunks())
    terms = terms.take(pc.sort_indices(terms))
    row = pc.index_in(cells["source"].combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
    col = pc.index_in(cells["term"].combine_chunks(), terms).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((col, row))
    row, col = row[order], col[order]
    n, total = cells["n"].to_numpy()[order], cells["total"].to_numpy()[order]
    of_source = heads["n"].to_numpy()
    p = parts_per_billion(n, of_source[row], kinds)
    p0 = parts_per_billion(np.zeros(len(of_source), np.int64), of_source, kinds)
    indptr = np.searchsorted(row, np.arange(len(names) + 1))
    tile = heads["tile"].to_numpy()
    tiles = np.unique(tile)
    left = np.flatnonzero(tile == tiles[0])
    diagonal = table["ti"][0].as_py() == table["tj"][0].as_py()
    right = left if diagonal else np.flatnonzero(tile == tiles[-1]) if len(tiles) > 1 else np.zeros(0, np.int64)
    out = []
    for a, with_, value, listed in _divergences(indptr, col, p, p0, len(terms), left, right):
        if len(with_):
            made = {"source": pa.array([names[a].as_py()] * len(with_), pa.string()), "item": names.take(pa.array(with_)), "value": value, "listed": listed, "rest": np.abs(p0[with_] - p0[a])}
            out.append(pa.table({"part": pa.array(["pair"] * len(with_)), **made}))
    if diagonal and len(row):
        q = parts_per_billion(total, heads["of_lang"].to_numpy()[:1], kinds)
        f = p - q
        best = np.flatnonzero(f > 0)
        best = best[np.lexsort((col[best], -f[best], row[best]))]
        begin = np.searchsorted(row[best], np.arange(len(names)))
        best = best[np.arange(len(best)) - begin[row[best]] < top]
        none = np.zeros(len(best), np.int64)
        out.append(pa.table({"part": pa.array(["term"] * len(best), pa.string()), "source": names.take(pa.array(row[best])), "item": terms.take(pa.array(col[best])), "value": f[best], "listed": none, "rest": none}))
    shape = pa.schema([("lang", pa.string()), ("part", pa.string()), ("source", pa.string()), ("item", pa.string()), *[(c, pa.int64()) for c in ("value", "listed", "rest", "kinds")]])
    if not out:
        return shape.empty_table()
    t = pa.concat_tables(out)
    t = t.append_column("lang", pa.array([lang] * t.num_rows, pa.string())).append_column("kinds", pa.array(np.full(t.num_rows, kinds), pa.int64()))
    return t.select(shape.names).cast(shape)


def audit(docs: DataFrame, least: int = 30, top: int = 50, block_rows: int = BLOCK_ROWS, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): divergences of a language's sources, and the terms that mark each."""
    kept = persist(kept_counts(term_counts(docs), least), "audit-kept")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = persist(groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), ["lang", "source"], "left"), "audit-groups")
    kinds = kept.groupBy("lang").agg(F.count_if("leads").alias("kinds"))
    langs = groups.groupBy("lang").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("of_lang"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("*").alias("m")).join(kinds, "lang", "left")
    langs = langs.select(
        "lang", "of_lang", F.coalesce("kinds", F.lit(0)).alias("kinds"),
        F.floor(F.col("rows") / block_rows + 1).cast("long").alias("blocks"), F.ceil(F.col("m") / tile).cast("long").alias("tiles"),
    )
    mine = F.pmod(F.xxhash64("source"), "tiles").alias("tile")
    # the languages' row stands at SALTS keys, so that the rows of a common language meet it in many tasks
    langs = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    data = kept.withColumn("salt", F.pmod(F.xxhash64("term", "source"), F.lit(SALTS)).cast("int")).join(langs, ["lang", "salt"]).select("lang", "source", "term", "n", "total", "kinds", "of_lang", mine, "tiles", F.pmod(F.xxhash64("term"), "blocks").alias("block"))
    heads = groups.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int")).join(langs, ["lang", "salt"]).select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(0).cast("long").alias("total"), "kinds", "of_lang", mine, "tiles",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
    )
    rows = data.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("*", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj")).drop("tiles", "other")
    parts = rows.groupBy("lang", "block", "ti", "tj").applyInArrow(lambda t: _block(t, top), BLOCK)
    parts = persist(parts, "audit-parts")
    pair = parts.filter("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"), F.sum("listed").alias("listed"), F.max("rest").alias("rest"), F.max("kinds").alias("kinds"))
    value = F.col("value") + (F.col("kinds") - F.col("listed")) * F.col("rest")
    ends = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")
    pair = pair.select("lang", "part", value.alias("value"), ends).select("lang", "x.source", "part", "x.item", "value")
    every = pair.unionByName(parts.filter("part = 'term'").select("lang", "source", "part", "item", "value"))
    best = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return every.withColumn("rank", best).filter((F.col("part") == "pair") | (F.col("rank") <= top))


op11 = audit


SQL = r"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
g as (select distinct lang, source from d),
w as (select rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as total from w group by all having count(distinct rid) >= 30),
v as (select lang, count(*) as v, sum(total) as nl from k group by lang),
c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by all),
s as (select g.lang, g.source, coalesce(sum(n), 0) as n from g left join c using (lang, source) group by all),
p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (s.n + 5 * v.v) as p,
  1 + (1000000000::hugeint * (k.total + 5)) // (v.nl + 5 * v.v) as q
  from s join k using (lang) join v using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, sum(abs(a.p - b.p)) as f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
  union all select a.lang, a.source, 'pair', b.source, 0 from g a join g b on a.lang = b.lang and a.source <> b.source where a.lang not in (select lang from v)),
f as (select * from pairs union all select lang, source, 'term', term, p - q from p where n > 0 and p > q)
select lang, source, part, item, cast(f as bigint) as value, cast(rank as integer) as rank from
  (select *, row_number() over (partition by lang, source, part order by f desc, encode(item)) as rank from f) where part = 'pair' or rank <= 50
"""
