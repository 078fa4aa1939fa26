"""Operator 12 - prefix trie of conversations.

1. ``rebuilt``: turns in order, each with a digest of (role, text); conversations get the
   head of the conversation that they continue.
2. ``prefixes``: every row gets the identity of its prefix, two running XORs of hashes of
   (depth, turn digest), so equal prefixes meet by key and no sequence is ever sent whole.
3. Subtries of a first turn are dealt to buckets by its digest.  A subtrie of more than
   LIMIT turns is repartitioned by its next turn, and again, until what hangs below a
   prefix fits: prefix sizes of the oversized ones are counted in one aggregation, and each
   conversation leaves for the subtrie of its first prefix that fits.
4. ``build``: applyInPandas, one dictionary of pointers a node, subtree values by an
   iterative postorder over all subtries of a bucket.
5. Prefixes above (the root and every prefix too large for a bucket) are summed from below:
   a node's value stands at its smallest member, each such member carries its running sum
   from the end of its path to every prefix it starts with, and one aggregation by prefix
   adds them up.  Nothing of a hot prefix is ever in one task.

Defined results: a null role or text is ''; rows of one turn (ties) are ordered by role, the
text's first 64 characters and the digest; repeated rows are turns of their own; rows with a
null conv_id belong to no conversation; a conversation left without turns is a member of the
root only; texts count whole, however long; an empty table has no node; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import persist

LIMIT = 4096
EVERY = 20
HEADS = 4
END_IDS = 4096
SALTS = 32

_WORD = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_key, words): turns in order; texts stay behind, their digests go on."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    c = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.left(text, F.lit(64)).alias("begin"), key.alias("turn_key"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "begin", "turn_key")
    return c.select("conv_id", F.row_number().over(order).alias("pos"), "turn_key", "words")


def rebuilt(ordered: DataFrame, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    """Conversations with the first h turns of the one they continue; h is crc32(conv_id) % heads.  Position 0 is the root."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.col("conv_id") % every
    who = ordered.filter("pos = 1").select("conv_id", base.alias("base"), h.alias("h"))
    begin = ordered.filter((F.col("pos") < heads) & (F.col("conv_id") == base)).select(F.col("conv_id").alias("base"), "pos", "turn_key", "words")
    copied = who.join(begin, "base").filter("pos <= h").select("conv_id", "pos", "turn_key", "words")
    root = who.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("long").alias("words"))
    return ordered.filter(F.col("pos") > h).unionByName(copied).unionByName(root)


def prefixes(sequences: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_key, words) -> one row a prefix of every conversation.

    (x, y) identifies the prefix of ``depth`` turns, (px, py) that of one turn less,
    (fx, fy) that of the first turn; ``size`` is the conversation's number of turns.
    """
    mine = W.partitionBy("conv_id").orderBy("pos")
    p = sequences.withColumn("depth", F.row_number().over(mine) - 1)
    none = F.lit(0).cast("long")
    zx = F.when(F.col("depth") > 0, F.xxhash64("depth", "turn_key")).otherwise(none)
    zy = F.when(F.col("depth") > 0, F.xxhash64("turn_key", "depth")).otherwise(none)
    upto = W.partitionBy("conv_id").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    p = p.select("conv_id", "depth", "turn_key", "words", zx.alias("zx"), zy.alias("zy"), F.max("depth").over(W.partitionBy("conv_id")).alias("size"))
    p = p.withColumn("x", F.bit_xor("zx").over(upto)).withColumn("y", F.bit_xor("zy").over(upto))
    first = [F.max(F.when(F.col("depth") == 1, F.col(c))).over(upto).alias(f"f{c}") for c in ("x", "y")]
    parent = [F.col("x").bitwiseXOR(F.col("zx")).alias("px"), F.col("y").bitwiseXOR(F.col("zy")).alias("py")]
    return p.select("conv_id", "depth", "turn_key", "words", "size", "x", "y", *parent, *first)


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
BUILT = NODE + ", top boolean, px long, py long"


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of all subtries of a bucket; ``top`` marks their roots, (px, py) the prefix that those hang from."""
    rows = rows.sort_values(["conv_id", "depth"], kind="stable")
    roots: dict[tuple[int, int], int] = {}
    child: list[dict[bytes, int]] = []
    first: list[int] = []
    depth: list[int] = []
    words: list[int] = []
    parent: list[int] = []
    convs: list[int] = []
    ends: list[list[bytes]] = []
    above: list[tuple[int, int]] = []
    at, last = -1, None
    for conv, d, key, w, size, x, y, px, py in rows[["conv_id", "depth", "turn_key", "words", "size", "x", "y", "px", "py"]].itertuples(index=False, name=None):
        # conversations come in ascending order: who makes a node is its smallest member
        new = conv != last
        where, name = (roots, (x, y)) if new else (child[at], bytes(key))
        node = where.get(name)
        if node is None:
            node = where[name] = len(child)
            child.append({})
            first.append(conv)
            depth.append(d)
            words.append(w)
            parent.append(-1 if new else at)
            convs.append(0)
            ends.append([])
            above.append((px, py))
        convs[node] += 1
        if d == size:
            ends[node].append(b"%d" % conv)
        at, last = node, conv
    n = len(child)
    leaves, saved = [0] * n, [0] * n
    stack = [(r, False) for r in roots.values()]
    while stack:
        node, done = stack.pop()
        if not done:
            stack.append((node, True))
            stack += [(c, False) for c in child[node].values()]
            continue
        leaves[node] += not child[node]
        saved[node] += (convs[node] - 1) * words[node]
        if (up := parent[node]) >= 0:
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    return pd.DataFrame(
        {
            "conv_id": first, "depth": depth, "parent_conv_id": pd.array([first[p] if p >= 0 else None for p in parent], dtype="Int64"), "n_convs": convs,
            "n_children": [len(c) for c in child], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": [hashlib.sha256(b",".join(e)).hexdigest() for e in ends],
            "top": [p < 0 for p in parent], "px": [a[0] for a in above], "py": [a[1] for a in above],
        }
    )


def _digests(ends: DataFrame) -> DataFrame:
    """(x, y, depth, conv_id) -> (x, y, depth, ends_sha256): ids in stretches, then one pass over the stretches of a prefix."""
    some = ends.groupBy("x", "y", "depth", F.floor(F.col("conv_id") / END_IDS).alias("stretch")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, hashlib.sha256()

        def out(key: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, sha.hexdigest())], names=["x", "y", "depth", "ends_sha256"])

        for batch in batches:
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if key == last:
                    sha.update(b",")
                else:
                    if last is not None:
                        yield out(tuple(last))
                    last, sha = key, hashlib.sha256()
                sha.update(ids.encode())
        if last is not None:
            yield out(tuple(last))

    ordered = some.select("x", "y", F.col("depth").cast("long").alias("depth"), "stretch", "ids").repartition("x", "y", "depth").sortWithinPartitions("x", "y", "depth", "stretch")
    return ordered.mapInArrow(run, "x long, y long, depth long, ends_sha256 string")


_AT = ["depth", "x", "y"]


def _marked(rows: DataFrame, few: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Left join of the rows with a column of ``few`` keys, each at SALTS places, so that the rows of a common key stay spread."""
    f = few.select(*keys, F.lit(True).alias(flag), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(f, [*keys, "_salt"], "left").drop("_salt")


def _split(paths: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows that subtries in buckets take, rows of the prefixes above them)."""
    below = paths.filter("depth > 0")
    large = below.groupBy("fx", "fy").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    marked = persist(_marked(below, large, ["fx", "fy"], "large"), "trie-marked")
    fits, over = marked.filter("large is null"), marked.filter("large")
    # turns below each prefix of an oversized first turn; those that do not fit are parted by their next turn
    tall = over.groupBy(*_AT).agg(F.sum(F.col("size") - F.col("depth") + 1).alias("n")).filter(F.col("n") > limit)
    over = persist(_marked(over, tall, _AT, "tall"), "trie-over")
    leaves = over.filter("tall is null")
    mine = W.partitionBy("conv_id")
    down = leaves.withColumn("_s", F.min(F.struct("depth", "x", "y")).over(mine)).withColumn("fx", F.col("_s.x")).withColumn("fy", F.col("_s.y")).drop("_s", "tall")
    return fits.drop("large").unionByName(down.drop("large")), over.filter("tall").drop("tall", "large").unionByName(paths.filter("depth = 0"))


def _above(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes of the prefixes that no bucket holds; ``tops`` are the roots of the subtries below them."""
    node = rows.groupBy(*_AT, "px", "py").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"))
    up = F.col("depth") - 1
    hung = tops.select(up.alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).unionByName(node.filter("depth > 0").select(up.alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")))
    node = node.join(hung.groupBy(*_AT).agg(F.count("*").alias("n_children")), _AT, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    node = persist(node, "trie-above")
    # what each smallest member brings, at the depth where it brings it
    own = node.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    given = own.unionByName(tops.select("conv_id", up.alias("depth"), "n_leaves", "saved_tokens")).groupBy("conv_id", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    path = rows.join(given.select("conv_id").distinct(), "conv_id").select("conv_id", *_AT).join(given, ["conv_id", "depth"], "left")
    on = W.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    path = path.select(*_AT, *[F.coalesce(F.sum(c).over(on), F.lit(0)).alias(c) for c in ("n_leaves", "saved_tokens")])
    total = path.groupBy(*_AT).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ended = _digests(rows.filter("depth = size").select("x", "y", "depth", "conv_id"))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return node.join(total, _AT).join(ended, _AT, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))


def trie(paths: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Nodes of the trie of all conversations in ``paths`` (see prefixes())."""
    paths = persist(paths, "trie-paths")
    inside, over = _split(paths, limit)
    bucket = F.pmod(F.xxhash64("fx", "fy"), F.lit(paths.count() // limit + 1))
    # the applied frame is named by its bucket alone: a bucket holds whole subtries, each within the limit
    built = inside.select("conv_id", F.col("depth").cast("long").alias("depth"), "turn_key", "words", F.col("size").cast("long").alias("size"), "x", "y", "px", "py", bucket.alias("bucket"))
    built = persist(built.groupBy("bucket").applyInPandas(build, BUILT), "trie-built")
    tops = built.filter("top")
    above = persist(_above(over, tops), "trie-nodes")
    # a node's parent is above too, unless it was built in the same bucket
    name = above.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent"))
    hung = tops.drop("parent_conv_id").join(name, ["depth", "px", "py"])
    high = above.filter("depth > 0").join(name, ["depth", "px", "py"]).unionByName(above.filter("depth = 0").withColumn("parent", F.lit(None).cast("long")))
    columns = [c.split()[0] for c in NODE.split(", ")]

    def out(df: DataFrame, parent: Column) -> DataFrame:
        return df.withColumn("parent_conv_id", parent).select(*[F.col(c).cast("string" if c == "ends_sha256" else "long").alias(c) for c in columns])

    return out(built.filter("not top"), F.col("parent_conv_id")).unionByName(out(hung, F.col("parent"))).unionByName(out(high, F.col("parent")))


def op12(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    ordered = persist(turns(conversations), "trie-turns")
    return trie(prefixes(rebuilt(ordered)), limit)


SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
t as (select conv_id, turn, role, left(text, 64) as b, md5(length(role) || ':' || role || text) as k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from c),
o as (select conv_id, k, words, row_number() over (partition by conv_id order by turn nulls first, role, b, k) as pos from t),
i as (select distinct conv_id, conv_id - conv_id % 20 as base, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]) as code from o),
h as (select conv_id, base, xor(list_reduce(list_prepend(4294967295::bigint, flatten(code)), lambda a, x: case when x >= 0 then xor(a, x::bigint) when a % 2 = 1 then xor(a // 2, 3988292384::bigint) else a // 2 end), 4294967295::bigint) % 4 as h from i),
r as (select h.conv_id, pos, k, words from h join o on o.conv_id = h.base where pos <= h union all select conv_id, pos, k, words from o join h using (conv_id) where pos > h
  union all select conv_id, 0, '', 0 from h),
p as (select conv_id, words, k, row_number() over (partition by conv_id order by pos) - 1 as d from r),
x as (select conv_id, words, d, string_agg(k, '') over (partition by conv_id order by d) as x, d = max(d) over (partition by conv_id) as stop from p),
n as (select x, max(d) as d, count(*) as n, min(conv_id) as mn, max(words) as w, case when max(d) > 0 then left(x, length(x) - 32) end as up,
  string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (stop) as ends from x group by x),
k as (select up, count(*) as kids from n group by up),
v as (select n.*, coalesce(kids, 0) as kids from n left join k on k.up = n.x),
s as (select x.x, sum(case when mn = conv_id then (n - 1) * w else 0 end) over u as saved, sum(case when mn = conv_id and kids = 0 then 1 else 0 end) over u as leaves
  from x join v using (x) window u as (partition by conv_id order by x.d desc rows unbounded preceding)),
q as (select x, sum(saved) as saved, sum(leaves) as leaves from s group by x)
select v.mn as conv_id, v.d as depth, m.mn as parent_conv_id, v.n as n_convs, v.kids as n_children, cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens,
  sha256(coalesce(v.ends, '')) as ends_sha256 from v join q using (x) left join n m on m.x = v.up
"""
