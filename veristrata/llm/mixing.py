"""Operator 10 - mixing sources to target weights (Efraimidis-Spirakis sampling).

Every document draws the exponential key ``-ln(u) / w`` with ``u`` from an md5 of its id,
text and a seed and ``w`` its quality weight; taking documents of a source in ascending key
order is weighted sampling without replacement.  A source takes every document
``floor(target / size)`` times (complete epochs) and then, in key order, documents
until the rest of its target is filled; the document at the line gives only its first
words, so a source meets its target to the word.

No source is ever sorted as a whole.  Keys fall into logarithmic buckets (64 an
octave), the budget line is found on per-bucket sums, refined once inside the bucket at
the line (256 parts), and only the rows of that one part are ordered, by range
partitions; all other rows are wholly in or out.  The parts shrink with the keys, not
with a cap: a source of 10^10 rows orders about 2 * 10^5.  Running sums over the sources
go by range partitions too, so any number of sources will do.

Defined results: a null text has size 0 and takes 0; a very long text is a document like
any other; a null source is a source of its own (ordered last); ``u`` comes from id and
text, so rows without an id draw keys by their text; equal rows draw equal keys (ties) and
are interchangeable, they may be taken differently at the line; columns of clashing names
pass through ``mixed_rows`` as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import running
from .storage import persist

WORD = r"[^\x20\x09-\x0D]+"
OCTAVE_PARTS, BUCKET_PARTS = 64, 256
#: Above this many sources their table is joined by shuffle.
BROADCAST_SOURCES = 50_000


def quality_weight(text: Column, size: Column) -> Column:
    """Default document weight in (0, 1]: falls with the share of markup symbols."""
    return (size + 1) / (size + 1 + 4 * F.regexp_count(text, F.lit(r"[#*$%&|<>]")))


def keyed(docs: DataFrame, seed: int = 17, payload: bool = False) -> DataFrame:
    """doc_id, source, size, tie, key and the key's buckets, one row per input row (and the row, if asked)."""
    t = F.coalesce("text", F.lit(""))
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if payload else []
    d = docs.select("doc_id", "source", F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"), t.alias("_t"), F.md5(t.cast("binary")).alias("tie"), *whole)
    drawn = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)), "tie").cast("binary"))
    u = (F.conv(F.substring(drawn, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    key = -F.log(u) / quality_weight(F.col("_t"), F.col("size"))
    d = d.select("doc_id", "source", "size", "tie", key.alias("key"), *(["row"] if payload else []))
    d = d.withColumn("b1", F.floor(F.log2("key") * OCTAVE_PARTS).cast("int"))
    octave = F.pow(F.lit(2.0), F.col("b1") / F.lit(float(OCTAVE_PARTS)))
    return d.withColumn("b2", F.floor((F.col("key") / octave - 1) / (2.0 ** (1 / OCTAVE_PARTS) - 1) * BUCKET_PARTS).cast("int"))


def targets(sizes: DataFrame, cycle: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> + target: shares by weight, capped, the excess reshared.

    Water filling in closed form: with sources ordered by cap / weight, the level is
    the first ``(total - caps before) / (weights from here)`` that does not pass the
    source's own ratio; each target is ``min(cap, level * weight)``.  The table has one
    row per source; only sums over it and the level reach the driver.
    """
    s = running(sizes, [F.col("source").isNull(), F.col("source")], {"_n": F.lit(1)}, tag="mix-order")
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (F.col("_n") % len(cycle) + 1).cast("int"))
    s = s.withColumn("_w", weight).withColumn("_cap", F.lit(cap) * F.col("source_size"))
    s = running(s.withColumn("_r", F.col("_cap") / F.col("_w")), [F.col("_r"), F.col("_n")], {"_caps": F.col("_cap"), "_weights": F.col("_w")}, tag="mix-levels")
    s = persist(s, "mix-sources")
    whole = s.agg(F.sum("source_size").alias("n"), F.sum("_w").alias("w")).first()
    level = (F.lit(share * (whole["n"] or 0)) - F.col("_caps")) / (F.lit(whole["w"] or 0.0) - F.col("_weights"))
    at = s.withColumn("_level", level).filter("_level <= _r").agg(F.min(F.struct("_r", "_n", "_level")).alias("l")).first()["l"]
    target = F.col("_cap") if at is None else F.least(F.col("_cap"), F.lit(at["_level"]) * F.col("_w"))
    return s.select("source", "source_size", target.alias("target"))


def _line(rows: DataFrame, part: str, budgets: DataFrame) -> DataFrame:
    """Per source, the part that holds the budget line and what is left for it."""
    sums = rows.groupBy("source", part).agg(F.sum("size").alias("n"))
    w = W.partitionBy("source").orderBy(part)
    s = sums.withColumn("upto", F.sum("n").over(w))
    s = s.join(budgets.select(F.col("source").alias("_b"), "left"), F.col("source").eqNullSafe(F.col("_b")))
    at = s.filter((F.col("upto") - F.col("n") < F.col("left")) & (F.col("upto") >= F.col("left")))
    return at.groupBy("source").agg(F.min(part).alias("cut"), F.min(F.col("left") - F.col("upto") + F.col("n")).alias("left"))


def mix(
    docs: DataFrame, seed: int = 17, cycle: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, payload: bool = False
) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, part, taken (and ``row``), one row per input row.

    ``part`` words beyond the complete epochs come from the document's beginning.
    """
    rows = persist(keyed(docs, seed), "mix-keys")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", whole)
    plan = persist(plan.withColumn("left", F.round("target").cast("long") - F.col("epochs") * F.col("source_size")), "mix-plan")
    first = persist(_line(rows, "b1", plan.filter("left > 0").select("source", "left")), "mix-first")
    small = plan.count() <= BROADCAST_SOURCES  # one short row a source
    at = first.select(F.col("source").alias("_s"), "cut")
    at = F.broadcast(at) if small else at
    edge = rows.join(at, F.col("source").eqNullSafe(F.col("_s")) & (F.col("b1") == F.col("cut"))).drop("_s", "cut")
    second = _line(edge, "b2", first.select("source", "left"))
    lines = plan.join(first.select(F.col("source").alias("_s1"), F.col("cut").alias("c1")), F.col("source").eqNullSafe(F.col("_s1")), "left")
    lines = lines.join(
        second.select(F.col("source").alias("_s2"), F.col("cut").alias("c2"), F.col("left").alias("rest")), F.col("source").eqNullSafe(F.col("_s2")), "left"
    )
    lines = persist(lines.select(F.col("source").alias("_s"), "source_size", "target", "epochs", "left", "c1", "c2", "rest"), "mix-lines")
    base = keyed(docs, seed, True) if payload else rows
    out = base.join(F.broadcast(lines) if small else lines, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    same = (F.col("b1") == F.col("c1")) & (F.col("left") > 0)
    out = out.withColumn("_line", F.coalesce(same & (F.col("b2") == F.col("c2")), F.lit(False)))
    out = out.withColumn("_in", F.coalesce((F.col("left") > 0) & ((F.col("b1") < F.col("c1")) | (same & (F.col("b2") < F.col("c2")))), F.lit(False)))
    keep = ["doc_id", "source", "size", "source_size", "target", "epochs", *(["row"] if payload else [])]
    clear = out.filter(~F.col("_line")).select(*keep, F.when(F.col("_in"), F.col("size")).otherwise(F.lit(0)).cast("long").alias("part"))
    edged = out.filter("_line").withColumn("_own", F.monotonically_increasing_id())  # tells equal rows apart
    edged = running(edged, [F.col(c) for c in ("key", "doc_id", "tie", "size", "_own")], {"_before": F.col("size")}, ["source"], "mix-edge")
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("_before"))).cast("long")
    edged = edged.withColumn("part", part).select(*keep, "part")
    return clear.unionByName(edged).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))


def mixed_rows(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, repeats included, with the same columns.

    The one document at a source's budget line that is taken in part keeps its first
    words, joined by single spaces.
    """
    m = mix(docs, payload=True, **parameters)
    cut = F.col("part") < F.col("size")
    copies = F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)
    m = m.filter(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    short = (F.col("_copy") > F.col("epochs")) & cut
    words = F.regexp_extract_all(F.coalesce(F.col("row.text"), F.lit("")), F.lit(WORD), F.lit(0))
    text = F.when(short, F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), " ")).otherwise(F.col("row.text"))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(text.alias(c))
        elif c == "n_chars":
            out.append(F.when(short, F.length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    return m.select(*out)


def op10(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "epochs")


SQL = r"""
with d as (select doc_id, source, coalesce(text, '') as t, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
k as (select *, md5(t) as tie, cast(size + 1 as double) / cast(size + 1 + 4 * len(regexp_extract_all(t, '[#*$%&|<>]')) as double) as w from d),
e as (select *, -ln((cast(cast('0x' || substr(md5(concat_ws(':', coalesce(cast(doc_id as varchar), ''), '17', tie)), 1, 12) as bigint) as double) + 0.5) / 281474976710656.0) / w as key from k),
s as (select source, cast(sum(size) as double) as n, row_number() over (order by source nulls last) - 1 as i from e group by source),
w as (select *, [3.0, 1.0, 2.0][i % 3 + 1]::double as w, 2.0 * n as cap, sum(n) over () * 1.5 as total from s),
r as (select *, cap / w as ratio, coalesce(sum(cap) over (order by cap / w, i rows between unbounded preceding and 1 preceding), 0) as caps,
  sum(w) over () - coalesce(sum(w) over (order by cap / w, i rows between unbounded preceding and 1 preceding), 0) as rest from w),
l as (select (total - caps) / rest as level from r where (total - caps) / rest <= ratio order by ratio, i limit 1),
p as (select source, cast(n as bigint) as source_size, least(cap, coalesce((select level from l) * w, cap)) as target from r),
q as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from p),
o as (select e.doc_id, e.size, q.source_size, q.target, q.epochs, cast(round(q.target) as bigint) - q.epochs * q.source_size as budget,
  coalesce(sum(e.size) over (partition by e.source order by e.key, e.doc_id, e.tie, e.size rows between unbounded preceding and 1 preceding), 0) as before
  from e join q on e.source is not distinct from q.source)
select doc_id, size, source_size, target, cast(epochs * size + least(size, greatest(0, budget - before)) as bigint) as taken, epochs from o
"""
