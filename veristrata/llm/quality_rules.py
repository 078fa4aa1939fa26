"""Operator 9 - quality rules as a bitmask ledger (DataFrame functions only).

``ledger`` evaluates every rule once per document and stores the measurements and
one failure bit per rule.  ``apply_policy`` and ``ablations`` work on the ledger
alone: a policy is a named, versioned bit mask, so adding or comparing policies
never reads a text again.

Defined results: a null or empty text has zero words, all measurements 0 and fails
``too_few_words``; equal rows get equal ledgers; an empty table gives an empty
ledger; columns of the input other than those asked for never clash, as the ledger
selects only the key columns named by the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

#: Rule name -> failure condition over the measurements; the position is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("too_many_symbols", "100 * n_symbols > 10 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("odd_word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("exclamations", "100 * n_exclaims > 50 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: Versioned policies: (name, version) -> bits that reject.
POLICIES: dict[tuple[str, int], int] = {
    ("base", 1): mask("too_few_words", "repeated_words"),
    ("strict", 1): mask("too_few_words", "repeated_words", "too_many_symbols", "repeated_lines"),
    ("strict", 2): mask(*BIT),
}


def _measure(docs: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(
        *[F.col(k) for k in keys],
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_words"),
        lines.alias("_lines"),
        F.regexp_count(t, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit("!")).cast("long").alias("n_exclaims"),
    )
    d = d.select(
        *keys,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_exclaims",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    h = F.col("_h")
    windows = F.when(
        F.size(h) >= 3,
        F.transform(F.slice(h, F.lit(1), F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))),
    )
    d = d.withColumn("_tri", windows).drop("_h")
    tri = F.col("_tri")
    # texts without a repeated window skip the sort
    ordered = F.when(
        F.size(F.array_distinct(tri)) < F.size(tri),
        F.sort_array(F.transform(tri, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
    )
    d = d.withColumn("_s", ordered).drop("_tri")
    s = F.col("_s")
    hit = F.transform(s, lambda e, j: F.when((F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]), e["i"]))
    d = d.withColumn("_at", F.sort_array(F.filter(hit, lambda x: x.isNotNull()))).drop("_s")
    at = F.col("_at")
    covered = F.transform(at, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(at, k - 1))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return d.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_at")


def ledger(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys + measurements + ``fail_bits`` (one bit a rule of RULES)."""
    bits: Column = F.lit(0).cast("long")
    for i, (_, when) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(when), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return _measure(docs, keys, text).withColumn("fail_bits", bits)


def fails(policy: tuple[str, int]) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) != 0


def apply_policy(led: DataFrame, policy: tuple[str, int] = ("strict", 2), column: str = "kept") -> DataFrame:
    """Add the verdict of one policy version."""
    return led.withColumn(column, ~fails(policy))


def ablations(led: DataFrame, policy: tuple[str, int] = ("strict", 2)) -> DataFrame:
    """For each rule of a policy: documents that fail it, and that only it rejects."""
    bits = POLICIES[policy]
    own = F.col("fail_bits").bitwiseAND(F.lit(bits))
    names = [n for n in BIT if BIT[n] & bits]
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(own != 0).alias("rejected"), F.bit_or(own).alias("seen_bits")]
    for n in names:
        aggs += [F.count_if(own.bitwiseAND(F.lit(BIT[n])) != 0).alias(f"f_{n}"), F.count_if(own == BIT[n]).alias(f"o_{n}")]
    row = led.agg(*aggs)
    packed = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("failed"), F.col(f"o_{n}").alias("only_this")) for n in names])
    return row.select(F.lit(policy[0]).alias("policy"), F.lit(policy[1]).alias("version"), "n", "rejected", F.explode(packed).alias("r")).select(
        "policy", "version", "n", "rejected", "r.rule", "r.failed", "r.only_this"
    )


def op9(docs: DataFrame, policy: tuple[str, int] = ("strict", 2)) -> DataFrame:
    led = apply_policy(ledger(docs), policy)
    base = fails(("base", 1))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "fail_bits",
    )


SQL = r"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from t),
g as (select rid, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
tri as (select rid, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from g),
rep as (select rid, i from tri qualify count(*) over (partition by rid, a, b, c) > 1),
cov as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from rep) group by rid),
ln as (select rid, unnest(string_split(text, chr(10))) as line from t),
dl as (select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup from ln where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
m as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
  cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(regexp_extract_all(text, '!')) as bigint) as n_ex,
  cast(coalesce(dl.n_lines, 0) as bigint) as n_lines, cast(coalesce(dl.n_dup, 0) as bigint) as n_dup_lines, cast(coalesce(cov.n, 0) as bigint) as n_repeat_words
  from w left join dl using (rid) left join cov using (rid)),
b as (select *, (case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
  + (case when 100 * n_symbols > 10 * n_words then 4 else 0 end) + (case when 100 * n_dup_lines > 30 * n_lines then 8 else 0 end)
  + (case when word_chars < 2 * n_words or word_chars > 20 * n_words then 16 else 0 end) + (case when 100 * n_ex > 50 * n_words then 32 else 0 end) as fb from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fb & 3) <> 0 as base_failed, fb = 0 as kept, cast(fb as bigint) as fail_bits from b
"""
