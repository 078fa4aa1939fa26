"""Operator 13 - licence scan with a positional index of rare tokens.

The index lists, for every template, the highest-IDF words (over the templates) of its
mandatory key phrase with their positions.  A file's words are looked up in it; a hit of a
template's rarest word at position i, listed at j, proposes the alignment i - j, the next
postings of the template are intersected at the same relative position, and what is left is
verified: every word of the key phrase in its place, and at least NEED of the template's
words.  As the key phrase is mandatory in whole, no alignment is lost to the index.  Base
phrases are templates that are all key phrase.

One pass, no exchange; the index is a few hundred words, whatever the input.  Word
identity is a 64-bit hash to find postings; every accepted alignment is compared with the
template byte by byte.

Defined results: a null or empty text has no words, no places (nulls for first and last)
and score 0; repeated rows get equal rows; places may overlap and all count; texts are
never cut; the score is the largest share of a template's words in place among what was
accepted; extra columns are ignored, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean, small_batches
from .textkernel import Words, text_blocks, word_hashes

NEED = (3, 4)
POSTINGS = 3

# Phrases and labels of the base, asked for as they stand.
BASE: tuple[tuple[str, str], ...] = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

# Notices as the licences word them: label, notice, key phrase in it.
NOTICES: tuple[tuple[str, str, str], ...] = (
    ("agpl", "This program is licensed under the GNU Affero General Public License", "gnu affero general public license"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the License", "use this file except in compliance"),
    ("artistic-2.0", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed", "changing it is not allowed"),
    ("boost-1.0", "Distributed under the Boost Software License, Version 1.0", "boost software license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "source and binary forms"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4 0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", "cc by nd"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived all copyright"),
    ("gpl-2.0", "either version 2 of the License, or (at your option) any later version", "version 2 of the license"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    ("gpl-3.0", "either version 3 of the License, or (at your option) any later version", "version 3 of the license"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License", "gnu lesser general public license"),
    ("mit", "Released under the MIT License", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "free of charge to any person"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SEP = np.ones(256, bool)
_SEP[0x30:0x3A] = _SEP[0x41:0x5B] = _SEP[0x61:0x7B] = _SEP[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words_of(text: str) -> list[str]:
    """Words of a notice, A-Z lower-cased."""
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


@dataclass
class Template:
    label: str
    base: bool
    words: list[str]
    key: list[int]  # positions of the key phrase
    need: int
    postings: list[int] = field(default_factory=list)  # rarest key positions, rarest first


def templates(base: Sequence[tuple[str, str]] = BASE, notices: Sequence[tuple[str, str, str]] = NOTICES) -> list[Template]:
    """Templates with their postings: the POSTINGS highest-IDF words of each key phrase."""
    made = [Template(label, True, w := words_of(phrase), list(range(len(w))), len(w)) for label, phrase in base]
    for label, notice, phrase in notices:
        w, k = words_of(notice), words_of(phrase)
        at = next((i for i in range(len(w)) if w[i : i + len(k)] == k), None)
        if at is None:
            raise ValueError(f"the key phrase of {label} is not in its notice: {phrase}")
        made.append(Template(label, False, w, list(range(at, at + len(k))), -(-len(w) * NEED[0] // NEED[1])))
    found: dict[str, int] = {}
    for t in made:
        for w in set(t.words):
            found[w] = found.get(w, 0) + 1
    idf = {w: math.log(len(made) / n) for w, n in found.items()}
    for t in made:
        t.postings = sorted(t.key, key=lambda j: (-idf[t.words[j]], -len(t.words[j]), j))[:POSTINGS]
    return made


def _hash(words: Sequence[str]) -> np.ndarray:
    raw = " ".join(words).encode()
    buf = np.frombuffer(raw, np.uint8)
    return word_hashes(buf, Words(buf, np.array([0, len(raw)]), _SEP))


class Index:
    """Postings of the rarest words: sorted word hashes, each with its (template, position) pairs."""

    def __init__(self, made: Sequence[Template]):
        self.templates = list(made)
        self.hashes = [_hash(t.words) for t in made]
        pairs = sorted((int(self.hashes[k][t.postings[0]]), k, t.postings[0]) for k, t in enumerate(made))
        self.seed_hash = np.array([p[0] for p in pairs], np.uint64)
        self.seed_template = np.array([p[1] for p in pairs], np.int64)
        self.seed_at = np.array([p[2] for p in pairs], np.int64)

    def alignments(self, buf: np.ndarray, words: Words) -> tuple[np.ndarray, ...]:
        """(row, template, first word within the row, words in place) of everything accepted, in that order."""
        h = word_hashes(buf, words)
        lo, hi = np.searchsorted(self.seed_hash, h, "left"), np.searchsorted(self.seed_hash, h, "right")
        at = np.flatnonzero(hi > lo)
        n = (hi - lo)[at]
        which = np.repeat(lo[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, template = np.repeat(at, n), self.seed_template[which]
        start = at - self.seed_at[which]
        out = []
        for k in np.unique(template).tolist():
            t, own = self.templates[k], self.hashes[k]
            s, anchor = start[template == k], at[template == k]
            row = words.row[anchor]
            begin, end = words.first[row], words.first[row + 1]
            for j in [*t.postings[1:], *(j for j in t.key if j not in t.postings)]:  # intersect at the relative position, then the whole phrase
                i = s + j
                ok = (i >= begin) & (i < end)
                ok[ok] = h[i[ok]] == own[j]
                s, row, begin, end = s[ok], row[ok], begin[ok], end[ok]
            placed = np.zeros((len(s), len(own)), bool)
            for j in range(len(own)):
                i = s + j
                ok = (i >= begin) & (i < end)
                ok[ok] = h[i[ok]] == own[j]
                placed[:, j] = ok
            for r, j in zip(*np.nonzero(placed), strict=True):  # alignments are few; hashes only proposed them
                i = s[r] + j
                placed[r, j] = _LOWER[buf[words.starts[i] : words.ends[i]]].tobytes() == t.words[j].encode()
            matched = placed.sum(1)
            good = placed[:, t.key].all(1) & (matched >= t.need)
            out.append((row[good], np.full(int(good.sum()), k), (s - begin)[good], matched[good]))
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        row, template, start, matched = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((start, template, row))
        return row[order], template[order], start[order], matched[order]


def spans(docs: DataFrame, made: Sequence[Template] | None = None) -> DataFrame:
    """(doc_id, label, base, first_word, n_words, matched): one row for every place where a template was accepted.

    ``first_word`` is negative where a notice begins before the text does.
    """
    small_batches(docs.sparkSession)
    index = Index(templates() if made is None else made)
    labels = pa.array([t.label for t in index.templates])
    base = np.array([t.base for t in index.templates])
    sizes = np.array([len(t.words) for t in index.templates], np.int64)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, buf, offs in text_blocks(batch.column(1)):
                row, template, start, matched = index.alignments(buf, Words(buf, offs, _SEP))
                ids = batch.column(0).take(pa.array(row + lo))
                yield pa.RecordBatch.from_arrays([ids, labels.take(pa.array(template)), pa.array(base[template]), pa.array(start), pa.array(sizes[template]), pa.array(matched)], names=names)

    schema = "doc_id long, label string, base boolean, first_word long, n_words long, matched long"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


class _Named:
    """Sets of labels as bits, and their texts."""

    def __init__(self, made: Sequence[Template]):
        self.labels = sorted({t.label for t in made})
        if len(self.labels) > 62:
            raise ValueError("at most 62 labels")
        self.bit = np.array([1 << self.labels.index(t.label) for t in made], np.int64)

    def texts(self, bits: np.ndarray) -> pa.Array:
        kinds, inverse = np.unique(bits, return_inverse=True)
        said = [",".join(x for i, x in enumerate(self.labels) if b >> i & 1) for b in kinds.tolist()]
        return pa.array(said, pa.string()).take(pa.array(inverse))


def scan(docs: DataFrame, made: Sequence[Template] | None = None) -> DataFrame:
    """One row a document: places and labels of the base phrases, labels of all templates, score."""
    small_batches(docs.sparkSession)
    index = Index(templates() if made is None else made)
    named = _Named(index.templates)
    base = np.array([t.base for t in index.templates])
    sizes = np.array([len(t.words) for t in index.templates], np.int64)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    names = [c.split()[0] for c in schema.split(", ")]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_blocks(batch.column(1)):
                words = Words(buf, offs, _SEP)
                row, template, start, matched = index.alignments(buf, words)
                m = hi - lo
                bits, base_bits, score = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m)
                np.bitwise_or.at(bits, row, named.bit[template])
                np.maximum.at(score, row, matched / sizes[template])
                b = base[template]
                np.bitwise_or.at(base_bits, row[b], named.bit[template[b]])
                places = np.bincount(row[b], minlength=m)
                first, last = np.full(m, np.iinfo(np.int64).max), np.full(m, -1)
                np.minimum.at(first, row[b], start[b])
                np.maximum.at(last, row[b], start[b])
                no = places == 0
                columns = [batch.column(0).slice(lo, m), pa.array(words.counts()), pa.array(places), pa.array(first, mask=no), pa.array(last, mask=no)]
                yield pa.RecordBatch.from_arrays([*columns, named.texts(base_bits), named.texts(bits), pa.array(score)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


op13 = scan


def _sql() -> str:
    made = templates()
    rows = ", ".join(f"({k}, {j}, '{w}', {str(j in t.key).lower()})" for k, t in enumerate(made) for j, w in enumerate(t.words))
    kinds = ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, {t.need}, {len(t.key)}, {len(t.words)})" for k, t in enumerate(made))
    return rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
w as (select rid, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as i from d),
t(k, j, word, is_key) as (values {rows}),
u(k, label, base, need, n_key, size) as (values {kinds}),
a as (select rid, k, i - j as o, count(*) as matched, count(*) filter (is_key) as keys from w join t using (word) group by all),
f as (select rid, o, label, base, matched / cast(size as double) as share from a join u using (k) where matched >= need and keys = n_key),
s as (select rid, count(*) filter (base) as n_base, min(o) filter (base) as first_word, max(o) filter (base) as last_word,
  string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score from f group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score from d left join s using (rid)
"""


SQL = _sql()
