"""Source audit, prefix trie and licence scan against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from veristrata.llm import license_scan, prefix_trie, source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# ------------------------------------------------------------------ 11


def audited(rows, least, top):
    docs = [(lang or "", source or "", TERM.findall(lower(text or ""))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df = Counter(t for g, _, ts in docs if g == lang for t in set(ts))
        kept = sorted(t for t in df if df[t] >= least)
        count = {s: Counter() for g, s, _ in docs if g == lang}
        for g, s, ts in docs:
            if g == lang:
                count[s].update(t for t in ts if df[t] >= least)
        total = sum(count.values(), Counter())

        def p(c, kept=kept):
            n = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // n for t in kept}

        q = p(total)
        ps = {s: p(c) for s, c in count.items()}
        for s in count:
            pairs = [(-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode(), o) for o in count if o != s]
            terms = [(-(ps[s][t] - q[t]), t.encode(), t) for t in kept if count[s][t] and ps[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, name, -v, i + 1) for i, (v, _, name) in enumerate(found)}
    return out


def got(df):
    found = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize(("block_rows", "tile"), [(200_000, 512), (7, 2)])
def test_audit(docs, rows, block_rows, tile):
    assert got(source_audit.audit(docs, 2, 3, block_rows, tile)) == audited([(r[1], r[2], r[3]) for r in rows], 2, 3)


def test_audit_of_rare_terms_and_odd_rows(spark, nothing):
    rows = [("Bé bé BE", "x", "s"), ("bé", "x", "t"), (None, "x", None), ("only", None, "s"), ("12 34", "y", "a"), ("", "y", "b")]
    df = spark.createDataFrame([(i, t, g, s, 1, 9) for i, (t, g, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, df long, rank int")
    for least in (1, 2, 30):  # at 30 no term is kept: every pair is 0
        assert got(source_audit.audit(df, least, 50)) == audited(rows, least, 50)
    assert source_audit.op11(nothing).count() == 0


def test_slices_are_grouped_by_their_bytes():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcXYZé") for _ in range(rng.randrange(1, 45))) for _ in range(300)] * 3
    raw = " ".join(words).encode()
    buf = np.frombuffer(raw, np.uint8)
    ends = np.append(np.flatnonzero(buf == 32), len(buf))
    starts = np.append(0, ends[:-1] + 1)
    for hashed in (source_audit.xxh64, lambda m: source_audit.xxh64(m) % np.uint64(3)):  # collisions
        ids, terms = source_audit.group_slices(buf, starts, ends, hashed)
        assert [terms[i].as_py() for i in ids.tolist()] == [lower(w) for w in words]
        assert len(terms) == len(set(map(lower, words)))
    for size in range(1, 40):
        m = np.frombuffer(rng.randbytes(size * 5), np.uint8).reshape(5, size)
        assert source_audit.xxh64(m).tolist() == [xxhash.xxh64_intdigest(r.tobytes()) for r in m]


def test_parts_are_exact():
    for count, total, kinds in [(0, 0, 3), (5, 5, 1), (10**14, 10**15, 10**9), (10**17, 10**18, 10**12), (0, 0, 0)]:
        want = 1 + 10**9 * (count + 5) // (total + 5 * kinds) if kinds else 0
        assert source_audit.parts_per_billion(np.array([count]), np.array([total]), kinds).tolist() == [want]


# ------------------------------------------------------------------ 12


def trie_of(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0), role, text[:64], hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(r, t) for _, r, _, _, t in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        seqs[c] = tuple(own.get(base, [])[:h] + v[h:])
    nodes = {s[:d] for s in seqs.values() for d in range(len(s) + 1)}
    members = {n: sorted(c for c, s in seqs.items() if s[: len(n)] == n) for n in nodes}
    kids = Counter(n[:-1] for n in nodes if n)
    out = set()
    for n in nodes:
        sub = [m for m in nodes if m[: len(n)] == n]
        ends = ",".join(str(c) for c in members[n] if seqs[c] == n)
        saved = sum((len(members[m]) - 1) * len(WORD.findall(m[-1][1])) for m in sub if m)
        out.add((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), kids[n], sum(not kids[m] for m in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(8)
    rows = []
    for c in range(-25, 140):
        for t in range(rng.randrange(0, 6)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "a  b c\nd", "e f g"])))
    for c in range(200, 290):  # one long common beginning, and copies
        rows += [(c, t, "user", f"turn {t}") for t in range(12)] + ([(c, 12, "user", str(c % 7))] if c % 3 else [])
    rows += [(300, None, None, None), (300, 0, "user", None), (300, 0, "user", "two at one turn"), (300, 0, "user", "two at one turn"), (None, 0, "user", "no conversation"), (301, 5, "", "x " * 30000)]
    return rows


@pytest.mark.parametrize("limit", [4096, 40, 3])
def test_trie(spark, chats, limit):
    df = spark.createDataFrame([(*r, 1, "k") for r in chats], "conv_id long, turn long, role string, text string, depth int, turn_key string").repartition(6)
    found = [tuple(r) for r in prefix_trie.op12(df, limit).collect()]
    assert len(found) == len(set(found))
    assert set(found) == trie_of(chats)


def test_trie_of_nothing_and_of_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.op12(spark.createDataFrame([], schema)).count() == 0
    gone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1)  # its only turn is replaced by that of an absent one
    rows = [(gone, 0, "user", "x")]
    assert {tuple(r) for r in prefix_trie.op12(spark.createDataFrame(rows, schema)).collect()} == trie_of(rows)


# ------------------------------------------------------------------ 13


def licensed(text):
    w = TOKEN.findall(lower(text or ""))
    made = license_scan.templates()
    base, labels, score, places = set(), set(), 0.0, []
    for t in made:
        for o in range(-len(t.words), len(w)):
            same = [0 <= o + j < len(w) and w[o + j] == x for j, x in enumerate(t.words)]
            if sum(same) >= t.need and all(same[j] for j in t.key):
                labels.add(t.label)
                score = max(score, sum(same) / len(same))
                if t.base:
                    base.add(t.label)
                    places.append(o)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


NOTICED = [
    "All rights reserved. ALL RIGHTS  RESERVED; all rights, reserved all rights",
    "x CC-BY 4.0 and cc by cc by",
    "Licensed under CC BY-NC 4.0.\nReleased under the MIT Licensé",
    "This work is licensed under the GNU General Public License, version 3.",
    "the GNU Lesser General Public License",
    "Redistribution AND use in source and binary forms, with or without modification, are permitted given that the following conditions are met: ...",
    "source and binary forms",
    "you may not use this file except in compliance with the Licence",
    "permission is hereby granted free of charge to any person obtaining a copy of this thing and associated documentation files",
    "general public\x00license\U0001f600general public license",
    "reserved",
    " ".join(["all rights reserved"] * 5000),
]


def test_license_scan(spark, docs, rows, nothing):
    more = [(1000 + i, t) for i, t in enumerate(NOTICED)]
    for label, notice, _ in license_scan.NOTICES:
        more.append((2000 + len(more), f"before {notice.upper()} after"))
        assert label in licensed(notice)[5].split(",")
    df = docs.select("doc_id", "text", "score").union(spark.createDataFrame([(*m, 0.1) for m in more], "doc_id long, text string, score double"))
    want = Counter((i, *licensed(t)) for i, t in [(r[0], r[1]) for r in rows] + more)
    assert Counter(tuple(r) for r in license_scan.op13(df).collect()) == want
    assert license_scan.op13(nothing).count() == 0


def test_spans_are_places(spark):
    df = spark.createDataFrame([(7, NOTICED[1]), (7, NOTICED[1]), (None, None)], "doc_id long, text string")
    found = sorted((r.label, r.first_word, r.matched, r.n_words) for r in license_scan.spans(df).filter("base").collect())
    assert found == sorted([("cc-by", p, 2, 2) for p in (1, 6, 8)] * 2)


def test_a_key_phrase_must_be_in_its_notice():
    with pytest.raises(ValueError, match="key phrase"):
        license_scan.templates(notices=[("x", "some notice", "other words")])
