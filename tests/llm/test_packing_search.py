"""Packing and top-k search against brute force."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veristrata.llm import packing, topk_search


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


TRICKY = ["", None, " a b", "a  b c", "x <|endoftext|> y", "tab\t here  and\n new \n ", "ends ", "it's don't 's", "  x y\x85 z", "a  b", "a　 b", "\n\n", "q\x1c\x1cq", "naïve 12,345.6 東京 ß", "a   b", "x" * 5000]


def test_encoder(tokenizer):
    enc = packing.Encoder(packing.default_tokenizer())
    assert enc.full is not None
    for t in TRICKY:
        want = np.asarray(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
        assert enc.encode(t) == want, t


def one_by_one(hist, max_len):
    """Rooms left when every piece goes, longest first, into the pack with the most room."""
    rooms = []
    for length in sorted(Counter(hist).elements(), reverse=True):
        best = max(rooms, default=-1)
        if best < length:
            rooms.append(max_len)
            best = max_len
        rooms.remove(best)
        rooms.append(best - length)
    return Counter(rooms)


def rooms_of(packs, max_len):
    out = Counter()
    for p, n in packs:
        assert p and n > 0
        out[max_len - sum(length * times for length, times in p)] += n
    assert min(out, default=0) >= 0
    return out


HISTOGRAMS = [
    dict(Counter(int(x) for x in np.random.default_rng(0).integers(1, 65, 1500))),
    dict(Counter(min(64, int(x)) for x in np.random.default_rng(1).pareto(1, 1500) * 3 + 1)),
    {10: 1000}, {33: 70}, {32: 71}, {1: 500}, {64: 9}, {40: 30, 3: 400}, {64: 500, 20: 7, 1: 1}, {60: 10, 4: 10}, {},
]


@pytest.mark.parametrize("hist", HISTOGRAMS)
def test_shortest_pack_first(hist):
    packs = packing.shortest_pack_first(hist, 64)
    back = Counter()
    for p, n in packs:
        for length, times in p:
            back[length] += n * times
    assert back == Counter(hist) and len(packs) <= 3 * 64
    assert rooms_of(packs, 64) == one_by_one(hist, 64)
    # every place is taken once
    seen = Counter()
    for length, lo, times, sequence, offset in packing.slots(packs).tolist():
        n = next(n for at, n in firsts(packs) if at == sequence)
        for k in range(n * times):
            seen[sequence + k // times, offset + k % times * length] += 1
    assert sum(seen.values()) == sum(hist.values()) and set(seen.values()) <= {1}


def firsts(packs):
    at = 0
    for _, n in packs:
        yield at, n
        at += n


@pytest.mark.parametrize(("hist", "least"), [({100: 10000}, 0.97), ({10: 100000}, 0.99), ({2048: 500, 7: 90000}, 0.99), ({1500: 1000, 500: 1000, 40: 1200}, 0.97)])
def test_little_padding(hist, least):
    packs = packing.shortest_pack_first(hist)
    used = sum(length * n for length, n in hist.items())
    assert used >= least * 2048 * sum(n for _, n in packs)


def test_equal_documents(spark):
    """Many equal rows: full sequences, gapless offsets, each place once, ids null or not."""
    df = spark.createDataFrame([(i % 7 or None, "one two three") for i in range(3000)], "doc_id long, text string")
    got = packing.pack(df, salt_rows=100).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    length = got[0].length
    assert len(got) == 3000 and len(by) == -(-3000 // (2048 // length))
    assert all(sorted(v) == [(k * length, length) for k in range(len(v))] for v in by.values())


def held_to(got, rows, tokenizer, max_len):
    """Each id of each row in exactly one piece, checksums of the ids themselves, sequences without a gap; the share of places filled."""
    brute, found, by = Counter(), Counter(), defaultdict(Counter)
    for i, t in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        brute.update((i, n, k) for k in range(n))
    for r in got:
        by[r.sequence_id][r.offset, r.length] += 1
        found.update((r.doc_id, r.doc_tokens, k) for k in range(r.start, r.start + r.length))
    assert found == brute
    # rows that share id and length are told apart by their text: any of them may own the piece
    owners = defaultdict(list)
    for i, t in set(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        owners[i, len(ids)].append(ids)
    for r in got:
        assert r.ids_crc32 in {zlib.crc32(np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes()) for ids in owners[r.doc_id, r.doc_tokens]}
    for pieces in by.values():
        at = 0
        for (offset, length), n in sorted(pieces.items()):
            assert n == 1 and offset == at
            at += length
        assert at <= max_len
    return sum(r.length for r in got) / (max_len * max(1, len(by)))


def test_pack(docs, rows, nothing, tokenizer):
    assert held_to(packing.op2(docs).collect(), [(r[0], r[1]) for r in rows], tokenizer, 2048) > 0.95
    assert packing.op2(nothing).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, max_len=1 << 15)


@pytest.mark.parametrize("salt_rows", [4096, 7])
def test_rests_are_cut_to_the_gaps(spark, tokenizer, salt_rows):
    """All documents of a length just above half a sequence: equal rows, null ids and one id with several texts among them."""
    rows = [(i if i % 9 else None, " ".join(f"w{(i * 7 + k) % 50}" for k in range(11))) for i in range(120)] + [(5, "same text here of words again and again and")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = packing.pack(df, max_len=32, salt_rows=salt_rows).collect()
    assert held_to(got, rows, tokenizer, 32) >= 0.93 and len(got) > len(rows)
    whole = packing.pack(df, max_len=32, least_fill=0.1).collect()
    assert len(whole) == len(rows) and held_to(whole, rows, tokenizer, 32) < 0.9


CUT = [{1100: 10000}, {1030: 5000, 1500: 5000}, {700: 9000, 1400: 100}, {k: 1 + k * 7919 % 1000 for k in range(1025, 2049)}, {1025: 3}, {2047: 90}, {5: 1}, {}]


@pytest.mark.parametrize("hist", CUT)
def test_cuts_fill_the_sequences(hist):
    cut = packing.cuts_to_fill(hist)
    new = packing.after(hist, cut)
    assert all(sum(parts) == length and len(parts) > 1 and min(parts) > 0 and n > 0 for length, parts, n in cut)
    assert all(sum(n for k, _, n in cut if k == length) <= hist[length] for length in hist) and min(new.values(), default=1) > 0
    used = sum(length * n for length, n in hist.items())
    assert used == sum(length * n for length, n in new.items())
    packs = sum(n for _, n in packing.shortest_pack_first(new))
    assert used >= 0.95 * 2048 * packs or packs == -(-used // 2048)


def brute_top(vectors, k=5):
    ok = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in vectors if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = Counter()
    for q, a in ok:
        if q % 50:
            continue
        s = [(min(2**63 - 1, max(-(2**63), sum(x * y for x, y in zip(a, b)))), i) for i, b in ok if i != q and len(a) == len(b)]
        s = sorted((-v, i) for v, i in s)
        out.update((q, n + 1, i, -v) for n, (v, i) in enumerate(s[:k]))
    return out


def vectors(dim):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim)]) for i in range(330)]
    rows += [(400 + i, rows[3][1]) for i in range(60)]  # ties
    rows += [(900, None), (901, [None] * dim), (902, [float("nan")] * dim), (903, [float("inf")] * dim), (950, [0.0] * dim), (None, [1.0] * dim), (951, [1.0, 2.0]), (1000, [3.0, 4.0])]
    rows += [(1050, [0.5] * dim), (1050, [-0.5] * dim), (1050, [0.5] * dim), (1051, [0.25] * dim), (1051, [0.25] * dim)]  # repeated queries and candidates
    return rows


def huge(dim):
    rng = np.random.default_rng(dim)
    at = [1e300, -1e300, 3e15, 1e10, -1e10, 2.0**60, 1e-300, 5.0]
    return [(2000 + 10 * i, [float(x) for x in rng.choice(at, dim)]) for i in range(30)]


def long_odd(dim):
    """Scores that differ in bits a double does not hold."""
    return [(3000 + 10 * i, [float(2**31 + i)] * dim) for i in range(12)]


@pytest.mark.parametrize("more", [lambda dim: [], huge, long_odd])
@pytest.mark.parametrize("dim", [1, 6])
def test_search(spark, dim, more, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", 5)
    rows = vectors(dim) + more(dim)
    df = spark.createDataFrame([(i, e, 1, 2, 3) for i, e in rows], "vec_id long, embedding array<double>, score int, block int, dim int")
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk_search.op3(df).collect())
    assert got == brute_top(rows)
    assert topk_search.op3(df.limit(0)).count() == 0


def test_threshold_stops_early():
    """With one strong dimension the lists end long before the last row, and a carried floor ends them at once."""
    rng = np.random.default_rng(0)
    x = np.stack([np.arange(2000.0), rng.integers(-2, 3, 2000)], 1)

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.ndim == 1:
                Counted.read += len(at)
            return super().__getitem__(at)

    q, own, ids = np.array([[1.0, 0.0]]), np.array([-1]), np.arange(2000)
    (rows, score), = topk_search.threshold_search(q, own, x.view(Counted), ids, 3)
    assert rows.tolist() == [1999, 1998, 1997] and score == [1999, 1998, 1997] and Counted.read <= 62
    Counted.read = 0
    (rows, _), = topk_search.threshold_search(q, own, x.view(Counted), ids, 3, None, [[5000, 5000, 5000]])
    assert Counted.read <= 31
