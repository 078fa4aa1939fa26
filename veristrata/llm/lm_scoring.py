"""Operator 5 - language-model scores of whole documents by a gated recurrent network.

Counts: one pass codes documents in segments (runs of rows of at most about 8 MB of text) and
sends each segment's distinct words, by hash bucket, to be counted over the whole
corpus; the buckets answer every segment with the counts of its words.  Nothing about
the vocabulary is broadcast or collected but the ``SHORTLIST`` most frequent words and
one row of totals per rare class.

Model: a GRU over word ids, trained in numpy by truncated back-propagation on streams
of training documents, with an output softmax factored into word classes.  Short-listed
words have ids of their own; every other word belongs to a rare class by its shape
(end mark, non-ASCII lead bytes, length), the network predicts the class, and within
the class the word has its smoothed corpus frequency.  So the score is the log10
probability of the whole text over an open vocabulary.  Every segment trains on its own
documents from common weights and the weights are averaged by tokens, for a few
rounds; each round learns its share of the documents, whole, and the rounds together
learn every training document once.  The network starts at the corpus unigrams.
Averages and corpus totals are added up in a tree.

Scoring: documents of like length step together; the state is carried from window to
window to the end of the document, whatever its length.

Defined results: a null or empty text is the end token alone; a very long text is one
document like any other, learned and scored to its end; equal texts score equally; a null doc_id counts as a training row; without training rows the base has
N = V = 0, and the score falls back to the class model's initial weights; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder
from .storage import discard, lean_cogroup, lean_group, parts_for, persist, persist_by, small_batches, steady
from .textkernel import U64, Words, text_blocks, word_hashes

SHORTLIST, RARE, HIDDEN = 991, 32, 32
CLASS_SIZE, FAN = 32, 16
VOCAB = SHORTLIST + 1 + RARE  # shortlist, end, rare classes: 32 classes of 32 words
SEGMENT_BYTES, TOGETHER_BYTES = 8 << 20, 12 << 20
TOGETHER, OUTPUTS = 1024, 8192  # documents that step together, states whose outputs are worked out together
ROUNDS, STREAMS, WINDOW, RATE = 4, 128, 24, 0.02
END_HASH = U64(0x5BD1E9955BD1E995)
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?)\"'"]] = True


def rare_class(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """0..RARE-1 by a word's shape: 2 (end mark) x 8 (non-ASCII bytes) x 2 (length)."""
    if not len(starts):
        return np.zeros(0, np.uint8)
    order = np.argsort(starts, kind="stable")  # in text order, so that the gaps between words add up to the text
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    starts, ends = starts[order], ends[order]
    mark = _MARK[buf[ends - 1]]
    # a set of the second bytes of two-byte characters, folded to 0..7; 0 for pure ASCII
    total = np.concatenate([[0], np.cumsum((buf >= 0xC0).astype(np.int64))])
    wide = total[ends] - total[starts] > 0
    bits = np.zeros(len(buf), np.uint8)
    cont = (buf >= 0x80) & (buf < 0xC0)
    bits[cont] = 1 << ((buf[cont] >> 1) % 7)
    any_bits = np.bitwise_or.reduceat(np.append(bits, np.uint8(0)), np.stack([starts, ends], 1).ravel())[::2]
    low = np.zeros(len(starts), np.int64)
    on = wide & (any_bits > 0)
    low[on] = 1 + np.log2((any_bits[on] & -any_bits[on].astype(np.int16)).astype(float)).astype(np.int64)
    long = ends - starts > 8
    return (mark * 16 + np.minimum(low, 7) * 2 + long).astype(np.uint8)[back]


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in the order of their first places, those places, and each value's number among them."""
    coded = pa.array(h).dictionary_encode()
    of = coded.indices.to_numpy()
    seen = np.maximum.accumulate(of)
    return coded.dictionary.to_numpy(), np.flatnonzero(np.diff(seen, prepend=-1)), of


def _bin(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _batch(rows: list[tuple], spec: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in spec.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


_CODED = "kind int, seg long, bucket int, a binary, b binary, c binary, d binary, e binary"


def _code(buckets: int):
    """Segments: documents as indices into the segment's words (kind 0); words by bucket (kind 1)."""

    @steady
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seg = TaskContext.get().partitionId() << 24
        for batch in batches:
            for lo, hi, buf, offs in text_blocks(batch.column(2), SEGMENT_BYTES):
                ids, held = batch.column(0)[lo:hi], np.asarray(batch.column(1)[lo:hi])
                w = Words(buf, offs)
                h = word_hashes(buf, w)
                n = w.counts()
                # every document ends with the end token
                all_h = np.insert(h, w.first[1:], END_HASH)
                trains = np.repeat(~held, n + 1)
                u, at, of = _distinct(all_h)
                count = np.bincount(of, trains, len(u)).astype(np.int64)
                # position of each distinct word among the block's words, for its shape
                word_at = at - np.searchsorted(w.first[1:] + np.arange(hi - lo), at)
                is_end = u == END_HASH
                cls = np.zeros(len(u), np.uint8)
                if len(h):
                    k = np.minimum(word_at, len(h) - 1)
                    cls = rare_class(buf, w.starts[k], w.ends[k])
                cls[is_end] = 0
                b = ((u >> U64(40)) % U64(buckets)).astype(np.int64)
                order = np.lexsort((u, b))
                place = np.empty(len(u), np.uint32)
                place[order] = np.arange(len(u), dtype=np.uint32)
                tokens = place[of].astype("<u4").view(np.uint8).reshape(-1, 4)
                small = len(u) < 1 << 24
                tokens = np.ascontiguousarray(tokens[:, :3]) if small else tokens
                null = np.asarray(ids.is_null())
                num = np.asarray(ids.fill_null(0)).astype(np.int64)
                rows = [(0, seg, 3 if small else 4, _bin(tokens), _bin(num), _bin(null), _bin((n + 1).astype(np.int64)), _bin(held))]
                cut = np.searchsorted(b[order], np.arange(buckets + 1))
                for j in np.flatnonzero(np.diff(cut)).tolist():
                    i = order[cut[j] : cut[j + 1]]
                    rows.append((1, seg, j, _bin(u[i]), _bin(count[i].astype(np.uint32)), _bin(cls[i]), b"", b""))
                yield _batch(rows, _CODED)
                seg += 1

    return run


_ANSWER = "kind int, seg long, bucket int, a binary, b binary, c binary"


def _count_words(table: pa.Table) -> pa.Table:
    """One bucket's words over the corpus: answers to the segments (0), totals by class and frequent words (1)."""
    bucket = table["bucket"][0].as_py()
    segs = table["seg"].to_pylist()
    hs = [np.frombuffer(x, U64) for x in table["a"].to_pylist()]
    cs = [np.frombuffer(x, np.uint32).astype(np.int64) for x in table["b"].to_pylist()]
    ks = [np.frombuffer(x, np.uint8) for x in table["c"].to_pylist()]
    u, first, inv = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
    count = np.bincount(inv, np.concatenate(cs), len(u)).astype(np.int64)
    cls = np.concatenate(ks)[first]
    rows, at = [], 0
    for seg, h, k in zip(segs, hs, ks, strict=True):
        mine = count[inv[at : at + len(h)]]
        rows.append((0, seg, bucket, _bin(h), _bin(mine.astype(np.uint32) if not len(mine) or mine.max() < 1 << 32 else mine), _bin(k)))
        at += len(h)
    known = count > 0
    not_end = known & (u != END_HASH)
    n_class = np.bincount(cls[not_end], count[not_end], RARE).astype(np.int64)
    v_class = np.bincount(cls[not_end], minlength=RARE).astype(np.int64)
    totals = np.concatenate([n_class, v_class, [count[u == END_HASH].sum(), (known & (u == END_HASH)).sum()]]).astype(np.int64)
    words = np.flatnonzero(not_end)
    words = words[np.lexsort((u[words], -count[words]))[:SHORTLIST]]  # no word beyond a bucket's first can be among the corpus's first
    rows.append((1, -1, bucket, _bin(totals), _bin(np.stack([u[words].view(np.int64), count[words], cls[words].astype(np.int64)])), b""))
    return pa.Table.from_batches([_batch(rows, _ANSWER)])


class Lexicon:
    """Totals of the corpus and the ids of frequent words."""

    def __init__(self, totals: np.ndarray, words: np.ndarray):
        n_class, v_class, (n_end, v_end) = totals[:RARE].copy(), totals[RARE : 2 * RARE].copy(), totals[2 * RARE :]
        self.n, self.v = int(n_class.sum() + n_end), int(v_class.sum() + v_end)
        order = np.lexsort((words[0], -words[1]))[:SHORTLIST]
        words = words[:, order]
        np.subtract.at(n_class, words[2], words[1])
        np.subtract.at(v_class, words[2], 1)
        mass = np.concatenate([words[1], [n_end], n_class]).astype(np.float64)
        # network ids by falling frequency, so that classes hold words of like frequency
        self.rank_of = np.empty(len(mass), np.int64)
        self.rank_of[np.argsort(-mass, kind="stable")] = np.arange(len(mass))
        self.mass = np.zeros(VOCAB)
        self.mass[self.rank_of] = mass
        by_hash = np.argsort(words[0].view(U64), kind="stable")
        self.hash = words[0].view(U64)[by_hash]
        self.id = self.rank_of[: len(order)][by_hash]
        self.end = int(self.rank_of[len(order)])
        self.rare = self.rank_of[len(order) + 1 :]
        self.n_class, self.v_class = n_class, v_class

    def look_up(self, h: np.ndarray, count: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Network id of each word and log10 of its share of that id (0 for short-listed words)."""
        out = self.rare[cls]
        share = np.log10((count + 0.5) / (self.n_class[cls] + 0.5 * (self.v_class[cls] + 1)))
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            hit = self.hash[at] == h
            out = np.where(hit, self.id[at], out)
            share = np.where(hit, 0.0, share)
        end = h == END_HASH
        return np.where(end, self.end, out).astype(np.uint16), np.where(end, 0.0, share)


_DOCS = "seg long, tokens binary, doc binary, isnull binary, n binary, held binary, base binary, rare binary, known binary"


def _join_counts(lexicon):
    """Segment and the answers to it: network ids per token, and per-document sums."""

    def run(segment: pa.Table, answers: pa.Table) -> pa.Table:
        lex: Lexicon = lexicon.value
        rows = []
        if segment.num_rows:
            order = np.argsort(answers["bucket"].to_numpy(), kind="stable")
            cols = [[answers[c].to_pylist()[i] for i in order] for c in ("a", "b", "c")]
            h = np.concatenate([np.frombuffer(x, U64) for x in cols[0]])
            count = np.concatenate([np.frombuffer(x, np.uint32 if 2 * len(x) == len(y) else np.int64).astype(np.int64) for x, y in zip(cols[1], cols[0], strict=True)])
            cls = np.concatenate([np.frombuffer(x, np.uint8) for x in cols[2]])
            ids, share = lex.look_up(h, count, cls)
            base = np.log10((count + 0.5) / (lex.n + 0.5 * (lex.v + 1)))
            width = segment["width"][0].as_py()
            raw = np.frombuffer(segment["s_a"][0].as_py(), np.uint8).reshape(-1, width)
            wide = np.zeros((len(raw), 4), np.uint8)
            wide[:, :width] = raw
            tok = wide.view("<u4").ravel()
            n = np.frombuffer(segment["s_d"][0].as_py(), np.int64)
            start = np.cumsum(n) - n
            per = [np.add.reduceat(x[tok], start) for x in (base, share, (count > 0).astype(np.int64))]
            keep = [segment[c][0].as_py() for c in ("s_b", "s_c", "s_d", "s_e")]
            rows = [(segment["s_seg"][0].as_py(), _bin(ids[tok]), *keep, *map(_bin, per))]
        return pa.Table.from_batches([_batch(rows, _DOCS)])

    return run


# ---------------------------------------------------------------- network


def initial(lexicon: Lexicon, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    classes = VOCAB // CLASS_SIZE
    mass = lexicon.mass + 0.5
    per = mass.reshape(classes, CLASS_SIZE)
    f = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {
        "P": f(VOCAB, 3 * HIDDEN),
        "U": f(HIDDEN, 3 * HIDDEN),
        "Wc": f(classes, HIDDEN) * 0.1,
        "bc": np.log(per.sum(1) / mass.sum()).astype(np.float32),
        "Ww": f(VOCAB, HIDDEN) * 0.1,
        "bw": np.log(mass / np.repeat(per.sum(1), CLASS_SIZE)).astype(np.float32),
    }


def _gates(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Input and state weights as (3, rows, HIDDEN): of both gates, halved as sigmoid(a) = tanh(a / 2) / 2 + 1 / 2, and of the candidate.

    The candidate's state weights are halved too: it reads (tanh + 1) times them.
    """
    half = w["P"].dtype.type(0.5)
    p, u = (np.ascontiguousarray(w[k].reshape(-1, 3, HIDDEN).transpose(1, 0, 2)) for k in "PU")
    p[:2] *= half
    u *= half
    return p, u


def _steps(w: dict[str, np.ndarray], rows: int) -> Callable[[np.ndarray, np.ndarray, np.ndarray], None]:
    """A function of (ids read, states before, states after), for at most ``rows`` documents at once."""
    p, u = _gates(w)
    half = p.dtype.type(0.5)
    by_state, by_input = np.empty(3 * rows * HIDDEN, p.dtype), np.empty(3 * rows * HIDDEN, p.dtype)

    def step(x: np.ndarray, h: np.ndarray, out: np.ndarray) -> None:
        n = 3 * len(x) * HIDDEN
        a, given = by_state[:n].reshape(3, -1, HIDDEN), by_input[:n].reshape(3, -1, HIDDEN)
        p.take(x, axis=1, out=given, mode="clip")
        np.matmul(h, u, out=a)
        zr, z, q, c = a[:2], a[0], a[2], given[2]
        zr += given[:2]
        np.tanh(zr, out=zr)
        c += q
        q *= zr[1]
        c += q
        np.tanh(c, out=c)
        np.subtract(h, c, out=q)
        q *= half
        z *= q
        c += q
        np.add(c, z, out=out)

    return step


def _step(w: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The state after reading ``x``."""
    out = np.empty_like(h)
    _steps(w, len(x))(x, h, out)
    return out


def _near(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no logit can leave the range of exponentials: a state's values lie from -1 to 1."""
    return bool((np.abs(weights).sum(1) + np.abs(bias)).max() < 80)


def _shift(a: np.ndarray) -> None:
    """Take a constant off each row so that exponentials stay in range: one for all rows where they lie close enough, else each row's largest."""
    a -= a.max(initial=-np.inf)
    if a.size and a.min() < -80:
        a -= a.max(1, keepdims=True)


def _log_prob(a: np.ndarray, at: np.ndarray, near: bool = False) -> np.ndarray:
    """Log-softmax of each row at one column; ``a`` is used up."""
    if not near:
        _shift(a)
    own = a.ravel().take(np.arange(0, a.size, a.shape[1]) + at)
    np.exp(a, out=a)
    return own - np.log(a @ np.ones(a.shape[1], a.dtype))


def _cuts(cls: np.ndarray) -> list[tuple[int, slice, slice]]:
    """(class, its positions, its words) of the classes that occur; ``cls`` is sorted."""
    cut = np.searchsorted(cls, np.arange(VOCAB // CLASS_SIZE + 1)).tolist()
    return [(k, slice(cut[k], cut[k + 1]), slice(k * CLASS_SIZE, (k + 1) * CLASS_SIZE)) for k in range(VOCAB // CLASS_SIZE) if cut[k] < cut[k + 1]]


def _within(w: dict[str, np.ndarray], h: np.ndarray, cls: np.ndarray, cuts: list[tuple[int, slice, slice]]) -> np.ndarray:
    """Logits of the words of each position's own class: a product a class, side by side."""
    a = np.empty((len(h), CLASS_SIZE), h.dtype)
    for _, i, words in cuts:
        np.matmul(h[i], w["Ww"][words].T, out=a[i])
        a[i] += w["bw"][words]
    return a


def log_probs(w: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray, near: bool = False) -> np.ndarray:
    """Natural log-probability of each next id: class, then word within the class."""
    order = np.argsort(y.astype(np.uint16), kind="stable")
    h, ys = h.take(order, axis=0), y.take(order).astype(np.int64)
    cls = ys // CLASS_SIZE
    a = h @ w["Wc"].T
    a += w["bc"]
    own = _log_prob(a, cls, near)
    own += _log_prob(_within(w, h, cls, _cuts(cls)), ys - cls * CLASS_SIZE, near)
    out = np.empty_like(own)
    out[order] = own
    return out


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, h0: np.ndarray, end: int, g: dict[str, np.ndarray]) -> np.ndarray:
    """Gradient of the mean loss over a window (steps x streams), written to ``g``; the state after it."""
    steps, streams = x.shape
    kind = w["P"].dtype
    n, half = kind.type(steps * streams), kind.type(0.5)
    inputs = w["P"].take(x, axis=0)
    inputs[:, :, : 2 * HIDDEN] *= half  # sigmoid(a) = tanh(a / 2) / 2 + 1 / 2
    u_zr, u_c = half * w["U"][:, : 2 * HIDDEN], np.ascontiguousarray(w["U"][:, 2 * HIDDEN :])
    fresh = (x != end)[:, :, None]
    ends = ~fresh.all(axis=(1, 2))
    before, zr, c, qn, hs = (np.empty((steps, streams, k * HIDDEN), kind) for k in (1, 2, 1, 1, 1))
    h = h0
    for t in range(steps):
        b, g_t, c_t, h_t = before[t], zr[t], c[t], hs[t]
        np.multiply(h, fresh[t], out=b) if ends[t] else np.copyto(b, h)  # a document begins without memory
        np.matmul(b, u_zr, out=g_t)
        g_t += inputs[t, :, : 2 * HIDDEN]
        np.tanh(g_t, out=g_t)
        g_t *= half
        g_t += half
        np.matmul(b, u_c, out=qn[t])
        np.multiply(g_t[:, HIDDEN:], qn[t], out=c_t)
        c_t += inputs[t, :, 2 * HIDDEN :]
        np.tanh(c_t, out=c_t)
        np.subtract(b, c_t, out=h_t)
        h_t *= g_t[:, :HIDDEN]
        h_t += c_t
        h = h_t
    last = h
    # positions by class, so that each class is one slice
    ys = y.ravel()
    order = np.argsort(ys.astype(np.uint16), kind="stable")
    flat, ys = hs.reshape(-1, HIDDEN).take(order, axis=0), ys.take(order)
    cls = ys // CLASS_SIZE
    d = flat @ w["Wc"].T
    d += w["bc"]
    d = _softmax(d, _near(w["Wc"], w["bc"]))
    d[np.arange(len(ys)), cls] -= 1
    d /= n
    np.matmul(d.T, flat, out=g["Wc"])
    d.sum(0, out=g["bc"])
    dh = d @ w["Wc"]
    cuts = _cuts(cls)
    d = _softmax(_within(w, flat, cls, cuts), _near(w["Ww"], w["bw"]))
    d[np.arange(len(ys)), ys - cls * CLASS_SIZE] -= 1
    d /= n
    g["Ww"][:], g["bw"][:] = 0, 0
    there = [k for k, _, _ in cuts]
    g["bw"].reshape(-1, CLASS_SIZE)[there] = np.add.reduceat(d, [i.start for _, i, _ in cuts], axis=0)
    within = np.empty_like(dh)
    for _, i, words in cuts:
        np.matmul(d[i].T, flat[i], out=g["Ww"][words])
        np.matmul(d[i], w["Ww"][words], out=within[i])
    dh += within
    back_h = np.empty_like(dh)
    back_h[order] = dh
    dh = back_h.reshape(steps, streams, HIDDEN)
    back = np.zeros((streams, HIDDEN), kind)
    dp = np.empty((steps, streams, 3 * HIDDEN), kind)
    turned = np.ascontiguousarray(w["U"].T)
    z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
    rest = 1 - z
    to_z = (before - c) * z * rest
    to_c = 1 - c * c
    to_c *= rest
    to_r = qn * r * (1 - r)
    for t in range(steps - 1, -1, -1):
        d_t = dp[t]
        back += dh[t]
        dc = np.multiply(back, to_c[t], out=qn[t])
        np.multiply(back, to_z[t], out=d_t[:, :HIDDEN])
        np.multiply(dc, to_r[t], out=d_t[:, HIDDEN : 2 * HIDDEN])
        np.multiply(dc, r[t], out=d_t[:, 2 * HIDDEN :])  # of the state's part; of the input's part below
        back *= z[t]
        back += d_t @ turned
        if ends[t]:
            back *= fresh[t]
    dp = dp.reshape(-1, 3 * HIDDEN)
    np.matmul(before.reshape(-1, HIDDEN).T, dp, out=g["U"])
    dp[:, 2 * HIDDEN :] = qn.reshape(-1, HIDDEN)
    _row_sums(dp, x.ravel(), g["P"])
    return last


def _row_sums(rows: np.ndarray, ids: np.ndarray, out: np.ndarray, deep: int = 12) -> None:
    """Rows of equal ids added up into ``out``, whose other rows become 0.

    The k-th rows of all ids go in together up to ``deep``; an id with more has the rest
    added by one product.
    """
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    sorted_ids = ids[order]
    start = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
    n = np.diff(start, append=len(ids))
    by = np.argsort(-n, kind="stable")
    start, n = start[by], n[by]
    total = rows.take(order[start], axis=0)
    for k in range(1, deep):
        more = int(np.searchsorted(-n, -k, "left"))  # ids with over k rows
        if not more:
            break
        total[:more] += rows.take(order[start[:more] + k], axis=0)
    for i in range(int(np.searchsorted(-n, -deep, "left"))):
        rest = rows[order[start[i] + deep : start[i] + n[i]]]
        total[i] += np.ones(len(rest), rows.dtype) @ rest
    out[:] = 0
    out[sorted_ids[start]] = total


def _softmax(a: np.ndarray, near: bool = False) -> np.ndarray:
    if not near:
        _shift(a)
    np.exp(a, out=a)
    a /= (a @ np.ones(a.shape[1], a.dtype))[:, None]
    return a


def _views(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Arrays shaped as ``like``'s, in the order of their names, on one flat array."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def train(weights: dict[str, np.ndarray], stream: np.ndarray, end: int, rate: float = RATE) -> dict[str, np.ndarray]:
    """Truncated back-propagation over one stream of ids cut into parallel streams (Adam).

    Every id of the stream is learned once.  A short stream is cut into fewer parallel
    ones; what they leave over at the end goes on from the state of the last one.
    """
    streams = int(np.clip(len(stream) // (4 * WINDOW), 1, STREAMS))
    per = (len(stream) - 1) // streams
    cut = per * streams
    x, y = stream[:cut].reshape(streams, per).T, stream[1 : cut + 1].reshape(streams, per).T
    spans = [(x[at : at + WINDOW], y[at : at + WINDOW]) for at in range(0, per, WINDOW)]
    spans += [(stream[at : at + WINDOW][: len(stream) - 1 - at, None], stream[at + 1 : at + 1 + WINDOW, None]) for at in range(cut, len(stream) - 1, WINDOW)]
    flat = np.concatenate([weights[k].ravel() for k in sorted(weights)])
    w, step = _views(flat, weights), np.empty_like(flat)
    g_flat, m, v = (np.zeros_like(flat) for _ in range(3))
    g = _views(g_flat, weights)
    h = np.zeros((streams, HIDDEN), flat.dtype)
    for k, (xs, ys) in enumerate(spans, 1):
        h = _gradient(w, xs, ys, h[-xs.shape[1] :], end, g)
        norm = float(np.sqrt(g_flat @ g_flat))
        if norm > 1:
            g_flat *= flat.dtype.type(1 / norm)
        m += np.multiply(np.subtract(g_flat, m, out=step), 0.1, out=step)
        np.multiply(g_flat, g_flat, out=g_flat)
        v += np.multiply(np.subtract(g_flat, v, out=step), 0.01, out=step)
        np.sqrt(v, out=step)
        step *= flat.dtype.type((1 - 0.99**k) ** -0.5)
        step += flat.dtype.type(1e-8)
        np.divide(m, step, out=step)
        step *= flat.dtype.type(rate / (1 - 0.9**k))
        flat -= step
    return w


def score_documents(w: dict[str, np.ndarray], tokens: np.ndarray, n: np.ndarray, end: int) -> np.ndarray:
    """log10 probability of the ids of each document, its state carried to its end."""
    start = np.cumsum(n) - n
    out = np.zeros(len(n))
    longest_first = np.argsort(-n, kind="stable")
    step = _steps(w, min(len(n), TOGETHER))
    near = _near(w["Wc"], w["bc"]) and _near(w["Ww"], w["bw"])
    for at in range(0, len(n), TOGETHER):
        group = longest_first[at : at + TOGETHER]
        s, size = start[group], n[group]
        alive = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # documents longer than t lead the group
        h = np.zeros((len(group), HIDDEN), w["P"].dtype)
        x = np.full(len(group), end)
        states = np.empty((OUTPUTS + len(group), HIDDEN), h.dtype)
        ids, rows, held = [], [], 0
        for t, live in enumerate(alive.tolist()):
            after = states[held : held + live]
            step(x[:live], h[:live], after)
            h, x = after, tokens.take(s[:live] + t)
            ids.append(x)
            rows.append(group[:live])
            held += live
            if held > OUTPUTS or t + 1 == len(alive):  # a window's outputs at once
                lp = log_probs(w, states[:held], np.concatenate(ids), near)
                out += np.bincount(np.concatenate(rows), lp, len(n))
                h, ids, rows, held = h.copy(), [], [], 0
    return out / np.log(10)


# ---------------------------------------------------------------- Spark


_SUMS = "part long, count long, weights binary"


def _train_round(shared, lexicon, number: int, rounds: int):
    """Weights after a segment's share of a round, times its tokens, summed over the task's segments.

    A document is learned in one round, the whole of it; the rounds together learn all.
    """

    @steady
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        end, total, count = lexicon.value.end, None, 0
        for batch in batches:
            for seg, tokens, n, held in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                tok, n, held = np.frombuffer(tokens, np.uint16), np.frombuffer(n, np.int64), np.frombuffer(held, bool)
                start = np.cumsum(n) - n
                mine = np.random.default_rng(seg).permutation(np.flatnonzero(~held))[number::rounds]
                parts = [tok[start[i] : start[i] + n[i]] for i in mine]
                if not parts:
                    continue
                stream = np.concatenate([[end], *parts]).astype(np.int64)
                w = train(shared.value, stream, end, RATE / (1 + number))
                flat = np.concatenate([w[k].ravel() for k in sorted(w)]).astype(np.float64) * len(stream)
                total = flat if total is None else total + flat
                count += len(stream)
        if total is not None:
            yield _batch([(TaskContext.get().partitionId(), count, _bin(total))], _SUMS)

    return run


def _add_up(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in table["weights"].to_pylist())
    return pa.Table.from_batches([_batch([(table["part"][0].as_py(), sum(table["count"].to_pylist()), _bin(total))], _SUMS)])


def _tree(rows: DataFrame, parts: int, add: Callable[[pa.Table], pa.Table], schema: str) -> list:
    """Rows numbered by ``part`` added up in a tree: a task gets FAN rows at most, and so does the driver."""
    while parts > FAN:
        parts = -(-parts // FAN)
        rows = rows.withColumn("part", F.expr(f"part div {FAN}")).groupBy("part").applyInArrow(lean_group(add), schema)
    return rows.collect()


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(shared, lexicon):
    @steady
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = lexicon.value
        for batch in batches:
            size = np.cumsum([len(x) for x in batch.column("tokens").to_pylist()])
            together = size // TOGETHER_BYTES  # few long documents of one segment step with those of others
            for k in np.unique(together):
                rows = batch.filter(pa.array(together == k)).to_pylist()
                col = {c: np.concatenate([np.frombuffer(r[c], kind) for r in rows]) for c, kind in _ROWS}
                n = col["n"]
                net = score_documents(shared.value, col["tokens"], n, lex.end)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(col["doc"], mask=col["isnull"]), pa.array(col["held"]), pa.array(n), pa.array(col["known"]),
                        pa.array(np.full(len(n), lex.n)), pa.array(col["base"]), pa.array(net + col["rare"]),
                    ],
                    names=[f.split()[0] for f in _SCORES.split(", ")],
                )

    return run


_ROWS = (
    ("tokens", np.uint16), ("doc", np.int64), ("isnull", bool), ("n", np.int64), ("held", bool), ("base", np.float64), ("rare", np.float64), ("known", np.int64)
)


def score(docs: DataFrame, mod: int = 5, held: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    d = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(remainder(F.col("doc_id"), mod) == held, F.lit(False)).alias("held"), F.col("text").cast("string")
    )
    buckets = parts_for(docs, 8 << 20)
    small_batches(spark)
    coded = persist_by(d.mapInArrow(_code(buckets), _CODED), "lm-coded", "kind", [0, 1])
    words = coded[1].select("bucket", "seg", "a", "b", "c")
    answers = persist(words.groupBy("bucket").applyInArrow(lean_group(_count_words), _ANSWER), "lm-answers")
    discard(coded[1])
    tops = _tree(answers.filter("kind = 1").select(F.col("bucket").cast("long").alias("part"), "a", "b"), buckets, _merge_tops, _TOPS)
    stats = [(np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int64).reshape(3, -1)) for r in tops]
    lexicon = Lexicon(
        sum((a for a, _ in stats), np.zeros(2 * RARE + 2, np.int64)), np.concatenate([b for _, b in stats] or [np.zeros((3, 0), np.int64)], 1)
    )
    lex = sc.broadcast(lexicon)
    seg = coded[0].select(
        F.col("seg").alias("s_seg"), F.col("bucket").alias("width"), *[F.col(c).alias(f"s_{c}") for c in "abcde"]
    )
    # s_a tokens, s_b ids, s_c null flags, s_d lengths, s_e held-out flags
    back = answers.filter("kind = 0").select("seg", "bucket", "a", "b", "c")
    table = persist(seg.groupBy("s_seg").cogroup(back.groupBy("seg")).applyInArrow(lean_cogroup(_join_counts(lex)), _DOCS), "lm-documents")
    discard(coded[0])
    discard(answers)
    weights = initial(lexicon)
    parts = table.rdd.getNumPartitions()
    for number in range(rounds):
        shared = sc.broadcast(weights)
        rows = _tree(table.select("seg", "tokens", "n", "held").mapInArrow(_train_round(shared, lex, number, rounds), _SUMS), parts, _add_up, _SUMS)
        shared.destroy()
        if rows:
            flat = sum(np.frombuffer(r["weights"], np.float64) for r in rows) / sum(r["count"] for r in rows)
            weights = {k: v.astype(np.float32) for k, v in _views(flat, weights).items()}
    return table.mapInArrow(_score(sc.broadcast(weights), lex), _SCORES)


_TOPS = "part long, a binary, b binary"


def _merge_tops(t: pa.Table) -> pa.Table:
    """Totals and frequent words of some buckets."""
    totals = sum(np.frombuffer(x, np.int64) for x in t["a"].to_pylist())
    words = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x in t["b"].to_pylist()], 1)
    words = words[:, np.lexsort((words[0], -words[1]))[:SHORTLIST]]
    return pa.Table.from_batches([_batch([(t["part"][0].as_py(), _bin(totals), _bin(words))], _TOPS)])


def op5(docs: DataFrame) -> DataFrame:
    return score(docs)
