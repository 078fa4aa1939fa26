"""Operator 1 - document quality by a linear-chain conditional random field over lines.

Every line gets a feature vector of its own shape (letter, digit, capital and symbol
shares, word statistics, repeats within the document) and the same vectors of the line
before and after it.  A two-state chain (bad, good) is fitted on labelled documents by
maximum conditional likelihood; a document's label stands for each of its lines.
Forward-backward marginals, weighted by line length, give the share of good text,
which a logistic calibration on the training documents turns into the score.

The model is fitted on the driver on a sample of at most ``bound`` labelled documents
a class.

Defined results: a null or empty text, or one of white space alone, has no line and
scores 0; lines without a word count as no line; a very long text is scored whole, as
one chain; equal texts score equally (ties need no rule); a repeated id is scored once
a row, and its equal rows are learned once; without
labels of both classes every non-empty text scores 0.5; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import apply_scores, keep_rows, sample
from .storage import lean
from .textkernel import U64, Words, mix, text_blocks, word_hashes

BOUND, THRESHOLD = 800, 0.7
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True

_CLASSES = {
    "letter": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 256)],
    "capital": [*range(0x41, 0x5B)],
    "digit": [*range(0x30, 0x3A)],
    "symbol": [ord(c) for c in "#*$%&|<>{}[]~^=+_@\\/`"],
    "exclaim": [ord(c) for c in "!?"],
    "stop": [ord(c) for c in ".,;:"],
    "space": [0x20, 0x09, 0x0B, 0x0C, 0x0D],
}
N_FEATURES = len(_CLASSES) + 8
_SHINGLE = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9))


class Lines:
    """Lines of a block that hold a word: row, byte length, and features."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        segs = Words(buf, offs, _NEWLINE)
        words = Words(buf, offs)
        h = word_hashes(buf, words)
        of = np.searchsorted(segs.starts, words.starts, "right") - 1  # line of each word
        n_words = np.bincount(of, minlength=len(segs.starts)) if len(segs.starts) else np.zeros(0, np.int64)
        keep = n_words > 0
        n = len(buf)
        size = (segs.ends - segs.starts).astype(np.float64)
        cols = []
        for members in _CLASSES.values():
            lut = np.zeros(256, np.uint8)
            lut[members] = 1
            total = np.concatenate([[0], np.cumsum(lut[buf], dtype=np.int64)]) if n else np.zeros(1, np.int64)
            cols.append((total[segs.ends] - total[segs.starts]) / np.maximum(1, size))
        nw = np.maximum(1, n_words)
        cols.append(np.minimum(size / nw, 40) / 10)
        cols.append(np.log1p(n_words) / 4)
        cols.append((n_words < 3).astype(float))
        # words inside three-word windows that come twice or more in the document
        again = np.zeros(len(h), bool)
        if len(h) > 2:
            ok = words.row[:-2] == words.row[2:]
            tri = mix(h[:-2] * _SHINGLE[0] + h[1:-1] * _SHINGLE[1] + h[2:] * _SHINGLE[2] + words.row[:-2].astype(U64))
            _, inv, times = np.unique(tri, return_inverse=True, return_counts=True)
            hit = np.flatnonzero((times[inv] > 1) & ok)
            for j in range(3):
                again[hit + j] = True
        cols.append(np.bincount(of, again, len(size)) / nw)
        # lines that repeat one of the document
        line = np.zeros(len(size), U64)
        if len(h):
            np.add.at(line, of, mix(h + U64(7)))
        _, inv, times = np.unique(mix(line + segs.row.astype(U64) * _SHINGLE[0]), return_inverse=True, return_counts=True)
        cols.append((times[inv] > 1).astype(float) if len(size) else size)
        # distinct words of the line
        pair = np.unique(mix(h + of.astype(U64) * _SHINGLE[1]), return_index=True)[1]
        cols.append(np.bincount(of[pair], minlength=len(size)) / nw)
        cols.append(np.log1p(size) / 8)
        cols.append(np.ones(len(size)))
        own = np.stack(cols, 1)[keep].astype(np.float32)
        self.row, self.size = segs.row[keep], size[keep]
        self.first = np.searchsorted(self.row, np.arange(len(offs)))
        prev, nxt = np.zeros_like(own), np.zeros_like(own)
        if len(own) > 1:
            same = (self.row[1:] == self.row[:-1])[:, None]
            prev[1:] = np.where(same, own[:-1], 0)
            nxt[:-1] = np.where(same, own[1:], 0)
        self.x = np.concatenate([own, prev, nxt], 1)


def _groups(lens: np.ndarray) -> Iterator[np.ndarray]:
    """Rows with lines, in groups of like length."""
    order = np.argsort(lens, kind="stable")
    order = order[lens[order] > 0]
    at = 0
    while at < len(order):
        group = order[at : at + 512]
        longest = lens[order[at]]
        group = group[lens[group] <= max(2 * longest, longest + 16)]
        at += len(group)
        yield group


def forward_backward(emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of ``good`` per line, log Z per row, and expected transitions (2 x 2).

    ``emit`` is the score of good over bad per line; ``trans[a, b]`` the score of b after a.
    """
    lens = np.diff(first)
    good, logz, pairs = np.zeros(len(emit)), np.zeros(len(lens)), np.zeros((2, 2))
    for group in _groups(lens):
        n = lens[group]
        steps = int(n.max())
        at = first[group][None, :] + np.arange(steps)[:, None]
        live = np.arange(steps)[:, None] < n
        e = np.zeros((steps, len(group), 2))
        e[..., 1] = np.where(live, emit[np.minimum(at, len(emit) - 1)], 0.0)
        alpha = np.empty_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            a = alpha[t - 1]
            s0 = np.logaddexp(a[:, 0] + trans[0, 0], a[:, 1] + trans[1, 0])
            s1 = np.logaddexp(a[:, 0] + trans[0, 1], a[:, 1] + trans[1, 1])
            alpha[t] = np.where(live[t][:, None], np.stack([s0, s1], 1) + e[t], a)
        z = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
        logz[group] = z
        beta = np.zeros((len(group), 2))
        for t in range(steps - 1, -1, -1):
            p1 = 1 / (1 + np.exp(np.clip(alpha[t, :, 0] + beta[:, 0] - alpha[t, :, 1] - beta[:, 1], -500, 500)))
            good[at[t][live[t]]] = p1[live[t]]
            if not t:
                break
            b = beta + e[t]
            on = live[t]
            w = alpha[t - 1][:, :, None] + trans + b[:, None, :] - z[:, None, None]
            pairs += np.exp(np.minimum(w[on], 0)).sum(0)
            new = np.stack([np.logaddexp(trans[0, 0] + b[:, 0], trans[0, 1] + b[:, 1]), np.logaddexp(trans[1, 0] + b[:, 0], trans[1, 1] + b[:, 1])], 1)
            beta = np.where(on[:, None], new, beta)
    return good, logz, pairs


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, trans: np.ndarray, slope: float, offset: float):
        self.mean, self.scale, self.weights, self.trans, self.slope, self.offset = mean, scale, weights, trans, slope, offset

    def share(self, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
        """(good share by length, whether the row has a line) per row; marginals via ``line_scores``."""
        good = self.line_scores(lines)
        n = len(lines.first) - 1
        total = np.bincount(lines.row, lines.size, n)
        return np.bincount(lines.row, lines.size * good, n) / np.maximum(1e-9, total), total > 0

    def line_scores(self, lines: Lines) -> np.ndarray:
        emit = ((lines.x - self.mean) / self.scale) @ self.weights
        return forward_backward(emit.astype(np.float64), lines.first, self.trans)[0]

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi, buf, offs in text_blocks(texts, 1 << 20):
            share, some = self.share(Lines(buf, offs))
            margin = self.slope * _logit(share) + self.offset
            out[lo:hi] = np.where(some, 1 / (1 + np.exp(-np.clip(margin, -35, 35))), 0.0)
        return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(rows: list[tuple[str, int]], steps: int = 60, rate: float = 0.1, l2: float = 1e-2) -> Model:
    """Gradient ascent (Adam) on the mean conditional log-likelihood of the line labels."""
    texts = pa.array([t for t, _ in rows], pa.large_string())
    y = np.array([float(v) for _, v in rows])
    parts = [(lo, Lines(buf, offs)) for lo, _, buf, offs in text_blocks(texts)]
    d = 3 * N_FEATURES
    if len(set(y.tolist())) < 2 or not sum(len(p.row) for _, p in parts):
        return Model(np.zeros(d), np.ones(d), np.zeros(d), np.zeros((2, 2)), 1.0, 0.0)
    x = np.concatenate([p.x for _, p in parts])
    row = np.concatenate([p.row + lo for lo, p in parts])
    size = np.concatenate([p.size for _, p in parts])
    first = np.searchsorted(row, np.arange(len(y) + 1))
    mean, scale = x.mean(0), x.std(0)
    flat = scale < 1e-6
    mean[flat], scale[flat] = 0.0, 1.0
    x = (x - mean) / scale
    gold = y[row]
    # each document counts once, whatever its number of lines
    per = np.maximum(1, np.diff(first))[row]
    weights, trans = np.zeros(d), np.zeros((2, 2))
    both = row[1:] == row[:-1]
    seen = np.array([[((gold[1:] == b) & (gold[:-1] == a) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
    m, v = np.zeros(d + 4), np.zeros(d + 4)
    for k in range(1, steps + 1):
        good, _, pairs = forward_backward((x @ weights).astype(np.float64), first, trans)
        g = np.concatenate([x.T @ ((gold - good) / per) / len(y) - l2 * weights, ((seen - pairs) / len(gold) - l2 * trans).ravel()])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        weights = weights + move[:d]
        trans = trans + move[d:].reshape(2, 2)
    good, _, _ = forward_backward((x @ weights).astype(np.float64), first, trans)
    some = np.diff(first) > 0
    share = np.bincount(row, size * good, len(y)) / np.maximum(1e-9, np.bincount(row, size, len(y)))
    slope, offset = _calibrate(_logit(share[some]), y[some])
    return Model(mean.astype(np.float32), scale.astype(np.float32), weights, trans, slope, offset)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two-parameter logistic fit by Newton steps; the slope stays positive."""
    a, b = 1.0, 0.0
    t = np.where(y == 1, 1 - 1e-3, 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        w = p * (1 - p) + 1e-9
        ga, gb = ((p - t) * x).sum() + 1e-2 * (a - 1), (p - t).sum() + 1e-2 * b
        haa, hab, hbb = (w * x * x).sum() + 1e-2, (w * x).sum(), w.sum() + 1e-2
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        a, b = a - 0.5 * (hbb * ga - hab * gb) / det, b - 0.5 * (haa * gb - hab * ga) / det
    return (float(a), float(b)) if a > 0 and np.isfinite([a, b]).all() else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    return fit(sample(docs, labels, "quality", bound, values=(0, 1)))


def score(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    def rows(m: Model, texts: pa.Array) -> list[pa.Array]:
        s = m.scores(texts)
        return [pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]

    return apply_scores(docs, train(docs, labels, bound), 4, 2, "score double, predicted int", rows)


def label_lines(docs: DataFrame, model: Model) -> DataFrame:
    """One row per line with a word: doc_id, line (from 0), n_bytes, p_good, good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, buf, offs in text_blocks(batch.column(1)):
                lines = Lines(buf, offs)
                good = shared.value.line_scores(lines)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(lines.row + lo)),
                        pa.array(np.arange(len(good)) - lines.first[lines.row]),
                        pa.array(lines.size.astype(np.int64)),
                        pa.array(good),
                        pa.array(good >= 0.5),
                    ],
                    names=["doc_id", "line", "n_bytes", "p_good", "good"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, line long, n_bytes long, p_good double, good boolean"
    )


def good_rows(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    return keep_rows(docs, train(docs, labels, bound), lambda m, texts: m.scores(texts) >= THRESHOLD)


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels)
