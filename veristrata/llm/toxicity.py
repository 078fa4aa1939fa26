"""Operator 6 - toxicity by FTRL-proximal logistic regression.

Features are the presence of hashed word n-grams (one and two words; single words also
by their first 4, 5 and 6 bytes, which inflected words share) and skip-grams (two
words with one or two between).  Per-coordinate rates and the L1 term leave few
weights other than zero; those alone are broadcast.  The model is fitted on the driver
on a sample of at most ``bound`` labelled documents a class.

Defined results: a null or empty text (or one without a word) scores the bias alone; a
very long text is scored whole, each feature once; equal texts score equally (ties need
no rule); a repeated id is scored once a row, and its equal rows are learned once;
without labelled rows every score is 0.5, the logistic of a zero margin; empty tables
give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .labelled import apply_scores, sample
from .textkernel import U64, Words, mix, text_blocks, word_hashes

BITS, BOUND, THRESHOLD = 20, 4000, 0.3
_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 256)]] = False
_SKIPS = (1, 2, 3)
_STEMS = (4, 5, 6)


def _features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature index) of every n-gram and skip-gram of a block."""
    w = Words(buf, offs, _NOT_WORD)
    h = word_hashes(buf, w)
    rows, feats = [w.row], [mix(h)]
    full = w.ends
    for k in _STEMS:
        longer = full - w.starts > k
        stem = Words.__new__(Words)
        stem.starts, stem.ends = w.starts[longer], w.starts[longer] + k
        rows.append(w.row[longer])
        feats.append(mix(word_hashes(buf, stem) + U64(1000 + k)))
    for gap in _SKIPS:
        if len(h) > gap:
            same = w.row[:-gap] == w.row[gap:]
            rows.append(w.row[:-gap][same])
            feats.append(mix(h[:-gap][same] * U64(0x9E3779B97F4A7C15) + h[gap:][same] + U64(gap)))
    return np.concatenate(rows), (np.concatenate(feats) & U64((1 << BITS) - 1)).astype(np.int64)


class Model:
    """Sparse weights (index, value) and a bias."""

    def __init__(self, index: np.ndarray, value: np.ndarray, bias: float):
        self.index, self.value, self.bias = index.astype(np.int32), value.astype(np.float32), float(bias)

    def scores(self, texts: pa.Array) -> np.ndarray:
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.index] = self.value
        out = np.empty(len(texts))
        for lo, hi, buf, offs in text_blocks(texts):
            row, f = _features(buf, offs)
            on = dense[f] != 0
            pairs = np.unique(row[on] * (1 << BITS) + f[on])
            margin = np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], hi - lo) + self.bias
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
        return out


def fit(rows: list[tuple[str, int]], alpha: float = 0.5, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0, epochs: int = 3) -> Model:
    """FTRL-proximal, one document at a time, positive and negative rows as sampled."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    texts = pa.array([t for t, _ in rows], pa.large_string())
    y = np.array([float(v) for _, v in rows])
    docs: list[np.ndarray] = []
    for lo, hi, buf, offs in text_blocks(texts):
        row, f = _features(buf, offs)
        pairs = np.unique(row * size + f)
        docs += np.split(pairs & (size - 1), np.searchsorted(pairs >> BITS, np.arange(1, hi - lo)))

    def weights(i: np.ndarray, penalty: np.ndarray | float) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for d, target in zip(docs, y, strict=True):
            i = np.append(d, size)  # the bias is a coordinate without L1
            penalty = np.full(len(i), l1)
            penalty[-1] = 0.0
            w = weights(i, penalty)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - target
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    every = np.arange(size)
    w = weights(every, l1)
    keep = np.flatnonzero(w)
    return Model(keep, w[keep], weights(np.array([size]), 0.0)[0])


def score(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    model = fit(sample(docs, labels, "toxic", bound, values=(0, 1)))

    def rows(m: Model, texts: pa.Array) -> list[pa.Array]:
        s = m.scores(texts)
        return [pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]

    return apply_scores(docs, model, 4, 2, "score double, predicted int", rows)


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels)
