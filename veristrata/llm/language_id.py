"""Operator 7 - language identification of mixed-language text.

Every word's script (by code-point ranges) narrows the candidate languages to those
that were seen with that script; byte n-gram scores of the word, learned per language,
rank them; a Viterbi pass over the words with a switching penalty labels spans.  The
document's language is the one whose spans hold most letters; the score is its share
of the letters.

The model is fitted on the driver on a sample of at most ``bound`` texts a language and a
documented number of bytes (labelled.MOST_BYTES).  However rare, a language is learned
from what it has; only beyond ``most_langs`` languages do the least frequent stay out.

Defined results: a very long text is labelled whole; of languages with equal letters the
first by code point wins (ties); a repeated id is labelled once a row, and its equal
rows are learned once; null texts and texts without a letter give ``und`` with score 0 (no
span); words without a letter join the span around them; without a learned language
everything is ``und``; equal texts agree; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import MOST_CLASSES, apply_scores, keep_rows, sample
from .storage import lean
from .textkernel import U64, Words, mix, text_blocks, word_hashes

BOUND, TABLE_BITS, ORDERS, SWITCH = 1500, 16, (1, 2, 3, 4), 8.0
LEAST_SHARE = 0.5

#: First and last code point of the letter ranges of each script.
SCRIPTS: dict[str, tuple[tuple[int, int], ...]] = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "indic": ((0x900, 0xDFF),),
    "thai_lao": ((0xE00, 0xEFF),),
    "georgian": ((0x10A0, 0x10FF),),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}


def _lead_table() -> np.ndarray:
    """First two UTF-8 bytes -> script number (0: none; 1 up: SCRIPTS in order)."""
    t = np.zeros(1 << 16, np.uint8)
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for lo, hi in ranges:
            for c in range(lo, hi + 1):
                b = chr(c).encode()
                if len(b) == 1:
                    t[(b[0] << 8) : (b[0] << 8) + 256] = i
                else:
                    t[b[0] << 8 | b[1]] = i
    return t


_LEAD = _lead_table()
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _lower(buf: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1, byte by byte."""
    out = buf.copy()
    out[(buf >= 0x41) & (buf <= 0x5A)] += 32
    after = np.zeros(len(buf), bool)
    after[1:] = buf[:-1] == 0xC3
    out[after & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)] += 32
    return out


class _Parsed:
    """Words of a block with letter counts, scripts and n-gram cells of the distinct words."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.words = w = Words(buf, offs)
        nxt = np.zeros(len(buf), np.uint8)
        if len(buf):
            nxt[:-1] = buf[1:]
        script = _LEAD[buf.astype(np.uint16) << 8 | nxt]
        script[(buf >= 0x80) & (buf < 0xC0)] = 0  # continuation bytes start no letter
        letters = script > 0
        total = np.concatenate([[0], np.cumsum(letters)])
        self.letters = total[w.ends] - total[w.starts]
        self.row_letters = total[offs[1:]] - total[offs[:-1]]
        at = np.flatnonzero(letters)
        first = np.searchsorted(at, w.starts)
        has = self.letters > 0
        self.script = np.zeros(len(w.starts), np.uint8)
        self.script[has] = script[at[first[has]]]
        h = word_hashes(buf, w)
        _, self.rep, self.of = np.unique(h, return_index=True, return_inverse=True)
        self.low = _lower(buf)

    def cells(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order, (distinct word, ascending; table cell) of the n-grams of words with letters."""
        keep = np.flatnonzero(self.letters[self.rep] > 0)
        s, e = self.words.starts[self.rep[keep]], self.words.ends[self.rep[keep]]
        n = e - s + 2  # a boundary mark on either side
        end = np.cumsum(n)
        at = np.arange(int(end[-1]) if len(end) else 0)
        begin = np.repeat(end - n, n)
        k = at - begin
        src = np.repeat(s, n) + k - 1
        edge = (k == 0) | (at == np.repeat(end, n) - 1)
        byte = np.where(edge, 0, self.low[np.clip(src, 0, max(0, len(self.low) - 1))]) if len(at) else np.zeros(0, np.uint8)
        byte = np.where((byte < 0x80) & ~_ASCII_LETTER[byte], 0, byte).astype(np.uint64)  # digits and marks are boundaries
        owner = np.repeat(keep, n)
        mask = U64((1 << TABLE_BITS) - 1)
        for o in ORDERS:
            v = np.zeros(max(0, len(byte) - o + 1), np.uint64)
            for j in range(o):
                v = (v << U64(8)) | byte[j : len(byte) - o + 1 + j]
            ok = (owner[: len(v)] == owner[o - 1 :]) & (v != 0)
            yield owner[: len(v)][ok], (mix(v[ok] + U64(o << 40)) & mask).astype(np.int64) + (ORDERS.index(o) << TABLE_BITS)


class Model:
    """Log-probabilities of n-gram cells per language and the scripts of each language."""

    def __init__(self, langs: list[str], table: np.ndarray, scripts: np.ndarray):
        self.langs, self.table, self.scripts = langs, table, scripts

    def word_scores(self, p: _Parsed) -> np.ndarray:
        out = np.zeros((len(p.rep), len(self.langs)), np.float32)
        for word, cell in p.cells():
            if len(word):
                start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                out[word[start]] += np.add.reduceat(self.table[cell], start, axis=0)
        out /= len(ORDERS)
        allowed = self.scripts[p.script[p.rep]]  # narrow by script unless nothing is left
        narrow = allowed.any(1) & (p.script[p.rep] > 0)
        return np.where(narrow[:, None] & ~allowed, np.float32(-1e4), out)


def fit(rows: list[tuple[str, str]]) -> Model:
    langs = sorted({lang for _, lang in rows})
    cells = len(ORDERS) << TABLE_BITS
    table = np.empty((cells, max(1, len(langs))), np.float32)  # 1 MB a language
    scripts = np.zeros((len(SCRIPTS) + 1, max(1, len(langs))))
    texts_of: dict[str, list[str]] = {}
    for t, lang in rows:
        texts_of.setdefault(lang, []).append(t)
    for i, lang in enumerate(langs):
        counts = np.zeros(cells)
        for _, _, buf, offs in text_blocks(pa.array(texts_of[lang], pa.large_string())):
            p = _Parsed(buf, offs)
            often = np.bincount(p.of, minlength=len(p.rep)) if len(p.rep) else np.zeros(0)
            for word, cell in p.cells():
                counts += np.bincount(cell, often[word], cells)
            scripts[:, i] += np.bincount(p.script, p.letters, len(scripts))
        c = counts.reshape(len(ORDERS), -1) + 0.1
        table[:, i] = np.log(c / c.sum(1, keepdims=True)).ravel()
    if not langs:
        table[:] = 0
    table -= table.max(1, keepdims=True)  # only differences between languages count
    share = scripts / np.maximum(1, scripts.sum(0))
    return Model(langs, table, share >= 0.01)


def _constant(scores: np.ndarray, first: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the best single language and whether no path with a switch can beat it.

    An interval spent in other languages costs a switch at least and gains at most the
    sum, over its words, of the best other score less the single language's; so if no
    interval's sum passes the penalty, the constant path is a best path.
    """
    lens = np.diff(first)
    some = np.flatnonzero(lens > 0)
    dom = np.zeros(len(lens), np.int16)
    dom[some] = np.add.reduceat(scores, first[:-1][some], axis=0, dtype=np.float64).argmax(1)
    row = np.repeat(np.arange(len(lens)), lens)
    gain = (scores.max(1) - scores[np.arange(len(scores)), dom[row]]).astype(np.float64)
    lead = scores[np.arange(len(scores)), dom[row]] - np.where(np.arange(scores.shape[1]) == dom[row][:, None], -np.inf, scores).max(1)
    step = np.where(gain > 0, gain, -np.minimum(lead, 1e6))
    upto = np.cumsum(step) - row * 1e9
    start = np.concatenate([[0.0], upto[:-1]])
    fresh = np.zeros(len(row), bool)
    fresh[first[:-1][some]] = True
    start[fresh] = upto[fresh] - step[fresh]
    best = upto - np.minimum.accumulate(start)
    worst = np.zeros(len(lens))
    worst[some] = np.maximum.reduceat(best, first[:-1][some])
    return dom, worst <= switch


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every word; ``first`` bounds each row's words.

    Rows that provably stay in one language are settled at once; the others step
    through their words together with rows of like length.
    """
    n_lang = scores.shape[1]
    lens = np.diff(first)
    if not len(scores) or n_lang < 2:
        return np.zeros(len(scores), np.int16)
    dom, settled = _constant(scores, first, switch)
    out = np.repeat(dom, lens)
    order = np.argsort(lens, kind="stable")
    order = order[(lens[order] > 0) & ~settled[order]]
    at = 0
    while at < len(order):
        longest = lens[order[at]]
        group = order[at : at + 256]
        group = group[lens[group] <= max(2 * longest, longest + 64)]
        at += len(group)
        start, n = first[group], lens[group]
        steps = int(n.max())
        back = np.zeros((steps, len(group), n_lang), bool)  # True: came from the best other state
        best_at = np.zeros((steps, len(group)), np.int16)
        v = scores[start].copy()
        final = np.zeros((len(group), n_lang), np.float32)
        for t in range(steps):
            if t:
                best = v.argmax(1)
                top = v[np.arange(len(group)), best] - switch
                back[t] = v < top[:, None]
                best_at[t] = best
                v = np.where(back[t], top[:, None], v)
                v += scores[np.minimum(start + t, start + n - 1)]
            done = n == t + 1
            if done.any():
                final[done] = v[done]
        state = final.argmax(1)
        rows = np.arange(len(group))
        for t in range(steps - 1, -1, -1):
            live = t < n
            out[(start + t)[live]] = state[live]
            if t:
                state = np.where(live & back[t, rows, state], best_at[t], state)
    return out


def _labels(model: Model, texts: pa.Array, switch: float) -> Iterator[tuple[int, int, _Parsed, np.ndarray, np.ndarray]]:
    for lo, hi, buf, offs in text_blocks(texts):
        p = _Parsed(buf, offs)
        s = model.word_scores(p)[p.of] if len(p.rep) else np.zeros((0, len(model.langs)), np.float32)
        yield lo, hi, p, viterbi(s, p.words.first, switch), offs


def _documents(model: Model, texts: pa.Array, switch: float = SWITCH) -> list[pa.Array]:
    lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    if model.langs:
        for lo, hi, p, path, _ in _labels(model, texts, switch):
            held = np.bincount(p.words.row * len(model.langs) + path, p.letters, (hi - lo) * len(model.langs)).reshape(hi - lo, -1)
            some = held.sum(1) > 0
            for i in np.flatnonzero(~some | ~_ascii_letter_rows(p, hi - lo)):
                t = texts[lo + int(i)].as_py()  # letters outside the ranges, or marks inside them
                some[i] = bool(t) and any(map(str.isalpha, t))
            top = held.argmax(1)
            lang[lo:hi][some] = np.array(model.langs, object)[top[some]]
            score[lo:hi][some] = (held.max(1) / np.maximum(1, held.sum(1)))[some]
    return [pa.array(lang, pa.string()), pa.array(score)]


def _ascii_letter_rows(p: _Parsed, n: int) -> np.ndarray:
    w = p.words
    on = np.concatenate([[0], np.cumsum(_ASCII_LETTER[p.low])])
    per = on[w.ends] - on[w.starts]
    return np.bincount(w.row, per, n) > 0


def train(docs: DataFrame, bound: int = BOUND, most_langs: int = MOST_CLASSES) -> Model:
    return fit(sample(docs, docs, "lang", bound, most_classes=most_langs))


def predict(docs: DataFrame, model: Model | None = None, bound: int = BOUND, switch: float = SWITCH) -> DataFrame:
    model = train(docs, bound) if model is None else model
    return apply_scores(docs, model, 4, 2, "lang_pred string, score double", lambda m, texts: _documents(m, texts, switch))


def spans(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """One row per labelled span: doc_id, start, end (UTF-8 bytes of the text), lang."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, _, p, path, offs in _labels(m, batch.column(1), switch):
                w = p.words
                if not len(path):
                    continue
                cut = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (w.row[1:] != w.row[:-1])])
                last = np.r_[cut[1:] - 1, len(path) - 1]
                row = w.row[cut]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row + lo)),
                        pa.array((w.starts[cut] - offs[row]).astype(np.int64)),
                        pa.array((w.ends[last] - offs[row]).astype(np.int64)),
                        pa.array(np.array(m.langs, object)[path[cut]], pa.string()),
                    ],
                    names=["doc_id", "start", "end", "lang"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, end long, lang string")


def identified_rows(docs: DataFrame, least: float = LEAST_SHARE, bound: int = BOUND) -> DataFrame:
    """The documents with one main language: not ``und``, and at least ``least`` of the letters in it."""

    def keep(model: Model, texts: pa.Array) -> np.ndarray:
        lang, share = _documents(model, texts)
        return (np.asarray(lang, object) != "und") & (np.asarray(share) >= least)

    return keep_rows(docs, train(docs, bound), keep)


def op7(docs: DataFrame) -> DataFrame:
    return predict(docs)
