"""Learned operators: pieces against brute force, and held-out accuracy on small corpora."""

from __future__ import annotations

import itertools
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from veristrata.llm import labelled, language_id, lm_scoring, quality_crf, textkernel, toxicity

from .conftest import sentence


def held(i, mod=4, rest=2):
    return i is not None and zlib.crc32(str(i).encode()) % mod == rest


def test_words():
    import re

    texts = ["", "a b", " x\ty\n\nz ", "é ü 東", None, "A" * 300 + " b", "\x0b\x0c"]
    for lo, hi, buf, offs in textkernel.text_blocks(pa.array(texts), 4):
        w = textkernel.Words(buf, offs)
        got = [[textkernel.string_at(buf, s, e) for s, e in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]])] for i in range(hi - lo)]
        assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts[lo:hi]]
    (_, _, buf, offs), = textkernel.text_blocks(pa.array(["Ab aB ab b"]))
    h = textkernel.word_hashes(buf, textkernel.Words(buf, offs))
    assert len({*h.tolist()}) == 2 and h[0] == h[1] == h[2]


def test_forward_backward():
    rng = np.random.default_rng(0)
    lens = [0, 1, 4, 6, 3]
    first = np.concatenate([[0], np.cumsum(lens)])
    emit, trans = rng.normal(size=first[-1]) * 2, rng.normal(size=(2, 2))
    good, logz, pairs = quality_crf.forward_backward(emit, first, trans)
    want = np.zeros((2, 2))
    for d, n in enumerate(lens):
        if not n:
            continue
        e, total, mass, pair = emit[first[d] : first[d + 1]], 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(e[i] for i in range(n) if path[i]) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += p
            mass += p * np.array(path)
            for a, b in zip(path, path[1:]):
                pair[a, b] += p
        assert logz[d] == pytest.approx(np.log(total))
        assert good[first[d] : first[d + 1]] == pytest.approx(mass / total)
        want += pair / total
    assert pairs == pytest.approx(want)


def test_viterbi():
    rng = np.random.default_rng(1)
    for k in range(40):
        lens = rng.integers(0, 7, 6)
        first = np.concatenate([[0], np.cumsum(lens)])
        s = (rng.normal(size=(first[-1], 3)) * rng.choice([1, 5])).astype(np.float32)
        got = language_id.viterbi(s, first, 2.0)
        for a, b in zip(first[:-1], first[1:]):
            value = lambda p: s[np.arange(a, b), p].sum() - 2.0 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731
            if b > a:
                best = max(value(list(p)) for p in itertools.product(range(3), repeat=b - a))
                assert value(got[a:b].tolist()) == pytest.approx(best, abs=1e-3)


def test_gradient():
    """Analytic gradient of the network against differences."""
    rng = np.random.default_rng(0)
    totals = np.full(2 * lm_scoring.RARE + 2, 500, np.int64)
    totals[-2:] = 5, 1
    words = np.stack([rng.integers(-(2**62), 2**62, 50), rng.integers(1, 9, 50), rng.integers(0, lm_scoring.RARE, 50)])
    lex = lm_scoring.Lexicon(totals, words)
    w = {k: v.astype(np.float64) for k, v in lm_scoring.initial(lex).items()}
    x, y = rng.integers(0, lm_scoring.VOCAB, (4, 3)), rng.integers(0, lm_scoring.VOCAB, (4, 3))
    x[2, 1] = lex.end
    h0 = rng.normal(size=(3, lm_scoring.HIDDEN))

    def loss(w):
        h, total = h0, 0.0
        for t in range(4):
            h = lm_scoring._step(w, x[t], h * (x[t] != lex.end)[:, None])
            total -= lm_scoring.log_probs(w, h, y[t]).sum()
        return total / 12

    g = {k: np.full_like(v, 9.0) for k, v in w.items()}
    after = lm_scoring._gradient(w, x, y, h0, lex.end, g)
    h = h0
    for t in range(4):
        h = lm_scoring._step(w, x[t], h * (x[t] != lex.end)[:, None])
    assert after == pytest.approx(h)
    for name in w:
        flat = np.flatnonzero(np.abs(g[name].ravel()) > 1e-4)
        for i in rng.choice(flat, min(4, len(flat)), replace=False):
            up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            up[name].ravel()[i] += 1e-5
            down[name].ravel()[i] -= 1e-5
            assert g[name].ravel()[i] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=2e-2, abs=1e-6), name


def test_network_is_a_distribution():
    rng = np.random.default_rng(0)
    totals = np.zeros(2 * lm_scoring.RARE + 2, np.int64)
    lex = lm_scoring.Lexicon(totals, np.zeros((3, 0), np.int64))
    w = lm_scoring.initial(lex)
    h = rng.normal(size=(1, lm_scoring.HIDDEN)).astype(np.float32)
    y = np.arange(lm_scoring.VOCAB)
    assert np.exp(lm_scoring.log_probs(w, np.repeat(h, len(y), 0), y)).sum() == pytest.approx(1, abs=1e-4)


def test_state_is_carried():
    """One long document scores as its steps taken one by one."""
    rng = np.random.default_rng(0)
    lex = lm_scoring.Lexicon(np.zeros(2 * lm_scoring.RARE + 2, np.int64), np.zeros((3, 0), np.int64))
    w = lm_scoring.initial(lex)
    n = np.array([3, 700, 1, 40])
    tok = rng.integers(0, lm_scoring.VOCAB, n.sum())
    got = lm_scoring.score_documents(w, tok, n, lex.end)
    start = np.cumsum(n) - n
    for d in range(len(n)):
        h, x, total = np.zeros((1, lm_scoring.HIDDEN), np.float32), np.array([lex.end]), 0.0
        for y in tok[start[d] : start[d] + n[d]]:
            h = lm_scoring._step(w, x, h)
            x = np.array([y])
            total += lm_scoring.log_probs(w, h, x)[0]
        assert got[d] == pytest.approx(total / np.log(10), rel=1e-4)


def test_lm_base(docs, rows, nothing):
    import collections
    import math
    import re

    low = {i: i + 32 for i in range(65, 91)}
    toks = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(low)) + [None]) for r in rows]
    count = collections.Counter(t for i, ts in toks if not held(i, 5, 1) for t in ts)
    n, v = sum(count.values()), len(count)
    want = collections.Counter((i, held(i, 5, 1), len(ts), sum(t in count for t in ts), n, round(sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 3)) for i, ts in toks)
    out = lm_scoring.score(docs, rounds=2).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in out) == want
    assert all(r.score < 0 and np.isfinite(r.score) for r in out)
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)
    assert lm_scoring.op5(nothing).count() == 0


def test_all_training_text_trains(monkeypatch):
    import types

    import pyspark

    end = lm_scoring.VOCAB - 1
    n = np.array([200_000, *[10] * 5000, 0, 7], np.int64)
    held_out = np.arange(len(n)) % 5 == 1
    tok = np.random.default_rng(4).integers(0, lm_scoring.VOCAB, n.sum()).astype(np.uint16)
    batch = pa.RecordBatch.from_pydict({"seg": [7], "tokens": [tok.tobytes()], "n": [n.tobytes()], "held": [held_out.tobytes()]})
    streams = []
    with monkeypatch.context() as m:
        m.setattr(lm_scoring, "train", lambda w, stream, end, rate: streams.append(stream) or w)
        m.setattr(pyspark.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
        box = types.SimpleNamespace(value={"w": np.ones(1)})
        made = [list(lm_scoring._train_round(box, types.SimpleNamespace(value=types.SimpleNamespace(end=end)), number, 3)([batch])) for number in range(3)]
    # the rounds together learn every training document once, each of them whole and in one round
    want = np.sort(tok[~np.repeat(held_out, n)])
    assert all(s[0] == end for s in streams) and len(streams) == 3 and np.array_equal(np.sort(np.concatenate([s[1:] for s in streams])), want)
    assert any(tok[:200_000].tobytes() in s.astype(np.uint16).tobytes() for s in streams)
    # weights count by tokens
    assert [(r[0]["count"][0].as_py(), np.frombuffer(r[0]["weights"][0].as_py())[0]) for r in made] == [(len(s), len(s)) for s in streams]
    for size in (1, 2, 20, 33, 34, 64, 700, 1999, 30_000):
        seen = []

        def window(w, x, y, h, end, g):
            seen.extend(zip(x.ravel().tolist(), y.ravel().tolist(), strict=True))
            return h

        with monkeypatch.context() as m:
            m.setattr(lm_scoring, "_gradient", window)
            lm_scoring.train({"w": np.zeros(1, np.float32)}, np.arange(size), end)
        assert sorted(seen) == [(i, i + 1) for i in range(size - 1)]


def test_learning_lowers_the_loss():
    """A stream with a rule: the trained network beats the unigrams it starts from by far."""
    totals = np.zeros(2 * lm_scoring.RARE + 2, np.int64)
    lex = lm_scoring.Lexicon(totals, np.zeros((3, 0), np.int64))
    w = lm_scoring.initial(lex)
    stream = np.tile([lex.end, *range(100, 140)], 1500)
    before, after = (lm_scoring.score_documents(v, stream[1:42], np.array([41]), lex.end)[0] for v in (w, lm_scoring.train(w, stream, lex.end)))
    assert after > before / 2


def test_tree(spark):
    """More rows than a task may take are added up in levels."""
    df = spark.createDataFrame([(i, 2, np.array([float(i), 1.0]).tobytes()) for i in range(300)], lm_scoring._SUMS)
    got = lm_scoring._tree(df, 300, lm_scoring._add_up, lm_scoring._SUMS)
    assert 1 < len(got) <= lm_scoring.FAN and sum(r["count"] for r in got) == 600
    assert sum(np.frombuffer(r["weights"]) for r in got).tolist() == [sum(range(300)), 300]


@pytest.fixture(scope="module")
def corpus(spark):
    """Clean, junk and toxic documents in three languages."""
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        lang = ("en", "fr", "ru")[i % 3]
        lines = [sentence(rng, lang, rng.randrange(6, 20)) for _ in range(rng.randrange(2, 8))]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if toxic:
            lines[-1] += " " + " ".join(rng.sample(["vile", "scum", "moron", "trash"], 3))
        if bad:
            lines = [x.upper().replace(" ", "!! ### ") for x in lines]
        docs.append((i, "\n".join(lines), lang, "s", 0.0))
        labels.append((i, int(not bad), int(toxic), "clash"))
    labels += [(9999, None, None, ""), (None, 1, 0, ""), (3, None, None, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), docs, labels


@pytest.mark.parametrize("op, column", [(quality_crf.op1, 1), (toxicity.op6, 2)])
def test_labels(corpus, docs, nothing, op, column):
    d, lab, raw, labels = corpus
    got = {r.doc_id: r for r in op(d, lab).collect()}
    assert len(got) == len(raw) and all(r.held_out == held(i) for i, r in got.items())
    test = [i for i in got if got[i].held_out]
    truth = {x[0]: x[column] for x in labels[:400]}
    assert np.mean([got[i].predicted == truth[i] for i in test]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = op(docs, lab).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert op(nothing, lab).count() == 0
    assert len(op(docs, lab.limit(0)).collect()) == docs.count()


def test_language(corpus, docs, nothing):
    d, _, raw, _ = corpus
    got = {r.doc_id: r for r in language_id.op7(d).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in raw if held(i))
    odd = language_id.op7(docs).collect()
    assert len(odd) == docs.count()
    by = {r.doc_id: r for r in odd if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (115, 116, 117, 121))
    assert by[120].lang_pred == "fr"
    assert language_id.op7(nothing).count() == 0
    unlabelled = language_id.op7(docs.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_mixed_language_spans(corpus, spark):
    d, _, raw, _ = corpus
    model = language_id.train(d)
    rng = random.Random(5)
    a, b, c = sentence(rng, "en", 40), sentence(rng, "fr", 40), sentence(rng, "ru", 40)
    one = spark.createDataFrame([(1, f"{a} {b} {c}")], "doc_id long, text string")
    got = sorted((r.start, r.end, r.lang) for r in language_id.spans(one, model).collect())
    assert [x[2] for x in got] == ["en", "fr", "ru"] and got[0][0] == 0 and got[-1][1] == len(f"{a} {b} {c}".encode())
    assert abs(got[1][0] - len(a)) < 12


def test_line_labels(corpus, spark):
    d, lab, raw, _ = corpus
    model = quality_crf.train(d, lab)
    rows = quality_crf.label_lines(d.filter("doc_id < 10"), model).collect()
    assert {r.doc_id for r in rows if not r.good} == {0, 5}


# ------------------------------------------------------------------ samples


def _rare(spark, n=3000, rare=10):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        bad = i % (n // rare) == 3
        text = " ".join(rng.choice("sun moon tree house road river stone cloud".split()) for _ in range(12)) + (" grunk vile zorp mugwort" if bad else "")
        docs.append((i, text, "en", "s", 1))
        labels.append((i, 0 if bad else 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_a_label_of_a_third_of_a_percent_is_learned(spark):
    docs, labels = _rare(spark)
    bad = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    assert len(bad) == 10
    assert {r.doc_id for r in toxicity.op6(docs, labels).filter("predicted = 1").collect()} == bad
    scores = {r.doc_id: r.score for r in quality_crf.op1(docs, labels).collect()}
    assert max(scores[i] for i in bad) < 0.5 < min(s for i, s in scores.items() if i not in bad)


def test_sample_bounds(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i % 40} {'x' * 100}", "a" if i % 40 < 30 else "b") for i in range(400)] + [(41, "two", "b"), (42, None, "c"), (None, "no id", "a")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(45)] + [(4, 1), (4, 0), (6, None), (7, 9)], "doc_id long, label int")
    got = labelled.sample(docs, labels, "label", 5, values=(0, 1))
    assert sorted(x for _, x in got) == [0] * 5 + [1] * 5 and len(set(got)) == 10
    whole = dict(labelled.sample(docs, labels, "label", 1000, values=(0, 1)))
    assert len(whole) == len([i for i in [*range(40), 41, 42] if zlib.crc32(str(i).encode()) % 4 != 2])  # equal rows once, an id's smallest label
    assert all(x == int(t.split()[1]) % 2 for t, x in whole.items() if t.startswith("text"))
    small = labelled.sample(docs, labels, "label", 1000, values=(0, 1), most_bytes=600)
    assert all(1 <= sum(x == v for _, x in small) <= 4 for v in (0, 1))
    assert {x for _, x in labelled.sample(docs, docs, "lang", 3, most_classes=2)} == {"a", "b"}


def test_many_languages_and_one_document_of_a_language(spark):
    rng = random.Random(9)
    words = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)] for k in range(300)}
    ids = iter(i for i in range(10**6) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(next(ids), " ".join(rng.choices(w, k=30)), lang) for lang, w in words.items() for _ in range(2 if lang != "l007" else 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, most_langs=300)
    assert len(model.langs) == 300
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.98 * len(rows)
    assert len(language_id.train(df).langs) == 256


def test_row_sums_and_wide_logits():
    rng = np.random.default_rng(1)
    for n, v in ((3072, 1024), (5, 10), (100, 1), (1, 4), (13, 1), (12, 1)):
        ids, rows, out = np.minimum(rng.zipf(1.3, n) - 1, v - 1), rng.standard_normal((n, 7)), np.ones((v, 7))
        lm_scoring._row_sums(rows, ids, out)
        want = np.zeros((v, 7))
        np.add.at(want, ids, rows)
        assert np.allclose(out, want)
    for scale in (1.0, 60.0, 5000.0):  # rows close together, and rows that no one constant serves
        a = rng.standard_normal((50, 32)) * scale + rng.standard_normal((50, 1)) * scale
        want = a - a.max(1, keepdims=True)
        want -= np.log(np.exp(want).sum(1, keepdims=True))
        at = rng.integers(0, 32, 50)
        assert np.allclose(lm_scoring._log_prob(a.copy(), at), want[np.arange(50), at])
        assert np.allclose(lm_scoring._softmax(a.copy()), np.exp(want))
    assert lm_scoring._softmax(np.zeros((0, 4))).shape == (0, 4)


def test_steady_worker_keeps_its_pages():
    """Arrays that come and go in a task do not go back to the system each time."""
    code = """
import resource, numpy as np
from veristrata.llm.storage import steady
def run(batches):
    for _ in batches:
        a = [np.ones(1 << 19, np.uint8) for _ in range(4)]
        yield len(a)
list(steady(run)(iter(range(20))))
before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
assert sum(steady(run)(iter(range(500)))) == 2000
print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
"""
    faults = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout)
    assert faults < 20_000  # 2,000 arrays of 128 pages


def test_word_hashes_of_any_number_of_words_at_once():
    text = " ".join(f"w{i} é{i}" for i in range(7000)).encode() + b" " + b"x" * 300
    buf, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    words = textkernel.Words(buf, offs)
    whole = textkernel.word_hashes(buf, words)
    for i in (0, 1, 4095, 4096, 9000, len(whole) - 1):
        one = np.frombuffer(text.split(b" ")[i], np.uint8)
        assert whole[i] == textkernel.word_hashes(one, textkernel.Words(one, np.array([0, len(one)])))[0]
    u, at, of = lm_scoring._distinct(np.concatenate([whole[::-1], whole]))
    assert len(u) == len(whole) and (u[of] == np.concatenate([whole[::-1], whole])).all() and (at == np.arange(len(u))).all()
