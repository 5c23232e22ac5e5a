"""The trained models against plain loops: prediction by partial matching, both networks, and their bounded fits."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import langid, lm, quality


def ppm_scores(train, texts, order=5):
    """log10 probability of each text: dictionaries of contexts, escapes by method C, exclusion of what longer contexts hold."""
    counts = defaultdict(Counter)

    def steps(t):
        s = b"\xff" * order + t + b"\xff"
        return [(s[i - order : i], s[i]) for i in range(order, len(s))]

    for t in train:
        for h, c in steps(t):
            for k in range(order + 1):
                counts[h[order - k :]][c] += 1

    def log_p(h, c):
        out, excluded = 0.0, set()
        for k in range(order, -1, -1):
            left = {x: n for x, n in counts.get(h[order - k :], {}).items() if x not in excluded}
            if h[order - k :] not in counts or not left:
                continue
            total = sum(left.values()) + len(left)
            if c in left:
                return out + math.log10(left[c] / total)
            out += math.log10(len(left) / total)
            excluded |= set(left)
        return out - math.log10(max(1, 256 - len(excluded)))

    return [sum(log_p(h, c) for h, c in steps(t)) for t in texts]


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_lm_by_dictionaries(spark, most):
    from zlib import crc32

    texts = ["the cat sat on the mat", "the cat ran", "", None, "a\0b\0c the end", "zebra \U0001f600 ÿ", "the the the cat", "the mat sat", "x" * 50, "caterpillar", "the cat sat on the mat", "\0"] * 3
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = [(t or "").encode() for t in texts]
    train = [t for i, t in enumerate(raw) if crc32(str(i).encode()) % 7 != 2]
    got = {r.doc_id: r.score for r in lm.lm_scores(d, most=most).collect()}
    for i, want in enumerate(ppm_scores(train, raw)):
        assert got[i] == pytest.approx(want, rel=1e-9), texts[i]


def test_lm_without_training_texts(spark):
    d = spark.createDataFrame([(10, "abc")], "doc_id long, text string")
    one = next(i for i in range(100) if d.select((F.crc32(F.lit(str(i)).cast("binary")) % 7).alias("r")).first().r == 2)
    r = lm.lm_scores(d.withColumn("doc_id", F.lit(one))).first()
    assert r.held_out and r.train_tokens == 0 and r.base_score == 0 and r.score == pytest.approx(-4 * math.log10(256))


def test_quality_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [b"", b"ab", bytes(rng.integers(97, 100, 700).astype(np.uint8)), b"spam and eggs " * 300, bytes(rng.integers(0, 256, 5000).astype(np.uint8))]
    off = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    p = quality.train(texts, np.array([0, 1, 1, 0, 1], np.float32), epochs=1, least_steps=5)
    whole = quality.forward(p, *quality.prepared(data, off))["p"]
    for at_once in (1, 3, 512):
        monkeypatch.setattr(quality, "AT_ONCE", at_once)
        assert np.allclose(quality.score(p, data, off), whole, atol=1e-5)
    # what a byte repeats is looked for in its own text alone
    first = quality.symbols(data, np.array([0, 2]), np.array([0, 2]), np.array([2, 702]))
    alone = quality.prepared(np.frombuffer(texts[2], np.uint8), np.array([0, 700]))[0][0]
    assert (first[1] == alone).all()


def test_quality_fit_is_bounded(spark):
    """An id in many rows, and very long texts, don't grow the fit."""
    seen = []
    d = spark.range(500).select(F.lit(1).alias("doc_id"), F.concat(F.lit("good text "), F.col("id").cast("string")).alias("text")).union(spark.createDataFrame([(3, "bad"), (3, "x" * 100_000)], "doc_id int, text string"))
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id int, quality int")
    kept = quality.train
    try:
        quality.train = lambda texts, y, **k: seen.append((len(texts), max(map(len, texts)))) or kept(texts, y, least_steps=1, epochs=1)
        out = quality.quality_scores(d, labels, train_rows=50)
        assert out.count() == 502
    finally:
        quality.train = kept
    assert not seen or (seen[0][0] <= 50 and seen[0][1] <= quality.TRAIN_BYTES)


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def by_loop(p, text):
    """Mean probabilities of a text's bytes, one byte and one unit at a time. Update and reset weights stand halved in p."""
    h_n, out = langid.HIDDEN, []
    for a in range(0, max(len(text), 1), langid.WINDOW):
        part = list(text[a : a + langid.WINDOW])
        padded = part + [langid.PAD] * (langid.WINDOW - len(part))

        def run(seq, table, w):
            h, states = np.zeros(h_n), []
            for c in seq:
                x, u = table[:, c].astype(float), w.astype(float) @ h
                z, r = sigmoid(2 * (x[:h_n] + u[:h_n])), sigmoid(2 * (x[h_n : 2 * h_n] + u[h_n : 2 * h_n]))
                h = (1 - z) * np.tanh(x[2 * h_n :] + r * u[2 * h_n :]) + z * h
                states.append(h)
            return states

        forth, back = run(padded, p["in_f"], p["w_f"]), run(padded[::-1], p["in_b"], p["w_b"])[::-1]
        for t in range(len(part)):
            e = np.exp(p["out_f"] @ forth[t] + p["out_b"] @ back[t] + p["bias"][:, 0])
            out.append(e / e.sum())
    return np.mean(out, axis=0) if out else np.zeros(len(p["bias"]))


def test_langid_by_loop():
    texts = [b"the cat and the dog " * 9, "der Hund läuft über die Straße".encode() * 4, b"x", b"", b"el gato y el perro" * 20]
    p = langid.train([t for t in texts if t], np.array([0, 1, 0, 1]), 2, steps=5, batch=16)
    off = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    got = langid.pooled(p, np.frombuffer(b"".join(texts), np.uint8), off, at_once=3)
    assert np.allclose(got, [by_loop(p, t) for t in texts], atol=1e-4)


def test_langid_gradients():
    """Backpropagation through time against differences, for the states' sum of squares."""
    rng = np.random.default_rng(3)
    table, w = rng.standard_normal((3 * langid.HIDDEN, 257)) * 0.4, rng.standard_normal((3 * langid.HIDDEN, langid.HIDDEN)) * 0.4
    x = rng.integers(0, 257, (7, 4))

    def loss(t, v):
        return float((langid.states(x, t.astype(np.float32), v.astype(np.float32)).astype(float) ** 2).sum())

    kept = []
    out = langid.states(x, table.astype(np.float32), w.astype(np.float32), kept)
    da, dw = langid.through_time(2 * out, kept, w.astype(np.float32))
    dtable = np.stack([np.bincount(x.ravel(), row.ravel(), 257) for row in da])
    for i, j in ((0, 1), (langid.HIDDEN + 2, 3), (2 * langid.HIDDEN + 1, 5)):
        for m, g in ((w, dw), (table, dtable)):
            k = (i, j) if m is w else (i, int(x[2, 1]))
            up, down = m.copy(), m.copy()
            up[k] += 1e-2
            down[k] -= 1e-2
            slope = (loss(table, up) - loss(table, down)) / 2e-2 if m is w else (loss(up, w) - loss(down, w)) / 2e-2
            assert slope == pytest.approx(float(g[k]), rel=0.05, abs=0.05)


def test_langid_fit_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROWS_ALL", 40)
    seen = []
    kept = langid.train
    monkeypatch.setattr(langid, "train", lambda texts, labels, classes, **k: seen.append((len(texts), max(map(len, texts)), classes)) or kept(texts, labels, classes, steps=2))
    rows = [(i, f"word{i} in language {i % 10} " * 4, f"l{i % 10}") for i in range(600)] + [(1000 + i, "y" * 70_000, "l1") for i in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.language_ids(d).count() == 604
    assert seen[0][0] <= 40 and seen[0][1] <= langid.TRAIN_BYTES and seen[0][2] == 10
