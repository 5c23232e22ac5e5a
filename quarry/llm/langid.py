"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text's bytes are cut into windows of WINDOW bytes that cover it whole. In each window one gated recurrent layer of
HIDDEN units reads forwards and one backwards; every position gets a probability of each language from both states, and
the mean over all positions of the text is its probability. The highest is the prediction (ties to the smaller name).

The network is trained here by backpropagation through time (Adam) on at most ``rows_each`` labelled texts of each
language (``rows_all`` of all), of at most ``train_bytes`` bytes each, chosen by a hash of the id and the text, and on the
``most`` most frequent languages: documented bounds of the fit alone. Every text is labelled whole.

Nulls and odd cases: a null text, or one without a letter, is ``und`` with score 0; rows with a null lang are not learned
from; a null id counts as an empty id for the split; ids may repeat; extra columns are ignored; an empty table gives an
empty result. Without anything to learn from every prediction is ``und``; with one language every text with letters is it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import groups, remainder, small_batches, store, text_buffer

HIDDEN, WINDOW, ROWS_EACH, ROWS_ALL, TRAIN_BYTES, MOST = 8, 48, 250, 4000, 1 << 16, 500
PAD = 256
Params = dict[str, np.ndarray]


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((WINDOW, windows) symbols, PAD past the end; index of each text's first window and the end)."""
    n = np.maximum(1, -(-np.diff(offsets) // WINDOW))
    first = np.r_[0, np.cumsum(n)]
    start = np.repeat(offsets[:-1], n) + (np.arange(first[-1]) - np.repeat(first[:-1], n)) * WINDOW
    at = start[None, :] + np.arange(WINDOW)[:, None]
    padded = np.r_[data.astype(np.int16), np.int16(PAD)]
    return np.where(at < np.repeat(offsets[1:], n)[None, :], padded[np.minimum(at, len(data))], PAD), first


def states(x: np.ndarray, table: np.ndarray, w: np.ndarray, keep: list | None = None) -> np.ndarray:
    """(steps, HIDDEN, windows) states of one direction. table: (3 * HIDDEN, symbols) input side with biases; w: recurrent.

    Rows of both are update, reset and new; the weights of update and reset are halved, as sigmoid(a) = (1 + tanh(a / 2)) / 2."""
    steps, n = x.shape
    h = np.zeros((HIDDEN, n), np.float32)
    out = np.empty((steps, HIDDEN, n), np.float32)
    half = np.float32(0.5)
    for t in range(steps):
        a = np.take(table, x[t], axis=1)
        u = w @ h
        gates = np.tanh(a[: 2 * HIDDEN] + u[: 2 * HIDDEN])
        gates *= half
        gates += half
        z, r, un = gates[:HIDDEN], gates[HIDDEN:], u[2 * HIDDEN :]
        new = np.tanh(a[2 * HIDDEN :] + r * un)
        if keep is not None:
            keep.append((z, r, new, un, h))
        h = new + z * (h - new)
        out[t] = h
    return out


def through_time(dout: np.ndarray, kept: list, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of (input side (3 * HIDDEN, steps, windows), recurrent weights), given those of all states."""
    steps, _, n = dout.shape
    da, dw = np.empty((3 * HIDDEN, steps, n), np.float32), np.zeros_like(w)
    back = np.zeros((HIDDEN, n), np.float32)
    for t in range(steps - 1, -1, -1):
        z, r, new, un, h = kept[t]
        d = dout[t] + back
        dnew = d * (1 - z) * (1 - new * new)
        g = np.concatenate([d * (h - new) * z * (1 - z) * 2, dnew * un * r * (1 - r) * 2, dnew * r])
        da[:, t] = g
        da[2 * HIDDEN :, t] = dnew
        dw += g @ h.T
        back = d * z + w.T @ g
    return da, dw


def train(texts: list[bytes], labels: np.ndarray, classes: int, seed: int = 8, batch: int = 512, steps: int = 220) -> Params:
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) * 0.4).astype(np.float32)
    p: Params = {"in_f": draw(3 * HIDDEN, 257), "in_b": draw(3 * HIDDEN, 257), "w_f": draw(3 * HIDDEN, HIDDEN), "w_b": draw(3 * HIDDEN, HIDDEN), "out_f": draw(classes, HIDDEN), "out_b": draw(classes, HIDDEN), "bias": np.zeros((classes, 1), np.float32)}
    off = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    x_all, first = windows(np.frombuffer(b"".join(texts), np.uint8), off)
    y_all = np.repeat(labels, np.diff(first))
    by_class = [np.flatnonzero(y_all == c) for c in range(classes)]
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for step in range(1, steps + 1):
        some = np.concatenate([rng.choice(i, max(1, batch // classes)) for i in by_class])
        x, y = x_all[:, some], y_all[some]
        keep_f: list = []
        keep_b: list = []
        hf = states(x, p["in_f"], p["w_f"], keep_f)
        hb = states(x[::-1], p["in_b"], p["w_b"], keep_b)[::-1]
        logit = p["out_f"] @ hf + p["out_b"] @ hb + p["bias"]
        prob = np.exp(logit - logit.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        prob[:, y, np.arange(len(y))] -= 1
        d = prob * ((x != PAD)[:, None, :] / np.float32((x != PAD).sum()))
        g = {"bias": d.sum(axis=(0, 2))[:, None], "out_f": np.einsum("tcn,thn->ch", d, hf), "out_b": np.einsum("tcn,thn->ch", d, hb)}
        for side, kept, flip in (("f", keep_f, 1), ("b", keep_b, -1)):
            da, g["w_" + side] = through_time((p["out_" + side].T @ d)[::flip], kept, p["w_" + side])
            flat = x[::flip].ravel()
            g["in_" + side] = np.stack([np.bincount(flat, row.ravel(), 257) for row in da]).astype(np.float32)
        rate = 0.03 * (1 - step / (steps + 1)) * min(1, step / 10)
        for k in p:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] ** 2 - v[k])
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def pooled(p: Params, data: np.ndarray, offsets: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """(texts, languages) mean of the positions' probabilities; zeros for an empty text."""
    x, first = windows(data, offsets)
    sums = np.zeros((x.shape[1], len(p["bias"])))
    for a in range(0, x.shape[1], at_once):
        part = x[:, a : a + at_once]
        logit = p["out_f"] @ states(part, p["in_f"], p["w_f"])
        logit += p["out_b"] @ states(part[::-1], p["in_b"], p["w_b"])[::-1]
        logit += p["bias"]
        np.exp(np.clip(logit, -30, 30, out=logit), out=logit)
        logit *= ((part != PAD) / logit.sum(axis=1))[:, None, :]
        sums[a : a + at_once] = logit.sum(axis=0).T
    return np.add.reduceat(sums, first[:-1]) / np.maximum(1, np.diff(offsets))[:, None]


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows_each: int) -> tuple[list[str], Params | None]:
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null").where(remainder("id", 4) != 2).where(F.octet_length("text") <= TRAIN_BYTES)
    order = F.xxhash64("id", "text", F.lit(8))
    # about 4 * rows_each rows of a language are ranked, however many it has (its least hash always is, should one row repeat
    # so often that no other is there); one row of counts for each output of the network
    counts = known.groupBy("lang").agg(F.count("*").alias("rows"), F.min(order).alias("least")).orderBy(F.desc("rows"), "lang").limit(MOST)
    counts = store(counts, "languages")
    rows_each = max(1, min(rows_each, ROWS_ALL // max(1, counts.count())))
    few = known.join(F.broadcast(counts), "lang").where((order / F.lit(2.0**64) + 0.5 <= F.lit(4.0 * rows_each) / F.col("rows")) | (order == F.col("least")))
    # rows that repeat have one hash: they count once, so what is ranked stays bounded
    few = few.withColumn("order", order).dropDuplicates(["lang", "id", "order"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "id", "text"))
    ids = few.select("id", "lang", "text", rank.alias("rank")).where(F.col("rank") <= rows_each).drop("rank").orderBy("lang", "id", "text").toArrow()
    langs = sorted(set(ids.column("lang").to_pylist()))
    if len(langs) < 2:
        return langs, None
    place = {x: i for i, x in enumerate(langs)}
    return langs, train([t.as_py().encode() for t in ids.column("text")], np.array([place[x] for x in ids.column("lang").to_pylist()]), len(langs))


def language_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_each: int = ROWS_EACH) -> DataFrame:
    """id_col, held_out (crc32 of the id modulo 4 is 2), lang_pred, score for every row of docs."""
    small_batches(docs.sparkSession)
    langs, model = learn(docs, id_col, text_col, lang_col, rows_each)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, "und"], object)
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            if sent.value is None:
                prob = np.full((batch.num_rows, max(1, len(langs))), 1.0 if langs else 0.0)
            else:
                parts = [pooled(sent.value, data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in groups(off, 1 << 18)]
                prob = np.concatenate(parts) if parts else np.zeros((0, len(langs)))
            best = np.where(batch.column("letter").to_numpy(zero_copy_only=False), prob.argmax(axis=1) if len(prob) else 0, len(langs))
            score = np.where(best < len(langs), prob.max(axis=1) if len(prob) else 0, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], names=["id", "lang_pred", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").select(F.col("id").alias(id_col), (remainder("id", 4) == 2).alias("held_out"), "lang_pred", "score")
