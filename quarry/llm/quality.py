"""Text quality by a byte-level convolutional network in numpy.

A text's bytes are cut into chunks of CHUNK bytes that overlap by half and cover the whole text. Each byte enters as a
learned vector of EMBED numbers and one input that tells whether its four bytes also stood up to LAGS bytes earlier (so
that repetition is visible to a filter). FILTERS learned filters of WIDTH bytes slide over a chunk by STRIDE; their
rectified responses are averaged within the chunk, a small dense layer turns them into chunk features, these are
max-pooled over all chunks (with their mean beside them) and a logistic output combines them into one probability.

The network is trained here by gradient descent (Adam) on at most ``train_rows`` labelled rows with texts of at most
``train_bytes`` bytes, chosen by a hash: a documented bound of the fit alone. Every row of the table is scored, over its
whole text; a long text goes through in parts, so it takes a few bytes of memory for each of its own.

Nulls and odd cases: a null text is empty; an empty text is one chunk of padding and gets the score of that. Labels that
are null, and labels of ids without a document, are not learned from; an id with several labels or rows is learned from
each. Without both classes among the labels every score is the share of label 1 (0.5 without any). Ids may be null or
repeat; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import blocks, remainder, small_batches

CHUNK, LAGS, EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 256, 48, 6, 8, 4, 24, 16
HOP = CHUNK // 2
TRAIN_ROWS, TRAIN_BYTES = 2000, 1 << 16
#: Chunks that are scored at once.
AT_ONCE = 512
CUT = 0.3
Params = dict[str, np.ndarray]


def repeats(data: np.ndarray) -> np.ndarray:
    """1 where the four bytes from here also begin at 4 to LAGS bytes before, else 0."""
    out = np.zeros(len(data), bool)
    if len(data) > 8:
        d = data.astype(np.uint32)
        four = d[:-3] | (d[1:-2] << np.uint32(8)) | (d[2:-1] << np.uint32(16)) | (d[3:] << np.uint32(24))
        hit = out[: len(four)]
        for lag in range(4, min(LAGS, len(four) - 1) + 1):
            hit[lag:] |= four[lag:] == four[:-lag]
    return out


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of every chunk, index of each text's first chunk and the end). A text has one chunk at least."""
    size = np.diff(offsets)
    n = np.maximum(1, -(-np.maximum(size - HOP, 0) // HOP))
    first = np.r_[0, np.cumsum(n)]
    return np.repeat(offsets[:-1], n) + (np.arange(first[-1]) - np.repeat(first[:-1], n)) * HOP, first


def prepared(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((chunks, CHUNK) symbols: byte, plus 256 where it repeats, 512 past the text's end; first chunk of each text)."""
    starts, first = chunks(data, offsets)
    begins, ends = (np.repeat(x, np.diff(first)) for x in (offsets[:-1], offsets[1:]))
    return symbols(data, starts, begins, ends), first


def symbols(data: np.ndarray, starts: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK) symbols of the chunks at starts, in order, of texts from begins to ends."""
    lo = max(int(begins[0]), int(starts[0]) - LAGS)
    hi = min(len(data), int(starts[-1]) + CHUNK + 3)
    part = data[lo:hi]
    symbol = part.astype(np.int16)
    # repeats are looked for within a text
    cuts = np.unique(np.clip(np.r_[begins, ends], lo, hi)) - lo
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        symbol[a:b] += repeats(part[a:b]) * np.int16(256)
    at = (starts - lo)[:, None] + np.arange(CHUNK)
    inside = at < (ends - lo)[:, None]
    padded = np.r_[symbol, np.int16(512)]
    return np.where(inside, padded[np.minimum(at, len(part))], np.int16(512))


def table(p: Params) -> np.ndarray:
    """Input vector of each symbol."""
    t = np.zeros((513, EMBED + 1), np.float32)
    t[:256, :EMBED] = t[256:512, :EMBED] = p["embed"]
    t[256:512, EMBED] = 1
    return t


def windows(x: np.ndarray) -> np.ndarray:
    """(n, CHUNK, k) -> (n, positions, WIDTH * k), filters' views by STRIDE."""
    n, _, k = x.shape
    pieces = x.reshape(n, CHUNK // STRIDE, STRIDE * k)
    return np.concatenate([pieces[:, i : CHUNK // STRIDE - WIDTH // STRIDE + 1 + i] for i in range(WIDTH // STRIDE)], axis=2)


def forward(p: Params, symbols: np.ndarray, first: np.ndarray) -> dict:
    x = table(p)[symbols]
    w = windows(x)
    z = w @ p["filters"] + p["bias"]
    act = np.maximum(z, 0)
    pooled = act.mean(axis=1)
    h = np.tanh(pooled @ p["dense"] + p["dense_bias"])
    top = np.maximum.reduceat(h, first[:-1])
    mean = np.add.reduceat(h, first[:-1]) / np.diff(first)[:, None]
    both = np.concatenate([top, mean], axis=1)
    logit = both @ p["out"] + p["out_bias"]
    return {"w": w, "z": z, "act": act, "pooled": pooled, "h": h, "top": top, "both": both, "p": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}


def backward(p: Params, f: dict, symbols: np.ndarray, first: np.ndarray, y: np.ndarray) -> Params:
    """Gradients of the mean cross-entropy."""
    g: Params = {}
    n = np.diff(first)
    d = ((f["p"] - y) / len(y)).astype(np.float32)
    g["out"], g["out_bias"] = f["both"].T @ d, d.sum(keepdims=True)
    back = d[:, None] * p["out"][None, :]
    at_top = f["h"] == np.repeat(f["top"], n, axis=0)
    ties = np.add.reduceat(at_top, first[:-1].astype(int), dtype=np.float32)
    dh = at_top * np.repeat(back[:, :HIDDEN] / np.maximum(ties, 1), n, axis=0) + np.repeat(back[:, HIDDEN:] / n[:, None], n, axis=0)
    dh = dh * (1 - f["h"] ** 2)
    g["dense"], g["dense_bias"] = f["pooled"].T @ dh, dh.sum(axis=0)
    dz = ((dh @ p["dense"].T) / f["z"].shape[1])[:, None, :] * (f["z"] > 0)
    g["filters"] = f["w"].reshape(-1, f["w"].shape[2]).T @ dz.reshape(-1, FILTERS)
    g["bias"] = dz.sum(axis=(0, 1))
    dw = dz @ p["filters"].T
    steps, k = CHUNK // STRIDE, EMBED + 1
    dx = np.zeros((len(symbols), steps, STRIDE * k), np.float32)
    for i in range(WIDTH // STRIDE):
        dx[:, i : steps - WIDTH // STRIDE + 1 + i] += dw[:, :, i * STRIDE * k : (i + 1) * STRIDE * k]
    dx = dx.reshape(-1, k)
    flat = symbols.ravel()
    by = np.stack([np.bincount(flat, dx[:, j], 513)[:512] for j in range(EMBED)], axis=1)
    g["embed"] = (by[:256] + by[256:]).astype(np.float32)
    return g


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 5, seed: int = 5, bytes_a_step: int = 120_000, least_steps: int = 150) -> Params:
    """Adam over steps of about bytes_a_step bytes of whole texts; both classes weigh as they occur.

    A small sample is gone through more than epochs times, until least_steps steps are made."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p: Params = {
        "embed": rng.standard_normal((256, EMBED)).astype(np.float32) * np.float32(0.5),
        "filters": draw(WIDTH * (EMBED + 1), FILTERS) * np.float32(1.5),
        "bias": np.zeros(FILTERS, np.float32),
        "dense": draw(FILTERS, HIDDEN) * np.float32(2),
        "dense_bias": np.zeros(HIDDEN, np.float32),
        "out": draw(2 * HIDDEN),
        "out_bias": np.zeros(1, np.float32),
    }
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    done, size = 0, np.array([len(t) + 64 for t in texts])
    each = max(1, int(size.sum() // bytes_a_step))
    epochs = max(epochs, -(-least_steps // each))
    total = epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        cut = np.flatnonzero(np.diff(np.cumsum(size[order]) // bytes_a_step, prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
            some = order[a:b]
            off = np.r_[0, np.cumsum([len(texts[i]) for i in some])].astype(np.int64)
            symbols, starts = prepared(np.frombuffer(b"".join(texts[i] for i in some), np.uint8), off)
            f = forward(p, symbols, starts)
            g = backward(p, f, symbols, starts, labels[some])
            done += 1
            rate = 0.01 * max(0.05, 1 - done / total) * min(1, done / 20)
            for k in p:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.01 * (g[k] ** 2 - second[k])
                p[k] = (p[k] - rate * (first[k] / (1 - 0.9**done)) / (np.sqrt(second[k] / (1 - 0.99**done)) + 1e-8)).astype(np.float32)
    return p


def score(p: Params, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text, AT_ONCE chunks at a time."""
    starts, first = chunks(data, offsets)
    begins, ends = (np.repeat(x, np.diff(first)) for x in (offsets[:-1], offsets[1:]))
    t = table(p)
    hs = []
    for a in range(0, len(starts), AT_ONCE):
        b = a + AT_ONCE
        z = windows(t[symbols(data, starts[a:b], begins[a:b], ends[a:b])]) @ p["filters"]
        z += p["bias"]
        np.maximum(z, 0, out=z)
        hs.append(np.tanh(z.mean(axis=1) @ p["dense"] + p["dense_bias"]))
    h = np.concatenate(hs)
    best = np.maximum.reduceat(h, first[:-1])
    total = np.add.reduceat(h.astype(np.float64), first[:-1]) / np.diff(first)[:, None]
    logit = np.concatenate([best, total], axis=1) @ p["out"].astype(np.float64) + float(p["out_bias"][0])
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, train_rows: int, train_bytes: int = TRAIN_BYTES) -> Params | float:
    """The network, or the share of label 1 if only one class is there to learn from."""
    known = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1) and id is not null").where(remainder("id", 5) != 0)
    # the ids first, without texts; then the texts of these alone
    chosen = known.orderBy(F.xxhash64("id", F.lit(5)), "id", "label").limit(train_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= train_bytes)
    # an id may stand in many rows: the bound holds for rows
    rows = texts.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id", F.lit(5)), "id", "label", F.xxhash64("text")).limit(train_rows).toArrow()
    y = np.array(rows.column("label").to_pylist(), np.float32)
    if len(np.unique(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    return train([t.as_py().encode() for t in rows.column("text")], y)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, keep: list[str] | None = None) -> DataFrame:
    """id_col, held_out (crc32 of the id modulo 5 is 0), score, predicted (score >= CUT) for every row of docs.

    keep: columns of docs to carry along besides."""
    small_batches(docs.sparkSession)
    model = learn(docs, labels, id_col, text_col, train_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    carried = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep or [])]
    rows = docs.select(F.col(id_col).alias("id"), *carried, F.col(text_col).cast("string").alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for part, data, off in blocks(batches, "__text"):
            out = np.full(len(off) - 1, p) if isinstance(p, float) else score(p, data, off)
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(out)], names=[*(f.name for f in fields), "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"
    back = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep or [])]
    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), *back, (remainder("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier accepts, columns unchanged. Texts go through the classifier once.

    Rows that repeat, or have no id, are judged by their texts like all others, a null text as the empty one; an empty table
    gives an empty one; extra columns may have any names."""
    scored = quality_scores(docs, labels, id_col, text_col, keep=docs.columns)
    flat = scored.toDF(*[f"c{i}" for i in range(len(scored.columns))])
    kept = flat.where(F.col(f"c{len(scored.columns) - 1}") == 1)
    return kept.select(*[F.col(f"c{i + 1}").alias(c) for i, c in enumerate(docs.columns)])
