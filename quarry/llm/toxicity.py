"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two strings sums, over all subsequences of ORDER characters that both hold, DECAY to the power of the spans
they take in each, normalised by both strings' own values; a gap or an inserted character lowers it by a power of DECAY
instead of ending the match, so insults that are stretched, padded or cut stay near the plain ones.

A text is the bag of its words, in lower case and without inner marks; letters that stand alone side by side also count as
one word, and digits and signs that stand for letters are read as these too. The kernel is approximated by its values with
LANDMARKS landmark strings chosen among the training words (Nyström: the inverse root of their own kernel matrix whitens
these values), on which a linear support vector machine with squared hinge loss is trained by Newton steps. Labels belong to
whole sentences or texts, so it is a multiple-instance machine: a clean text's words are all negative, a toxic text's
positive ones are the words that score best, chosen anew in each round, and clean texts' best-scoring words are added
as hard negatives. Last, a logistic function of a text's highest word scores, the share of words above the margin and the
number of words gives its probability.

Labels are learned from at most ``train_rows`` labelled rows with texts of at most ``train_bytes`` bytes, chosen by a
hash: a documented bound of the fit alone. Every row is scored over its whole text. A worker keeps the scores of at most
KNOWN readings of words.

Nulls and odd cases: a null text is empty; a text without a letter gets the score of no words. Labels that are null, and
labels of ids without a document, are not learned from; an id with several labels or rows is learned from each. Without
both classes every score is the share of label 1 (0 without any). Ids may be null or repeat; extra columns are ignored; an
empty table gives an empty result. A word of more than LONGEST characters is looked at in overlapping parts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import blocks, remainder, small_batches

ORDER, DECAY, LANDMARKS, LONGEST = 3, 0.75, 48, 16
TRAIN_ROWS, TRAIN_BYTES = 4000, 1 << 15
KNOWN = 800_000
#: Words whose kernel values are worked out in one go.
WORDS = 20_000
CUT = 0.5
#: Log odds times the log of the count from which a word is taken for telling at first.
SURE = 5.0
#: What a text that is left with one telling word counts for, in the fit of the logistic.
THIN = 0.2
#: Kernel value from which a word is like another.
LIKE = 0.65
#: Strings in one go of the kernel's recursion.
AT_ONCE = 1024
#: Signs that are read as letters, too (fixed values).
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
SPACED = re.compile(r"(?<!\S)[^\W\d_](?:[^\w\s]?\s+[^\W\d_]){2,}(?!\w)")
MARKS = re.compile(r"[\W_]+")


def recursion(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Unnormalised kernel (len(s), len(t)) of strings of one length each, (n, length) code points; ORDER is 3.

    one and two hold, for each end in t, the decayed sums of common subsequences of one and two characters up to here; a
    matrix of DECAY's powers carries them along t."""
    n, m, lt = len(s), len(t), t.shape[1]
    decay, square = np.float32(DECAY), np.float32(DECAY * DECAY)
    gap = np.arange(lt)[:, None] - np.arange(lt)
    along = np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0).astype(np.float32)
    one, two, ends_here = (np.zeros((lt, n * m), np.float32) for _ in range(3))
    total = np.zeros(n * m, np.float32)
    for i in range(s.shape[1]):
        match = (s[:, i][None, :, None] == t.T[:, None, :]).reshape(lt, n * m) * square
        if i > 1:
            total += np.einsum("jk,jk->k", match[1:], two[:-1])
        if i:
            np.multiply(match[1:], one[:-1], out=ends_here[1:])
            two *= decay
            two += along @ ends_here
        one *= decay
        one += along @ match
    return total.reshape(n, m)


def own_values(s: np.ndarray) -> np.ndarray:
    """The kernel of each string with itself."""
    n, length = s.shape
    decay, square = np.float32(DECAY), np.float32(DECAY * DECAY)
    one = np.zeros((length + 1, n), np.float32)
    two = np.zeros((length + 1, n), np.float32)
    total = np.zeros(n, np.float32)
    for i in range(length):
        run1, run2 = np.zeros(n, np.float32), np.zeros(n, np.float32)
        before1, before2 = one[0].copy(), two[0].copy()
        for j in range(1, length + 1):
            match = (s[:, i] == s[:, j - 1]) * square
            run1 = run1 * decay + match
            run2 = run2 * decay + match * before1
            total += match * before2
            before1, before2 = one[j].copy(), two[j].copy()
            one[j] = one[j] * decay + run1
            two[j] = two[j] * decay + run2
    return total


def coded(words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (indices, code points) of words."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    return {n: (np.array(at), np.array([words[i] for i in at]).view(np.uint32).reshape(len(at), -1)[:, :n]) for n, at in by.items() if n}


def kernel(words: list[str], marks: list[str]) -> np.ndarray:
    """Normalised kernel (len(words), len(marks)); strings without ORDER characters have no value with any."""
    out = np.zeros((len(words), len(marks)), np.float32)
    right = [(at, t, np.sqrt(own_values(t))) for n, (at, t) in coded(marks).items() if n >= ORDER]
    for n, (at, s) in coded(words).items():
        if n < ORDER:
            continue
        for a in range(0, len(at), AT_ONCE):
            some, own = s[a : a + AT_ONCE], at[a : a + AT_ONCE]
            root = np.sqrt(own_values(some))[:, None]
            for cols, t, norm in right:
                out[np.ix_(own, cols)] = recursion(some, t) / (root * norm)
    return out


def parts(word: str) -> list[str]:
    """A cleaned word, or its overlapping parts."""
    if len(word) <= LONGEST:
        return [word]
    half = LONGEST // 2
    return [word[a : a + LONGEST] for a in range(0, len(word) - half, half)]


def readings(raw: str) -> list[str]:
    """What a lower-case word without white space may be read as."""
    plain = MARKS.sub("", raw)
    out = parts(plain)
    if not raw.isalpha():
        other = MARKS.sub("", raw.rstrip("!.,;:?").translate(STANDS_FOR))
        if other != plain and not plain.isdigit():
            out += parts(other)
    return out


def bag(text: str) -> Counter[str]:
    """The words of a text as they stand, in lower case, with letters that stand alone side by side as one more word."""
    text = text.lower()
    words = Counter(text.split())
    for m in SPACED.finditer(text):
        words[MARKS.sub("", m[0])] += 1
    return words


class Model:
    """landmarks and two decisions' weights over kernel values; the logistic over a text's word scores."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: np.ndarray, logistic: np.ndarray) -> None:
        self.landmarks, self.weights, self.bias, self.logistic = landmarks, weights, bias, logistic
        # of a reading, as one number to save memory: the loose machine's score, the strict one's as imaginary part
        self.known: dict[str, complex] = {}

    def score_readings(self, words: list[str]) -> dict[str, complex]:
        out: dict[str, complex] = {}
        for a in range(0, len(words), WORDS):
            some = words[a : a + WORDS]
            f = kernel(some, self.landmarks).astype(np.float64) @ self.weights + self.bias
            out |= zip(some, (f[:, 0] + 1j * f[:, 1]).tolist(), strict=True)
        return out

    def bag_scores(self, bags: list[Counter[str]]) -> list[np.ndarray]:
        """Of each bag's words both machines' scores (n, 2), the best of each word's readings."""
        known = self.known
        read = {w: None if w.isalpha() and len(w) <= LONGEST else readings(w) for b in bags for w in b if w not in known}
        new = self.score_readings(list(dict.fromkeys(r for w, rs in read.items() for r in (rs or [w]) if r not in known)))

        def value(w: str) -> complex:
            if w in known:
                return known[w]
            if (rs := read[w]) is None:
                return new[w]
            found = [new[r] if r in new else known[r] for r in rs]
            return found[0] if len(found) == 1 else complex(max(x.real for x in found), max(x.imag for x in found))

        out = [np.array([value(w) for w in b], np.complex128).view(np.float64).reshape(-1, 2) for b in bags]
        if len(known) + len(new) > KNOWN:
            known.clear()
        if len(new) <= KNOWN:
            known |= new
        return out

    def text_features(self, bags: list[Counter[str]]) -> np.ndarray:
        return np.array([features(s, np.array(list(b.values()), np.int64)) for s, b in zip(self.bag_scores(bags), bags, strict=True)]).reshape(-1, FEATURES)

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.text_features([bag(t) for t in texts]) @ self.logistic[1:] + self.logistic[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


FEATURES = 7


def features(score: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Of a text's distinct words' scores (n, 2) and numbers: the highest three, what is clear
    of the first, how far the strict machine's highest is beyond its margin, and the number of words above the
    loose one's margin and their share."""
    top = np.full(3, -1.0)
    best = np.sort(score[:, 0])[::-1][:3]
    top[: len(best)] = np.clip(best, -1.0, 1.0)
    strict = 2 * np.clip(score[:, 1].max(initial=-1.0) - 0.9, 0.0, 0.5)
    n, above = times.sum(), times[score[:, 0] > 0].sum()
    return np.array([*top, 5 * max(0.0, top[0] - 0.5), strict, np.log1p(min(above, 20)), np.sqrt(above / max(n, 1))])


def changed(word: str, rng: np.random.Generator) -> list[str]:
    """A word with a character put in, one left out, one repeated, and something before or behind it."""
    letter = lambda: chr(97 + int(rng.integers(26)))
    i, j, k = (int(rng.integers(1, max(2, len(word) - 1))) for _ in range(3))
    out = [word[:i] + letter() + word[i:], word[:k] + word[k] * int(rng.integers(1, 4)) + word[k:], word + letter(), letter() + word]
    return [*out, word[:j] + word[j + 1 :]] if len(word) > 4 else out


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Linear squared-hinge machine on rows x (a last column of ones is the bias) by Newton steps; y is 1 or -1."""
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    keep[-1, -1] = 1e-3
    active = np.ones(len(x), bool)
    for _ in range(steps):
        xs = x[active] * weight[active, None]
        w = np.linalg.solve(keep + xs.T @ x[active], xs.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (weight * (y - p)) - keep @ w)
    return w


def train(texts: list[str], labels: np.ndarray, rounds: int = 4, seed: int = 12) -> Model:
    """The machine from labelled texts of both classes."""
    rng = np.random.default_rng(seed)
    bags = [bag(t) for t in texts]
    held = [list(dict.fromkeys(r for w in b for r in readings(w) if len(r) >= ORDER)) for b in bags]
    toxic, clean = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    in_toxic = Counter(w for i in toxic for w in held[i])
    in_clean = Counter(w for i in clean for w in held[i])
    odds = {w: np.log((n + 0.5) / (len(toxic) + 1)) - np.log((in_clean[w] + 0.5) / (len(clean) + 1)) for w, n in in_toxic.items()}
    telling = lambda w: (-odds[w] * np.log1p(in_toxic[w]), w)
    chosen = sorted(in_toxic, key=telling)
    plain = sorted(in_clean)
    # landmarks: telling words that are not near each other, and ordinary words
    marks: list[str] = []
    near = kernel(first := chosen[: LANDMARKS * 8], first)
    free = np.ones(len(first), bool)
    for i in range(len(first)):
        if free[i] and len(marks) < LANDMARKS * 3 // 4:
            marks.append(first[i])
            free &= near[i] < 0.6
    marks += [plain[i] for i in rng.permutation(len(plain)) if plain[i] not in marks and len(plain[i]) <= LONGEST // 2][: LANDMARKS - len(marks)]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    white = vectors / np.sqrt(np.maximum(values, 1e-3))
    words = sorted(in_toxic.keys() | in_clean.keys())
    place = {w: i for i, w in enumerate(words)}
    phi = np.c_[kernel(words, marks).astype(np.float64) @ white, np.ones(len(words))]
    own = [np.array([place[w] for w in h], np.int64) for h in held]
    valued = lambda w: np.c_[kernel(w, marks).astype(np.float64) @ white, np.ones(len(w))]
    negative = np.array([place[w] for w in plain], np.int64)
    negative = rng.permutation(negative)[:20_000] if len(negative) > 20_000 else negative
    # at first words that are telling by their counts are positive, then those that the last machine puts above its margin
    telling_now = np.array([odds.get(w, 0.0) * np.log1p(in_toxic.get(w, 0)) for w in words])
    sure = (np.array([odds.get(w, 0.0) for w in words]) > 1.5) & (telling_now > SURE)
    score = np.where(sure, 1.0, -1.0)
    for _ in range(rounds):
        positive = np.unique(np.concatenate([np.zeros(0, np.int64), *(o[(score[o] > 0) | sure[o]] for o in (own[i] for i in toxic))]))
        hard = np.array([own[i][np.argmax(score[own[i]])] for i in clean if len(own[i])], np.int64)
        # a word counts by its texts: those of toxic ones for it, those of clean ones against it
        support = np.array([[in_toxic[words[i]], in_clean[words[i]]] for i in positive], float).reshape(-1, 2)
        rows = np.r_[positive, positive, hard, negative]
        y = np.r_[np.ones(len(positive)), -np.ones(len(positive) + len(hard) + len(negative))]
        weight = np.r_[support[:, 0], support[:, 1], np.full(len(hard), 1.0), np.full(len(negative), 0.2)]
        w = machine(phi[rows], y, weight)
        score = phi @ w
    # once more, with changed forms of the words beside them
    above = [words[i] for i in positive if score[i] > 0]
    more = [v for x in above for _ in range(max(1, 600 // max(1, len(above)))) for v in changed(x, rng)]
    less = [v for i in rng.permutation(negative)[:800] for v in changed(words[i], rng)]
    x, y = np.r_[phi[rows], valued(more + less)], np.r_[y, np.ones(len(more)), -np.ones(len(less))]
    weight = np.r_[weight, np.full(len(more), 2.0), np.full(len(less), 0.2)]
    loose = machine(x, y, weight)
    # a strict machine learns those alone that no clean text's best words are like: one of them is enough
    rivals = [words[i] for i in np.unique(hard) if score[i] > 0]
    alone = {w for w in above if not in_clean[w]}
    if rivals and alone:
        listed = sorted(alone)
        alone = {w for w, k in zip(listed, kernel(listed, rivals).max(axis=1), strict=True) if k < LIKE}
    forms = [v for w in sorted(alone) for _ in range(max(1, 600 // len(alone))) for v in changed(w, rng)]
    x = np.r_[phi[[place[w] for w in sorted(alone)]], valued(forms), phi[hard], phi[negative], valued(less)]
    n_for = len(alone) + len(forms)
    y = np.r_[np.ones(n_for), -np.ones(len(x) - n_for)]
    weight = np.r_[np.full(len(alone), 50.0), np.full(len(forms), 2.0), np.full(len(hard), 2.0), np.full(len(negative) + len(less), 0.2)]
    both = np.c_[loose, machine(x, y, weight)]
    model = Model(marks, white @ both[:-1], both[-1], np.zeros(1 + FEATURES))
    told = phi @ both
    model.known = dict(zip(words, (told[:, 0] + 1j * told[:, 1]).tolist(), strict=True))
    x = [model.text_features(bags)]
    # toxic texts once more with a single such word left and no other that is above a margin
    thin = []
    for i in toxic:
        scored = dict(zip(bags[i], model.bag_scores([bags[i]])[0].tolist(), strict=True))
        sole = [w for w in bags[i] if scored[w][1] > 0 and any(r in alone for r in readings(w))]
        if sole:
            left = sole[int(rng.integers(len(sole)))]
            thin.append(Counter({w: n for w, n in bags[i].items() if w == left or max(scored[w]) <= 0}))
    x.append(model.text_features(thin))
    model.logistic = logistic_fit(np.concatenate(x), np.r_[labels, np.ones(len(thin))].astype(float), np.r_[np.ones(len(labels)), np.full(len(thin), THIN)])
    model.known = {}
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, train_rows: int, train_bytes: int = TRAIN_BYTES) -> Model | float:
    """The machine, or the share of label 1 if only one class is there to learn from."""
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1) and id is not null").where(remainder("id", 5) != 0)
    # the ids first, without texts; then the texts of these alone
    chosen = known.orderBy(F.xxhash64("id", F.lit(12)), "id", "label").limit(train_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= train_bytes)
    # an id may stand in many rows: the bound holds for rows
    rows = texts.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id", F.lit(12)), "id", "label", F.xxhash64("text")).limit(train_rows).toArrow()
    y = np.array(rows.column("label").to_pylist(), np.int64)
    if len(np.unique(y)) < 2:
        return float(y.mean()) if len(y) else 0.0
    return train(rows.column("text").to_pylist(), y)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """id_col, held_out (crc32 of the id modulo 5 is 0), score, predicted (score >= CUT) for every row of docs."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, train_rows))  # a few hundred numbers and words
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part, _, _ in blocks(batches, "__text"):
            texts = ["" if t is None else t for t in part.column("__text").to_pylist()]
            out = np.full(len(texts), model) if isinstance(model, float) else model.scores(texts)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out)], names=["id", "score"])

    scored = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), (remainder("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
