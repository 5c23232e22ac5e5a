"""Language-model scores by prediction by partial matching (PPM) over a pretrained byte-context trie.

The trie holds, for contexts of 0 to ORDER bytes, the counts of the bytes that follow, over all training texts; they are
counted in one distributed pass and summed by shuffles. A text's score is the sum over its bytes (and one end symbol, the
byte 255, which UTF-8 never uses) of log10 of PPM's probability: from the longest context that the trie has, a byte seen there is coded by its
count (method C: a context escapes with weight equal to the number of its different bytes); otherwise the escape is coded,
the bytes of that context are excluded, and the next shorter context codes the byte; last come the bytes never seen, all
alike. Probabilities sum to one.

Whole model: every context and byte of the training texts is in the trie, however rare; its levels are stored tables. A
byte's probability depends on its code alone (ORDER bytes of history and the byte), so it is worked out once for every
distinct code of all texts, by joins of these tables. The MOST most frequent codes are sent to the tasks with their
probabilities; the rest is joined by a shuffle, so memory is bounded and no score depends on what is sent.

The base score is a unigram of words with add-one smoothing. Words are held by 64-bit hashes; those that make up one part
in MOST of all tokens or more (MOST at most) are sent to the tasks, the rest is joined by a shuffle. All of these are rare,
so no key is hot.

Nulls and odd cases: a null text is empty: one end token, and the score of the end symbol alone. A null id counts as an
empty id for the split and stays null; ids may repeat: each row is scored. Without training texts the base score is 0 and
bytes are coded alike. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import groups, mix, remainder, small_batches, store, text_buffer, word_hashes

ORDER = 5
#: Most codes, and most words, that are sent to every task; the rest is joined.
MOST = 1 << 20
#: Levels of the trie with more contexts are joined by a shuffle.
SMALL = 1 << 18
#: Partial counts that a task holds before it passes them on.
HELD = 3_000_000


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of ORDER bytes of history and a symbol, the symbol lowest; index of each text's first code and the end).

    Every text starts with a history of end symbols and ends with one of its own."""
    raw = data.tobytes()
    gap = b"\xff" * ORDER
    b = np.frombuffer(gap + gap.join(raw[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)) + gap, np.uint8)
    code = np.zeros(len(b) - ORDER, np.uint64)
    for i in range(ORDER + 1):
        code = (code << np.uint64(8)) | b[i : len(b) - ORDER + i]
    # a text's own codes: its bytes and the end; the rest of the gap belongs to no text
    own = np.diff(offsets) + 1
    first = np.r_[0, np.cumsum(own)]
    at = np.arange(first[-1]) + np.repeat(np.arange(len(own)) * (ORDER - 1), own)
    return code[at], first


def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (keys, counts) by key."""
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[at], np.add.reduceat(n, at) if len(keys) else n


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(keys)
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, int)
    return s[at], np.diff(np.r_[at, len(s)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): of training texts 0 words, 1 codes, 2 texts; 3 codes of the others."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: [], 3: []}
    texts = 0

    def out(kind: int) -> pa.RecordBatch:
        keys, n = counted(held[kind])
        held[kind] = []
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    for batch in batches:
        for train in (True, False):
            side = batch.filter(batch.column("train") if train else pc.invert(batch.column("train")))
            data, off = text_buffer(side.column("text"))
            texts += side.num_rows * train
            for a, b in groups(off):
                part = data[off[a] : off[b]], off[a : b + 1] - off[a]
                if train:
                    held[0].append(runs(word_hashes(*part)[0]))
                held[1 if train else 3].append(runs(codes(*part)[0]))
                for kind in held:
                    if sum(len(k) for k, _ in held[kind]) > HELD:
                        held[kind] = [counted(held[kind])]
                        if len(held[kind][0][0]) > HELD // 2:
                            yield out(kind)
    for kind in held:
        if held[kind]:
            yield out(kind)
    yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], names=["kind", "key", "n"])


class Lookup:
    """Vectorised key -> position over distinct 64-bit keys, by hash buckets. -1: not there."""

    def __init__(self, keys: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(8, int(len(keys)).bit_length() + 1))
        h = mix(keys) >> self.shift
        order = np.argsort(h, kind="stable")
        self.keys, self.place = np.r_[keys[order], np.uint64(0)], np.r_[order, -1].astype(np.int32)
        self.first = np.searchsorted(h[order], np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)
        self.deep = int(np.diff(self.first).max()) if len(keys) else 0

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        h = (mix(wanted) >> self.shift).astype(np.int64)
        at, end = self.first[h], self.first[h + 1]
        out = np.where((self.keys[at] == wanted) & (at < end), self.place[at], -1)
        left = np.flatnonzero((out < 0) & (at + 1 < end))
        for j in range(1, self.deep):
            if not len(left):
                break
            i = at[left] + j
            hit = self.keys[i] == wanted[left]
            out[left[hit]] = self.place[i[hit]]
            left = left[~hit & (i + 1 < end[left])]
        return out


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


class Trie:
    """A trie in memory with PPM's log10 weights ready for look-up, pruned or whole: what probabilities() is tested against. grams[k]: (keys of k + 1 bytes, counts); contexts[k]: (keys of k bytes, totals)."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.order = len(grams) - 1
        self.gram, self.ctx, self.first_level, self.count, self.own, self.down, self.down_z = [], [], [], [], [], [], []
        before: tuple | None = None
        for k in range(self.order + 1):
            keys, n = grams[k]
            names, total = contexts[k]
            gram, ctx = Lookup(keys), Lookup(names)
            of = ctx(keys >> np.uint64(8))
            q = np.bincount(of, minlength=len(names)).astype(float)
            kept = np.bincount(of, n, minlength=len(names))
            rest = total - kept
            z = total + q
            self.gram.append(gram)
            self.ctx.append(ctx)
            self.first_level.append(np.log10(n / z[of]))
            self.count.append(np.log10(n.astype(float)))
            with np.errstate(divide="ignore"):
                self.own.append(np.log10((q + rest) / np.maximum(z, 1e-300)))
                if before is None:
                    self.down.append(np.zeros(len(names)))
                    self.down_z.append(np.zeros(len(names)))
                else:
                    # what is left at the next shorter context once this context's bytes are excluded
                    p_gram, p_n, p_ctx, p_q, p_kept, p_rest = before
                    parent = p_ctx(names & _mask(k - 1))
                    taken = np.bincount(of, p_n[p_gram(keys & _mask(k))], minlength=len(names))
                    q2, rest2 = p_q[parent] - q, p_rest[parent]
                    z2 = p_kept[parent] - taken + q2 + rest2
                    self.down.append(np.where(z2 > 0, np.log10((q2 + rest2) / np.maximum(z2, 1e-300)), 0.0))
                    self.down_z.append(np.log10(np.maximum(z2, 1e-300)))
            before = gram, n, ctx, q, kept, rest
        self.unseen = -np.log10(max(1, 256 - len(grams[0][0])))

    def log10(self, code: np.ndarray) -> np.ndarray:
        at = self.gram[self.order](code & _mask(self.order + 1))
        out = np.zeros(len(code)) if not len(self.first_level[self.order]) else np.where(at >= 0, self.first_level[self.order][at], 0.0)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            some, back = np.unique(code[miss], return_inverse=True)
            out[miss] = self._escaped(some)[back]
        return out

    def _escaped(self, code: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(code)), np.arange(len(code))
        child = np.full(len(code), -1)  # the context escaped from, one order up
        for k in range(self.order, -1, -1):
            if not len(todo):
                return out
            c, up = code[todo], child[todo]
            at = self.gram[k](c & _mask(k + 1))
            ctx = self.ctx[k]((c >> np.uint64(8)) & _mask(k))
            found, fresh = at >= 0, up < 0
            i = found & fresh
            out[todo[i]] += self.first_level[k][at[i]]
            i = found & ~fresh
            out[todo[i]] += self.count[k][at[i]] - self.down_z[k + 1][up[i]] if k < self.order else 0
            i = ~found & fresh & (ctx >= 0)
            out[todo[i]] += self.own[k][ctx[i]]
            i = ~found & ~fresh
            if k < self.order:
                out[todo[i]] += self.down[k + 1][up[i]]
            child[todo] = ctx
            todo = todo[~found]
        out[todo] += self.unseen
        return out


def _low(key: str, n: int) -> Column:
    """The last n bytes of a code."""
    return F.col(key).bitwiseAND((1 << (8 * n)) - 1)


def probabilities(counts: DataFrame) -> DataFrame:
    """(key, m, p), stored, from the stored counts: for every distinct code its number in all texts and log10 of its probability.

    Level k of the trie: grams (k + 1 bytes, n) and contexts (k bytes: total, q different bytes; once these are excluded, the
    next shorter context has the weight z2 left, of it q2 for its escape). A gram or context has at most 256 longer ones."""
    both = counts.where("kind in (1, 3)").groupBy("key").agg(F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("n"))), F.lit(0)).alias("n"), F.sum("n").alias("m"))
    both = store(both, "codes")
    grams: list[DataFrame] = [both.where("n > 0").select("key", "n")]
    for k in range(ORDER - 1, -1, -1):
        grams.insert(0, store(grams[0].groupBy(_low("key", k + 1).alias("key")).agg(F.sum("n").alias("n")), f"grams{k}"))
    contexts: list[DataFrame] = []
    for k in range(ORDER + 1):
        name = F.shiftrightunsigned("key", 8).alias("ctx")
        if not k:
            level = grams[0].groupBy(name).agg(F.sum("n").alias("total"), F.count("*").alias("q")).select("*", F.lit(None).cast("long").alias("z2"), F.lit(None).cast("long").alias("q2"))
        else:
            shorter = grams[k - 1].select(F.col("key").alias("low"), F.col("n").alias("low_n"))
            own = grams[k].withColumn("low", _low("key", k)).join(shorter, "low").groupBy(name).agg(F.sum("n").alias("total"), F.count("*").alias("q"), F.sum("low_n").alias("taken"))
            parent = contexts[-1].select(F.col("ctx").alias("up"), F.col("total").alias("up_total"), F.col("q").alias("up_q"))
            q2 = F.col("up_q") - F.col("q")
            level = own.withColumn("up", _low("ctx", k - 1)).join(parent, "up").select("ctx", "total", "q", (F.col("up_total") - F.col("taken") + q2).alias("z2"), q2.alias("q2"))
        contexts.append(store(level, f"contexts{k}"))

    def hint(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df

    z = F.col("total") + F.col("q")
    seen = grams[ORDER].join(contexts[ORDER], F.shiftrightunsigned("key", 8) == F.col("ctx")).select("key", F.log10(F.col("n") / z).alias("p"))
    done = [seen]
    # codes that training has not: todo has log10 of the escapes so far, and z2 and q2 of the context escaped from, if any
    todo = both.where("n = 0").select("key", F.lit(0.0).alias("p"), F.lit(None).cast("long").alias("z2"), F.lit(None).cast("long").alias("q2"))
    for k in range(ORDER, -1, -1):
        at = todo.withColumnsRenamed({"z2": "left_z", "q2": "left_q"}).withColumn("ctx", F.shiftrightunsigned("key", 8).bitwiseAND((1 << (8 * k)) - 1)).join(hint(contexts[k]), "ctx", "left")
        at = at.withColumn("low", _low("key", k + 1)).join(hint(grams[k].select(F.col("key").alias("low"), "n")), "low", "left")
        fresh = F.col("left_z").isNull()
        coded = F.when(fresh, F.log10(F.col("n") / z)).otherwise(F.log10(F.col("n") / F.col("left_z")))
        escape = F.when(fresh, F.coalesce(F.log10(F.col("q") / z), F.lit(0.0))).otherwise(F.when(F.col("left_z") > 0, F.log10(F.col("left_q") / F.col("left_z"))).otherwise(0.0))
        at = store(at.select("key", F.col("n").isNotNull().alias("found"), (F.col("p") + F.when(F.col("n").isNotNull(), coded).otherwise(escape)).alias("p"), "z2", "q2"), f"escaped{k}")
        done.append(at.where("found").select("key", "p"))
        todo = at.where("not found").drop("found")
    never = max(1, 256 - grams[0].count())  # 256 grams of one byte at most
    done.append(todo.select("key", F.col("p") - float(np.log10(never))))
    return store(both.select("key", "m").join(reduce(DataFrame.union, done), "key"), "probabilities")


def frequent(codes_: DataFrame, most: int) -> Column:
    """Whether a code is among the most frequent: whole classes of about equal frequency, ``most`` codes at most in all."""
    size = F.floor(F.log2("m") * 8).cast("int")
    classes = sorted(codes_.groupBy(size.alias("size")).count().collect(), reverse=True)  # 8 for each doubling of the frequency
    least, room = 1 << 30, most
    for r in classes:
        if r["count"] > room:
            break
        least, room = r["size"], room - r["count"]
    return size >= least


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counts = rows.select((remainder("id", 7) != 2).alias("train"), "text").mapInArrow(_count, "kind int, key long, n long")
    counts = store(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("kind = 0").select("key", "n")
    texts = counts.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    distinct, seen = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_train, v = seen + texts, distinct + (texts > 0)
    often = words.where(F.col("n") * most >= n_train).toArrow()
    weights = probabilities(counts)
    near = frequent(weights, most)
    top = weights.where(near).select("key", "p").toArrow()
    table_of = lambda t: (Lookup(t.column(0).to_numpy().view(np.uint64)), t.column(1).to_numpy())
    sent = spark.sparkContext.broadcast((*table_of(top), *table_of(often)))
    del top, often
    norm = float(n_train + v + 1)
    names = ["uid", "id", "kind", "key", "n_tokens", "n_known", "base", "score"]

    def rest(uid: pa.Array, ids: pa.Array, kind: int, row: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        """A row for each text and key that has to be joined, with its number in n_tokens. kind: 0 a text, 1 a word, 2 a code."""
        pair = np.lexsort((key, row))
        r, k = row[pair], key[pair]
        new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])])
        m, z = np.diff(np.r_[new, len(r)]), len(new)
        return pa.RecordBatch.from_arrays(
            [uid.take(pa.array(r[new])), pa.nulls(z, ids.type), pa.array(np.full(z, kind, np.int32)), pa.array(k[new].view(np.int64)), pa.array(m), pa.nulls(z, pa.int64()), pa.nulls(z, pa.float64()), pa.nulls(z, pa.float64())], names=names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_table, p, table, often_n = sent.value
        p = np.r_[p, 0.0]
        worth = np.r_[np.log10((often_n + 1) / norm), 0.0]
        end = np.log10((texts + 1) / norm)
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            for a, b in groups(off):
                part = data[off[a] : off[b]], off[a : b + 1] - off[a]
                code, first = codes(*part)
                place = code_table(code)
                score = np.add.reduceat(p[place], first[:-1])
                h, of = word_hashes(*part)
                at = table(h)
                row = np.repeat(np.arange(b - a), np.diff(of))
                known, base = np.bincount(row, at >= 0, b - a), np.bincount(row, worth[at], b - a)
                uid, ids = batch.column("uid").slice(a, b - a), batch.column("id").slice(a, b - a)
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [uid, ids, pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int64()), pa.array(np.diff(of) + 1), pa.array(known.astype(np.int64) + (texts > 0)), pa.array(base + end), pa.array(score)], names=names
                )
                rare = at < 0
                if rare.any():
                    yield rest(uid, ids, 1, row[rare], h[rare])
                rare = np.flatnonzero(place < 0)
                if len(rare):
                    yield rest(uid, ids, 2, np.searchsorted(first, rare, "right") - 1, code[rare])

    out = rows.mapInArrow(run, f"uid long, id {kind}, kind int, key long, n_tokens long, n_known long, base double, score double")
    # a text's own row gets a key of its own for the join, so that these rows spread
    out = out.withColumn("key", F.when(F.col("kind") == 0, F.xxhash64("uid")).otherwise(F.col("key")))
    known = words.select(F.lit(1).alias("kind"), "key", F.col("n").alias("c"), F.lit(None).cast("double").alias("p")).union(weights.where(~near).select(F.lit(2).alias("kind"), "key", F.lit(None).cast("long").alias("c"), "p"))
    c, text, word, code = F.coalesce(F.col("c"), F.lit(0)), F.col("kind") == 0, F.col("kind") == 1, F.col("kind") == 2
    joined = out.join(known, ["kind", "key"], "left").select(
        "uid",
        "id",
        F.when(text, F.col("score")).when(code, F.col("n_tokens") * F.col("p")).alias("score"),
        F.when(text, F.col("n_tokens")).alias("n_tokens"),
        F.when(text, F.col("n_known")).when(word & (c > 0), F.col("n_tokens")).otherwise(0).alias("n_known"),
        F.when(text, F.col("base")).when(word, F.col("n_tokens") * F.log10((c + 1) / F.lit(norm))).alias("base"),
    )
    done = joined.groupBy("uid").agg(F.max("id").alias("id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return done.select(F.col("id").alias(id_col), (remainder("id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(int(n_train)).cast("long").alias("train_tokens"), "base_score", "score")
