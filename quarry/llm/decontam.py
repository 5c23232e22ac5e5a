"""Benchmark decontamination with DataFrame functions alone.

Features are shingles of five words (fewer if an item is shorter; words: runs without ASCII white space, in lower case).
A shingle weighs 4 divided by the number of items that hold it (rounded down, at least 1); any other shingle of a document
weighs 1.

1. Windows of an item's number of words start at each place where a document has a shingle of such an item, cut at the
   text's end: a window that starts before its first shared shingle holds no more of the item than one that starts there,
   so no other place needs a fingerprint.
2. Each window and each item has a SimHash of 2 * 64 bits over all its shingles, benchmark's or not, by weight.
3. Multi-index: fingerprints are cut into BLOCKS blocks of 8 bits; two within RADIUS bits agree up to RADIUS // BLOCKS bits
   in one block at least, so looking up all values that near in every block finds every window within the radius of an
   item of its length.
4. These candidates are verified by the exact weighted Jaccard similarity of the two multisets of shingles; pairs at 0.75
   or more are reported with their best window.

At a similarity of 0.75 two fingerprints differ in 22 of 128 bits with a standard deviation of 4.3, so RADIUS = 47 loses a
pair with about 1 in 10 million.

Tables of numbers that come from the benchmark are broadcast only while they have at most BROADCAST_ROWS rows; larger ones
are shuffled. Windows meet their shingles by blocks of SPAN words, so a document with very many matches is no quadratic task.

Nulls and odd cases: null, empty or blank texts and items match nothing; documents shorter than an item are compared as
one window from each start; a null doc_id is reported as null; repeated rows are reported each; extra columns are ignored;
empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_ROWS, numbered, semi_join, store

SHINGLE, THRESHOLD, SPAN = 5, 0.75, 64
BLOCKS, RADIUS = 16, 47
#: All changes of a block of 8 bits in RADIUS // BLOCKS bits at most.
_NEAR = [sum(1 << i for i in bits) for k in range(RADIUS // BLOCKS + 1) for bits in combinations(range(8), k)]
WINDOW = ["uid", "pos", "len", "size"]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingles(w: str, size: int) -> Column:
    """Hashes of all runs of size words, in order; empty if there are fewer words."""
    starts = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, size)))


def fingerprints(features: DataFrame, by: list[str]) -> DataFrame:
    """by, fp0, fp1 (SimHash of 64 bits each), weight; features: by, h, w, n.

    A bit is set if the shingles that have it weigh more than half. Two bits are summed in one number, 32 bits apart: the
    shingles of a text of 2 GB weigh less than 2**32."""
    hashes = (F.col("h"), F.xxhash64("h", F.lit(1)))
    weight = F.col("w") * F.col("n")
    lanes = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(0x100000001) * weight).alias(f"s{j}_{i}") for j, h in enumerate(hashes) for i in range(32)]
    sums = features.groupBy(*by).agg(F.sum(weight).alias("weight"), *lanes)

    def word(j: int) -> Column:
        # the sign of weight - 2 * sum, at the bit's place
        bit = lambda s, at: F.shiftleft(F.shiftrightunsigned(F.col("weight") - s * 2, 63), at)
        bits = [bit(F.col(f"s{j}_{i}").bitwiseAND(0xFFFFFFFF), i) for i in range(32)] + [bit(F.shiftrightunsigned(f"s{j}_{i}", 32), 32 + i) for i in range(32)]
        while len(bits) > 1:  # in pairs: Spark's code for a long chain nests too deep
            bits = [x.bitwiseOR(y) for x, y in zip(bits[::2], bits[1::2], strict=True)]
        return bits[0]

    return sums.select(*by, "weight", word(0).alias("fp0"), word(1).alias("fp1"))


def _blocks(prints: DataFrame, keep: list[str], near: list[int]) -> DataFrame:
    """keep and key: a row for each block of a fingerprint and each change in near; the key holds length, block and value."""
    values = F.array(*(F.shiftrightunsigned(f"fp{b // 8}", 8 * (b % 8)).bitwiseAND(255) for b in range(BLOCKS)))
    out = prints.select(*keep, F.posexplode(values).alias("block", "value"))
    if near != [0]:
        out = out.withColumn("near", F.explode(F.array(*map(F.lit, near)))).withColumn("value", F.col("value").bitwiseXOR(F.col("near")))
    return out.select(*keep, ((F.col("len").cast("long") * BLOCKS + F.col("block")) * 256 + F.col("value")).alias("key"))


def within_radius(windows: DataFrame, items: DataFrame) -> DataFrame:
    """WINDOW, iid of all windows and items of one length whose fingerprints differ in RADIUS bits at most."""
    index = _blocks(items, ["iid", "len", "size", "fp0", "fp1"], _NEAR).select("iid", F.col("size").alias("item_size"), F.col("fp0").alias("i0"), F.col("fp1").alias("i1"), "key")
    met = _blocks(windows, [*WINDOW, "fp0", "fp1"], [0]).join(_hint(store(index, "bench-index")), "key")
    differ = F.bit_count(F.col("fp0").bitwiseXOR(F.col("i0"))) + F.bit_count(F.col("fp1").bitwiseXOR(F.col("i1")))
    return met.where((differ <= RADIUS) & (F.col("size") == F.col("item_size"))).select(*WINDOW, "iid").distinct()


def _hint(df: DataFrame) -> DataFrame:
    """df, stored and of numbers only, to be broadcast if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """uid (row number of docs), id_col, item_col, start (word of the best window), similarity: one row for each pair."""
    rows = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "uid")
    found = _leaks(rows, benchmark, item_col, item_text, threshold)
    return semi_join(rows.select("uid", "id"), store(found.select("uid").distinct(), "leaking"), "uid").join(found, "uid").select("uid", F.col("id").alias(id_col), F.col("item").alias(item_col), "start", "similarity")


def _leaks(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, threshold: float) -> DataFrame:
    """uid, item, start, similarity, stored; rows (stored): uid, text."""
    items = numbered(benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("ws")), "iid")
    items = items.withColumn("len", F.size("ws")).where("len > 0").withColumn("size", F.least(F.lit(SHINGLE), F.col("len")))
    parts = [items.where(F.col("size") == s).select("iid", "len", "size", F.explode(shingles("ws", s)).alias("h")) for s in range(1, SHINGLE + 1)]
    item_shingles = reduce(DataFrame.union, parts).groupBy("iid", "len", "size", "h").agg(F.count("*").alias("n"))
    spread = item_shingles.groupBy("h").agg(F.count_distinct("iid").alias("holders")).select("h", F.greatest(F.lit(1), F.floor(F.lit(4) / F.col("holders"))).cast("long").alias("w"))
    item_shingles = store(item_shingles.join(spread, "h"), "bench-shingles")
    sizes = sorted(r[0] for r in item_shingles.select("size").distinct().collect())  # five at most
    prints = store(fingerprints(item_shingles, ["iid", "len", "size"]), "bench-prints")
    vocabulary = _hint(store(item_shingles.select("h", "size", "w").distinct(), "bench-vocabulary"))
    lengths = _hint(store(item_shingles.select("h", "len", "size").distinct(), "bench-lengths"))

    split = rows.select("uid", words(F.col("text")).alias("ws"))
    every = lambda df, s: df.select("uid", F.posexplode(shingles("ws", s)).alias("pos", "h")).withColumn("size", F.lit(s))
    place = F.floor(F.col("pos") / SPAN)
    nothing = rows.sparkSession.createDataFrame([], f"uid long, item {benchmark.schema[item_col].dataType.simpleString()}, start int, similarity double")
    if not sizes:
        return nothing
    hits = [every(split, s).join(vocabulary.where(F.col("size") == s).select("h"), "h", "left_semi") for s in sizes]
    starts = store(reduce(DataFrame.union, hits).join(lengths, ["h", "size"]).select(*WINDOW).distinct(), "bench-windows")
    spans = starts.withColumn("span", F.explode(F.sequence(place, F.floor((F.col("pos") + F.col("len") - F.col("size")) / SPAN))))
    covered = store(spans.select("uid", "span", "size").distinct(), "bench-spans")
    # all shingles of the spans that windows cover, from the documents that have any
    some = semi_join(split, store(covered.select("uid").distinct(), "bench-documents"), "uid")
    near = reduce(DataFrame.union, [every(some, s) for s in sizes]).withColumn("span", place)
    near = near.join(_hint(covered), ["uid", "span", "size"], "left_semi").join(vocabulary, ["h", "size"], "left")
    near = near.select("uid", "span", "size", F.col("pos").alias("at"), "h", F.coalesce("w", F.lit(1)).alias("w"))
    inside = spans.join(near, ["uid", "span", "size"]).where("at >= pos and at <= pos + len - size")
    features = store(inside.repartition("uid", "pos", "len").groupBy(*WINDOW, "h").agg(F.first("w").alias("w"), F.count("*").alias("n")), "bench-features")
    windows = store(fingerprints(features, WINDOW), "window-prints")

    pairs = within_radius(windows, prints).join(windows.select(*WINDOW, "weight"), WINDOW)
    both = pairs.join(features.select(*WINDOW, "h", "n"), WINDOW).join(_hint(store(item_shingles.select("iid", "h", F.col("n").alias("item_n"), "w"), "bench-counts")), ["iid", "h"])
    exact = both.groupBy(*WINDOW, "weight", "iid").agg(F.sum(F.least("n", "item_n") * F.col("w")).alias("common"))
    exact = exact.join(_hint(prints.select("iid", F.col("weight").alias("item_weight"))), "iid")
    similar = exact.withColumn("similarity", F.col("common") / (F.col("weight") + F.col("item_weight") - F.col("common"))).where(F.col("similarity") >= threshold)
    best = similar.groupBy("uid", "iid").agg(F.max(F.struct("similarity", (-F.col("pos")).alias("minus"))).alias("b"))
    return store(best.join(items.select("iid", "item"), "iid").select("uid", "item", (-F.col("b.minus")).alias("start"), F.round("b.similarity", 6).alias("similarity")), "leaks")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item; columns unchanged.

    Rows are told apart by a stored number, so ids may be null or repeat; null and empty texts stay; empty tables give all
    of docs; extra columns may have any names."""
    name = "__quarry_uid"
    whole = numbered(docs, name)
    found = _leaks(whole.select(F.col(name).alias("uid"), F.col(text_col).cast("string").alias("text")), benchmark, "item_id", "text", THRESHOLD)
    out = store(found.select(F.col("uid").alias(name)).distinct(), "leaking")
    return whole.join(_hint(out), name, "left_anti").drop(name)


__all__ = ["drop_leaks", "leaks"]
