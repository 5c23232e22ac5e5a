"""Near-duplicate documents: MinHash banding, signature checks, exact confirmation, alternating large-star and small-star.

A text's set is its distinct five-word shingles (words: runs without ASCII white space, A-Z lower-cased; all words
as one shingle if fewer than five). Two texts are linked if their sets' Jaccard similarity is at least the threshold.

The stages:
1. every text gets a signature of ``BANDS * ROWS`` universal hash minima; texts of equal sets become one class, with the
   smallest row as representative, so that thousands of copies cost no more than one;
2. representatives that share a band's minima share a bucket. In each bucket a hub (the member seen in the most and
   largest buckets) is paired with all others; a signature check and then the full sets confirm these pairs;
3. alternating large-star and small-star gives the components of confirmed links;
4. buckets that still hold members of several components are compared exactly, across components only, in cells of
   CELL x CELL members, so that neither a large bucket nor its pairs ever meet in one task. Only links are emitted;
5. the components are joined again.

A pair at the threshold shares no band with probability (1 - 0.75**ROWS)**BANDS = 7e-6, and fails the signature check
(four standard deviations of slack) with 3e-5; no cap or sample drops a candidate.

Nulls and odd cases: null, empty or blank texts have an empty set, n_shingles 0, and are linked with nothing; their
component is their own id. Rows that repeat an id are separate nodes. A null id stays null; the component id is the
smallest non-null id of the component. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import blocks, join_hot, mix, numbered, semi_join, shingle_sets, small_batches, store, tidy

BANDS, ROWS, CELL = 44, 5, 512
THRESHOLD = 75  # per cent
_rng = np.random.default_rng(4)
_MUL = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least(threshold: int) -> int:
    """Equal minima that a pair at the threshold has, less four standard deviations."""
    p, n = threshold / 100, BANDS * ROWS
    return int(n * (p - 4 * (p * (1 - p) / n) ** 0.5))


def signature(s: np.ndarray) -> np.ndarray:
    """Minima of the multiply-shift hashes of a set; large sets go through in parts."""
    out = np.full(len(_MUL), 0xFFFFFFFF, np.uint64)
    for a in range(0, len(s), 4096):
        part = s[a : a + 4096]
        np.minimum(out, ((_MUL[:, None] * part[None, :] + _ADD[:, None]) >> np.uint64(32)).min(axis=1), out=out)
    return out.astype(np.uint32)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, off in blocks(batches, "text"):
        n, k1, k2, sigs = [], [], [], []
        for s in shingle_sets(data, off):
            n.append(len(s))
            key = np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
            k1.append(int(key[0]))
            k2.append(int(key[1]))
            sigs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.binary())], names=["uid", "n", "k1", "k2", "sig"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
        keys = mix((sig.astype(np.uint64) * _BAND).sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * _BAND[0, 0])
        uid = np.repeat(batch.column("rep").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(keys.ravel().view(np.int64))], names=["rep", "key"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, off in blocks(batches, "text"):
        yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array([s.tobytes() for s in shingle_sets(data, off)], pa.binary())], names=["uid", "elements"])


def _similar_sigs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return run


def linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """100 * |x & y| >= threshold * |x | y|, for sorted distinct arrays."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def _confirmed(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), threshold) for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each cell together, from batches sorted by cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and held[0].column("cell")[0].as_py() != cell[a]:
                yield pa.concat_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_batches(held)


def _sides(cell: pa.RecordBatch, payload: str, dtype):
    left = cell.column("is_left").to_numpy(zero_copy_only=False)
    uid, comp = cell.column("rep").to_numpy(), cell.column("comp").to_numpy()
    values = [np.frombuffer(v.as_buffer(), dtype) for v in cell.column(payload)]
    at = np.flatnonzero(left), np.flatnonzero(~left)
    return [(uid[i], comp[i], [values[k] for k in i]) for i in at]


def _active(least: int):
    """Members of a bucket's cell that have a partner of another component with a similar signature, in the first band that both share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_cell(batches):
            (u, cu, su), (v, cv, sv) = _sides(cell, "sig", np.uint32)
            if not len(u) or not len(v):
                continue
            y, hit_v, hit_u = np.stack(sv), np.zeros(len(v), bool), np.zeros(len(u), bool)
            keys, key = mix((y.reshape(-1, BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * _BAND[0, 0]), np.uint64(cell.column("key")[0].as_py() & 0xFFFFFFFFFFFFFFFF)
            band = int(np.argmax(keys[0] == key))
            for i, x in enumerate(su):
                same = y == x
                ok = (same.sum(axis=1) >= least) & (cv != cu[i])
                if band:
                    ok &= ~same.reshape(-1, BANDS, ROWS)[:, :band].all(axis=2).any(axis=1)
                hit_v |= ok
                hit_u[i] = ok.any()
            hits = np.unique(np.r_[u[hit_u], v[hit_v]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hits), key.view(np.int64) if hasattr(key, "view") else key)), pa.array(hits)], names=["key", "rep"])

    return run


def _cell_links(threshold: int):
    """Links of a cell across components; for each left member and other component one suffices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_cell(batches):
            (u, cu, su), (v, cv, sv) = _sides(cell, "elements", np.uint64)
            if not len(u) or not len(v):
                continue
            sizes = np.array([len(s) for s in sv])
            flat, first = np.concatenate(sv), np.r_[0, np.cumsum(sizes)[:-1]]
            a, b = [], []
            for i, x in enumerate(su):
                at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
                both = np.add.reduceat((x[at] == flat).astype(np.int64), first)
                ok = np.flatnonzero((100 * both >= threshold * (len(x) + sizes - both)) & (cv != cu[i]))
                _, one = np.unique(cv[ok], return_index=True)
                a += [u[i]] * len(one)
                b += list(v[ok[one]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _cells(members: DataFrame) -> DataFrame:
    """key, rep, comp, lead (the hub's component), size -> a row for each cell of the bucket that the member is part of.

    Left are members outside the hub's component, right are all: two members of the hub's component need no comparing."""
    n = F.ceil(F.col("size") / CELL).cast("int")
    own = F.pmod(F.xxhash64("rep"), n).cast("int")
    sides = F.array(F.struct(F.lit(False).alias("is_left")), F.struct(F.lit(True).alias("is_left")))
    return (
        members.withColumn("is_left", F.explode(F.transform(sides, lambda s: s["is_left"])))
        .where(~F.col("is_left") | (F.col("comp") != F.col("lead")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("cell", F.xxhash64("key", F.when(F.col("is_left"), own).otherwise(F.col("other")), F.when(F.col("is_left"), F.col("other")).otherwise(own)))
        .drop("other")
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node that each node of edges (a, b) reaches, by alternating large-star and small-star.

    Each round is a written table; minima are pre-aggregated, so a hub with many neighbours is no hot task. Rounds grow with
    the logarithm of the longest chain; should max_rounds not do, an error is raised and no link lost."""
    from_to = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = from_to.union(from_to.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large-star: neighbours above a node go to the least of its neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = store(large, "large-star")
        # small-star: a node and its neighbours below it go to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        from_to = store(small.select("e.u", "e.v").where("u <> v").distinct(), "small-star")
        # stars have settled when the sum over edges no longer changes
        now = from_to.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return from_to.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of docs: uid (its row number), id_col, n_shingles, component_id, kept, is_first.

    kept: the id is the component's smallest. is_first: the one row of its component that a deduplicated corpus keeps."""
    return _near_duplicates(numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "uid"), id_col, threshold)


def _near_duplicates(rows: DataFrame, id_col: str, threshold: int) -> DataFrame:
    """near_duplicates of stored rows (uid, id, text): a uid that is computed anew may differ once executors are lost or join."""
    small_batches(rows.sparkSession)
    least = _least(threshold)
    signed = store(rows.select("uid", "text").mapInArrow(_signed, "uid long, n long, k1 long, k2 long, sig binary"), "signatures")
    ids = rows.select("uid", "id")
    full = signed.where("n > 0")
    classes = store(full.groupBy("k1", "k2").agg(F.min("uid").alias("rep"), F.count("*").alias("rows")), "classes")
    reps = classes.select("rep")
    sigs = full.select(F.col("uid").alias("rep"), "sig").join(reps, "rep", "left_semi")
    bands = store(sigs.mapInArrow(_banded, "rep long, key long"), "bands")
    sizes = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = store(bands.join(sizes, "key"), "buckets")
    score = shared.groupBy("rep").agg(F.sum("size").alias("score"))
    hubs = shared.join(score, "rep").groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("hub"))
    shared = store(shared.join(hubs, "key"), "hubs")
    pairs = shared.where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()

    known = sigs.join(shared.select("rep").distinct(), "rep", "left_semi")
    known = store(known, "known")
    of = lambda table, side, what, name: table.select(F.col(table.columns[0]).alias(side), F.col(what).alias(name))
    likely = store(pairs.join(of(known, "a", "sig", "sig_a"), "a").join(of(known, "b", "sig", "sig_b"), "b").mapInArrow(_similar_sigs(least), "a long, b long"), "likely")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = store(nodes.distinct(), "wanted")
        return store(semi_join(rows.select("uid", "text"), wanted, "uid").mapInArrow(_sets, "uid long, elements binary"), "sets")

    sets = sets_of(likely.select(F.col("a").alias("uid")).union(likely.select(F.col("b").alias("uid"))))
    sure = likely.join(of(sets, "a", "elements", "set_a"), "a").join(of(sets, "b", "elements", "set_b"), "b").mapInArrow(_confirmed(threshold), "a long, b long")
    sure = store(sure, "links")
    first = components(sure)
    tidy(rows.sparkSession)

    # buckets that still hold several components
    in_comp = shared.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    in_comp = store(in_comp, "in-comp")
    open_keys = in_comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("rep") == F.col("hub"), F.col("comp"))).alias("lead")).where("lo <> hi").select("key", "lead")
    unsure = in_comp.join(open_keys, "key").drop("hub")
    cells = lambda df: df.repartition("cell").sortWithinPartitions("cell")
    active = cells(_cells(unsure.join(known, "rep"))).select("cell", "key", "rep", "comp", "is_left", "sig").mapInArrow(_active(least), "key long, rep long")
    active = store(active.distinct(), "active")
    sets = sets_of(active.select(F.col("rep").alias("uid")))
    again = _cells(unsure.join(active, ["key", "rep"]).join(sets.withColumnRenamed("uid", "rep"), "rep"))
    more = cells(again).select("cell", "key", "rep", "comp", "is_left", "elements").mapInArrow(_cell_links(threshold), "a long, b long")
    more = store(more.distinct(), "more-links")
    final = first if more.isEmpty() else components(sure.union(more))

    # class -> component -> smallest id; every row of a class shares its component, a row without shingles is its own
    node = store(classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("comp", "rep").alias("comp"), "rows"), "class-components")
    member = join_hot(full.select("uid", "n", "k1", "k2"), node, ["k1", "k2"], "rows").select("uid", "n", "comp")
    member = store(member.union(signed.where("n = 0").select("uid", "n", F.col("uid").alias("comp"))).join(ids, "uid"), "members")
    # a component in which no row has an id keeps its first row
    top = member.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("top"), F.count("*").alias("rows"))
    return join_hot(member, store(top, "component-ids"), ["comp"], "rows").select(
        "uid",
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("top.id").alias("component_id"),
        F.col("id").eqNullSafe(F.col("top.id")).alias("kept"),
        (F.col("uid") == F.col("top.uid")).alias("is_first"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """docs with one row of each component, its columns unchanged.

    Texts without a word are linked with nothing and stay, null ones too; of rows that repeat one stays, also without an id;
    an empty table gives an empty one; extra columns may have any names."""
    name = "__quarry_uid"
    whole = numbered(docs, name)
    rows = whole.select(F.col(name).alias("uid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    stay = _near_duplicates(rows, id_col, threshold).where("is_first").select(F.col("uid").alias(name))
    return semi_join(whole, store(stay, "stay"), name).drop(name)
