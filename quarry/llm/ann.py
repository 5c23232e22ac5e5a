"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

ROTATIONS rotations are learned (principal axes, then iterative quantisation: the rotation that brings the axes nearest to
their signs) on a sample of at most ``sample_rows`` vectors, a documented bound of the fit alone. The signs are a
vector's code. Codes are split into PARTS substrings, each indexed by its distinct values; by the pigeonhole principle a
code within radius r of the query's has a substring within r // PARTS, so probing these buckets finds every code within the
radius, whose vectors are then ranked by their exact distances. The radius holds COVER of the sample's true neighbours,
which lie farther apart than those in the full table; where a query finds too few codes, its radius grows.

How far probing narrows down depends on the vectors: the more bits, the sharper a code tells angles, so codes are long and
substrings few. Even for vectors alike in all directions, whose tenth neighbour still differs in 40 % of all bits, about an
eighth of the rows shares a bucket with a query and a hundredth is within the radius.

All vectors are indexed, in shards of about SHARD rows by a hash of their row number, so copies of one vector or id spread;
each shard answers all queries of a block (at most about QUERIES) with its nearest, and these are merged. No task holds more
than a shard and a block of queries.

Nulls and odd cases: vectors that are null, zero, hold null or non-finite components, or have another length than most
(ties to the longer), and rows without an id, take no part. Each row is a query of its own, also if its id repeats: its
candidates are all rows but itself. Fewer candidates than k: all are returned. Extra columns are ignored; empty tables
give an empty result. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import numbered

ROTATIONS, PARTS, COVER, SHARD, QUERIES, SAMPLE_ROWS = 8, 2, 0.985, 50_000, 20_000, 8_192


def _differ(codes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Bits in which each row of codes differs from q."""
    return np.bitwise_count(codes ^ q).sum(axis=1, dtype=np.int64)


class Codes:
    """The learned mean and axes (dimensions, bits), and the radius."""

    def __init__(self, x: np.ndarray, k: int, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        self.mean = x.mean(axis=0)
        centred = x - self.mean
        values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
        top = vectors[:, np.argsort(values)[::-1][: min(64, x.shape[1])]]
        axes = []
        for _ in range(ROTATIONS):
            v = centred @ top
            r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
            for _ in range(25):
                a, _, b = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (a @ b).T
            axes.append(top @ r)
        self.axes = np.concatenate(axes, axis=1)
        self.bits = self.axes.shape[1]
        self.radius = self.learned_radius(x, k)

    def of(self, x: np.ndarray) -> np.ndarray:
        """(rows, words) of 64 bits each, a whole number of words for each substring."""
        out = []
        for a in range(0, max(1, len(x)), 8192):
            bit = (x[a : a + 8192] - self.mean) @ self.axes >= 0
            out.append(np.packbits(np.pad(bit, ((0, 0), (0, -self.bits % (64 * PARTS)))), axis=1).view(np.uint64))
        return np.concatenate(out)

    def learned_radius(self, x: np.ndarray, k: int, queries: int = 300) -> int:
        if len(x) < 2:
            return self.bits
        code, far = self.of(x), []
        for i in range(0, len(x), max(1, len(x) // queries)):
            d = ((x - x[i]) ** 2).sum(axis=1)
            d[i] = np.inf
            near = np.argpartition(d, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
            far.append(_differ(code[near], code[i]))
        return int(np.quantile(np.concatenate(far), COVER))


class Index:
    """The distinct values of every substring, with the rows that hold them, over one shard."""

    def __init__(self, code: np.ndarray) -> None:
        self.code = code
        self.width = code.shape[1] // PARTS
        self.buckets = []
        for s in range(PARTS):
            part = np.ascontiguousarray(code[:, s * self.width : (s + 1) * self.width])
            _, first, of = np.unique(part.view(f"V{8 * self.width}").ravel(), return_index=True, return_inverse=True)
            self.buckets.append((part[first], of))

    def probed(self, q: np.ndarray, radius: int) -> np.ndarray:
        """Rows in a bucket near the query's: by pigeonhole these hold all within the radius."""
        each, extra = divmod(radius, PARTS)
        found = np.zeros(len(self.code), bool)
        for s, (values, of) in enumerate(self.buckets):
            # the first extra + 1 substrings are probed to each bits, the others to one less
            found |= (_differ(values, q[s * self.width : (s + 1) * self.width]) <= each - (s > extra))[of]
        return np.flatnonzero(found)

    def within(self, q: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from q's in radius bits at most: probe, then check the whole code."""
        rows = self.probed(q, radius)
        return rows[_differ(self.code[rows], q) <= radius]


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, its k nearest others found."""
    spark = vectors.sparkSession
    ok = F.size("v") > 0
    ok = ok & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null").where(ok)
    rows = numbered(rows, "uid")
    found = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = found
    rows = rows.where(F.size("v") == d)
    sample = rows.select("v", F.xxhash64("id", "v").alias("h"), "uid").orderBy("h", "uid").limit(sample_rows).toArrow()
    sent = spark.sparkContext.broadcast(Codes(_matrix(sample.column("v")), k))
    shards = -(-n // SHARD)
    asked = rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-asked.count() // QUERIES))
    spread = lambda df, own, own_n, other, other_n: df.withColumn(own, F.pmod(F.xxhash64("uid"), F.lit(own_n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))
    base = spread(rows, "shard", shards, "block", blocks)
    queries = spread(asked, "block", blocks, "shard", shards)

    def search(base: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if base.num_rows and queries.num_rows:
            codes = sent.value
            x, ids, uids = _matrix(base.column("v")), base.column("id").to_numpy(), base.column("uid").to_numpy()
            y, asking, own = _matrix(queries.column("v")), queries.column("id").to_numpy(), queries.column("uid").to_numpy()
            index, q = Index(codes.of(x)), codes.of(y)
            want = min(k + 1, len(x))
            for i in range(len(y)):
                radius = codes.radius
                hit = index.within(q[i], radius)
                while len(hit) < want and radius < codes.bits:
                    radius = min(codes.bits, radius + max(4, codes.bits // 32))
                    hit = index.within(q[i], radius)
                hit = hit[uids[hit] != own[i]]
                score = np.sqrt(((x[hit] - y[i]) ** 2).sum(axis=1))
                best = np.lexsort((ids[hit], score))[:k]
                for col, value in zip(out, (np.full(len(best), own[i]), np.full(len(best), asking[i]), ids[hit][best], score[best]), strict=True):
                    col.append(value)
        cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"row": cat(out[0], pa.int64()), "query_id": cat(out[1], pa.int64()), "vec_id": cat(out[2], pa.int64()), "score": cat(out[3], pa.float64())})

    local = base.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(search, "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
