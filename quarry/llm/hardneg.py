"""Hard-negative mining by dual-tree search over inner products.

For every anchor its best same-label rows are its positives, and for every positive the best other-label rows whose score
lies within a band below the positive's are its hard negatives. Both searches walk two trees at once: a node of anchors and a
node of candidates, each a ball, bound all their inner products to an interval (product of the centres, plus or minus what
both radii allow); a pair of nodes whose interval lies under the worst score that its anchors still look for, or above their
bands, is dropped as a whole, and pairs of leaves are scored exactly, by one matrix product of integers in double precision.

The trees' upper level is shared by all tasks: CELLS cells at most, around the centres of groups of at most SAMPLE_ROWS
sampled vectors (a bound of the fit alone; every row is put into a cell, each cell's radius is that of all its rows). A
cell's rows are dealt out in pieces of about PIECE rows by a hash of their row number, so copies of one vector spread.
Anchors go to a cell's pieces only if the interval of their own cell with that cell allows a hit; what their own cell
gives comes first and sets the bound. In a task a piece's lower tree is built once, its anchors stream by, in blocks of
BLOCK_ROWS that get a tree of their own.

Nulls and odd cases: rows without an id, with a null label or vector, with null or non-finite components, or of another
length than most (ties to the longer) take no part. Rows that repeat are rows of their own: each is a candidate for all
others, and an anchor by itself. Fewer positives or negatives than asked for: all there are; positives with a negative
score have an empty band. Ties go to the smaller id. Components must stay below 2 to the power of 24 after scaling, so that
products are exact. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import numbered, store

SAMPLE_ROWS, CELLS, PIECE, BLOCK_ROWS, LEAF, ANCHOR_LEAF = 8192, 1024, 8192, 2048, 64, 16
#: Least sampled rows of a cell.
LEAST = 8
#: The label rule, the anchors and the scale of the task.
SCALE, ANCHORS, CHANGED, LABELS = 256, 50, 7, 10


class Cells:
    """The upper level: centres of k groups of the sample (Lloyd's steps from rows spread over it); a row's cell is the nearest."""

    def __init__(self, sample: np.ndarray, k: int, steps: int = 8) -> None:
        self.centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
        for _ in range(steps):
            cell = self.cells(sample)
            for i in range(k):
                if (own := cell == i).any():
                    self.centres[i] = sample[own].mean(axis=0)

    def cells(self, v: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(axis=1) - 2 * (v @ self.centres.T)).argmin(axis=1)


def halves(v: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, int]:
    """(order of rows, size of the first part): rows nearer to one of two that lie far apart, then those nearer to the other;
    where one part would be under a sixteenth, two parts of one size, along the line between both."""
    far = v[((v - centre) ** 2).sum(axis=1).argmax()]
    other = v[((v - far) ** 2).sum(axis=1).argmax()]
    along = v @ (other - far)
    middle = (far + other) @ (other - far) / 2
    n = int((along < middle).sum())
    if min(n, len(v) - n) < len(v) / 16:
        n = len(v) // 2
        return np.argpartition(along, n), n
    return np.argsort(along >= middle, kind="stable"), n


class Tree:
    """A ball tree: rows in order, and of each node its rows [a, b), children, centre, its length, and radius."""

    def __init__(self, v: np.ndarray, leaf: int) -> None:
        self.order = np.arange(len(v))
        self.span: list[tuple[int, int]] = []
        self.kids: list[tuple[int, int] | None] = []
        centres, radii = [], []
        todo, parent = [(0, len(v), -1)], []
        while todo:
            a, b, up = todo.pop()
            at = len(self.span)
            own = v[self.order[a:b]]
            centre = own.mean(axis=0)
            self.span.append((a, b))
            self.kids.append(None)
            parent.append(up)
            centres.append(centre)
            radii.append(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            if b - a > leaf:
                part, half = halves(own, centre)
                self.order[a:b] = self.order[a:b][part]
                todo += [(a + half, b, at), (a, a + half, at)]
        for i, up in enumerate(parent):
            if up >= 0:
                self.kids[up] = (i,) if self.kids[up] is None else (*self.kids[up], i)
        self.centre, self.radius = np.array(centres), np.array(radii)
        self.length = np.sqrt((self.centre**2).sum(axis=1))
        self.rows = np.ascontiguousarray(v[self.order])


def intervals(a_centre: np.ndarray, a_radius: np.ndarray, c_centre: np.ndarray, c_radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bound of the inner products of every ball of a with every ball of c."""
    middle = a_centre @ c_centre.T
    a_length, c_length = np.sqrt((a_centre**2).sum(axis=1)), np.sqrt((c_centre**2).sum(axis=1))
    reach = a_radius[:, None] * c_length + a_length[:, None] * c_radius + a_radius[:, None] * c_radius
    reach = reach * (1 + 1e-9) + 1e-6
    return middle - reach, middle + reach


def dual(a: Tree, c: Tree, need: Callable[[int, int], float], cap: Callable[[int, int], float], leaves: Callable[[int, int, int, int], None]) -> int:
    """Walk both trees; need and cap tell the least and greatest score that anchors [a, b) look for. Returns the products made."""
    low, high = intervals(a.centre, a.radius, c.centre, c.radius)
    made = 0
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        s, e = a.span[i]
        if high[i, j] < need(s, e) or low[i, j] > cap(s, e):
            continue
        if a.kids[i] is None and c.kids[j] is None:
            made += (e - s) * (c.span[j][1] - c.span[j][0])
            leaves(s, e, *c.span[j])
        elif c.kids[j] is None or a.kids[i] is not None and a.radius[i] > c.radius[j]:
            todo += [(k, j) for k in a.kids[i]]
        else:
            todo += [(i, k) for k in sorted(c.kids[j], key=lambda k: high[i, k])]  # the most promising is taken next
    return made


def merged(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of both, row by row; a score of minus infinity is none."""
    s = np.concatenate([scores, more], axis=1)
    n = np.concatenate([ids, np.broadcast_to(more_ids, more.shape)], axis=1)
    best = np.lexsort((n, -s), axis=1)[:, :k]
    return np.take_along_axis(s, best, 1), np.take_along_axis(n, best, 1)


class Part:
    """One piece's rows: uid, id, label, vectors; and the trees over all of them or a label's, made when asked for."""

    def __init__(self, t: pa.Table, leaf: int) -> None:
        self.leaf = leaf
        self.uid, self.id, self.label = (np.asarray(t.column(c)) for c in ("uid", "vec_id", "label"))
        self.v = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(len(self.uid), -1)
        self._trees: dict[int | None, tuple[Tree, np.ndarray]] = {}

    def tree(self, label: int | None = None) -> tuple[Tree, np.ndarray] | None:
        """(tree, its rows' places in the piece) of a label's rows; None: of all."""
        if label not in self._trees:
            at = np.arange(len(self.v)) if label is None else np.flatnonzero(self.label == label)
            if not len(at):
                return None
            tree = Tree(self.v[at], self.leaf)
            self._trees[label] = tree, at[tree.order]
        return self._trees[label]


def best_positives(part: Part, anchors: Part, floor: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """For each anchor its k best rows of its label in the piece that reach its floor, itself not among them."""
    out = []
    for label in np.unique(anchors.label):
        if not (found := part.tree(int(label))):
            continue
        tree, rows = found
        a_tree, a_rows = anchors.tree(int(label))
        least = floor[a_rows]
        scores, ids = np.full((len(a_rows), k), -np.inf), np.full((len(a_rows), k), np.iinfo(np.int64).max)

        def leaves(s: int, e: int, x: int, y: int) -> None:
            p = a_tree.rows[s:e] @ tree.rows[x:y].T
            p[(p < np.maximum(least[s:e], scores[s:e, -1])[:, None]) | (anchors.uid[a_rows[s:e], None] == part.uid[rows[x:y]])] = -np.inf  # noqa: B023
            if np.isfinite(p).any():
                scores[s:e], ids[s:e] = merged(scores[s:e], ids[s:e], p, part.id[rows[x:y]], k)  # noqa: B023

        dual(a_tree, tree, lambda s, e: np.maximum(least[s:e], scores[s:e, -1]).min(), lambda s, e: np.inf, leaves)  # noqa: B023
        r, j = np.nonzero(np.isfinite(scores))
        out.append({"anchor": anchors.uid[a_rows[r]], "band": np.zeros(len(r), np.int64), "score": scores[r, j].astype(np.int64), "vec_id": ids[r, j]})
    return {c: np.concatenate([x[c] for x in out]) if out else np.zeros(0, np.int64) for c in ("anchor", "band", "score", "vec_id")}


def best_negatives(part: Part, anchors: Part, low: np.ndarray, high: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """For each anchor and band (low to high; none: low above high) its k best rows of other labels within."""
    tree, rows = part.tree()
    a_tree, a_rows = anchors.tree()
    low, high = low[a_rows], high[a_rows]
    n, bands = low.shape
    scores, ids = np.full((n, bands, k), -np.inf), np.full((n, bands, k), np.iinfo(np.int64).max)
    need = np.where(low <= high, low, np.inf)
    cap = np.where(low <= high, high, -np.inf).max(axis=1)

    def leaves(s: int, e: int, x: int, y: int) -> None:
        p = a_tree.rows[s:e] @ tree.rows[x:y].T
        p[anchors.label[a_rows[s:e], None] == part.label[rows[x:y]]] = -np.inf
        for b in range(bands):
            inside = (p >= need[s:e, b, None]) & (p <= high[s:e, b, None])
            r = np.flatnonzero(inside.any(axis=1))
            if len(r):
                scores[s + r, b], ids[s + r, b] = merged(scores[s + r, b], ids[s + r, b], np.where(inside[r], p[r], -np.inf), part.id[rows[x:y]], k)
                need[s + r, b] = np.maximum(need[s + r, b], scores[s + r, b, -1])

    dual(a_tree, tree, lambda s, e: need[s:e].min(), lambda s, e: cap[s:e].max(), leaves)
    r, b, j = np.nonzero(np.isfinite(scores))
    return {"anchor": anchors.uid[a_rows[r]], "band": b, "score": scores[r, b, j].astype(np.int64), "vec_id": ids[r, b, j]}


def search(rows: DataFrame, anchors: DataFrame, work: Callable[[Part, Part, pa.Table], dict[str, np.ndarray]]) -> DataFrame:
    """anchor, band, score, vec_id: what work finds for the anchors (with the key of a piece each) in the pieces of rows.

    rows: key, uid, vec_id, label, v; anchors: these and low, high. A piece comes first, then its anchors, as a stream."""
    both = rows.select("key", F.lit(0).alias("kind"), "uid", "vec_id", "label", "v").unionByName(anchors.select("key", F.lit(1).alias("kind"), "uid", "vec_id", "label", "v", "low", "high"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, part = None, None
        for batch in batches:
            keys, kinds = np.asarray(batch.column("key")), np.asarray(batch.column("kind"))
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1]), True])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if keys[a] != key:
                    key, part, held = keys[a], None, []
                if kinds[a] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if not held:
                    continue
                part = part or Part(pa.Table.from_batches(held), LEAF)
                for x in range(a, b, BLOCK_ROWS):
                    some = pa.Table.from_batches([batch.slice(x, min(BLOCK_ROWS, b - x))])
                    found = work(part, Part(some, ANCHOR_LEAF), some)
                    if len(found["anchor"]):
                        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in found.values()], names=list(found))

    return both.repartition(F.col("key")).sortWithinPartitions("key", "kind").mapInArrow(run, "anchor long, band long, score long, vec_id long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """rank: the k best of each anchor and band."""
    w = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _positive_work(k: int) -> Callable[[Part, Part, pa.Table], dict[str, np.ndarray]]:
    return lambda part, anchors, t: best_positives(part, anchors, np.array([x[0] for x in t.column("low").to_pylist()], float), k)


def _negative_work(k: int) -> Callable[[Part, Part, pa.Table], dict[str, np.ndarray]]:
    def work(part: Part, anchors: Part, t: pa.Table) -> dict[str, np.ndarray]:
        low, high = t.column("low").to_pylist(), t.column("high").to_pylist()
        most = max(map(len, low))
        fill = lambda rows, none: np.array([[*r, *[none] * (most - len(r))] for r in rows], float)
        return best_negatives(part, anchors, fill(low, 1.0), fill(high, 0.0), k)

    return work


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (vec_id, label, v) of vectors.

    v: array of long of one length; anchor: which rows are anchors. A band goes from half of the positive's score to 95 %."""
    spark = vectors.sparkSession
    base = numbered(vectors.select("vec_id", "label", "v", anchor.alias("anchor")), "uid")
    n = base.count()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sample = base.orderBy(F.xxhash64("uid", F.lit(11)), "uid").limit(SAMPLE_ROWS).select("v").toArrow()
    v = np.array(sample.column("v").to_pylist(), np.float64).reshape(sample.num_rows, -1)
    k = max(1, min(-(-n // PIECE), CELLS, len(v) // LEAST))
    sent = spark.sparkContext.broadcast(Cells(v, k))  # CELLS centres at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        for batch in batches:
            flat = np.asarray(batch.column("v").flatten(), np.float64).reshape(batch.num_rows, -1)
            cell = found.cells(flat)
            away = np.sqrt(((flat - found.centres[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("vec_id"), batch.column("label"), batch.column("anchor"), pa.array([x.tobytes() for x in flat], pa.binary()), pa.array(cell), pa.array(away)], names=["uid", "vec_id", "label", "anchor", "v", "cell", "away"])

    placed = store(base.mapInArrow(place, "uid long, vec_id long, label long, anchor boolean, v binary, cell long, away double"), "hard-rows")
    # CELLS rows at most
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max(F.when(F.col("anchor"), F.col("away"))).alias("reach")).toPandas()
    pieces = np.maximum(1, -(-cells["n"].to_numpy(np.int64) // PIECE))
    first = np.r_[0, np.cumsum(pieces)]
    place_of = spark.createDataFrame([(int(c), int(p), int(f)) for c, p, f in zip(cells["cell"], pieces, first[:-1], strict=True)], "cell long, pieces long, first long")
    rows = placed.join(F.broadcast(place_of), "cell").withColumn("key", F.col("first") + F.pmod(F.xxhash64("uid", F.lit(3)), "pieces"))
    anchors = placed.where("anchor")
    centre = sent.value.centres[cells["cell"].to_numpy(np.int64)]
    low, high = intervals(centre, cells["reach"].fillna(0).to_numpy(float), centre, cells["radius"].to_numpy(float))
    own = np.eye(len(cells), dtype=bool)

    def sent_to(some: DataFrame, allowed: np.ndarray) -> DataFrame:
        """The anchors, once for each piece of the cells that allowed (cells of anchors by cells of rows) tells."""
        keys = [(int(c), [int(k) for j in np.flatnonzero(allowed[i]) for k in range(first[j], first[j + 1])]) for i, c in enumerate(cells["cell"])]
        route = spark.createDataFrame(keys, "cell long, keys array<long>")
        return some.join(F.broadcast(route), "cell").withColumn("key", F.explode("keys"))

    def by_cell(some: DataFrame, value: Column, none: float) -> np.ndarray:
        found = {r["cell"]: r["x"] for r in some.groupBy("cell").agg(value.cast("double").alias("x")).collect()}
        return np.array([found.get(c, none) for c in cells["cell"]], float)

    floor, ceiling = -float(1 << 62), F.array(F.lit(0).cast("long"))
    start = anchors.withColumn("low", F.array(F.lit(int(floor)).cast("long"))).withColumn("high", ceiling)
    seeds = store(search(rows, sent_to(start, own), _positive_work(positives)), "hard-seeds")
    # a full set of seeds bounds what other cells must reach
    reached = _best(seeds, positives).groupBy("anchor").agg(F.count("*").alias("k"), F.min("score").alias("least"))
    bounded = anchors.join(reached, anchors["uid"] == reached["anchor"], "left").drop(reached["anchor"]).withColumn("least", F.when(F.col("k") >= positives, F.col("least")).otherwise(F.lit(int(floor)).cast("long")))
    bounded = bounded.withColumn("low", F.array("least")).withColumn("high", ceiling)
    allowed = (high >= by_cell(bounded, F.min("least"), np.inf)[:, None]) & ~own
    found = seeds.unionByName(search(rows, sent_to(bounded, allowed), _positive_work(positives))) if allowed.any() else seeds
    chosen = store(_best(found, positives), "hard-positives")
    band = chosen.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("found"))
    ps = lambda x: x["score"]
    band = band.select(F.col("anchor").alias("of"), F.transform("found", lambda x: ((ps(x) + F.pmod(ps(x), F.lit(2))) / 2).cast("long")).alias("low"), F.transform("found", lambda x: ((ps(x) * 95 - F.pmod(ps(x) * 95, F.lit(100))) / 100).cast("long")).alias("high"))
    ready = anchors.join(band, anchors["uid"] == band["of"])
    allowed = (high >= by_cell(ready, F.min(F.array_min("low")), np.inf)[:, None]) & (low <= by_cell(ready, F.max(F.array_max("high")), -np.inf)[:, None])
    hits = _best(search(rows, sent_to(ready, allowed), _negative_work(negatives)), negatives)
    named = chosen.select(F.col("anchor").alias("of"), (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = named.join(anchors.select(F.col("uid").alias("of"), F.col("vec_id").alias("anchor_id")), "of")
    joined = hits.join(named, (hits["anchor"] == named["of"]) & (hits["band"] == named["place"]))
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), hits["vec_id"].alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(embeddings: DataFrame) -> DataFrame:
    """hard_negatives of the table embeddings by the task's rules for labels, components and anchors."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
    usual = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size(v) == (usual["d"] if usual else 0))
    label = F.when(F.col("vec_id") % CHANGED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("long")
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))
    return hard_negatives(whole, F.col("vec_id") % ANCHORS == 0)


#: DuckDB SQL of mined, all products.
SQL = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % {CHANGED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS id, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM e a JOIN e c ON a.vec_id % {ANCHORS} = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, ps AS positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * ps <= 100 * score AND 100 * score <= 95 * ps QUALIFY rank <= 3"""
