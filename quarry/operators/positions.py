"""Positions of rows in a global order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.shared import store

#: Low bits of monotonically_increasing_id are the row's number within its partition.
LOW = 33


def positions(df: DataFrame, by: list[str], order: list[str | Column], name: str = "pos") -> DataFrame:
    """df with each row's position (from 0) among the rows of its group, nulls alike; by []: among all rows.

    Rows are sorted into ranges, stored as sorted with their number in their range, and numbered by the ranges' sizes: no
    task gets more than a range. Rows that tie get any order among them; a last sort key, a hash of the whole row's
    storage number, spreads rows that repeat over the ranges."""
    plain = [F.col(c) for c in by] + [F.col(o) if isinstance(o, str) else o for o in order]
    uid, part, at = "__uid", "__part", "__at"
    own = store(df.withColumn(uid, F.monotonically_increasing_id()), "unsorted")
    keys = [*plain, F.col(uid)]
    sorted_ = store(own.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()).drop(uid), "sorted")
    sorted_ = sorted_.withColumn(part, F.shiftright(at, LOW)).withColumn(at, F.col(at).bitwiseAND((1 << LOW) - 1))
    # a row for each range, so as many as there are partitions
    sizes = {r[part]: r["count"] for r in sorted_.groupBy(part).count().collect()}
    ahead, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, ahead))
        ahead += sizes[p]
    offsets = df.sparkSession.createDataFrame(rows, f"{part} long, __ahead long")
    numbered = sorted_.join(F.broadcast(offsets), part).withColumn(name, F.col(at) + F.col("__ahead")).drop(part, at, "__ahead")
    if not by:
        return numbered
    starts = numbered.groupBy(*by).agg(F.min(name).alias("__start"))
    renamed = starts.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], "__start")
    match = F.lit(True)
    for i, c in enumerate(by):
        match = match & numbered[c].eqNullSafe(renamed[f"__by{i}"])
    return numbered.join(renamed, match).withColumn(name, F.col(name) - F.col("__start")).drop("__start", *[f"__by{i}" for i in range(len(by))])
