"""Helpers shared by the corpus operators: shared storage, Arrow text buffers, vectorised word hashing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import clear, shared_dir, store  # noqa: F401

#: Bytes of text that the vectorised code looks at in one go; a longer single text goes alone.
BLOCK = 1 << 20
#: Most rows that are sent to every task; joins with more rows are shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows from which a key's rows are not shuffled to one task.
HOT = 10_000

#: Bytes of rows that are sent to a Python worker at once, where the session has Spark's default.
BATCH = "8m"
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(spark: SparkSession) -> None:
    """Let Spark drop broadcast tables and shuffles of queries that are done: it does so when the driver collects garbage, which
    a large driver seldom does, while the executors' memory fills with them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a row number, stored: a number that is computed anew may differ once executors are lost or join."""
    tidy(df.sparkSession)
    return store(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def small_batches(spark: SparkSession) -> None:
    """Before an operator sends whole texts to Python workers: bound the bytes of a batch, as texts by the thousand take a lot
    of memory on both sides, and tidy up."""
    if spark.conf.get(_BATCH_CONF, None) in (None, "67108864b"):
        spark.conf.set(_BATCH_CONF, BATCH)
    tidy(spark)


def semi_join(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (distinct, stored). ids is broadcast only up to BROADCAST_ROWS rows."""
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if small else ids, key, "left_semi")


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """big joined to small, stored and with one row for each key; rows: small's column with the key's number of rows in big.

    Keys of HOT rows or more are few (a HOT-th of the rows at most) and sent to the tasks, so no key's rows meet in one task;
    should they be more than BROADCAST_ROWS, they are joined by a shuffle like the others."""
    hot = store(small.where(F.col(rows) >= HOT), "hot")
    n = hot.limit(BROADCAST_ROWS + 1).count()
    if not 0 < n <= BROADCAST_ROWS:
        return big.join(small.drop(rows), keys)
    some = F.broadcast(hot.drop(rows))
    return big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(small.where(F.col(rows) < HOT).drop(rows), keys).unionByName(big.join(some, keys))


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id's text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def groups(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of about limit bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def release() -> None:
    """Give freed memory back to the machine: a worker lives on for other stages."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Every batch in parts of about BLOCK bytes of text, each with its text_buffer: what a task holds besides a batch stays bounded."""
    for batch in batches:
        data, off = text_buffer(batch.column(column))
        for a, b in groups(off):
            yield batch.slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a]
        del batch, data, off
        release()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

# Words: maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower case.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(9)
_KEYS = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}
_PLACE = _rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK + 1024), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, index of each text's first word and the end): words[of[i]:of[i+1]] are text i's."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    after = np.empty(n, bool)  # the byte before is white space, or another text's
    after[1:] = space[:-1]
    after[offsets[:-1][offsets[:-1] < n]] = True
    before = np.empty(n, bool)
    before[:-1] = space[1:]
    before[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(after & ~space)
    ends = np.flatnonzero(before & ~space) + 1
    out = np.empty(len(starts), np.uint64)
    a = 0  # words done
    while a < len(starts):
        lo = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        hi = ends[b - 1]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_KEYS[_LOWER[data[lo:hi]]] * _powers(_BASE, hi - lo), out=sums[1:])
        s = starts[a:b] - lo
        h = (sums[ends[a:b] - lo] - sums[s]) * _powers(pow(_BASE, -1, 1 << 64), hi - lo + 1)[s]
        out[a:b] = mix(h + (ends[a:b] - starts[a:b]).astype(np.uint64) * _PLACE[7])
        a = b
    return out, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For every text the sorted distinct 64-bit hashes of its shingles of size words; all words as one, if fewer."""
    words, first = word_hashes(data, offsets)
    m = max(0, len(words) - size + 1)
    at = np.zeros(m, np.uint64)
    for j in range(size):
        at += words[j : j + m] * _PLACE[j]
    at = mix(at)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(at[a : b - size + 1]))
        elif b > a:
            short = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
