"""Lines of text files with their numbers, however large a file is, and however many files there are."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources.shared import store

#: Files up to so many bytes are read as one row each, larger ones in blocks.
SMALL = 4 << 20
#: Names of files that Spark's reader of text unpacks.
PACKED = r"(?i)\.(gz|bz2|zst|deflate|snappy|lz4)$"


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """While it holds, folders are listed by as many tasks as the cluster runs a few times over, instead of one for each folder."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def numbered_lines(spark: SparkSession, paths: str | list[str], pattern: str = "*.jsonl") -> DataFrame:
    """file, line_no (from 0, in the order of the file), raw. A last line without its end is kept, carriage returns too.

    Files up to SMALL bytes are rows that are split into lines where they are read. Larger ones are read in blocks."""
    with listing(spark):
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(paths)
    small = (F.col("_metadata.file_size") <= SMALL) & ~F.col("_metadata.file_name").rlike(PACKED)
    # such filters are applied to the list of files: no file is opened for them
    rest = [r.path for r in files.where(~small).select("path").collect()]
    text = F.col("content").cast("string")
    text = F.when(text.startswith("﻿"), F.substring(text, 2, SMALL)).otherwise(text)
    pieces = F.split(text, "\n")
    n = F.size(pieces) - F.when(F.endswith(text, F.lit("\n")) | (text == ""), 1).otherwise(0)
    out = files.where(small).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.slice(pieces, F.lit(1), n)).alias("line_no", "raw"))
    out = out.withColumn("line_no", F.col("line_no").cast("long"))
    return out.unionByName(lines_in_blocks(spark, rest)) if rest else out


def lines_in_blocks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """numbered_lines of files that are read in blocks by many tasks.

    Each line is stored with its number within what its task read; a block's first line then has as many lines ahead as the
    file's blocks before it hold (a sum over blocks, not lines)."""
    with listing(spark):
        text = spark.read.option("lineSep", "\n").text(paths)
    raw = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("raw"))
    # a number that is computed anew may differ once tasks are dealt out otherwise, so it is stored
    kept = store(raw.withColumn("at", F.monotonically_increasing_id()), "lines")
    blocks = kept.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return kept.join(blocks, ["file", "block"]).select("file", (F.col("ahead") + F.col("at") - F.col("first")).alias("line_no"), "raw")
