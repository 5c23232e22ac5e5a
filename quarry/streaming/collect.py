"""Incremental collection: new session files are folded in micro-batches into a stored cache, each batch exactly once.

A batch writes its sessions under its own number, in place of what an earlier try of the same batch left; readers take the
latest row of a file, and sum failures up. So a batch that was killed at any time and runs again changes nothing. A trigger
takes up many batches, which are folded in one job: a backlog costs by its files, not by its batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import lists
from quarry.sources.fold import fold
from quarry.sources.lines import listing, numbered_lines

FILES = "path string, modificationTime timestamp, length long, content binary"
_KNOWN = "file string, mtime_ms long, size long, batch long"
#: Most files of a trigger; its batches are numbered from its own number times this on.
AT_ONCE = 50_000


def batch(files: DataFrame, number: int, cache: str, most: int = 1000) -> None:
    """Fold files (path, modificationTime, length) of the trigger of this number, as batches of most files each."""
    spark = files.sparkSession
    listed = files.select(F.col("path").alias("file"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size")).collect()  # bounded by maxFilesPerTrigger
    if not listed:
        return
    there = spark.createDataFrame([(*r, number * AT_ONCE + i // most) for i, r in enumerate(sorted(listed))], _KNOWN)
    same = F.regexp_replace("file", "^file:/*", "/")
    s = fold(numbered_lines(spark, [r.file for r in listed], "*")).withColumn("path", same).withColumnRenamed("file", "read_as")
    # a file without a session is known, too; the files of a try are those of the next, so each of its batches is replaced
    out = there.withColumn("path", same).join(s, "path", "left").drop("path", "read_as").repartition(F.col("batch"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{cache}/sessions")


def run(spark: SparkSession, root: str, cache: str, offsets: str, pattern: str = "*.jsonl", most: int = 1000) -> None:
    """Collect what is new below root, most files a batch; goes on where the last run of these offsets was stopped."""
    together = most * max(1, AT_ONCE // most)
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", together).load(root)
    named = files.select("path", "modificationTime", "length")
    with listing(spark):
        named.writeStream.foreachBatch(lambda df, i: batch(df, i, cache, most)).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()


def _rows(spark: SparkSession, cache: str) -> DataFrame:
    with listing(spark):
        return spark.read.parquet(f"{cache}/sessions")


def sessions(spark: SparkSession, cache: str) -> DataFrame:
    """The latest row of each file that has a session."""
    rows = _rows(spark, cache)
    fields = [c for c in rows.columns if c != "file"]
    latest = rows.groupBy("file").agg(F.max_by(F.struct(*fields), F.struct("mtime_ms", "batch")).alias("s"))
    return latest.select("file", "s.*").where("lines is not null").drop("batch")


def failures(spark: SparkSession, cache: str) -> DataFrame:
    """file, attempts, permanent: the ledger over all batches, without files that were read since. A file of broken lines alone has failed."""
    rows = _rows(spark, cache).where("lines is not null")
    return lists.ledger(rows.where("malformed = lines").select("file", F.lit(False).alias("permanent")), rows.where("malformed < lines").select("file"))
