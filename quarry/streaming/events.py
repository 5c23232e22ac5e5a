"""The event log of runs as a stream: reading, repeated ids, poison payloads, streams that end, runs that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "id long, run_id string, type string, at_ms long, payload string"
#: Types of events that end a run's stream (fixed values).
TERMINAL = ("run_finished", "run_failed", "run_aborted")
SILENT_MS = 600_000


def read_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Events of a folder to which files of JSON lines are added; a file is read once."""
    return parsed(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).json(path))


def parsed(events: DataFrame) -> DataFrame:
    """events with data (variant): null where the payload is no JSON, so one poison event stops nothing."""
    return events.withColumn("data", F.try_parse_json("payload"))


def page(events: DataFrame, since: int, most: int = 200) -> DataFrame:
    """The next events after an id, in order; from 0 all are played again."""
    return events.where(F.col("id") > since).orderBy("id").limit(max(1, most))


def once(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Each id once. On a stream with ids that repeat within a delay, state is kept no longer than that."""
    if delay:
        stamped = events.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", delay)
        return stamped.dropDuplicatesWithinWatermark(["id"]).drop("at")
    return events.dropDuplicates(["id"])


def until_end(events: DataFrame) -> DataFrame:
    """Events of each run up to its first terminal one (batch)."""
    w = Window.partitionBy("run_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("type").isin(*TERMINAL)).over(w), F.lit(False))
    return events.withColumn("ended", ended).where("not ended").drop("ended")


def stream_until_end(events: DataFrame) -> DataFrame:
    """The same on a stream: a run's state is its last id and whether it has ended; what comes later or again is left out."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ended = state.get if state.exists else (-1, False)
        rows = pd.concat(list(batches)).drop_duplicates("id").sort_values("id")
        rows = rows[rows["id"] > last]
        if ended:
            rows = rows[:0]
        over = rows["type"].isin(TERMINAL)
        if over.any():
            rows, ended = rows[: int(over.values.argmax()) + 1], True
        if len(rows):
            last = int(rows["id"].max())
        state.update((last, bool(ended)))
        yield rows

    flat = events.select("id", "run_id", "type", "at_ms", "payload")
    return flat.groupBy("run_id").applyInPandasWithState(step, SCHEMA, "last long, ended boolean", "append", GroupStateTimeout.NoTimeout)


def heartbeats(runs: DataFrame, now_ms: int, every_ms: int = 60_000) -> DataFrame:
    """run_id, type, at_ms: the heartbeats of runs (run_id, started_ms, ended_ms, null: still running) up to now, one each every_ms.

    They prove that a run lives while nothing else happens; a run that is over has none."""
    until = F.least(F.coalesce("ended_ms", F.lit(now_ms)), F.lit(now_ms))
    first = F.col("started_ms") + every_ms
    return runs.where(first <= until).select("run_id", F.lit("heartbeat").alias("type"), F.explode(F.sequence(first, until, F.lit(every_ms).cast("long"))).alias("at_ms"))


def silent(runs: DataFrame, events: DataFrame, now_ms: int, after_ms: int = SILENT_MS) -> DataFrame:
    """runs (run_id, status, started_ms) that are running and had no event, heartbeats included, for a time: they count as aborted."""
    last = events.groupBy("run_id").agg(F.max("at_ms").alias("last_ms"))
    j = runs.join(last, "run_id", "left").withColumn("last_ms", F.coalesce("last_ms", "started_ms"))
    gone = (F.col("status") == "running") & (F.lit(now_ms) - F.col("last_ms") > after_ms)
    return j.withColumn("status", F.when(gone, "aborted").otherwise(F.col("status")))


def close_cases(cases: DataFrame, runs: DataFrame, terminal: tuple[str, ...] = ("passed", "failed", "error", "skipped")) -> DataFrame:
    """cases whose run is aborted and that are not done become errors."""
    aborted = runs.where("status = 'aborted'").select("run_id", F.lit(True).alias("aborted"))
    open_ = F.coalesce(F.col("aborted"), F.lit(False)) & ~F.col("status").isin(*terminal)
    return cases.join(aborted, "run_id", "left").withColumn("status", F.when(open_, "error").otherwise(F.col("status"))).drop("aborted")
