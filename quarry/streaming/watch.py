"""Runs that fall silent, watched on a stream: keyed state with timers in event time, dropped once a run is long over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.streaming.events import SILENT_MS, TERMINAL

ABORTS = "run_id string, type string, at_ms long"
#: How long a run's end is remembered, so that late events don't open it again.
KEPT_MS = 30 * 86_400_000


def aborts(events: DataFrame, after_ms: int = SILENT_MS, late: str = "0 seconds", kept_ms: int = KEPT_MS) -> DataFrame:
    """run_id, type (run_aborted), at_ms for each run of the stream that has no event, heartbeats included, for after_ms.

    A run's state is the time of its last event and whether it is over; its timer stands at the time when it would count
    as silent, or, once it is over, when its end may be forgotten. A silence that lies between two events of one batch
    counts as well. Each run is aborted once; one that has ended by itself never."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        silent_at = None
        if state.hasTimedOut:
            last, over = state.get
            if over:
                state.remove()
                return
            silent_at = last + after_ms
        else:
            last, over = state.get if state.exists else (None, False)
            # times and ends alone of a run's events in this batch
            seen = sorted((at, i, kind in TERMINAL) for rows in batches for at, i, kind in zip(rows["at_ms"].tolist(), rows["id"].tolist(), rows["type"].tolist(), strict=True))
            for at, _, ends in seen:
                if not over and last is not None and at - last > after_ms:
                    silent_at, over = last + after_ms, True
                last = at if last is None else max(last, at)
                over = over or ends
        over = over or silent_at is not None
        state.update((last, over))
        state.setTimeoutTimestamp(max(last + (kept_ms if over else after_ms), state.getCurrentWatermarkMs() + 1))
        if silent_at is not None:
            yield pd.DataFrame({"run_id": [key[0]], "type": ["run_aborted"], "at_ms": [silent_at]})

    flat = events.select("id", "run_id", "type", "at_ms", F.timestamp_millis("at_ms").alias("at")).withWatermark("at", late)
    return flat.groupBy("run_id").applyInPandasWithState(step, ABORTS, "last long, over boolean", "append", GroupStateTimeout.EventTimeTimeout)


def run(events: DataFrame, out: str, offsets: str, after_ms: int = SILENT_MS) -> None:
    """Append the aborts of all that is there to Parquet in out; a run that is stopped goes on from its offsets."""
    aborts(events, after_ms).writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
