"""The annotation log as keyed state: a streaming query and its twin in batch.

The state of a (run, class) is its number of events, the last value and the step
of that value: an upsert by the order of the events, not of their arrival, so
late events change nothing that they shouldn't; repeats are told by their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE_MS = 24 * 3600 * 1000  # how long a key is kept without events
STATE = "run bigint, cls string, n bigint, last_ink double, last_step int"


def state_of(events: DataFrame) -> DataFrame:
    """The state after all of ``run, cls, step, ink``, in one aggregate."""
    return events.groupBy("run", "cls").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("ink", "step").alias("last_ink"), F.max("step").cast("int").alias("last_step")
    )


def _upserter(time: str | None):
    def upsert(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, ink, step, seen = state.get if state.exists else (0, None, -1, 0)
        for b in batches:
            n += len(b)
            top = b.loc[b["step"].idxmax()]
            if top["step"] > step:
                ink, step = float(top["ink"]), int(top["step"])
            if time:
                seen = max(seen, int(b["ms"].max()))
        state.update((n, ink, step, seen))
        if time:
            state.setTimeoutTimestamp(max(seen + IDLE_MS, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"run": [key[0]], "cls": [key[1]], "n": [n], "last_ink": [ink], "last_step": [step]})

    return upsert


def stream_state(events: DataFrame, event_id: str | None = None, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The changing states of a stream of ``run, cls, step, ink``; write it in update mode, keyed by (run, cls).

    With ``time``, events may come as ``late`` as that, and a key whose last
    event is ``IDLE_MS`` before the watermark is forgotten, so that the state
    doesn't grow for ever. With ``event_id`` too, an event delivered again
    within ``late`` counts once. Without ``time`` keys are kept.
    """
    rows = events if time is None else events.withWatermark(time, late)
    if event_id is not None:
        if time is None:
            raise ValueError("repeats are told within a watermark: name the time")
        rows = rows.dropDuplicatesWithinWatermark([event_id])
    names = ["run", "cls", "step", "ink"] + ([] if time is None else [time])
    rows = rows.select(*names) if time is None else rows.select(*names).withColumn("ms", F.unix_millis(time))
    timeout = GroupStateTimeout.NoTimeout if time is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("run", "cls").applyInPandasWithState(_upserter(time), STATE, "n bigint, ink double, step int, seen bigint", "update", timeout)


def windowed(events: DataFrame, width: str = "10 minutes", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Events and ink by class and window of time, with a watermark; for streams and tables alike. An extension: the engine's own logs have no windows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("ink").alias("ink")).select(
        F.col("w.start").alias("start"), "cls", "n", "ink"
    )
