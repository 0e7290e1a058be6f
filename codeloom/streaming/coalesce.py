"""Structured Streaming form of the change feed: events are normalised, coalesced by path and flushed after quiet time.

State per path is one row: the latest intent, when it was first and last seen. A processing-time timer flushes a path
once it has been quiet for the debounce time or pending for the longest latency; the sink gets one row a burst.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import names as N

DEBOUNCE_MS, LATENCY_MS = 250, 2000
TEMPORARY = (".tmp", ".swp", "~", ".part")
OUT = "path string, intent string, first_seen timestamp, last_seen timestamp"
STATE = "intent string, first_ms long, last_ms long"


def normalised(events: DataFrame, ignored: list[str] | None = None, suffixes: tuple[str, ...] = TEMPORARY) -> DataFrame:
    """path, intent, ts, seq of raw events (kind, path, old_path, ts, seq): overflow, temporary and ignored paths are dropped.

    A delete removes its path, all else reindexes it, and a rename removes its old path as well.
    """
    rows = events.where((F.col("kind") != "overflow") & F.col("path").isNotNull())
    new = rows.select("path", F.when(F.col("kind") == "delete", "remove").otherwise("reindex").alias("intent"), "ts", "seq")
    old = rows.where((F.col("kind") == "rename") & F.col("old_path").isNotNull()).select(F.col("old_path").alias("path"), F.lit("remove").alias("intent"), "ts", "seq")
    out = new.unionByName(old)
    for s in suffixes:
        out = out.where(~F.col("path").endswith(s))
    for regex in ignored or []:
        out = out.where(~F.col("path").rlike(regex))
    return out


def coalesced(events: DataFrame, debounce_ms: int = DEBOUNCE_MS, latency_ms: int = LATENCY_MS) -> DataFrame:
    """One row a path and burst, when it is quiet or has waited long enough. Works on a stream of `normalised` rows."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        rows = pd.concat(list(batches)) if not state.hasTimedOut else pd.DataFrame()
        now = state.getCurrentProcessingTimeMs()
        if len(rows):
            last = rows.sort_values(["seq"], kind="stable").iloc[-1]
            held = (last["intent"], held[1] if held else now, now)
            state.update(held)
        if held is None:
            return
        due = min(held[2] + debounce_ms, held[1] + latency_ms)
        if state.hasTimedOut or due <= now:
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "intent": [held[0]], "first_seen": [pd.Timestamp(held[1], unit="ms")], "last_seen": [pd.Timestamp(held[2], unit="ms")]})
        else:
            state.setTimeoutDuration(max(1, due - now))

    return events.groupBy("path").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def split_batch(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reindex, remove) paths of a batch; a path that is in both is reindexed."""
    reindex = batch.where("intent = 'reindex'").select("path").distinct()
    return reindex, batch.where("intent = 'remove'").select("path").distinct().join(reindex, "path", "left_anti")


def is_source(path: str) -> F.Column:
    return ~N.is_generated_path(path)
