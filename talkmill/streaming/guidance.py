"""The latest guidance of each session, as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "session_id string, updated_at timestamp, rank int, event_id long, status string, payload string"


def status_rank(status: Column) -> Column:
    """A run is pending before it is ready or failed; anything else comes before that."""
    return F.when(status.isin("ready", "failed"), 2).when(status == "pending", 1).otherwise(0)


class LatestGuidance(StatefulProcessor):
    """Keeps a session's last state by (time, status rank, event id), and forgets it after ttl_ms without a newer one. What is
    late, repeated, or a pending beside a result of the same time changes nothing and gives no row."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "updated_at timestamp, rank int, event_id long, status string, payload string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        best = old = tuple(self.state.get()) if self.state.exists() else None
        for part in rows:
            for row in zip(part["updated_at"], part["rank"], part["event_id"], part["status"], part["payload"], strict=True):
                new = (row[0].to_pydatetime(), int(row[1]), int(row[2]), row[3], row[4])
                if best is None or new[:3] > best[:3]:
                    best = new
        if best != old:
            self.state.update(best)
            yield pd.DataFrame([(key[0], *best)], columns=["session_id", "updated_at", "rank", "event_id", "status", "payload"])
        else:
            yield pd.DataFrame([], columns=["session_id", "updated_at", "rank", "event_id", "status", "payload"])

    def close(self) -> None:
        pass


def latest_guidance(rows: DataFrame, ttl_days: int = 7) -> DataFrame:
    """A stream (session_id, updated_at, event_id, status, payload) to each session's latest state whenever it changes, in update mode; needs the RocksDB state store."""
    keyed = rows.select("session_id", "updated_at", status_rank(F.col("status")).alias("rank"), "event_id", "status", "payload").groupBy("session_id")
    return keyed.transformWithStateInPandas(LatestGuidance(ttl_days * 86_400_000), outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime")
