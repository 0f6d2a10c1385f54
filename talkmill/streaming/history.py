"""Rolling histories per session, as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "session_id string, n long, history array<struct<role:string,text:string>>"


class RollingHistory(StatefulProcessor):
    """Appends a session's messages in order of `turn`, keeps the last `most`, and forgets after `ttl_ms` without new ones. Emits the history after each batch."""

    def __init__(self, most: int, ttl_ms: int):
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", "role string, text string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = pd.concat(list(rows)).sort_values("turn", kind="stable")
        kept = ([*self.messages.get(), *zip(new["role"], new["text"], strict=True)])[-self.most :]
        self.messages.put(kept)
        yield pd.DataFrame({"session_id": [key[0]], "n": [len(kept)], "history": [[{"role": r, "text": t} for r, t in kept]]})

    def close(self) -> None:
        pass


def rolling_history(messages: DataFrame, most: int = 12, ttl_days: int = 7) -> DataFrame:
    """A stream (session_id, turn, role, text) to histories; needs the RocksDB state store."""
    return messages.groupBy("session_id").transformWithStateInPandas(
        RollingHistory(most, ttl_days * 86_400_000), outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime"
    )
