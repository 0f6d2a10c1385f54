"""Questions and answers of a session paired across micro-batches, as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "session_id string, turn long, user_message string, assistant_message string, created_at timestamp"


def answers(messages: dict[int, tuple]) -> dict[int, tuple]:
    """By student turn: (message, the assistant's message if it is the next one known, else None, time)."""
    turns = sorted(messages)
    after = dict(zip(turns, turns[1:], strict=False))
    said = lambda t: messages[t][1] if messages[t][0] == "assistant" else None
    return {t: (messages[t][1], said(after[t]) if t in after else None, messages[t][2]) for t in turns if messages[t][0] == "student"}


COLUMNS = ["session_id", "turn", "user_message", "assistant_message", "created_at"]
#: A session's messages by turn; times as microseconds.
STATE = "turns array<long>, roles array<string>, texts array<string>, times array<long>"


def paired(wait_ms: int):
    """A function for applyInPandasWithState that holds a session's messages until event time has passed the last of them by wait_ms.

    After each batch it gives the student messages that are new or whose answer has changed, so a question comes out at
    once, without an answer, and again when its answer is there, whichever comes first. Repeated messages change nothing;
    of two with one turn the one that is less (by role, then text) counts, in whatever order they come. A session's state
    travels with its rows, as one value, so a batch asks for nothing message by message.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = {t: (r, x, at) for t, r, x, at in zip(*state.get)} if state.exists else {}
        before, changed = answers(known), False
        for part in parts:
            for turn, role, text, at in zip(part["turn"].tolist(), part["role"].tolist(), part["text"].tolist(), part["created_at"].astype("datetime64[us]").astype("int64").tolist(), strict=True):
                if turn not in known or (role, text or "") < (known[turn][0], known[turn][1] or ""):
                    known[turn] = (role, text, at)
                    changed = True
        if changed:
            turns = sorted(known)
            state.update((turns, *([known[t][k] for t in turns] for k in range(3))))
        state.setTimeoutTimestamp(max(max(v[2] for v in known.values()) // 1000 + wait_ms, state.getCurrentWatermarkMs() + 1))
        now = [(key[0], t, *a) for t, a in answers(known).items() if before.get(t) != a] if changed else []
        if now:
            made = pd.DataFrame(now, columns=COLUMNS)
            yield made.assign(created_at=pd.to_datetime(made["created_at"], unit="us"))

    return step


def exchanges(messages: DataFrame, wait: str = "1 day") -> DataFrame:
    """A stream (session_id, turn, role, text, created_at) to exchanges (session_id, turn, user_message, assistant_message, created_at), in update mode:
    a turn may come again with its answer, and the last one counts. Rows later than `wait` are left out."""
    ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    keyed = messages.select("session_id", F.col("turn").cast("long").alias("turn"), "role", "text", "created_at").withWatermark("created_at", wait).groupBy("session_id")
    return keyed.applyInPandasWithState(paired(ms), OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
