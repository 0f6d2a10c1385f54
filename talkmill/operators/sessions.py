"""Histories, as-of joins and tables of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled
from .queues import BROADCAST_RUNS, numbered

MESSAGES = "array<struct<role:string,text:string>>"
#: Rows of a session that one part holds, when sessions are spread over tasks.
PART = 4096


def read_history(raw: Column, roles: tuple[str, ...]) -> Column:
    """Messages of known roles with text; JSON that doesn't parse is an empty history."""
    return F.filter(F.coalesce(F.from_json(raw, MESSAGES), F.array().cast(MESSAGES)), lambda m: F.coalesce(m["role"].isin(*roles) & (m["text"] != ""), F.lit(False)))


def prior_messages(messages: DataFrame, session: str, order: str, last: int | None = None) -> DataFrame:
    """messages plus history: all (or the last few) messages of the session before this one, in order."""
    rows = Window.partitionBy(session).orderBy(order).rowsBetween(-last if last else Window.unboundedPreceding, -1)
    return messages.withColumn("history", F.collect_list(F.struct("role", "text")).over(rows))


def shared_histories(messages: DataFrame, session: str, order: str, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(parts, turns): every message's full history without a copy of it. parts (session, part, said) holds a session's messages,
    `part` at a time, in order; turns is messages without role and text, plus before: how many messages its history has.
    Both are linear in the messages, whatever a session's length; histories_of() puts a history together where it is written."""
    placed = settled(numbered(messages, order, within=(session,)))
    at = F.floor((F.col("number") - 1) / part)
    said = F.transform(F.array_sort(F.collect_list(F.struct("number", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    parts = placed.groupBy(session, at.alias("part")).agg(said.alias("said"))
    return parts, placed.select(*(c for c in messages.columns if c not in ("role", "text")), (F.col("number") - 1).alias("before"))


def histories_of(turns: DataFrame, parts: DataFrame, session: str, part: int = PART) -> DataFrame:
    """turns of shared_histories() plus history, the array that prior_messages() gives; turns may be any of them."""
    rows = turns.withColumn("__id", F.monotonically_increasing_id())
    rows = settled(rows)
    needed = rows.select("__id", F.col(session), "before", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("before") - 1) / part))).alias("part")).where("before > 0")
    met = needed.join(parts, [session, "part"])
    told = met.groupBy("__id").agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "said"))), lambda p: p["said"])), F.lit(1), F.first("before").cast("int")).alias("history"))
    return rows.join(told, "__id", "left").select(*turns.columns, F.coalesce("history", F.array().cast(MESSAGES)).alias("history"))


def paired_turns(messages: DataFrame, session: str, order: str) -> DataFrame:
    """One row per student message with the assistant's answer right after it (null: none)."""
    w = Window.partitionBy(session).orderBy(order)
    after = messages.withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)})
    return after.where("role = 'student'").select(session, order, F.col("text").alias("user_message"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("assistant_message"))


def recent_messages(messages: DataFrame, session: str, order: str, last: int, part: int = PART) -> DataFrame:
    """messages plus history, as prior_messages() with `last`, for sessions of any length: a session is numbered without one task
    for it, cut into parts, and each part is handed copies of the `last` messages before it. No task gets a whole session."""
    if not 0 < last <= part:
        raise ValueError("last must be between 1 and part")
    placed = numbered(messages, order, within=(session,))
    mine = F.floor((F.col("number") - 1) / part)
    # The last rows of a part come again, as context of the next one.
    ahead = (F.col("number") - 1) % part >= part - last
    both = placed.withColumn("__part", F.explode(F.when(ahead, F.array(mine, mine + 1)).otherwise(F.array(mine))))
    w = Window.partitionBy(session, "__part").orderBy("number").rowsBetween(-last, -1)
    told = both.withColumn("history", F.collect_list(F.struct("role", "text")).over(w)).where(F.col("__part") == mine)
    return told.select(*messages.columns, "history")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left plus the value of the latest right row of its key at or before its time (null values are passed over).

    Both sides are dealt by range of key and time and kept with their part, so a key with most rows is spread over many tasks.
    Within a part the last value is carried from row to row; a part begins with the last value that the key's parts before it have.
    """
    both = left.withColumns({"__value": F.lit(None).cast(right.schema[value].dataType), "__side": F.lit(1)}).unionByName(
        right.select(key, at, F.col(value).alias("__value"), F.lit(0).alias("__side")), allowMissingColumns=True
    )
    dealt = settled(both.withColumn("__order", F.struct(key, at, "__side")).repartitionByRange("__order").sortWithinPartitions("__order").drop("__order").withColumn("__at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("__part", F.shiftright("__at", 33))
    told = F.when(F.col("__value").isNotNull(), F.col("__at"))
    runs = dealt.groupBy(key, "__part").agg(F.max_by("__value", told).alias("__last"))
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as keys and parts together; those of one key are no more than parts.
    carried = settled(runs.withColumn("__carried", F.last("__last", ignorenulls=True).over(earlier)).where("__carried is not null").select(F.col(key).alias("__key"), F.col("__part").alias("__of"), "__carried"))
    few = F.broadcast(carried) if carried.count() <= BROADCAST_RUNS else carried
    w = Window.partitionBy("__part", key).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.withColumn("__seen", F.last("__value", ignorenulls=True).over(w)).where("__side = 1")
    met = inside.join(few, (inside["__part"] == few["__of"]) & inside[key].eqNullSafe(few["__key"]), "left")
    return met.select(*left.columns, F.coalesce("__seen", "__carried").alias(value))


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last row of each key, by time and then tie."""
    return rows.groupBy(key).agg(F.max(F.struct(at, tie, *(c for c in rows.columns if c not in (key, at, tie)))).alias("x")).select(key, "x.*")


def fan_out(turns: DataFrame, candidates: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """One exchange as five tables: sessions, messages, turns, scored candidates, preferences. Each is one narrow plan, written on its own."""
    spoken = F.array(F.struct(F.lit("student").alias("role"), F.col("user_message").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("assistant_message").alias("text")))
    return {
        "sessions": turns.groupBy("session_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at")),
        "messages": turns.select("session_id", "turn_id", F.posexplode(spoken).alias("position", "m")).select("session_id", "turn_id", "position", "m.role", "m.text").where("text is not null"),
        "turns": turns,
        "candidates": candidates.join(turns.select("turn_id"), "turn_id"),
        "preferences": pairs.join(turns.select("turn_id"), "turn_id"),
    }


def critic_run(runs: DataFrame, key: str, scores: str) -> tuple[DataFrame, DataFrame]:
    """(parents, children) of runs with a nested array of scores."""
    return runs.drop(scores), runs.select(key, F.posexplode(scores).alias("position", "s")).select(key, "position", "s.*")


def erase(rows: DataFrame, user: Column | None, session: Column | None) -> tuple[DataFrame, DataFrame]:
    """(rows left, counts): rows of the user and/or session removed. One of the two must be given."""
    if user is None and session is None:
        raise ValueError("user or session is needed")
    gone = F.coalesce(F.lit(True) if user is None else user, F.lit(False)) & F.coalesce(F.lit(True) if session is None else session, F.lit(False))
    return rows.where(~gone), rows.agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("remaining"))
