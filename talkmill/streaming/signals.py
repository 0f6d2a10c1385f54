"""Streams of messages, scores and signals. Each function takes streams and batches alike unless it says so."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rules


def risk_rates(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(hour, n, risky, rate, sessions) of (ts, user_id, risky) by tumbling windows; late rows are waited for as long as `late`."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width))
        .agg(F.count("*").alias("n"), F.count_if("risky").alias("risky"), F.approx_count_distinct("user_id").alias("sessions"))
        .select(F.col("window.start").alias("hour"), "n", "risky", (F.col("risky") / F.col("n")).alias("rate"), "sessions")
    )


def triage(messages: DataFrame, red: float = 0.45, yellow: float = 0.55) -> DataFrame:
    """messages (text, p_yellow, p_red) plus signals and level, without state: what batches get, streams get too."""
    rows, signals = rules.with_signals(messages, name="__flags")
    level = rules.thresholds(F.col("p_yellow"), F.col("p_red"), F.lit(red), F.lit(yellow))
    final = rules.soft_rules(level, F.col("p_yellow"), F.col("p_red"), F.col("text"), signals, yellow)
    return rows.withColumns({"signals": signals["signals"], "level": final}).drop("__flags")


def scored_turns(turns: DataFrame, scores: DataFrame, wait: str = "10 minutes") -> DataFrame:
    """turns (session_id, turn_id, ts) with scores that arrive later (session_id, turn_id, score_ts, score); a turn without one after `wait` comes out with null."""
    left = turns.withWatermark("ts", wait).alias("t")
    right = scores.withWatermark("score_ts", wait).alias("s")
    on = f"t.session_id = s.session_id and t.turn_id = s.turn_id and s.score_ts >= t.ts and s.score_ts <= t.ts + interval {wait}"
    return left.join(right, F.expr(on), "left_outer").select("t.*", "s.score", "s.score_ts")


def append_log(levels: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The safety log: an append-only stream of Parquet files."""
    return levels.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def each_batch(rows: DataFrame, write: Callable[[dict[str, DataFrame], int], None], tables: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Fan each micro-batch out to tables; write gets the batch's number, so that a batch that comes again can be replaced.
    A batch is kept while its tables are written, or each of them would run the stream's steps, state and all, once more."""

    def fan(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            write(tables(batch), n)
        finally:
            batch.unpersist()

    return rows.writeStream.outputMode(mode).foreachBatch(fan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


TABLES = ("sessions", "messages", "turns", "candidates", "preferences")


def batch_tables(folder: str) -> Callable[[dict[str, DataFrame], int], None]:
    """A writer for each_batch(): every table of batch n as Parquet in its own part, which replaces what an earlier try left."""

    def write(tables: dict[str, DataFrame], n: int) -> None:
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={n}")

    return write


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables as the last micro-batch that holds a turn left it: what an earlier one said about the turn is gone.
    Sessions begin with their first turn and end with their last."""
    t = {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}
    last = t["turns"].groupBy("turn_id").agg(F.max("batch").alias("batch"))
    now = {name: t[name].join(last, ["turn_id", "batch"]).drop("batch") for name in TABLES if name != "sessions"}
    sessions = now["turns"].groupBy("session_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    return {"sessions": t["sessions"].select("session_id").distinct().join(sessions, "session_id"), **now}
