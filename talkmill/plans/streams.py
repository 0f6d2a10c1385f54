"""Queries that run as streams to their end; their twins are batch SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import scores, sessions
from ..streaming import guidance, history, signals
from ..streaming.exchanges import exchanges
from ..streaming.replay import STATEFUL, drained, in_pieces, replay, scratch, settings, stream_of
from .registry import query
from .rules import FINAL, LEVELS, NAMES, SIGNALS
from .views import drawn, spoken


@query("r01_rolling_history", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role <> 'system') SELECT 's' || conv_id AS session_id, least(count(*), 4) AS n, sum(length(text)) FILTER (k <= 4)::BIGINT AS chars FROM r GROUP BY conv_id""")
def _(v):
    def plan(rows):
        said = rows.where("role <> 'system'").select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), "turn", "role", "text")
        return history.rolling_history(said, most=4)

    out = replay(v.spark, f"{v.sf_dir}/conversations.parquet", plan, "update", **STATEFUL)
    return out.select("session_id", "n", F.aggregate("history", F.lit(0).cast("long"), lambda a, m: a + F.length(m["text"])).alias("chars"))


def exchange_tables(batch):
    """Exchanges (session_id, turn, user_message, assistant_message, created_at), with candidates made up from the question, as five tables."""
    turns = batch.select("session_id", (F.substring("session_id", 2, 20).cast("long") * 1000 + F.col("turn")).alias("turn_id"), "user_message", "assistant_message", "created_at")
    made = turns.select("turn_id", F.length("user_message").alias("size"), F.posexplode(F.array(F.lit("c1"), F.lit("c2"))).alias("i", "candidate_id"))
    scored = made.select("turn_id", "candidate_id", "i", ((F.col("size") + F.col("i") * 7) % 3).alias("er"), ((F.col("size") + F.col("i")) % 5 == 0).alias("flagged"))
    return sessions.fan_out(turns, scored, scores.preference_pairs(scored, "turn_id", "er", "flagged", "i", "candidate_id"))


@query("r03_fanout_stream", """WITH {views}, m AS (SELECT *, 's' || conv_id AS session_id, conv_id * 1000 + turn AS turn_id FROM messages WHERE role = 'student'), a AS (SELECT conv_id * 1000 + turn - 1 AS turn_id, text FROM messages WHERE role = 'assistant'),
c AS (SELECT m.turn_id, o.k AS candidate_id, (length(m.text) + o.i * 7) % 3 AS er, (length(m.text) + o.i) % 5 = 0 AS flagged FROM m, (VALUES ('c1', 0), ('c2', 1)) o(k, i)), p AS (SELECT turn_id, max(er) FILTER (candidate_id = 'c1' AND NOT flagged) AS x, max(er) FILTER (candidate_id = 'c2' AND NOT flagged) AS y FROM c GROUP BY turn_id)
SELECT 'sessions' AS tbl, session_id AS key, count(*)::VARCHAR AS detail FROM m GROUP BY session_id UNION ALL SELECT 'turns', turn_id::VARCHAR, session_id FROM m UNION ALL SELECT 'messages', m.turn_id || '/0', md5(m.text) FROM m UNION ALL SELECT 'messages', a.turn_id || '/1', md5(a.text) FROM a JOIN m USING (turn_id)
UNION ALL SELECT 'candidates', turn_id || '/' || candidate_id, er::VARCHAR FROM c UNION ALL SELECT 'preferences', turn_id::VARCHAR, CASE WHEN x > y THEN 'c1>c2' ELSE 'c2>c1' END FROM p WHERE x <> y""")
def _(v):
    """Messages as a stream of eight micro-batches in no order, some of them twice; questions wait for their answers in state, and what is new or has
    changed is fanned out to five tables batch by batch."""
    folder = scratch(v.spark)
    at = F.timestamp_seconds(1_700_000_000 + F.col("turn") * 60).alias("created_at")
    said = v.messages.select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), "turn", "role", "text", at)
    twice = said.unionByName(said.where("xxhash64(session_id, turn) % 5 = 0"))
    made = exchanges(in_pieces(v.spark, twice, 8), "365 days")
    write = signals.batch_tables(folder)
    with settings(v.spark, STATEFUL):
        signals.each_batch(made, write, exchange_tables, f"{folder}/state", "update").awaitTermination()
    t = signals.read_tables(v.spark, folder)
    row = lambda name, key, detail: t[name].select(F.lit(name).alias("tbl"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))
    key = lambda *c: F.concat_ws("/", *(F.col(x).cast("string") for x in c))
    counted = t["turns"].groupBy("session_id").agg(F.count("*").alias("n")).join(t["sessions"].select("session_id").distinct(), "session_id")
    parts = [
        counted.select(F.lit("sessions").alias("tbl"), F.col("session_id").alias("key"), F.col("n").cast("string").alias("detail")), row("turns", F.col("turn_id"), F.col("session_id")), row("messages", key("turn_id", "position"), F.md5("text")),
        row("candidates", key("turn_id", "candidate_id"), F.col("er")), row("preferences", F.col("turn_id"), F.concat_ws(">", "winner", "loser")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("r02_guidance_stream", """WITH e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status FROM events), r AS (SELECT *, CASE status WHEN 'pending' THEN 1 ELSE 2 END AS rank FROM e)
SELECT 's' || user_id AS session_id, first(event_id ORDER BY ts DESC, rank DESC, event_id DESC) AS event_id, first(status ORDER BY ts DESC, rank DESC, event_id DESC) AS status FROM r GROUP BY user_id""")
def _(v):
    """Guidance states in eight micro-batches in no order, some of them twice; the last row that a session gave is its latest state."""
    status = F.when(F.col("event_type") == "purchase", "ready").when(F.col("event_type") == "error", "failed").otherwise("pending")
    rows = v.table("events").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("ts").cast("timestamp").alias("updated_at"), "event_id", status.alias("status"), F.col("props").alias("payload"))
    made = guidance.latest_guidance(in_pieces(v.spark, rows.unionByName(rows.where("event_id % 7 = 0")), 8))
    out = drained(v.spark, made, "update", **STATEFUL)
    return out.groupBy("session_id").agg(F.max_by(F.struct("event_id", "status"), "batch").alias("x")).select("session_id", "x.*")


@query("r04_s11_triage_stream", "WITH {views}, " + SIGNALS + ", " + LEVELS + f" SELECT doc_id, {NAMES} AS signals, {FINAL} AS level FROM l")
def _(v):
    """Each message is judged as it comes and appended to the safety log, which is read back."""
    folder = scratch(v.spark)
    source = stream_of(v.spark, f"{v.sf_dir}/documents.parquet")
    levels = signals.triage(spoken(drawn(source))).select("doc_id", F.array_join("signals", ",").alias("signals"), "level")
    signals.append_log(levels, f"{folder}/log", f"{folder}/state").awaitTermination()
    return v.spark.read.schema(levels.schema).parquet(f"{folder}/log")


@query("r05_scored_turns", """WITH t AS (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN value WHEN event_id % 5 = 0 THEN NULL ELSE value END AS score FROM events WHERE event_type <> 'purchase')
SELECT event_id AS turn_id, score, score IS NULL AS missing FROM t WHERE score IS NOT NULL OR ts + INTERVAL 10 MINUTE < (SELECT max(ts) - INTERVAL 30 MINUTE FROM events)""")
def _(v):
    """A third of the turns get no score, some of the others get theirs too late; both come out as missing once the wait is over."""

    def plan(rows):
        at = rows.withColumn("ts", F.col("ts").cast("timestamp"))
        turns = at.where("event_type <> 'purchase'").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn_id"), "ts")
        late = F.when((F.col("event_id") % 3 == 2) & (F.col("event_id") % 5 == 0), F.expr("interval 25 minutes")).otherwise(F.expr("interval 1 minute"))
        found = at.where("event_id % 3 <> 0").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn_id"), (F.col("ts") + late).alias("score_ts"), F.col("value").alias("score"))
        return signals.scored_turns(turns, found).select("turn_id", "ts", "score")

    out = replay(v.spark, f"{v.sf_dir}/events.parquet", plan)
    # What the watermark has not passed when the replay ends is not decided; up to where it surely has, all is.
    end = v.spark.read.parquet(f"{v.sf_dir}/events.parquet").agg((F.max(F.col("ts").cast("timestamp")) - F.expr("interval 30 minutes")).alias("end"))
    decided = out.crossJoin(F.broadcast(end)).where("score is not null or ts + interval 10 minutes < end")
    return decided.select("turn_id", "score", F.col("score").isNull().alias("missing"))


@query("r06_risk_stream", """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n FROM events GROUP BY 1) SELECT hour, n FROM w WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def _(v):
    plan = lambda s: signals.risk_rates(s.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("event_type") == "purchase").alias("risky")))
    out = replay(v.spark, f"{v.sf_dir}/events.parquet", plan)
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "n")
