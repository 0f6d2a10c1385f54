"""Keyed state across micro-batches, against the same rows as one batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from talkmill.operators import sessions
from talkmill.plans.streams import exchange_tables
from talkmill.streaming import guidance, signals
from talkmill.streaming.exchanges import answers, exchanges
from talkmill.streaming.replay import STATEFUL, drained, in_pieces, scratch, settings

START = datetime(2024, 1, 1)
MESSAGES = "session_id string, turn long, role string, text string, created_at timestamp"


def conversation():
    """Sessions with unanswered questions, two questions in a row, answers without one, gaps between turns, and null texts."""
    rng = random.Random(4)
    rows = []
    for s in range(12):
        turn = 0
        for _ in range(rng.randint(1, 9)):
            turn += rng.choice([1, 1, 1, 3])
            rows.append((f"s{s}", turn, rng.choice(["student", "student", "assistant"]), rng.choice([None, "x", f"says {turn}"]), START + timedelta(minutes=turn)))
    return rows


def tables(spark, rows, parts):
    folder = scratch(spark)
    with settings(spark, STATEFUL):
        signals.each_batch(exchanges(in_pieces(spark, spark.createDataFrame(rows, MESSAGES), parts), "365 days"), signals.batch_tables(folder), exchange_tables, f"{folder}/state", "update").awaitTermination()
    return {name: sorted((tuple(r) for r in t.select(sorted(t.columns)).collect()), key=repr) for name, t in signals.read_tables(spark, folder).items()}


def test_tables_do_not_depend_on_the_batches(spark):
    rows = conversation()
    one = tables(spark, rows, 1)
    assert tables(spark, rows, 10) == one
    assert tables(spark, rows + rows[::3], 7) == one
    known = {}
    for s, turn, role, text, at in rows:
        known.setdefault(s, {})[turn] = (role, text, at)
    want = {(f"s{s[1:]}", int(s[1:]) * 1000 + t, *a[:2]) for s, m in known.items() for t, a in answers(m).items()}
    columns = sorted(["assistant_message", "created_at", "session_id", "turn_id", "user_message"])
    assert {(r[columns.index("session_id")], r[columns.index("turn_id")], r[columns.index("user_message")], r[columns.index("assistant_message")]) for r in one["turns"]} == want


def test_a_batch_is_made_once_for_all_tables(spark):
    """Five tables and their joins read a micro-batch several times; its rows are made once."""
    made = spark.sparkContext.accumulator(0)

    def seen(parts):
        for part in parts:
            made.add(len(part))
            yield part

    df = spark.createDataFrame(conversation(), MESSAGES)
    folder = scratch(spark)
    rows = in_pieces(spark, df, 3).selectExpr("session_id", "turn", "text as user_message", "text as assistant_message", "created_at").mapInPandas(seen, "session_id string, turn long, user_message string, assistant_message string, created_at timestamp")
    signals.each_batch(rows, signals.batch_tables(folder), exchange_tables, f"{folder}/state").awaitTermination()
    assert made.value == df.count() == spark.read.parquet(f"{folder}/turns").count()


def test_pairs_equal_those_of_a_batch(spark):
    rows = conversation()
    df = spark.createDataFrame(rows, MESSAGES)
    out = drained(spark, exchanges(in_pieces(spark, df, 6), "365 days"), "update", **STATEFUL)
    last = out.groupBy("session_id", "turn").agg(F.max_by(F.struct("user_message", "assistant_message"), "batch").alias("x")).select("session_id", "turn", "x.*")
    want = sessions.paired_turns(df, "session_id", "turn")
    assert sorted(map(tuple, last.collect()), key=repr) == sorted(map(tuple, want.select(last.columns).collect()), key=repr)


def test_state_goes_when_event_time_has_passed(spark, tmp_path):
    """After a much later message a session's first messages are forgotten: its answer finds no question and gives no row."""
    batches = [[("a", 1, "student", "q", START)], [("b", 1, "student", "later", START + timedelta(days=9))], [("b", 2, "assistant", "too", START + timedelta(days=9, minutes=1))], [("a", 2, "assistant", "late", START + timedelta(minutes=1))]]
    folder = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(folder)
        import time

        time.sleep(1.1)  # files are taken by their time
    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(folder)
    out = drained(spark, exchanges(stream, "1 hour"), "update", **STATEFUL)
    assert sorted(((r.session_id, r.turn, r.assistant_message) for r in out.collect()), key=repr) == sorted([("a", 1, None), ("b", 1, None), ("b", 1, "too")], key=repr)


@pytest.mark.parametrize("parts", [1, 6])
def test_guidance_is_monotone_and_order_does_not_matter(spark, parts):
    rng = random.Random(parts)
    rows = [(f"s{rng.randrange(5)}", START + timedelta(minutes=rng.randrange(6)), i, rng.choice(["pending", "ready", "failed", "odd"]), f"p{i}") for i in range(80)]
    rows += rows[::4]
    df = spark.createDataFrame(rows, "session_id string, updated_at timestamp, event_id long, status string, payload string")
    rank = {"pending": 1, "ready": 2, "failed": 2}
    want = {}
    for s, at, i, status, p in rows:
        new = (at, rank.get(status, 0), i, status, p)
        want[s] = max(want.get(s, new), new)
    out = drained(spark, guidance.latest_guidance(in_pieces(spark, df, parts)), "update", **STATEFUL).collect()
    seen = {}
    for r in sorted(out, key=lambda r: r.batch):
        new = (r.updated_at, r["rank"], r.event_id, r.status, r.payload)
        assert r.session_id not in seen or new[:3] > seen[r.session_id][:3]
        seen[r.session_id] = new
    assert seen == want
