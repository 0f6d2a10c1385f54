"""Probes by automaton, overlaps by rolling hash, and sessions that hold most rows, against plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmill.functions import text
from talkmill.operators import features, probes, retrieval, sessions


def texts_and_keywords(n):
    r = random.Random(n)
    word = lambda k: "".join(r.choice("abcdé") for _ in range(k))
    texts = [(i, r.choice(["x", "y", None]), r.choice([None, "", " ".join(word(r.randint(1, 9)) for _ in range(12))])) for i in range(150)]
    return texts, list(dict.fromkeys(word(r.randint(1, 7)) for _ in range(n)))[:n]


@pytest.mark.parametrize("n,most", [(10, 200_000), (10_000, 200_000), (10_000, 3_000)])
def test_probes_equal_contains(spark, n, most):
    texts, words = texts_and_keywords(n)
    rows = spark.createDataFrame(texts, "id long, label string, text string").repartition(3)
    keywords = spark.createDataFrame([(w,) for w in [*words, words[0], "", None]], "keyword string")
    want = {(i, w): t.count(w) for i, _, t in texts if t is not None for w in {*words, ""} if w in t}
    got = probes.keyword_hits(rows, keywords, "text", ["id", "label"], most=most).collect()
    assert {(r.id, r.keyword): r.n for r in got} == want and len(got) == len(want)
    counts = {}
    label = {i: x for i, x, _ in texts}
    for i, w in want:
        counts[w, label[i]] = counts.get((w, label[i]), 0) + 1
    got = probes.keyword_counts(rows, keywords, "text", "label", most=most).collect()
    assert {(r.keyword, r.label): r.rows for r in got} == counts and len(got) == len(counts)


def test_audit_plan_has_no_nested_loop(spark):
    rows = spark.createDataFrame([("x", "a b")], "label string, text string")
    plan = features.keyword_audit(rows, spark.createDataFrame([("a",)], "keyword string"), "text", "label")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert probes.keyword_hits(rows, rows.where("false").select(F.col("text").alias("keyword")), "text", ["label"]).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_copied_shares_equal_those_of_gram_sets(spark, most):
    r = random.Random(5)
    base = ["".join(r.choice("abcdé漢😀") for _ in range(40)) for _ in range(6)]
    made = lambda: "".join(b[a : a + r.randint(0, 15)] for b in r.sample(base, 3) for a in [r.randint(0, 30)])
    texts = [(i, made()) for i in range(60)] + [(100, ""), (101, None), (102, "abc"), (103, base[0])]
    refs = [(i, b) for i, b in enumerate(base)] + [(50, "abc"), (51, ""), (52, base[0])]
    t, q = (spark.createDataFrame(x, "id long, text string") for x in (texts, refs))
    grams = lambda d: d.select("id", text.char_ngrams(F.coalesce("text", F.lit("")), 8).alias("grams"))
    want = sorted(map(tuple, retrieval.copy_overlap(grams(t), grams(q)).collect()))
    assert sorted(map(tuple, retrieval.copied_shares(t, q, most=most).collect())) == want
    assert retrieval.copied_shares(t, q.where("id < 0"), most=most).where("overlap > 0").count() == 0


def test_rolling_hashes_know_the_gram_and_not_the_place():
    code = np.array([ord(c) for c in "abcabcabx"], np.uint32)
    h = retrieval.gram_hashes(code, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4 and h[1] == retrieval.gram_hashes(code[1:4], 3)[0]


def hot_sessions():
    """A session with nine tenths of all rows, some short ones, and ties of time."""
    r = random.Random(7)
    return [("hot" if i % 10 else f"s{r.randrange(30)}", i, r.choice(["student", "assistant"]), f"t{i}") for i in range(4000)]


def test_recent_messages_of_a_hot_session(spark):
    rows = hot_sessions()
    df = spark.createDataFrame(rows, "s string, n long, role string, text string").repartition(5)
    got = sessions.recent_messages(df, "s", "n", 3, part=50)
    assert got.columns == [*df.columns, "history"]
    want = sessions.prior_messages(df, "s", "n", 3)
    plain = lambda d: sorted((r.s, r.n, r.text, tuple(map(tuple, r.history))) for r in d.collect())
    assert plain(got) == plain(want)
    # The window's groups are parts, none of them larger than a part and its context.
    placed = got.withColumn("at", F.size("history"))
    assert placed.where("s = 'hot'").count() == 3600
    with pytest.raises(ValueError):
        sessions.recent_messages(df, "s", "n", 60, part=50)


def test_as_of_spreads_a_hot_session(spark):
    r = random.Random(9)
    left = [("hot" if i % 10 else r.choice(["a", "b", None]), r.randrange(3000), i) for i in range(3000)]
    right = [("hot" if i % 10 else r.choice(["a", "b", None]), 2 * i, r.choice([None, f"v{i}"])) for i in range(1200)]
    left_df, right_df = spark.createDataFrame(left, "k string, at long, id long"), spark.createDataFrame(right, "k string, at long, v string")
    got = {x.id: x.v for x in sessions.as_of(left_df, right_df, "k", "at", "v").collect()}
    assert len(got) == len(left)
    for k, at, i in left:
        seen = [(t, v) for key, t, v in right if key == k and t <= at and v is not None]
        assert got[i] == (max(seen)[1] if seen else None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plan = sessions.as_of(left_df, right_df, "k", "at", "v")
        spread = plan.where("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 1 and max(x["count"] for x in spread) < 2700


def test_shared_histories_read_back(spark):
    """As many stored messages as there are, in parts; put together they are the copied histories."""
    rows = [x for x in hot_sessions() if x[1] < 700]
    df = spark.createDataFrame(rows, "s string, n long, role string, text string").repartition(5)
    parts, turns = sessions.shared_histories(df, "s", "n", part=64)
    assert turns.columns == ["s", "n", "before"] and parts.agg(F.sum(F.size("said")), F.max(F.size("said"))).first()[:] == (len(rows), 64)
    got = sessions.histories_of(turns, parts, "s", part=64)
    plain = lambda d: sorted((r.s, r.n, tuple(map(tuple, r.history))) for r in d.collect())
    assert plain(got) == plain(sessions.prior_messages(df, "s", "n"))
    some = sessions.histories_of(turns.where("n % 50 = 0"), parts, "s", part=64)
    assert some.count() == turns.where("n % 50 = 0").count()


@pytest.mark.parametrize("block,asking", [(16_384, 50_000), (7, 11)])
def test_tiers_by_blocks_equal_all_pairs(spark, block, asking):
    """Any size of blocks gives what all pairs give: levels, ties, examples of no scenario or tier; and no pair is joined by its tokens."""
    r = random.Random(3)
    words = lambda: r.sample([f"w{i}" for i in range(14)], r.randint(0, 9))
    q = [(i, r.choice(["a", "b", "c", "none", None]), words()) for i in range(60)]
    e = [(i, r.choice(["a", "a", "b", "c" if i < 20 else "a", None if i % 5 == 0 else "b"]), r.choice(["exemplar" if i % 2 else "reference", "reference", None]), r.sample(["u", "x", "u"], 2), words()) for i in range(90)]
    held = lambda s, t: sum(x[1] == s and t in (x[2], "") for x in e)
    want = set()
    for i, asked, tq in q:
        last = 3 if held(asked, "") < 3 else 2 if held(asked, "exemplar") < 3 else 1
        found = []
        for j, s, tier, strategies, te in e:
            level = 3 if s is not None and s != asked else 1 if tier == "exemplar" else 2
            cosine = round(len({*tq} & {*te}) / (len(tq) * len(te)) ** 0.5, 9) if tq and te else 0.0
            if asked is not None and level <= last and cosine >= 0.4:
                found.append((level, -round(cosine + 0.08 * (tier == "exemplar") + 0.02 * strategies.count("u"), 9), j))
        want |= {(i, j, level, -s, k + 1) for k, (level, s, j) in enumerate(sorted(found)[:3])}
    queries = spark.createDataFrame(q, "id long, scenario string, tokens array<string>")
    examples = spark.createDataFrame(e, "id long, scenario string, tier string, strategies array<string>, tokens array<string>")
    made = retrieval.tiered(queries, examples, 3, 0.4, ("u",), block=block, asking=asking)
    assert {(x.query_id, x.example_id, x.level, x.score, x["rank"]) for x in made.collect()} == want and {w[2] for w in want} == {1, 2, 3}
    assert "explode(t" not in made._jdf.queryExecution().executedPlan().toString()


def test_rounding_of_scores_is_that_of_spark(spark):
    r = random.Random(1)
    values = [0.0, 0.5, 1.0, 0.1234567885, 0.0000000005, 0.2999999995, *(r.random() for _ in range(200)), *(round(r.random(), 9) + 5e-10 for _ in range(200))]
    got = [x.v for x in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 9).alias("v")).collect()]
    assert retrieval.rounded_up(np.array(values), 9).tolist() == got
