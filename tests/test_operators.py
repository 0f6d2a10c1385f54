"""Operators on small tables, against plain Python."""

import difflib
import hashlib
import json
import math
import random
import re
import unicodedata
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.functions import text, vectors
from talkmill.operators import agreement, dedup, features, metrics, models, queues, reshape, retrieval, sampling, scores, sessions
from talkmill.plans import QUERIES
from talkmill.sources import tables


def test_greedy_keep_equals_the_loop(spark):
    random.seed(4)
    for n, p in ((1, 0.0), (12, 0.2), (30, 0.1), (30, 0.4)):
        edges = [(a, b) for a in range(n) for b in range(a + 1, n) if random.random() < p]
        kept, by = [], {}
        for b in range(n):
            first = next((a for a in kept if (a, b) in edges), None)
            by[b] = first
            if first is None:
                kept.append(b)
        got = dedup.greedy_keep(spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(edges, "a long, b long"))
        assert {r.id: r.by for r in got.collect()} == by


def test_chain_does_not_collapse(spark):
    texts = [(1, "x", "the quick brown fox jumps over the lazy dog again and again"), (2, "x", "the quick brown fox jumps over the lazy dog again and agaim"), (3, "y", "the quick brown fox jumps over the lazy dog, again and again!"), (4, "x", "nothing of that kind"), (5, "x", ""), (6, "x", "")]
    got = {r.id: (r.reason, r.by) for r in dedup.dedupe_utterances(spark.createDataFrame(texts, "id long, cell string, text string")).collect()}
    assert got == {1: ("", None), 2: ("duplicate_in_cell", 1), 3: ("duplicate_exact", 1), 4: ("", None), 5: ("", None), 6: ("duplicate_exact", 5)}


def test_dedupe_equals_the_loop(spark):
    random.seed(12)
    base = ["".join(random.choice("abcdefg") for _ in range(90)) for _ in range(3)]
    texts = [(i, random.choice("xyz"), "".join(random.choice("abc") if random.random() < 0.015 else c for c in random.choice(base))) for i in range(60)]
    texts += [(100 + i, c, t) for i, (_, _, t) in enumerate(texts[:12]) for c in "xz"[i % 2]]

    def grams(t):
        return {t[k : k + 3] for k in range(len(t) - 2)}

    kept, want = [], {}
    for i, cell, t in texts:
        want[i] = ("", None)
        for j, other, u in kept:
            same = len(grams(t) & grams(u)) / len(grams(t) | grams(u))
            why = "duplicate_exact" if t == u else "duplicate_in_cell" if cell == other and same >= 0.82 else "duplicate_global" if same >= 0.9 else ""
            if why:
                want[i] = (why, j)
                break
        else:
            kept.append((i, cell, t))
    got = {r.id: (r.reason, r.by) for r in dedup.dedupe_utterances(spark.createDataFrame(texts, "id long, cell string, text string")).collect()}
    assert got == want and len({w for w, _ in want.values()}) == 4


def test_dedupe_by_ratio_equals_the_loop(spark):
    """One-letter edits in and across cells, short and long, against the loop over max(Jaccard, matching ratio)."""
    random.seed(21)
    texts = [(0, "x", "anutterancewithfewletters12"), (1, "x", "anutterancewithXewletters12"), (2, "y", "anutterancewithfewlexters12")]
    for n in (4, 9, 15, 20, 27, 40, 58, 90, 230):
        base = "".join(random.choice("abcdefghijkl") for _ in range(n))
        for edits in (0, 1, 1, 2, n // 9, n // 7, n // 5):
            t = list(base)
            for at in random.sample(range(n), edits):
                t[at] = random.choice(["", "z", "yy"])
            texts.append((len(texts), random.choice("xy"), "".join(t)))
    order = random.sample(texts[3:], len(texts) - 3)
    texts = texts[:3] + [(3 + i, c, t) for i, (_, c, t) in enumerate(order)] + [(len(texts), "y", texts[0][2]), (len(texts) + 1, "y", "")]

    def grams(t):
        return {t[k : k + 3] for k in range(len(t) - 2)} or {t} - {""}

    kept, want = [], {}
    for i, cell, t in texts:
        want[i] = ("", None)
        for j, other, u in kept:
            same = max(len(grams(t) & grams(u)) / max(len(grams(t) | grams(u)), 1), difflib.SequenceMatcher(None, t, u).ratio())
            why = "duplicate_exact" if t == u else "duplicate_in_cell" if cell == other and same >= 0.82 else "duplicate_global" if same >= 0.9 else ""
            if why:
                want[i] = (why, j)
                break
        else:
            kept.append((i, cell, t))
    df = spark.createDataFrame(texts, "id long, cell string, text string")
    got = {r.id: (r.reason, r.by) for r in dedup.dedupe_utterances(df, by_ratio=True).collect()}
    assert got == want and got[1] == ("duplicate_in_cell", 0) and got[2] == ("duplicate_global", 0)
    reps = df.groupBy(F.col("text").alias("norm")).agg(F.min("id").alias("id"), F.lit(1).cast("long").alias("cells"))
    pairs = {(r.a, r.b) for r in dedup.ratio_pairs(reps, 0.82, 0.9, tile=7).where("forward >= 0.82").collect()}
    norm = {r.id: r.norm for r in reps.collect()}
    assert pairs == {(a, b) for a in norm for b in norm if a < b and norm[a] and norm[b] and difflib.SequenceMatcher(None, norm[b], norm[a]).ratio() >= 0.82}


def test_common_subsequence_bound_is_exact():
    """The banded bit steps say yes just when the longest common subsequence is long enough."""
    rng = random.Random(0)
    for _ in range(800):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        b = list(a)
        for _ in range(rng.randint(0, 30)):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randint(0, len(b)), rng.choice("abcd"))
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
        at = {}
        for k, x in enumerate(a):
            at[x] = at.get(x, 0) | 1 << k
        for need in {row[-1] - 1, row[-1], row[-1] + 1} - {0, -1}:
            if need <= min(len(a), len(b)):
                assert dedup._common(at, len(a), "".join(b), need) == (row[-1] >= need)


def test_bit_steps_over_many_pairs_are_exact():
    """The bit steps over many pairs say yes just when the longest common subsequence is long enough, over one word of bits or several."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé漢") for _ in range(rng.choice([1, 5, 63, 64, 65, 130, 200]))) for _ in range(24)]
    texts += [t[:-1] for t in texts[:8]]
    code = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    i, j = (x.ravel() for x in np.indices((len(texts), len(texts))))
    longest = []
    for a, b in zip((texts[x] for x in i), (texts[x] for x in j)):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for k, y in enumerate(b, 1):
                row[k], before = (before + 1 if x == y else max(row[k], row[k - 1])), row[k]
        longest.append(row[-1])
    codes, longest = [code(t) for t in texts], np.array(longest)
    assert len(dedup._subsequences(codes, codes, i, j, longest)) == len(i) and not len(dedup._subsequences(codes, codes, i, j, longest + 1))


def test_ratios_of_long_texts_are_complete():
    """Of long texts, whose frequent characters seed no block, no pair is missed that the matcher finds alike, and grams alone leave few to it."""
    rng = random.Random(9)
    said = lambda n: "".join(rng.choice(["th", "er", "on", "an", "ti", "ed", "Wh", "re"]) for _ in range(n // 2)) + "qxJ漢"
    texts = []
    for n in (180, 199, 210, 400, 900):
        for _ in range(6):
            base = said(n)
            texts.append(base)
            for edits in (3, n // 20, n // 12):
                t = list(base)
                for at in rng.sample(range(n), edits):
                    t[at] = rng.choice(["", "z", "yy"])
                texts.append("".join(t))
    rows = pd.DataFrame([(0, 0, s, k, t, 1) for s in (0, 1) for k, t in enumerate(texts)], columns=["i", "j", "side", "id", "norm", "cells"])
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    want = {(a, b) for a, x in enumerate(texts) for b, y in enumerate(texts) if a < b and max(ratio(x, y), ratio(y, x)) >= 0.82}
    got = dedup._match(rows, 0.82, 0.9)
    assert {(r.a, r.b) for r in got.itertuples() if max(r.forward, r.backward) >= 0.82} == want and len(want) > 30
    assert len(got) < 0.2 * len(texts) * (len(texts) - 1) / 2


def test_tiles_meet_wherever_texts_may_be_alike(spark):
    """Tile pairs against all pairs of texts: none whose bounds allow the ratio is dropped, and some tiles don't meet."""
    rng = random.Random(8)
    texts = [(i, "".join(rng.choice("abcdef" if i % 2 else "uvwxyz") for _ in range(rng.choice([5, 30, 33, 36, 90, 100])))) for i in range(120)]
    texts += [(200 + i, t[:-1]) for i, t in texts[:40]]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "id long, norm string, cells long")
    got = {(r.a, r.b) for r in dedup.ratio_pairs(df, 0.8, 0.8, tile=8).where("greatest(forward, backward) >= 0.8").collect()}
    sim = lambda x, y: max(difflib.SequenceMatcher(None, x, y).ratio(), difflib.SequenceMatcher(None, y, x).ratio())
    assert got == {(a, b) for a, x in texts for b, y in texts if a < b and sim(x, y) >= 0.8}
    tiles = [(k, 30, 36, *(x for c in range(dedup.SHADES) for x in ((c == k % 2) * 30, (c == k % 2) * 36))) for k in range(6)] + [(9, 100, 100, *([0, 100] * dedup.SHADES))]
    columns = "tile long, small int, large int, " + ", ".join(f"l{k} int, h{k} int" for k in range(dedup.SHADES))
    met = {(r.i, r.j) for r in dedup.tile_pairs(spark.createDataFrame(tiles, columns), 0.8).collect()}
    assert met == {(i, j) for i in range(6) for j in range(i, 6) if i % 2 == j % 2} | {(9, 9)}


def test_similar_pairs_are_complete(spark):
    random.seed(5)
    base = ["".join(random.choice("abcde ") for _ in range(40)) for _ in range(4)]
    texts = [(i, "".join(random.choice("abcde") if random.random() < 0.05 else c for c in base[i % 4])) for i in range(40)]
    grams = {}
    for i, t in texts:
        n = t.replace(" ", "")
        grams.setdefault(n, (i, {n[k : k + 3] for k in range(len(n) - 2)}))
    sets = list(grams.values())
    want = {(a, b) for a, x in sets for b, y in sets if a < b and len(x & y) >= 0.6 * len(x | y)}
    got = dedup.similar_pairs(spark.createDataFrame(texts, "id long, text string"), 0.6).collect()
    assert {(r.a, r.b) for r in got} == want and want


@pytest.mark.parametrize("tile,common", [(11, 8), (300, 1024)])
def test_similar_pairs_by_tiles(spark, tile, common):
    """Tiles of any size, few grams in the bitmap or all: each pair once, with what its sets share, also of texts shorter than a gram and of wide characters."""
    r = random.Random(6)
    texts = [(i, "".join(r.choice(["ti", "on", "ha", "é", "漢", "😀"][: r.choice([3, 6])]) for _ in range(r.choice([0, 1, 2, 3, 12, 14, 40])))) for i in range(150)]
    sets = {}
    for i, t in texts:
        sets.setdefault(t, (i, {t[k : k + 3] for k in range(len(t) - 2)} or {t} - {""}))
    near = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    want = {(a, b, near(x, y)) for a, x in sets.values() for b, y in sets.values() if a < b and near(x, y) >= 0.5}
    made = dedup.similar_pairs(spark.createDataFrame(texts, "id long, text string").repartition(3), 0.5, tile=tile, common=common)
    got = [tuple(x) for x in made.collect()]
    assert len(got) == len(want) and set(got) == want and len(want) > 50


def test_memories(spark):
    """A negative cosine counts as none, every sensitivity but high is open, and a session only sees its own."""
    records = spark.createDataFrame(
        [(1, "u", "s", [-1.0, 0.0], ["a"], "medium"), (2, "u", "t", [1.0, 0.0], ["b"], "low"), (3, "u", "s", [1.0, 0.0], ["a"], "high"), (4, "v", "s", [1.0, 0.0], ["a"], "low"), (5, "u", "s", [0.0, 1.0], ["a"], None)],
        "record_id long, user string, session string, vector array<double>, tokens array<string>, sensitivity string",
    ).withColumn("created", F.lit(0.0))
    queries = spark.createDataFrame([(10, "u", None, [1.0, 0.0], ["a"]), (11, "u", "t", [1.0, 0.0], ["a"])], "query_id long, user string, session string, vector array<double>, tokens array<string>")
    got = {(r.query_id, r.record_id): (r.score, r.rank) for r in retrieval.memory_search(queries, records, 0.0, 5, 0.0).collect()}
    assert got == {(10, 2): (0.7, 1), (10, 1): (0.35, 2), (10, 5): (0.35, 3), (11, 2): (0.7, 1)}


def test_tiers_fill_before_the_floor(spark):
    """Levels open by how many examples the ones before hold, not by how many are alike; within a level the bonus counts."""
    e = [(i, "x", "exemplar", [], ["a"] + [f"n{i}{k}" for k in range(40)]) for i in range(3)] + [(3, "x", "reference", [], ["a", "b"]), (4, "y", "exemplar", [], ["a", "b"]), (5, "y", "reference", [], ["a", "b"]), (6, "y", "stats_only", ["u", "u"], ["a", "b", "c"]), (7, "z", "exemplar", ["u"], ["a", "b"])]
    q = [(10, "x", ["a", "b"]), (11, "y", ["a", "b"]), (12, "z", ["a", "b"])]
    got = retrieval.tiered(spark.createDataFrame(q, "id long, scenario string, tokens array<string>"), spark.createDataFrame(e, "id long, scenario string, tier string, strategies array<string>, tokens array<string>"), 3, 0.5, ("u",))
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.example_id, r.level))
    assert found == {11: [(4, 1), (5, 2), (6, 2)], 12: [(7, 1), (4, 3), (3, 3)]}


@pytest.mark.parametrize("bad", [[("a", 1), ("a", 2), ("other", 3)], [("a", 1), ("b", 2), ("b", 3)], [("c", 5), ("d", 4)], [(None, 9)], []])
def test_round_robin_falls_back(spark, bad):
    good = [("a", i) for i in range(4)] + [("b", 10 + i) for i in range(3)] + [(None, 20), (None, 21)]
    groups = {}
    for g, i in bad:
        groups.setdefault(g or "other", []).append(i)
    want, seen = set(), {}
    for g, i in sorted(good, key=lambda r: r[1]):
        k = seen.setdefault(g or "other", 0)
        seen[g or "other"] += 1
        partners = sorted(groups.get(g or "other") or groups.get("other") or [i for x in groups.values() for i in x])
        if partners:
            want.add((i, partners[k % len(partners)]))
    got = reshape.round_robin(spark.createDataFrame(good, "g string, i long"), spark.createDataFrame(bad, "g string, j long"), "g", "i", "j").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_copy_overlap_gives_every_text_a_row(spark):
    t = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"]), (3, [])], "id long, grams array<string>")
    r = spark.createDataFrame([(7, ["a", "b"]), (8, ["b", "c"]), (9, ["a"])], "id long, grams array<string>")
    assert sorted(map(tuple, retrieval.copy_overlap(t, r).collect())) == [(1, 7, 0.6667), (2, None, 0.0), (3, None, 0.0)]


def test_kappa(spark):
    random.seed(6)
    for rows in ([(0, 0), (1, 1), (2, 2)], [(random.randrange(3), random.randrange(3)) for _ in range(60)], [(1, 1)] * 5):
        n = len(rows)
        observed = sum(Fraction((a - b) ** 2) for a, b in rows) / n
        expected = sum(Fraction((a - b) ** 2) for a, _ in rows for _, b in rows) / n**2
        want = None if expected == 0 else float(1 - observed / expected)
        got = spark.createDataFrame(rows, "a int, b int").agg(agreement.kappa(F.col("a"), F.col("b")).alias("k")).first().k
        assert got == (want if want is None else pytest.approx(want))


def test_consensus_rounds_half_up(spark):
    got = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (0, 0)], "a int, b int").select(agreement.consensus(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.c for r in got] == [1, 1, 2, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9])
def test_terciles_by_index(spark, n):
    xs = sorted(random.Random(n).choices(range(5), k=n))
    r = sampling.tercile_cuts(spark.createDataFrame([(float(x),) for x in xs], "s double"), "s").first()
    assert (r.low, r.high) == (xs[(n - 1) // 3], xs[2 * (n - 1) // 3])


def test_stratified_sample(spark):
    rows = [(i, "ab"[i % 10 == 0], "xy"[i % 3 == 0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, s string, o string")
    one = [r for r in sampling.stratified_sample(df, "id", ["s", "o"], 12, "z").orderBy("sample_no").collect()]
    eight = [r for r in sampling.stratified_sample(df.repartition(8), "id", ["s", "o"], 12, "z").orderBy("sample_no").collect()]
    assert one == eight and len(one) == 12 and [r.sample_no for r in one] == list(range(1, 13))
    assert sum(r.s == "b" for r in one) == 6  # as many as there are, and no more than an even share
    for bad in (0, 61):
        with pytest.raises(ValueError):
            sampling.stratified_sample(df, "id", ["s"], bad, "z")


def test_balanced_subset(spark):
    rows = [(i, g) for i, g in enumerate("aaabbac")]
    got = sampling.balanced_subset(spark.createDataFrame(rows, "i long, g string"), "g", "i", 5).collect()
    assert sorted(r.i for r in got) == [0, 1, 3, 4, 6]


def test_numbering_is_total(spark):
    rows = [(i, (i * 7) % 50) for i in range(200)]
    got = queues.numbered(spark.createDataFrame(rows, "i long, k long").repartition(5), "k", "i").collect()
    want = {i: n for n, (k, i) in enumerate(sorted((k, i) for i, k in rows), 1)}
    assert {r.i: r.number for r in got} == want


def test_numbering_of_many_rows_with_a_payload(spark, tmp_path):
    """Two million rows over eight partitions, written and read back: every number once, in order, all rows there."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = spark.range(2_000_000).select("id", F.xxhash64("id").alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 3).alias("payload"))
        queues.numbered(rows, "k", "id").write.parquet(str(tmp_path / "n"))
        got = spark.read.parquet(str(tmp_path / "n"))
        assert got.agg(F.count("*"), F.count_distinct("number"), F.min("number"), F.max("number"), F.count_distinct("id")).first() == (2_000_000, 2_000_000, 1, 2_000_000, 2_000_000)
        after = got.repartitionByRange(8, "number").sortWithinPartitions("number").withColumn("next", F.lead("k").over(Window.partitionBy(F.spark_partition_id()).orderBy("number")))
        assert after.where("next < k").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbering_within_groups(spark):
    random.seed(3)
    rows = [(random.choice(["a", "b", None, None, None]), random.randrange(30), i) for i in range(500)]
    got = queues.numbered(spark.createDataFrame(rows, "g string, k long, i long").repartition(7), "k", "i", within=("g",)).collect()
    want = {}
    for g in ("a", "b", None):
        want |= {i: n for n, (k, i) in enumerate(sorted((k, i) for h, k, i in rows if h == g), 1)}
    assert {r.i: r.number for r in got} == want
    assert queues.numbered(spark.createDataFrame([], "k long"), "k").count() == 0


def test_numeric_keys_take_their_value_others_come_last(spark):
    keys = ["5000000000", "x", " 7 ", "-3", "1000000000", "", "1.5", None]
    got = [r.k for r in spark.createDataFrame([(k,) for k in keys], "k string").orderBy(queues.numeric_key(F.col("k")), "k").collect()]
    assert got == ["-3", " 7 ", "1000000000", "5000000000", None, "", "1.5", "x"]


def test_priority_queue_equals_the_cascade(spark):
    random.seed(8)
    rows = [(o, random.randrange(12), random.random() < 0.2, random.random() < 0.3) for o in range(40)]
    picked, seen = [], set()
    for name, test in (("p", lambda r: r[2]), ("q", lambda r: r[3]), ("balanced_fill", lambda r: True)):
        for r in rows:
            if test(r) and r[1] not in seen and len(picked) < 8:
                picked.append((r[0], name))
                seen.add(r[1])
    got = queues.priority_queue(spark.createDataFrame(rows, "o long, k long, p boolean, q boolean"), "k", "o", [("p", F.col("p")), ("q", F.col("q"))], 8)
    assert [(r.o, r.reason) for r in got.where("bucket = 'priority'").orderBy("rank").collect()] == picked


def test_upper_median_and_consolidate(spark):
    got = spark.createDataFrame([("1;2",), ("0;x;2;1",), ("",), ("x",)], "r string").select(scores.upper_median(F.col("r")).alias("m")).collect()
    assert [r.m for r in got] == [2, 1, None, None]
    runs = spark.createDataFrame([(1, 1, 1, 0, 2, False, "", "a"), (1, 2, 2, 1, 2, True, "why", "b")], "k int, n int, er int, ip int, ex int, boundary boolean, reason string, rationale string")
    assert tuple(scores.consolidate(runs, ["k"], "n").first()) == (1, 1, 0, 2, True, "why", "a")


def test_preferences_on_ties_and_flags(spark):
    rows = [(1, 1, "a", 3.0, False), (1, 2, "b", 3.0, False), (2, 1, "a", 2.0, False), (2, 2, "b", 3.0, True), (3, 1, "a", 1.0, False), (3, 2, "b", 2.0, False), (4, 1, "a", 1.0, True)]
    df = spark.createDataFrame(rows, "t int, p int, n string, total double, f boolean")
    assert [tuple(r) for r in scores.preference_pairs(df, "t", "total", "f", "p", "n").collect()] == [(3, "b", "a")]
    assert {r.t: r.best for r in scores.best_candidates(df, "t", "total", "f", "p", "n", "-").collect()} == {1: "a", 2: "a", 3: "b", 4: "-"}


def test_as_of_passes_over_nothing_later(spark):
    left = spark.createDataFrame([("s", 1), ("s", 5), ("t", 5)], "k string, at int")
    right = spark.createDataFrame([("s", 2, "a"), ("s", 5, "b"), ("s", 9, "c")], "k string, at int, v string")
    assert {(r.k, r.at): r.v for r in sessions.as_of(left, right, "k", "at", "v").collect()} == {("s", 1): None, ("s", 5): "b", ("t", 5): None}


def test_history_excludes_itself(spark):
    rows = [("s", i, "student", str(i)) for i in range(4)]
    got = sessions.prior_messages(spark.createDataFrame(rows, "s string, n int, role string, text string"), "s", "n", 2).orderBy("n").collect()
    assert [[m.text for m in r.history] for r in got] == [[], ["0"], ["0", "1"], ["1", "2"]]


def test_erasure_needs_a_key(spark):
    with pytest.raises(ValueError):
        sessions.erase(spark.range(3), None, None)


def test_p95_index(spark):
    r = metrics.latencies(spark.createDataFrame([(float(x),) for x in range(11)], "v double"), "v").first()
    assert r.p95 == sorted(range(11))[round(0.95 * 10)]


def test_scorer_failures_become_a_column(spark):
    def scorer(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("down")
        return [(len(t), "") for t in texts]

    rows = spark.createDataFrame([("ok",), ("boom",)], "t string").repartition(2, "t")
    got = {r.t: (r.score, r.error) for r in models.score_batches(rows, "t", scorer, "long", retries=1).collect()}
    assert got["boom"] == (None, "RuntimeError: down")


def test_unknown_tokenizer():
    with pytest.raises(ValueError):
        models.tokenizer("none")


def test_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿sample,note,\n1,"two\nlines ""quoted""",x\n2,,\n'.encode())
    got = tables.read_sheet(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["sample", "note"]
    assert [tuple(r) for r in got.collect()] == [("1", 'two\nlines "quoted"'), ("2", "")]
    tables.write_sheet(got, str(tmp_path / "out"), ["note", "sample"])
    back = tables.read_sheet(spark, str(tmp_path / "out"))
    assert back.columns == ["note", "sample"] and back.count() == 2


def test_json_sources(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType())])
    (tmp_path / "list.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    (tmp_path / "wrapped.json").write_text(json.dumps({"samples": [{"a": 3}]}))
    assert [r.a for r in tables.read_samples(spark, str(tmp_path / "list.json"), schema).orderBy("a").collect()] == [1, 2]
    assert [r.a for r in tables.read_samples(spark, str(tmp_path / "wrapped.json"), schema).collect()] == [3]
    (tmp_path / "lines.json").write_text('{"a":1}\n{broken\n{"a":2}\n')
    good, bad = tables.read_lines(spark, str(tmp_path / "lines.json"), schema)
    assert good.count() == 2 and bad.count() == 1
    assert tables.read_optional(spark, str(tmp_path / "missing.json"), schema).count() == 0
    tables.append_lines(good, str(tmp_path / "log"))
    tables.append_lines(good, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    (tmp_path / "t.txt").write_text("one\n\n  two \n")
    assert [r.text for r in tables.read_texts(spark, str(tmp_path / "t.txt")).collect()] == ["one", "two"]


def test_nfkc(spark):
    said = ["ＡＢＣ１２３！", "e\u0301", "\u00e9", "ﬁne ①②", "㌔ ｶﾞ", "x² ½", "가", "a\xa0b", "plain", "", None]
    want = {"ABC123!", "\u00e9", "fine 12", "キロ ガ", "x2 1⁄2", "가", "a b", "plain", "", None}
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").orderBy("i").select(text.nfkc("t").alias("n")).collect()]
    assert set(got) == want and got == [t and unicodedata.normalize("NFKC", t) for t in said]


def test_nfkc_query_takes_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {(d.doc_id, unicodedata.normalize("NFKC", d.lang + d.source), hashlib.md5(unicodedata.normalize("NFKC", d.text).encode()).hexdigest()) for d in docs}
    assert {tuple(r) for r in QUERIES["f02_nfkc"](spark, sf).collect()} == want and not all(d.text.isascii() for d in docs)


def test_order_statistics_equal_the_sorted_values(spark):
    rng = random.Random(3)
    inf = float("inf")
    cases = [
        [rng.gauss(0, 1e3) for _ in range(500)], [float(rng.randrange(4)) for _ in range(300)], [1e300, -1e300, 0.0, 5e-324], [2.5], [rng.expovariate(1) ** 9 for _ in range(400)],
        [inf, -inf, 1e308, -1e308, 1.5, 1.5, -5e-324, 1.7976931348623157e308], [inf] * 3, [-inf, inf], [-0.0, 0.0, -0.0, 1.0, -1.0], [1.0 + k * 2.0**-52 for k in range(200)],
    ]
    for xs in cases:
        places = [0, len(xs) // 2, (len(xs) - 1) // 3, round(0.95 * (len(xs) - 1)), len(xs) - 1]
        df = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "v double").repartition(3)
        n, got = metrics.order_statistics(df, "v", lambda n: places)
        assert (n, got) == (len(xs), [sorted(xs)[p] for p in places])
        assert all(math.copysign(1, g) == 1 for g in got if g == 0)
    empty = spark.createDataFrame([], "v double")
    assert metrics.order_statistics(empty, "v", lambda n: [0]) == (0, []) and metrics.latencies(empty, "v").first().p95 is None


def test_order_statistics_of_many_rows_with_infinities_and_ties(spark):
    """More rows than a pass has digits, most of them one value, and an infinity at either end."""
    ids = spark.range(200_000)
    df = ids.select(F.when(F.col("id") % 3 == 0, F.lit(7.25)).otherwise(F.sin("id") * 1e6).alias("v")).union(spark.createDataFrame([(float("inf"),), (float("-inf"),)], "v double"))
    want = sorted(r.v for r in df.collect())
    places = [0, 1, 66_666, 100_000, 133_333, 200_000, 200_001]
    assert metrics.order_statistics(df, "v", lambda n: places) == (200_002, [want[p] for p in places])
    got = metrics.latencies(df, "v").first()
    assert (got.n, got.least, got.most, got.p95, got["median"]) == (200_002, float("-inf"), float("inf"), want[round(0.95 * 200_001)], (want[100_000] + want[100_001]) / 2)


def test_order_patterns_keep_the_order(spark):
    rng = np.random.default_rng(1)
    xs = np.sort(np.concatenate([rng.integers(0, 1 << 64, 3000, dtype=np.uint64).view(np.float64), [0.0, np.inf, -np.inf, 1e308, -1e308, 5e-324]]))
    xs = xs[~np.isnan(xs)]
    patterns = metrics.order_patterns(xs)
    assert (patterns[1:] >= patterns[:-1]).all() and [metrics.from_pattern(int(p)) for p in patterns] == (xs + 0.0).tolist()


def test_sweep_finds_the_setting_that_separates(spark):
    """Logits that only the right thresholds tell apart; the best setting and its measures against a loop."""
    rows = []
    for i in range(90):
        truth = ("green", "yellow", "red")[i % 3]
        base = {"green": [2.0, 0.0, -1.0], "yellow": [0.0, 1.0, 0.2], "red": [-1.0, 0.0, 1.2 + i / 100]}[truth]
        rows.append((("validation", "test")[i % 2], truth, base, [0.0, 0.0, 0.5 if truth == "red" else 0.0], i % 7 == 0, False, False, i % 5 == 0))
    df = spark.createDataFrame(rows, "split string, truth string, base array<double>, keyword array<double>, idiom boolean, bullying boolean, negated boolean, red_necessary boolean")
    got = metrics.policy_sweep(df, [0.0, 1.0], [1.0, 2.0], [0.4, 0.6], [0.3, 0.5], ["none", "soft", "strict"]).orderBy("rank").collect()

    def level(r, alpha, t, red, yellow, mode):
        z = [math.exp((b + alpha * k) / t) for b, k in zip(r[2], r[3])]
        p = [x / sum(z) for x in z]
        if p[2] < red:
            return "yellow" if p[1] + p[2] >= yellow else "green"
        if mode == "none":
            return "red"
        if r[4]:
            return "yellow" if p[1] + p[2] >= yellow else "green"
        return "yellow" if not r[7] and (mode == "strict" or p[2] < 0.8) else "red"

    def objective(split, *setting):
        n = {}
        for r in rows:
            if r[0] == split:
                key = (r[1], level(r, *setting))
                n[key] = n.get(key, 0) + 1
        row = lambda t: max(sum(v for (a, _), v in n.items() if a == t), 1)
        col = lambda t: sum(v for (_, b), v in n.items() if b == t)
        f1 = sum(2 * n.get((t, t), 0) / (row(t) + col(t)) for t in metrics.CLASSES) / 3
        return f1 - 2 * n.get(("green", "red"), 0) / row("green") - 1.5 * n.get(("yellow", "red"), 0) / row("yellow") - 3 * n.get(("red", "green"), 0) / row("red")

    assert len(got) == 2 * 2 * 3 * 3 and [r.rank for r in got] == list(range(1, len(got) + 1))
    for r in got:
        assert r.val_objective == pytest.approx(objective("validation", r.alpha, r.temperature, r.red, r.yellow, r.mode), abs=1e-8)
    assert got[0].val_objective == max(r.val_objective for r in got)


def test_keyword_model_on_a_separable_sample(spark):
    words = {"green": "sunny bright warm", "yellow": "cloudy grey rain", "red": "storm thunder flood"}
    rows = [(i, c, f"{words[c]} filler{i % 4} {words[c]}", "train" if i % 10 < 6 else "validation" if i % 10 < 8 else "test") for i in range(90) for c in [("green", "yellow", "red")[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, safety string, text string, split string")
    df = df.select("doc_id", "safety", "split", *(models.tokenizer(n)(F.col("text")).alias(n) for n in ("word", "char_ngram")))
    got = models.keyword_model(df, "safety", [5, 40], {"word": "word", "char_ngram": "char_ngram"}, least=2.0).collect()
    assert {(r.strategy, r.keywords) for r in got} == {(s, k) for s in ("word", "char_ngram") for k in (5, 40)}
    assert got[0].validation_f1 == got[0].test_f1 == 1.0 and all(a.validation_f1 >= b.validation_f1 for a, b in zip(got, got[1:]))


def test_keyword_models_of_texts(spark, monkeypatch):
    """Counts made where the texts are give what arrays of tokens give: words that are runs of characters too, repeats, wide characters, capitals, empty texts."""
    rng = random.Random(3)
    said = {"green": ["sunny", "is", "Bright", "漢字", "warm1"], "yellow": ["cloudy", "IS", "grey", "字漢", "rain"], "red": ["storm", "is", "thunder", "a", "flood é"]}
    rows = [(i, c, " ".join(rng.choices(said[c] + ["is", "IS", "filler"], k=rng.choice([0, 1, 9, 30]))) if i % 17 else ["", "x", None][i % 3], "train" if i % 10 < 6 else "validation" if i % 10 < 8 else "test") for i in range(120) for c in [("green", "yellow", "red")[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, safety string, text string, split string").repartition(3)
    tokens = df.select("doc_id", "safety", "split", *(models.tokenizer(n)(F.col("text")).alias(n) for n in models.STRATEGIES))
    want = models.keyword_model(tokens.where("word is not null"), "safety", [3, 20], {n: n for n in models.STRATEGIES}, least=2.0).collect()
    got = models.keyword_models(df.where("text is not null"), "safety", [3, 20], least=2.0)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want] and len(want) == 6
    # The same counts, also if a task hands them on many times.
    for held in (models.HELD, 5):
        monkeypatch.setattr(models, "HELD", held)
        batches = [pa.RecordBatch.from_pylist([{"label": c, "text": t} for _, c, t, s in rows if s == "train"])]
        found = {}
        for r in (r for b in models._counted(iter(batches)) for r in b.to_pylist()):
            x = found.setdefault((r["kind"], r["token"], r["label"]), [0, 0])
            x[0], x[1] = x[0] + r["weight"], x[1] + r["rows"]
        for n in ("word", "char_ngram"):
            some = tokens.where("split = 'train'").select("doc_id", "safety", F.col(n).alias("tokens"), F.lit(1.0).alias("w"))
            assert {(r.token, r.safety): [r.weight, r.rows] for r in features.token_class_counts(some, "safety").collect()} == {k[1:]: v for k, v in found.items() if k[0] == n}


def test_sequence_ratio(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("abc", ""), ("kitten sitting", "sitting kitten"), ("a" * 250 + "b", "b" + "a" * 250), (None, "x")]
    got = spark.createDataFrame(pairs, "a string, b string").select(vectors.sequence_ratio("a", "b").alias("r")).collect()
    assert [r.r for r in got] == [None if a is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_embedders_and_classifiers_by_name(spark):
    df = spark.createDataFrame([(1, "red fox red"), (2, ""), (3, "blue")], "id long, text string")
    got = {r.id: r.embedding for r in models.embedder("hashing")(df, "id", "text").collect()}
    assert all(len(e) == 384 for e in got.values()) and sum(x * x for x in got[1]) == pytest.approx(1) and not any(got[2])
    scored = {r.id: r.embedding for r in models.embedder("model", lambda texts: [([float(len(t))], "") for t in texts])(df, "id", "text").collect()}
    assert scored == {1: [11.0], 2: [0.0], 3: [4.0]}
    with pytest.raises(ValueError):
        models.embedder("none")
    p = models.classify_batches(df, "text", lambda texts: [(1.0, 0.0, 0.0) for _ in texts]).orderBy("id").first()
    assert (p.probabilities.green, p.probabilities.red, p.problem) == (1.0, 0.0, "")


def test_the_validator_as_one_flow(spark):
    """p21_j10_validation against the sequential loop, on the driver's smallest table."""
    sf = "/root/testdata/sf0.001"
    marks = str.maketrans("", "", text.PUNCTUATION)
    bare = lambda t: "".join(t.translate(marks).split())
    grams = lambda t: {t[k : k + 3] for k in range(len(t) - 2)} if len(t) > 3 else {t} - {""}
    rows = sorted((r.conv_id * 1000 + r.turn, "student" if r.role == "user" else "assistant", r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").where("role <> 'system'").collect())
    kept, want = [], {}
    for i, cell, said in rows:
        t = (said or "").strip()
        if not said:
            want[i] = ("rejected", "missing_fields:text")
        elif not ("idiot" in t or "scum" in t) and not 20 <= len(t) <= 220:
            want[i] = ("rejected", "text_length_out_of_range")
        elif not ("idiot" in t or "scum" in t) and not 1 <= len([p for p in re.split("[。！？!?]+", t) if p.strip()]) <= 5:
            want[i] = ("rejected", "sentence_count_out_of_range")
        elif not ("idiot" in t or "scum" in t) and re.search("https?://|@", t):
            want[i] = ("rejected", "non_student_or_prompt_marker")
        elif "idiot" in said or "scum" in said:
            want[i] = ("quarantine", "explicit_crisis_signal")
        elif i % 31 == 0:
            want[i] = ("quarantine", "f1_exception")
        elif i % 29 == 0:
            want[i] = ("quarantine", "f1_non_green")
        elif 180 < len(t) <= 220:
            want[i] = ("length_review", "length_review_required")
        else:
            n, why = bare(said), ""
            for other, m in kept:
                both = max(len(grams(n) & grams(m)) / max(len(grams(n) | grams(m)), 1), difflib.SequenceMatcher(None, n, m).ratio())
                why = "duplicate_exact" if n == m else "duplicate_in_cell" if cell == other and both >= 0.82 else "duplicate_global" if both >= 0.9 else ""
                if why:
                    break
            want[i] = ("duplicate", why) if why else ("accepted", "")
            if not why:
                kept.append((cell, n))
    got = {r.id: (r.disposition, r.reason) for r in QUERIES["p21_j10_validation"](spark, sf).collect()}
    assert got == want


def test_hashes_of_bundles_and_json(spark):
    got = spark.createDataFrame([("a\"b\n", 3, None, True)], "s string, n int, z string, b boolean").select(text.stable_hash({c: F.col(c) for c in "snzb"}).alias("h")).first().h
    assert got == hashlib.sha256(json.dumps({"s": "a\"b\n", "n": 3, "z": None, "b": True}, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    rows = spark.createDataFrame([("k", "b", "two"), ("k", "a", "one")], "k string, l string, t string")
    assert text.bundle_hash(rows, ["k"], "l", "t", "head").first().bundle == hashlib.sha256(b"head\na\none\nb\ntwo").hexdigest()


def test_pooled_by_mask(spark):
    """Masked means by hand, with a mask of zeros, null and empty vectors; and by batches of a model that is loaded once for a partition."""
    rows = [(1, [[1.0, 2.0], [3.0, 6.0], [100.0, 100.0]], [1, 1, 0]), (2, [[1.0, 2.0]], [0]), (3, [[5.0, 5.0], [7.0, 9.0]], [None, 1]), (4, [], []), (5, None, None)]
    df = spark.createDataFrame(rows, "id long, v array<array<double>>, m array<int>")
    assert {r.id: r.p for r in df.select("id", models.pooled(F.col("v"), F.col("m")).alias("p")).collect()} == {1: [2.0, 4.0], 2: [0.0, 0.0], 3: [7.0, 9.0], 4: None, 5: None}

    def load():
        calls = []

        def model(texts):
            calls.append(len(texts))
            assert max(calls) <= 4
            size = max(1, *(len(t) for t in texts)) if len(texts) > 1 else max(1, len(texts[0]))
            vectors, mask = np.zeros((len(texts), size, 2)), np.zeros((len(texts), size))
            for i, t in enumerate(texts):
                for k, c in enumerate(t):
                    vectors[i, k], mask[i, k] = (ord(c), len(calls)), c != " "
            return vectors, mask

        return model

    texts = [(i, "ab c"[: i % 5] or None) for i in range(10)]
    got = {r.id: r.embedding for r in models.embed_batches(spark.createDataFrame(texts, "id long, t string").coalesce(1), "id", "t", load, batch=4).collect()}
    for i, t in texts:
        codes = [ord(c) for c in (t or "") if c != " "]
        assert got[i] == ([sum(codes) / len(codes), i // 4 + 1] if codes else [0.0, 0.0])


def test_sample_falls_back_when_draws_run_short(spark, monkeypatch):
    """With draws that all lie high, the limit lets too few through; the sample is the same as without a limit."""
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(600)], "id long, level string")
    real = sampling.draw
    high = lambda seed, *keys: F.concat(F.lit("ffffffff"), real(seed, *keys))
    monkeypatch.setattr(sampling, "draw", high)
    got = {r.id for r in sampling.stratified_sample(df, "id", ["level"], 30, "x").collect()}
    want = set()
    for s in range(3):
        ids = sorted((hashlib.md5(f"x|{i}".encode()).hexdigest(), i) for i in range(600) if i % 3 == s)
        want |= {i for _, i in ids[:10]}
    assert got == want
