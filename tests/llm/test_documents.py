"""Operators on documents against plain Python."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkmill.llm import common, exact, licenses, mixing, near, queries, toxicity
from talkmill.llm.tokens import count_tokens, with_token_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_groups(docs, none):
    rows = [(r.doc_id, (r.text or "").translate(LOWER)) for r in docs.collect()]
    for keep, best in (("max", max), ("min", min)):
        got = {r.doc_id: r for r in exact.exact_groups(docs, keep=keep).collect()}
        for i, t in rows:
            same = [j for j, u in rows if u == t]
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best(same), len(same), i == best(same), hashlib.sha256(t.encode()).hexdigest())
        assert len(got) == len(rows)
        assert sorted(r.doc_id for r in exact.drop_exact(docs, keep=keep).collect()) == sorted({best([j for j, u in rows if u == t]) for _, t in rows})
    assert exact.exact_groups(none).count() == 0 and exact.drop_exact(none).count() == 0
    assert exact.drop_exact(docs).columns == docs.columns


def test_exact_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "b"), (None, "c")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(df).collect()), key=str) == sorted([(1, 1, 2, True), (1, 1, 2, True), (2, 2, 2, True), (None, 2, 2, False), (None, None, 1, True)], key=str)
    assert sorted((str(r.doc_id), r.text) for r in exact.drop_exact(df).collect()) == [("1", "a"), ("2", "b"), ("None", "c")]


def test_exact_compares_bytes_where_hashes_collide(spark, monkeypatch):
    """With a hash that knows only the first letter, and with tables too large to broadcast."""
    real = exact._hashed
    monkeypatch.setattr(exact, "_hashed", lambda *a: real(*a).withColumn("md5", F.md5(F.left("norm", F.lit(1)))))
    rows = [(1, "ab"), (2, "AB"), (3, "ac"), (4, "ac"), (5, "ad"), (6, "x"), (7, "x"), (8, "y"), (9, None), (10, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for i, t in rows:
        want.setdefault((t or "").lower(), []).append(i)
    want = {i: (max(g), len(g)) for g in want.values() for i in g}
    for limit in (10**6, 0):
        monkeypatch.setattr(common, "BROADCAST_GROUPS", limit)
        monkeypatch.setattr(common, "HOT", 2)
        assert {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_groups(df, keep="max").collect()} == want
    monkeypatch.setattr(exact, "_hashed", real)
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_groups(df, keep="max").collect()} == want


def test_drop_exact_with_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "a", 1, 5), (1, "A", 2, 6), (1, "a", 1, 5), (2, "b", 3, 7), (3, "b", 4, 8), (None, "c", 5, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, md5 long").withColumn("norm", F.lit(1)).withColumn("best", F.lit(2)).withColumn("place", F.lit(3))
    got = exact.drop_exact(df, keep="max")
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.text, r.n) for r in got.collect()) == [("1", "A", 2), ("3", "b", 4), ("None", "c", 5)]


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_components(rows, n, percent):
    sets = {i: shingle_set(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_components(docs, none, words, percent):
    plan = near.Plan(words=words, percent=percent)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], words, percent)
    got = near.near_components(docs, plan=plan).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near.near_components(none, plan=plan).count() == 0
    left = near.drop_near(docs, plan=plan)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_near_components_of_one_large_cluster(spark):
    """Chains of edits, in tiles far smaller than their cluster."""
    random.seed(1)
    text = [f"t{i}" for i in range(90)]
    rows = []
    for i in range(70):
        if i % 7 == 0:
            text[random.randrange(90)] = f"n{i}"
        own = list(text)
        own[random.randrange(90)] = f"o{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plan = near.Plan(words=3, percent=85)
    got = {r.doc_id: r.component_id for r in near.near_components(df, plan=plan, tile=6).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 3, 85).items()}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_near_components_of_a_long_chain(spark, monkeypatch, limit):
    """Each text is like its neighbours only; boilerplate that many share links nothing; units grow with neighbours."""
    monkeypatch.setattr(near, "BROADCAST_GROUPS", limit)
    monkeypatch.setattr(common, "BROADCAST_GROUPS", limit)
    monkeypatch.setattr(common, "HOT", 3)
    random.seed(7)
    words = [f"c{i}" for i in range(1200)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 90])) for i in range(150)]
    shared = [f"b{i}" for i in range(30)]
    rows += [(1000 + i, " ".join(shared + [f"x{i}_{k}" for k in range(30)])) for i in range(80)]
    rows += [(2000 + i, rows[i % 5][1]) for i in range(30)]
    seen = []
    real = near._residue
    monkeypatch.setattr(near, "_residue", lambda members, *a: seen.append(members.count()) or real(members, *a))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near.near_components(df, plan=near.Plan(words=3, percent=80), tile=8).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 3, 80).items()} and len({got[i] for i in range(150)}) == 1
    assert sum(seen) <= 80 * 32


def test_near_where_labels_meet_in_buckets(spark):
    """Families whose members are near to some of each other only, so that buckets hold several labels."""
    random.seed(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        own = list(base)
        for k in random.sample(range(60), random.choice([0, 1, 2, 3, 4])):
            own[k] = f"z{i}_{k}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (5, 256):
        got = {r.doc_id: r.component_id for r in near.near_components(df, plan=near.Plan(words=1, percent=92), tile=tile).collect()}
        assert got == {i: c for i, (_, c) in brute_components(rows, 1, 92).items()}


def test_near_estimate_follows_the_similarity():
    plan = near.Plan(words=3, percent=85)
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 62, 400, dtype=np.uint64)
    for share in (0.0, 0.1, 0.3):
        other = base.copy()
        other[: int(400 * share)] = rng.integers(1, 1 << 62, int(400 * share), dtype=np.uint64)
        keys, odd = near._sketches(near._signatures([base, other], plan.bands * plan.rows), plan)
        bits = np.bitwise_count(odd[0] ^ odd[1]).sum()
        true = 1 - (1 - share) / (1 + share)
        assert abs(plan.differing(bits) / (plan.bands * plan.rows) - true) < 0.15
    assert plan.differing(0) == 0 and plan.most_differing < plan.bands * plan.rows * 0.5


def test_near_where_an_id_has_several_texts(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (4, c), (5, c + " more")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near.near_components(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_near_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(2, "a b c d"), (2, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near.near_components(df).collect()), key=str)
    assert got == sorted([(2, 1, False), (2, 1, False), (1, 1, True), (None, None, True), (None, None, True)], key=str)


def test_components(spark):
    random.seed(2)
    edges = [(i + 1, i) for i in range(40)] + [(random.randrange(100, 160), random.randrange(100, 160)) for _ in range(40)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {x: root(x) for x in parent}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_words_equal_the_pattern():
    random.seed(3)
    texts = [None, "", "  ", "a", "É B\tc\x0b\x0cd\x1fe f", *("".join(random.choice("aB0 \t\né.-漢") for _ in range(30)) for _ in range(50))]
    for table, pattern in ((common.SPACED, r"[^\x20\x09-\x0D]+"), (common.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = common.split_words(pa.array(texts, pa.string()), table)
        for i, t in enumerate(texts):
            mine = [w.bytes[a:b].tobytes().decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
            assert mine == re.findall(pattern, (t or "").translate(LOWER))
        words = {}
        for h, a, b in zip(common.hash_words(w), w.start, w.end, strict=True):
            assert words.setdefault(w.bytes[a:b].tobytes(), h) == h
        assert len(set(words.values())) == len(words)


def brute_segments(scores):
    """All maximal segments by definition: the best one (first and shortest of equals), then those left and right of it."""
    if not any(s > 0 for s in scores):
        return []
    best = max(((round(sum(scores[i:j]), 9), -i, -j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    i, j = -best[1], -best[2]
    i, j = min(((i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1) if abs(sum(scores[i:j]) - best[0]) < 1e-9), key=lambda x: (x[0], x[1]))
    return brute_segments(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(scores[j:])]


def test_segments_are_maximal():
    random.seed(4)
    for _ in range(200):
        scores = [round(random.uniform(-2, 1.5), 6) for _ in range(random.randrange(0, 18))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(scores))] == brute_segments(scores)


def test_toxicity_learns_and_is_told_apart(spark, docs, none):
    random.seed(5)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        said = random.choices(words, k=40)
        bad = i % 6 == 0
        if bad:
            said[5:5] = random.choices(["foul", "vileish", "vilest", "vilely"], k=3)
        rows.append((i, " ".join(said)))
        labels.append((i, int(bad)))
    df, lf = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = {r.doc_id: r for r in toxicity.score_toxicity(df, lf, train=F.col("doc_id") % 4 != 2).collect()}
    held = [i for i in range(600) if i % 4 == 2]
    assert sum(scored[i].predicted == (i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored.values())
    for i in held:
        for p in scored[i].passages:
            said = rows[i][1].split()[p.start : p.end]
            assert any(w.startswith(("foul", "vile")) for w in said)
    kept = toxicity.drop_toxic(df, lf)
    assert kept.columns == df.columns and 480 <= kept.count() <= 515
    # Texts without evidence, labels of one kind, no labels, no rows.
    odd = {r.doc_id: r for r in toxicity.score_toxicity(docs, lf).collect()}
    assert odd[3].score == odd[4].score == odd[5].score and odd[3].predicted == 0 and len(odd) == docs.count()
    assert toxicity.score_toxicity(docs, lf.where("toxic = 0")).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(docs, lf.where("toxic > 5")).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(none, lf).count() == 0


def test_licenses(spark, docs, none):
    texts = [None, "", "MIT License", "the Apache  License, and cc-by, cc by", "GNU General Public License mit license license", "no licence", "# SPDX-License-Identifier: (Apache-2.0 OR MIT) AND GPL-2.0-only WITH Classpath-exception-2.0 is what holds", "SPDX-License-Identifier: LicenseRef-x\n"]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        places = sorted((i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert rows[6].labels == "apache,gpl,mit" and rows[7].labels == "licenseref-x"
    assert rows[6].expressions == ["(apache-2.0 or mit) and gpl-2.0-only with classpath-exception-2.0"] and rows[6].required == "gpl"
    assert rows[6].options == ["apache-2.0+gpl-2.0-only with classpath-exception-2.0 | gpl-2.0-only with classpath-exception-2.0+mit"]
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(none).count() == 0


@pytest.mark.parametrize(
    "text,postfix", [("mit", "mit"), ("mit or apache-2.0 and bsd", "mit apache-2.0 bsd and or"), ("(mit or isc) and x", "mit isc or x and"), ("a with b or c", "a b with c or"), ("mit or", "mit"), ("and mit", None), ("", None), ("mit is fine", "mit"), ("(mit", None), ("mit)", "mit")]
)
def test_shunting_yard(text, postfix):
    got = licenses.parse_expression(text)
    assert (got and " ".join(got)) == postfix


def test_expression_choices():
    got = licenses.evaluate(licenses.parse_expression("(mit or isc) and gpl with x"))
    assert got.choices == {frozenset({"mit", "gpl with x"}), frozenset({"isc", "gpl with x"})}
    assert (got.need, got.may, got.text) == ({"gpl with x"}, {"mit", "isc", "gpl with x"}, "(mit or isc) and gpl with x")


@pytest.mark.parametrize("seed", range(30))
def test_expressions_equal_their_truth_table(seed):
    """A set of licences satisfies an expression just when it holds one of its choices."""
    random.seed(seed)

    def grow(depth):
        if depth == 0 or random.random() < 0.2:
            return random.choice("abcd")
        return f"({grow(depth - 1)} {random.choice(['and', 'or'])} {grow(depth - 1)})"

    said = grow(4)
    got = licenses.evaluate(licenses.parse_expression(said))
    for k in range(16):
        held = {c for i, c in enumerate("abcd") if k >> i & 1}
        assert eval(re.sub(r"\b[a-d]\b", lambda m: str(m[0] in held), said)) == any(c <= held for c in got.choices)
    assert got.need == frozenset.intersection(*got.choices) and licenses.evaluate(licenses.parse_expression(got.text)).choices == got.choices


def test_long_licence_lines_take_time_in_proportion():
    """Some 1 MB each, of one licence and of as many as there are operands, in chains, choices and brackets."""
    import time

    n = 70_000
    cases = [
        (" and ".join(["mit"] * n), 1, 1), (" and ".join(f"l-{i}" for i in range(n)), n, n), (" or ".join(f"l-{i}" for i in range(n)), 0, n), ("(" * n + "mit" + ")" * n, 1, 1),
        (" or ".join(f"l-{i} with e and b" for i in range(n // 2)), 1, n // 2 + 1), ("mit " + "and (" * n, 1, 1),
    ]
    for said, need, may in cases:
        began = time.process_time()
        got = licenses.evaluate(licenses.parse_expression(said))
        assert (len(got.need), len(got.may)) == (need, may)
        assert time.process_time() - began < 5


def test_choices_are_listed_as_far_as_one_asks(spark):
    said = "SPDX-License-Identifier: " + " OR ".join(f"lic-{i}" for i in range(100))
    df = spark.createDataFrame([(1, said)], "doc_id long, text string")
    few, many = (licenses.scan_licenses(df, most_choices=m).first() for m in (64, 128))
    assert few.options == [""] and len(many.options[0].split(" | ")) == 100 and few.labels == many.labels


def test_choices_change_what_is_asked_for(spark):
    said = ["MIT OR GPL-2.0", "MIT AND GPL-2.0", " AND ".join(f"(a{i} OR b{i})" for i in range(30))]
    rows = licenses.scan_licenses(spark.createDataFrame([(i, f"SPDX-License-Identifier: {s}") for i, s in enumerate(said)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (rows[0].options, rows[0].required) == (["gpl-2.0 | mit"], "") and (rows[1].options, rows[1].required) == (["gpl-2.0+mit"], "gpl,mit")
    assert rows[0].labels == rows[1].labels == "gpl,mit" and rows[0].score < rows[1].score
    assert rows[2].options == [""] and len(rows[2].labels.split(",")) == 60
    assert [licenses.family(x) for x in ("gpl-2.0-or-later", "bsd-3-clause", "cc-by-sa-4.0", "apache-2.0", "mit-0", "zlib", "mpl-2.0-no-copyleft-exception", "gpl+")] == ["gpl", "bsd", "cc-by-sa", "apache", "mit", "zlib", "mpl", "gpl"]


def test_mixing(spark, docs, none):
    rows = [(i, "big" if i < 300 else "mid" if i < 380 else None, "a b c d " + "x " * (i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    tokens = {i: t.count(" ") + 1 for i, _, t in rows}
    total = sum(tokens.values())
    mixed = mixing.mix_sources(df, entropy=0.95, repeats=2.0, blocks=16)
    got = mixed.groupBy("source").agg(F.sum("__tokens").alias("t"), F.max("__epoch").alias("e")).collect()
    out = {r.source: r.t for r in got}
    share = [t / sum(out.values()) for t in out.values()]
    assert abs(sum(out.values()) - total) <= 30 and max(r.e for r in got) <= 3
    assert all(out[s] <= 2.05 * sum(tokens[i] for i, x, _ in rows if x == s) + 10 for s in out)
    natural = [sum(tokens[i] for i, x, _ in rows if x == s) / total for s in out]
    entropy = lambda p: -sum(x * math.log(x) for x in p)
    assert entropy(natural) < entropy(share) <= 0.96 * math.log(3)
    # A document comes once in each whole pass, and at most once in the last one.
    assert mixed.groupBy("doc_id", "__epoch").count().where("count > 1").count() == 0
    assert mixed.drop("__tokens", "__epoch", "__at").columns == df.columns
    plain = mixing.mix_sources(df, entropy=None, repeats=None, blocks=16)
    assert sorted(r.doc_id for r in plain.collect()) == list(range(400))
    odd = mixing.mix_sources(docs, source="norm", entropy=0.9)
    assert odd.drop("__tokens", "__epoch", "__at").columns == docs.columns and odd.count() == docs.count()
    assert mixing.mix_sources(none, source="norm").count() == 0
    empty = mixing.mix_sources(docs.where("doc_id in (3, 4)"), source="norm")
    assert empty.count() == 2


def plain_mix(rows, budget, entropy, repeats, blocks, seed="mix"):
    """The draws of mix_sources in plain Python, the exponent by bisection: {(doc_id, text): copies}. rows: (doc_id, source, text, tokens)."""
    import xxhash

    def h(*values):
        at = 42
        for x in values:
            if x is not None:
                raw = x.encode() if isinstance(x, str) else int(x).to_bytes(4 if isinstance(x, bool) else 8, "little", signed=True)
                at = xxhash.xxh64_intdigest(raw, at)
        return at - (1 << 64) if at >= 1 << 63 else at

    held, sizes = {}, {}
    for r in rows:
        key = (r[1] is None, r[1] or "")
        block = h(seed, r[0], r[2]) % blocks
        held.setdefault(key, {}).setdefault(block, []).append(r)
        sizes[key] = sizes.get(key, 0) + r[3]
    total = sum(sizes.values())
    share = {k: s / total for k, s in sizes.items() if s}

    def weights(x):
        z = sum(p**x for p in share.values())
        return {k: p**x / z for k, p in share.items()}

    def bisect(good):
        low, high = 0.0, 1.0
        if good(0.0):
            return 0.0
        if not good(1.0):
            return 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if good(middle) else (middle, high)
        return high

    wanted = bisect(lambda x: -sum(w * math.log(w) for w in weights(x).values()) <= entropy * math.log(len(share)) + 1e-12)
    limit = bisect(lambda x: max(budget * total * w / sizes[k] for k, w in weights(x).items()) <= repeats)
    w = weights(max(wanted, limit))
    out = {}
    for key, of in held.items():
        drawn = round(w[key] * budget * total) if sizes[key] else 0
        passes, room = divmod(drawn, sizes[key]) if sizes[key] else (1, 0)
        for block in sorted(of, key=lambda b: (h(seed, *key, b), b)):
            for r in sorted(of[block], key=lambda r: (h(f"{seed} inside", r[0], r[2]), r[0])):
                out[r[0], r[2]] = out.get((r[0], r[2]), 0) + passes + (room > 0)
                room -= r[3]
    return {k: n for k, n in out.items() if n}


@pytest.mark.parametrize("entropy,repeats", [(0.95, 2.0), (0.9, 10.0), (0.99, 1.3)])
def test_mixing_equals_plain_draws(spark, entropy, repeats):
    random.seed(5)
    rows = [(i, random.choices(["big", "mid", "small", None, "bare"], [60, 25, 8, 4, 3])[0], f"text {i % 180} é") for i in range(400)]
    rows = [(i, s, t, 0 if s == "bare" else random.randrange(0, 40)) for i, s, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, k long")
    got = mixing.mix_sources(df, entropy=entropy, repeats=repeats, blocks=16, tokens="k")
    counts = {(r.doc_id, r.text): r.n for r in got.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    assert counts == plain_mix(rows, 1.0, entropy, repeats, 16)


def test_mixing_leaves_clashing_columns_alone(spark):
    df = spark.createDataFrame([(i, "s", "a b") for i in range(9)], "doc_id long, source string, text string")
    for c in ("__block", "__key", "__plan", "__copies", "size"):
        df = df.withColumn(c, F.lit(777))
    got = mixing.mix_sources(df)
    assert got.columns == [*df.columns, "__tokens", "__epoch", "__at"] and got.where("`__block` = 777 and `__copies` = 777 and `__key` = 777").count() == 9
    with pytest.raises(ValueError):
        mixing.mix_sources(df.withColumn("__AT", F.lit(1)))


def test_mixing_by_token_counts(spark):
    """Lines and unspaced texts weigh by their tokens, repeated ids by their own texts."""
    rows = [(i % 90, "lines" if i % 2 else "spaced", ("\n" if i % 2 else " ").join(["word"] * 10)) for i in range(200)] + [(500, "lines", None), (501, "spaced", "")]
    counted = with_token_counts(spark.createDataFrame(rows, "doc_id long, source string, text string"), queries.MODEL, "__n")
    want = {(r.doc_id, r.n_tokens) for r in count_tokens(counted, queries.MODEL).collect()}
    assert {(r.doc_id, r["__n"]) for r in counted.collect()} == want and counted.count() == len(rows)
    drawn = {r.source: r.t for r in mixing.mix_sources(counted, entropy=None, repeats=None, blocks=16, tokens="__n").groupBy("source").agg(F.sum("__tokens").alias("t")).collect()}
    assert drawn == {r.source: r.t for r in counted.groupBy("source").agg(F.sum("__n").alias("t")).collect()} and drawn["lines"] > 900
    made = {r.doc_id: r.n_tokens for r in queries.op8_source_mixing(spark, "/root/testdata/sf0.001").collect()}
    op7 = {r.doc_id: r.n_tokens for r in queries.op7_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert made and all(op7[i] == n for i, n in made.items())


def test_chance_law_is_that_of_exponential_excesses():
    rng = np.random.default_rng(3)
    rate, decay = toxicity.chance_law(1 + rng.exponential(1 / 2.5, 4000), 1_000_000)
    assert decay == pytest.approx(2.5, rel=0.1) and rate * math.exp(-decay) == pytest.approx(4001 / 1_000_000)
    assert toxicity.chance_law(np.zeros(0), 0) == (pytest.approx(math.e), 1.0)


def test_toxicity_learns_from_one_text_of_a_repeated_id(spark):
    clean, bad = "the sun is warm and bright today", "you vile scum rotten filth"
    rows = [(i, f"{bad if i % 2 else clean} word{i}") for i in range(60)] + [(1, f"{bad} again")] * 50 + [(None, bad), (100, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score_toxicity(df, labels).collect()
    assert len(got) == len(rows) and all(r.predicted == (r.doc_id % 2 if r.doc_id is not None and r.doc_id < 60 else int(r.doc_id is None)) for r in got)
    named = df.withColumn("toxic", F.lit("x")).withColumn("score", F.lit("y"))
    assert toxicity.drop_toxic(named, labels).columns == named.columns


def test_mix_without_texts_and_with_late_counts(spark):
    """Hashes instead of texts, and counts asked for only where a budget ends, draw the same rows; one source has most of them."""
    random.seed(12)
    rows = [(i, "hot" if i % 10 else random.choice(["a", None]), " ".join(["w"] * random.randrange(0, 30))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plain = mixing.mix_sources(df, entropy=0.9, repeats=2.0, blocks=4)
    outer, inner = mixing.mix_hashes(F.col("doc_id"), F.col("text"))
    narrow = df.select("doc_id", "source", mixing.token_length(F.col("text")).alias("k"), outer.alias("o"), inner.alias("i"))
    asked = []

    def counted(part, name):
        asked.append(part)
        return part.withColumn(name, mixing.token_length(F.col("text")))

    by_hash = mixing.mix_sources(narrow, entropy=0.9, repeats=2.0, blocks=4, tokens="k", hashes=("o", "i"))
    late = mixing.mix_sources(df, entropy=0.9, repeats=2.0, blocks=4, counted=counted)
    keep = lambda d: sorted(tuple(r) for r in d.select("doc_id", "__epoch", "__at").collect())
    assert keep(plain) == keep(by_hash) == keep(late)
    assert late.columns == [*df.columns, "__epoch", "__at"] and len(asked) == 2 and asked[1].count() < df.count()


def test_sieve_lets_all_wanted_rows_through_and_few_others(spark):
    rows = spark.range(50_000).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("key"), F.lit("text").alias("text"))
    wanted = rows.where("id % 41 = 0").select("key")
    for key in ("key", "id"):
        keys = wanted if key == "key" else rows.where("id % 41 = 0").select("id")
        left = common.sifted(rows, keys, key)
        assert left.columns == rows.columns and left.join(keys, key).count() == keys.count() == 1220 and left.count() < 1300
    assert common.sifted(rows, wanted.where("key is null"), "key").count() == 0


def test_tables_are_broadcast_by_rows_and_bytes(spark, monkeypatch):
    """A table of few rows with long keys goes by shuffle, with the same result."""
    groups = spark.range(50).select(F.concat(F.repeat(F.lit("x"), 2000), F.col("id").cast("string")).alias("key"), F.lit(2).cast("long").alias("n")).cache()
    rows = spark.range(200).select("id", F.concat(F.repeat(F.lit("x"), 2000), (F.col("id") % 60).cast("string")).alias("key"))
    want = sorted(((r.id, r.n) for r in common.with_groups(rows, groups, "key").collect()), key=repr)
    assert common.fits(groups)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 50_000)
    assert not common.fits(groups) and sorted(((r.id, r.n) for r in common.with_groups(rows, groups, "key").collect()), key=repr) == want
    assert common.fits(groups.where("n < 0"))
