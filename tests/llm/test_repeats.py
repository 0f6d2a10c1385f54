"""Repeated passages against a dictionary of all strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmill.llm import queries, repeats

SF = "/root/testdata/sf0.001"


def masks(texts, size):
    """Plainly: which bytes are covered by a string that starts in two places."""
    seen = {}
    for t in texts:
        for j in range(len(t) - size + 1):
            seen[t[j : j + size]] = seen.get(t[j : j + size], 0) + 1
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for j in range(len(t) - size + 1):
            if seen[t[j : j + size]] > 1:
                m[j : j + size] = True
        out.append(m)
    return out


def want(rows, size):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), t, m in zip(rows, texts, masks(texts, size), strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], m.astype(int), [0]))))
        spans = tuple((int(a), int(b)) for a, b in edges.reshape(-1, 2))
        out.append((i, len(t), int(m.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~m])).hexdigest()))
    return sorted(out, key=repr)


def got(df, size, unit=repeats.UNIT):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, tuple((s.start, s.end) for s in r.spans), r.kept_sha256) for r in repeats.find_repeats(df, size=size, unit=unit).collect()), key=repr)


def mosaic(seed, letters, size, n=15):
    """Texts pieced together from a few others."""
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randint(0, 5 * size))) for _ in range(6)]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(r.randint(0, 4)):
            b = r.choice(base)
            a = r.randint(0, len(b))
            t += b[a : a + r.randint(0, 3 * size)] + "".join(r.choice("xyz") for _ in range(r.randint(0, 3)))
        out.append(t)
    return out


@pytest.mark.parametrize("size", [9, 20, 200])
@pytest.mark.parametrize("letters", ["ab\0c", "abcdefghij", "a"])
def test_transform_finds_every_repeat(size, letters):
    for seed in range(4):
        texts = [t.encode() for t in mosaic(seed, letters, size)]
        for m, t, (s, e) in zip(masks(texts, size), texts, repeats.covered(texts, size), strict=True):
            found = np.zeros(len(t), bool)
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                assert not found[max(0, a - 1) : b].any()
                found[a:b] = True
            assert (found == m).all()


def test_segments_partition_windows_and_equal_windows_share_anchors():
    raw = np.frombuffer("".join(mosaic(3, "abc", 20)).encode() * 2, np.uint8)
    offset = np.array([0, 0, 7, 500, 519, len(raw), len(raw)])
    key = {}
    windows = 0
    for s, w, h, t in zip(*repeats.segments(raw, offset, 20, 7), strict=True):
        windows += w
        assert offset[t] <= s and s + w + 19 <= offset[t + 1]
        for k in range(s, s + w):
            assert key.setdefault(raw[k : k + 20].tobytes(), h) == h
    assert windows == sum(max(0, int(b - a) - 19) for a, b in zip(offset[:-1], offset[1:], strict=True))


def test_blocks_change_nothing(monkeypatch):
    texts = mosaic(5, "abcd", 20) * 2
    raw, offset = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = {(int(s) + k, h) for s, w, h, _ in zip(*repeats.segments(raw, offset, 20, 7), strict=True) for k in range(w)}
    monkeypatch.setattr(repeats, "BLOCK", 50)
    assert {(int(s) + k, h) for s, w, h, _ in zip(*repeats.segments(raw, offset, 20, 7), strict=True) for k in range(w)} == whole


@pytest.mark.parametrize("unit", [1 << 20, 3000, 60])
def test_rows_equal_brute_force(spark, unit):
    """Units from all at once to almost one string each, so that hot anchors go through every level."""
    texts = mosaic(11, "abcdeé", 20, 40)
    rows = list(enumerate(texts + texts[:3] + [None, "", "a" * 300, "aé" * 10, "b" * 20, "b" * 19]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"md5": F.lit(1), "n": F.lit(2), "spans": F.lit("x"), "kept": F.lit(0)}).repartition(3)
    assert got(df, 20, unit) == want(rows, 20)
    kept = {r.doc_id: bytes(r["_kept"]) for r in repeats.cut_repeats(df, size=20, unit=unit).collect()}
    assert {i: hashlib.sha256(k).hexdigest() for i, k in kept.items()} == {w[0]: w[4] for w in want(rows, 20)}
    assert repeats.cut_repeats(df, size=20).columns == [*df.columns, "_kept"]


def test_a_passage_in_a_third_of_rows(spark):
    """Each row has the passage between words of its own, so the passage's edges are as many texts under one anchor."""
    r = random.Random(2)
    passage = "".join(r.choice("abcdefgh ") for _ in range(260))
    own = lambda: "".join(r.choice("ijklmnop ") for _ in range(150))
    rows = [(i, own() + (passage if i % 3 == 0 else own()) + own()) for i in range(300)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 200, 5000) == want(rows, 200)


def test_repeated_rows_null_ids_and_empty_tables(spark, none):
    rows = [(1, "x" * 50 + "abcdefghijklmnopqrstuv"), (1, "x" * 50 + "abcdefghijklmnopqrstuv"), (None, "abcdefghijklmnopqrstuv123"), (None, "q"), (2, "q")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 20) == want(rows, 20)
    assert repeats.find_repeats(none).count() == 0 and repeats.cut_repeats(none).count() == 0
    assert got(spark.createDataFrame([("a", "t" * 30)], "doc_id string, text string"), 20) == want([("a", "t" * 30)], 20)


def test_long_texts(spark):
    """A run of one byte, and a text of some MB that holds itself twice."""
    r = random.Random(9)
    half = "".join(r.choice("abcdefghijklmnop") for _ in range(700_000))
    rows = [(1, "=" * 1_000_000), (2, half + "|" + half), (3, half[:199]), (4, half[1000:1200])]
    found = {x[0]: x[1:4] for x in got(spark.createDataFrame(rows, "doc_id long, text string"), 200)}
    assert found[1] == (1_000_000, 1_000_000, ((0, 1_000_000),))
    assert found[2] == (1_400_001, 1_400_000, ((0, 700_000), (700_001, 1_400_001)))
    assert found[3][1] == 0 and found[4] == (200, 200, ((0, 200),))


def test_query_over_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op11_suffix_array_dedup(spark, SF).collect()), key=repr)
    assert found == [(i, n, k, len(s), h) for i, n, k, s, h in want(rows, 200)]
