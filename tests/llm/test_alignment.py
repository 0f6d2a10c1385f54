"""Token alignment against plain loops over the public libraries' tokens."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talkmill.llm import alignment, queries

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  two  spaces ", "a", "<|endoftext|> and </s><s><unk>", "a▁b", "▁", "ﬁ é é ​", "😀👩‍👩‍👧 ok", "\x00\x01", "tab\tline\n\n\r\nend", " " * 3000 + "x" + "\n" * 2500,
    "=" * 5000, "a" * 20000, "word " * 3000, "汉字仮名한글", "don't we'll I'M", "1234567890123", "﻿bom", "퟿",
]


@pytest.fixture(scope="module")
def libraries():
    whole = Tokenizer.from_file(queries.BYTE_LEVEL)
    whole.encode_special_tokens = True
    return whole, sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)


def tokens(text, libraries):
    """[(id, bytes)] of A and of B, or None."""
    if not text:
        return None
    whole, pieces = libraries
    byte = alignment._printable()
    a = [(i, bytes(byte[c] for c in whole.id_to_token(i))) for i in whole.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:-1], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()) for i in pieces.encode(text) for p in [pieces.id_to_piece(i)]]
    same = b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode()
    return (a, b) if same else None


def plain(a, b):
    """(links, groups) of tokens (id, bytes), by offsets."""
    at = [np.cumsum([0, *(len(x) for _, x in side)]).tolist() for side in (a, b)]
    links, j = [], 0
    for i in range(len(a)):
        while at[1][j + 1] <= at[0][i]:
            j += 1
        k = j
        while k < len(b) and at[1][k] < at[0][i + 1]:
            links.append((i, k))
            k += 1
    groups = [[[], []]]
    shared = set(at[0]) & set(at[1])
    for side, ids in enumerate((a, b)):
        g = 0
        for (i, _), end in zip(ids, at[side][1:], strict=True):
            groups[g][side].append(i)
            if end in shared:
                g += 1
                if g == len(groups):
                    groups.append([[], []])
    return links, groups[:-1]


def want(rows, libraries):
    found, df = [], collections.Counter()
    for i, t in rows:
        both = tokens(t, libraries)
        if both is None:
            found.append((i, None))
            continue
        a, b = both
        links, groups = plain(a, b)
        pairs = [(a[x][0], b[y][0]) for x, y in links]
        df.update(set(pairs))
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        found.append((i, (len(a), len(b), len(groups), pairs, hashlib.sha256(said.encode()).hexdigest())))
    top = collections.Counter()
    for (a, _), n in df.items():
        top[a] = max(top[a], n)
    return sorted(((i, 0, 0, 0, 0, 0, 0, "") if f is None else (i, *f[:3], len(f[3]), sum(df[p] == top[p[0]] for p in f[3]), sum(df[p] for p in f[3]), f[4]) for i, f in found), key=repr)


def got(df, **more):
    found = alignment.alignment_counts(df, queries.BYTE_LEVEL, queries.MODEL, **more)
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found.collect()), key=repr)


def test_lockstep_equals_loops_with_lanes_of_any_length():
    r = random.Random(1)
    a, b, count_a, count_b = [], [], [], []
    for _ in range(30):
        n = r.choice([0, 1, 5, 60])
        sides = []
        for _ in range(2):
            inner = sorted(r.sample(range(1, n), r.randint(0, n - 1))) if n else []
            edges = [0, *inner, n] if n else [0]
            sides.append([y - x for x, y in zip(edges, edges[1:], strict=False)])
        a += sides[0]
        b += sides[1]
        count_a.append(len(sides[0]))
        count_b.append(len(sides[1]))
    a, b, count_a, count_b = (np.array(x, np.int64) for x in (a, b, count_a, count_b))
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    links = {(i, j) for i in range(len(a)) for j in range(len(b)) if ends_a[i] - a[i] < ends_b[j] and ends_b[j] - b[j] < ends_a[i]}
    shared = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    for lane in (1, 2, 7, 1000):
        found = alignment.align(a, count_a, b, count_b, lane)
        assert len(found.link_a) == len(links) and set(zip(found.link_a.tolist(), found.link_b.tolist(), strict=True)) == links
        assert ends_a[found.cut_a].tolist() == ends_b[found.cut_b].tolist() == shared


@pytest.mark.parametrize("most", [alignment.MOST_PAIRS, 300, 0])
def test_counts_equal_plain_ones(spark, libraries, most):
    """With all counts broadcast, some, and none."""
    r = random.Random(3)
    words = "the a of cat dogs running Zebra antidisestablishment naïve 3.14 -- :) über straße".split()
    rows = list(enumerate([*ODD, *(" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(60)), *ODD[4:8]]))
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").withColumns({"row": F.lit(1), "pairs": F.lit(2), "n": F.lit(3), "times": F.lit(4)}).repartition(3)
    assert got(df, most=most) == want(rows, libraries)


def test_tokens_links_and_cuts(spark, libraries):
    rows = list(enumerate(ODD))
    for r in alignment.align_tokens(spark.createDataFrame(rows, "doc_id long, text string"), queries.BYTE_LEVEL, queries.MODEL).collect():
        both = tokens(rows[r.doc_id][1], libraries)
        if both is None:
            assert r.a_ids == r.b_ids == r.link_a == r.link_b == r.cut_a == r.cut_b == []
            continue
        a, b = both
        links, groups = plain(a, b)
        assert (r.a_ids, r.b_ids) == ([i for i, _ in a], [i for i, _ in b])
        assert list(zip(r.link_a, r.link_b, strict=True)) == links
        assert r.cut_a == (np.cumsum([len(g) for g, _ in groups]) - 1).tolist() and r.cut_b == (np.cumsum([len(h) for _, h in groups]) - 1).tolist()


def test_null_ids_repeated_rows_and_empty_tables(spark, libraries, none):
    rows = [(None, "some text"), (None, None), (1, "some text"), (1, "some text"), (2, "other text")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want(rows, libraries)
    assert got(none) == [] and alignment.align_tokens(none, queries.BYTE_LEVEL, queries.MODEL).count() == 0
    assert got(spark.createDataFrame([("x", None)], "doc_id string, text string")) == want([("x", None)], libraries)


def test_long_runs(spark, libraries):
    rows = [(1, " " * 1_000_000), (2, "=" * 1_000_000), (3, "a" * 1_000_000)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want(rows, libraries)


def test_query_over_documents(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in queries.op12_tokenizer_alignment(spark, SF).collect()), key=repr)
    assert found == want(rows, libraries)
