"""Encoding against the public library, plain dynamic programming and round trips."""

import functools
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from talkmill.llm import pieces, tokens

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def samples():
    random.seed(9)
    fixed = ["", " ", "  ", "\n", "a", " a", "a ", "Hello, world! It isn't.", "日本語のテキスト", "naïve café déjà-vu", "😀é́\x00\x01", "x" * 400, " " * 70, "-" * 50, "    def f(x):\n\treturn x**2", "a▁b"]
    return fixed + ["".join(random.choice("abcdeéß tionthe  \n漢字.") for _ in range(random.randrange(1, 200))) for _ in range(300)]


def test_ids_equal_the_library(vocabulary, library):
    ids, count = tokens.Encoder(vocabulary)(pa.array(samples()))
    ends = np.cumsum(count)
    for text, n, end in zip(samples(), count, ends, strict=True):
        assert ids[end - n : end].tolist() == library.encode(text), text


def test_memory_that_forgets_changes_nothing(vocabulary):
    small, large = tokens.Encoder(vocabulary, most=50), tokens.Encoder(vocabulary)
    for i in range(0, len(samples()), 20):
        part = pa.array(samples()[i : i + 20])
        assert all((a == b).all() for a, b in zip(small(part), large(part), strict=True))


def test_every_occurrence_is_an_edge(vocabulary):
    u = tokens.units_of(pa.array(["the theatre other"]), vocabulary)
    start, piece = tokens.Matcher(vocabulary).edges(u.number)
    got = set(zip(start.tolist(), piece.tolist(), strict=True))
    text = u.number.tolist()
    want = {(i, int(p)) for p in np.flatnonzero(vocabulary.length > 1) for i in range(len(text)) if text[i : i + int(vocabulary.length[p])] == vocabulary.text[p].tolist()}
    assert got == want


def test_counts(vocabulary, library):
    bpe, unigram = tokens.Counter(vocabulary)(pa.array(samples()))
    assert bpe.tolist() == [len(library.encode(t)) for t in samples()]
    score = {tuple(t.tolist()): s for t, s, n in zip(vocabulary.text, vocabulary.score, vocabulary.length, strict=True) if n}
    u = tokens.units_of(pa.array(samples()), vocabulary)
    ends = np.append(u.start[1:], len(u.code))
    want = np.zeros(len(samples()), int)
    for a, b, d in zip(u.start, ends, u.doc, strict=True):
        unit = tuple(u.number[a:b].tolist())
        if unit == (pieces.NO_CHAR,):
            want[d] += len(chr(u.code[a]).encode())
            continue
        best = [(0.0, 0)]
        for e in range(1, len(unit) + 1):
            best.append(max((best[s][0] + score[unit[s:e]], best[s][1] - 1) for s in range(max(0, e - 16), e) if unit[s:e] in score))
        want[d] -= best[-1][1]
    assert unigram.tolist() == want.tolist()


def test_encode_and_decode(spark, docs, none, library):
    encoded = tokens.encode(docs, MODEL)
    rows = {r.doc_id: r for r in encoded.collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        assert rows[i].ids == library.encode(t) and rows[i].n_tokens == len(rows[i].ids) and rows[i].round_trip
    assert {r.doc_id: r.text for r in tokens.decode(encoded, MODEL).collect()} == texts
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, MODEL).collect()} == {i: r.n_tokens for i, r in rows.items()}
    assert tokens.encode(none, MODEL).count() == 0 and tokens.count_tokens(none, MODEL).count() == 0
    mark = spark.createDataFrame([(1, "a▁b")], "doc_id long, text string")
    assert not tokens.encode(mark, MODEL).first().round_trip and tokens.decode(tokens.encode(mark, MODEL), MODEL).first().text == "a b"
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.text for r in tokens.decode(nulls, MODEL).collect()] == ["", ""]


def test_pairs_side_by_side(vocabulary, library):
    """compatible() against merging the two texts."""

    @functools.cache
    def merged(text):
        score = {library.id_to_piece(i): library.get_score(i) for i in range(259, library.get_piece_size())}
        return score, text

    score = merged("")[0]
    random.seed(10)
    usable = [i for i in range(259, len(vocabulary.rank)) if vocabulary.length[i]]
    one, other = np.array(random.choices(usable[:4000], k=400)), np.array(random.choices(usable[:4000], k=400))
    got = pieces.compatible(vocabulary, one, other)
    for a, b, g in zip(one.tolist(), other.tolist(), got, strict=True):
        left, right = library.id_to_piece(a), library.id_to_piece(b)
        steps = pieces._merged(left + right, score)
        assert g == ([s[0] for s in steps if s[1] == ""] == [left, right]), (left, right)


def test_long_runs_without_spaces(library):
    """Blocks and mended seams give the library's ids, whatever the text; a million characters take seconds."""
    import time

    v = pieces.load_vocabulary(MODEL)
    encoder, counter = tokens.Encoder(v), tokens.Counter(v)
    random.seed(4)
    words = "the quick brown fox jumps over lazy dogs information international understanding".split()
    texts = ["".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (511, 512, 513, 1025, 30000)]
    texts += ["".join(random.choice(words) for _ in range(2000)), "ab" * 5000, "a" * 3000, "漢字かな" * 700, "".join(random.choice("abc漢́😀") for _ in range(4000)), "x" * 600 + "  " + "y" * 700]
    ids, n = encoder(pa.array(texts))
    at = 0
    for t, k in zip(texts, n.tolist(), strict=True):
        assert ids[at : at + k].tolist() == library.encode(t)
        at += k
    assert counter(pa.array(texts))[0].tolist() == n.tolist()
    million = "".join(random.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1_000_000))
    began = time.time()
    assert encoder(pa.array([million]))[0].tolist() == library.encode(million)
    assert time.time() - began < 60


@pytest.mark.parametrize("size", [16, 23, 64])
def test_blocks_of_any_size(library, monkeypatch, size):
    """Small blocks, so that many seams need mending, some over and over; best paths against a plain DP."""
    monkeypatch.setattr(tokens, "LONG", size)
    monkeypatch.setattr(tokens, "SIDE", 3)
    v = pieces.load_vocabulary(MODEL)
    random.seed(size)
    texts = ["".join(random.choice(a) for _ in range(random.randrange(1, 400))) for a in ("abcdefghij", "etaoin", "ABCabc123", "thean") for _ in range(15)]
    ids, n = tokens.Encoder(v)(pa.array(texts))
    bpe, best = tokens.Counter(v)(pa.array(texts))
    score = {library.id_to_piece(i): library.get_score(i) for i in range(library.get_piece_size()) if v.length[i]}
    at = 0
    for t, k, b, u in zip(texts, n.tolist(), bpe.tolist(), best.tolist(), strict=True):
        assert ids[at : at + k].tolist() == library.encode(t) and b == k
        at += k
        said = "▁" + t
        state = [(0.0, 0)]
        for e in range(1, len(said) + 1):
            state.append(max((state[s][0] + score[said[s:e]], state[s][1] - 1) for s in range(max(0, e - 16), e) if said[s:e] in score))
        assert u == -state[-1][1]


def test_units_of_one_hash_are_told_apart(library, monkeypatch):
    """With a hash that knows only a unit's length, ids and counts are still right."""
    v = pieces.load_vocabulary(MODEL)
    real = tokens.units_of

    def weak(texts, v):
        u = real(texts, v)
        return u._replace(hash=np.diff(np.append(u.start, len(u.code))).astype(np.uint64))

    monkeypatch.setattr(tokens, "units_of", weak)
    encoder, counter = tokens.Encoder(v), tokens.Counter(v)
    for texts in (["one two six ten", "the cat sat on a mat"], ["red fox é ran far", "one", "sixteen"]):
        ids, n = encoder(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in library.encode(t)] and counter(pa.array(texts))[0].tolist() == n.tolist()


def test_runs_of_a_few_characters(library):
    """A million times one character, and runs within other text, in seconds and as the library has it."""
    import time

    v = pieces.load_vocabulary(MODEL)
    rng = random.Random(1)
    words = "".join(rng.choice("abcdefgh") for _ in range(900))
    texts = [
        "a" * 1000, "=" * 3000, "ab" * 2000, "-=-" * 900, "x" * 700 + "hello" + "=" * 900 + "end", "a" * 5000 + "b" * 5000, "abc" * 300 + "abcabd" * 300, "." * 513, "é" * 2000, "0" * 1025, "hello" * 400, " " * 800,
        "Z" * 300 + words + "=" * 257 + "q", "12" * 1000 + "3", words + "y" * 255 + words, words + "y" * 256 + words, "\u2581" * 600, "12345678" * 200, "123456789" * 200,
    ]
    ids, n = tokens.Encoder(v)(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in library.encode(t)] and tokens.Counter(v)(pa.array(texts))[0].tolist() == n.tolist()
    for text in ("a" * 1_000_000, "=" * 1_000_000):
        began = time.process_time()
        ids, n = tokens.Encoder(v)(pa.array([text]))
        assert ids.tolist() == library.encode(text) and tokens.Counter(v)(pa.array([text]))[0].tolist() == n.tolist()
        assert time.process_time() - began < 60


def test_counter_without_unigrams_counts_the_same(library):
    v = pieces.load_vocabulary(MODEL)
    rng = random.Random(4)
    texts = ["".join(rng.choice("etaoin shrdlu,.\n1") for _ in range(rng.randrange(0, 900))) for _ in range(40)] + ["z" * 700, "", "é▁x"]
    assert tokens.Counter(v, unigram=False)(pa.array(texts))[0].tolist() == tokens.Counter(v)(pa.array(texts))[0].tolist() == [len(library.encode(t)) if t else 0 for t in texts]


def test_decode_odd_lists(spark, library):
    rows = [(None, [5, 6]), (1, None), (1, None), (2, []), (3, library.encode("a long list ") * 30_000), (4, [None])][:5]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumn("text", F.lit(1))
    got = sorted(((r.doc_id, r.text) for r in tokens.decode(df, MODEL).collect()), key=repr)
    assert got == sorted(((i, library.decode(x) if x else "") for i, x in rows), key=repr)
    assert tokens.decode(df.where("doc_id < 0"), MODEL).count() == 0


def test_counting_keeps_no_memory_after_a_task():
    """A worker goes on to other stages' tasks: what a task has needed at its peak must not stay. In a process of its own, as a worker is one."""
    code = f"""
import random
import re
import pyarrow as pa
from talkmill.llm import pieces, tokens

def own():
    return sum(map(int, re.findall(r"Pss_Anon: +(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

v = pieces.load_vocabulary({MODEL!r})
random.seed(1)
texts = [" ".join("".join(random.choices("etaoinshrdlu", k=random.randrange(3, 9))) for _ in range(150)) for _ in range(3000)]
count = tokens.counted(v)
list(count(iter([pa.array(["a b"])])))
before = own()
n = sum(len(x) for x in count(pa.array(texts[i : i + 500]) for i in range(0, len(texts), 500)))
print(n, own() - before)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    n, more = said.split()
    assert int(n) == 3000
    assert float(more) < 40
