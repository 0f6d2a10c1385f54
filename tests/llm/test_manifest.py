"""The Merkle manifest against a tree of lists."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from talkmill.llm import common, manifest, oracles, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return digest(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def want(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    trees = {}
    for lang, own in langs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = levels([leaf(*r) for r in own])
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    top = levels([trees[x][-1][0] for x in names])
    out = []
    for k, lang in enumerate(names):
        for i, r in enumerate(langs[lang]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            now, said = leaf(*r[:4], r[4].translate(LOWER) if hit else r[4]), ""
            for tree, at in ((trees[lang], i), (top, k)):
                for nodes in tree[:-1]:
                    a = at - at % 8
                    left, right = nodes[a:at], nodes[at + 1 : a + 8]
                    said += "".join(left + right)
                    now = digest(*left, now, *right)
                    at //= 8
            out.append((r[0], trees[lang][0][i], trees[lang][-1][0], top[-1][0], digest(said), now, now == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r)[:7] for r in manifest.manifest(df).collect()), key=repr)


def made(n, langs, seed=1):
    r = random.Random(seed)
    return [(i * 3, r.choice(["a", None]), r.choice(langs), r.choice([None, i]), r.choice([None, "", "Tëxt", f"lower {i}", f"Upper {i}"])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513, 4100])
def test_sizes_about_whole_runs_and_blocks(spark, n):
    rows = made(n, ["en"])
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want(rows)


def test_many_langs_nulls_ties_and_other_columns(spark):
    rows = made(700, [None, "", "É", "e", "z", *(f"l{i}" for i in range(70))], 4)
    rows += [rows[3], rows[3], (None, "a", "e", 1, "Null Id"), (None, "a", "e", 1, "Null Id"), (5, "a", "e", 1, "X"), (5, "b", "e", 1, "Y")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit(1), "n": F.lit(2), "number": F.lit(3), "tree": F.lit(4), "changed": F.lit("x")})
    assert got(df) == want(rows)


def test_hot_lang_without_broadcasts(spark, monkeypatch):
    rows = made(1500, ["en"] * 20 + ["de", None], 5)
    monkeypatch.setattr(common, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(common, "HOT", 500)
    assert got(spark.createDataFrame(rows, SCHEMA)) == want(rows)


def test_empty_and_long(spark, none):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(3, "s", "l", 2_000_000, "Ab" * 1_000_000)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == want(rows)


def test_a_version_copies_one_path_and_shares_the_rest(spark):
    rows = made(600, ["en"])
    base = [w[1] for w in sorted(want(rows), key=lambda w: w[0])]
    first = levels(base)
    for r in manifest.manifest(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect():
        at = r.doc_id // 3
        changed = list(base)
        changed[at] = r.path[0]
        again = levels(changed)
        assert [nodes[at // 8**k] for k, nodes in enumerate(again)] == r.path
        if r.path[0] != r.leaf:
            assert sum(a != b for x, y in zip(first, again, strict=True) for a, b in zip(x, y, strict=True)) == len(r.path) and not r.verified


def test_query_equals_plain_tree_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, SF).collect()), key=repr)
    assert found == want(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert sorted(con.execute(oracles.ORACLES["op13_merkle_manifest"]).fetchall(), key=repr) == found
