"""Operators on vectors, pages and conversations, and the pipeline, against plain Python."""

import hashlib
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from talkmill.llm import chat, common, mixing, near, oracles, queries, toxicity, urls, vectors
from talkmill.llm.tokens import with_token_counts

SF = "/root/testdata/sf0.001"


def brute_vectors(rows, least):
    fine = {i: (l, np.array(v, float)) for i, v, l in rows if v and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: [] for i, _, _ in rows}
    for a, (la, x) in fine.items():
        for b, (lb, y) in fine.items():
            if a != b and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[a].append(b)
    out = {}
    for i in links:
        seen, open_ = {i}, [i]
        while open_:
            for j in links[open_.pop()]:
                if j not in seen:
                    seen.add(j)
                    open_.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


@pytest.mark.parametrize("tile", [3, 7, 512])
def test_near_vectors(spark, tile):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 24))
    rows = [(i, (centres[i % 6] + rng.normal(size=24) * 0.28).astype(np.float32).tolist(), int(i % 2)) for i in range(90)]
    rows += [(100, rows[0][1], 0), (101, rows[0][1], 0), (102, rows[0][1], 1), (103, None, 0), (104, [0.0] * 24, 0), (105, [float("nan")] * 24, 0), (106, rows[1][1], None), (107, [], 0), (108, [None] * 24, 0), (109, [1.0, 2.0], 0), (110, [2.0, 4.0], 0), (111, [float("inf")] + [1.0] * 23, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("group", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df, tile=tile).collect()}
    want = brute_vectors(rows, 0.93)
    assert got == want and sum(n for n, _ in want.values()) > 20


def test_near_vectors_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_vectors(empty).count() == 0
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]


def test_near_vectors_at_the_limit(spark):
    """Cosines within rounding of the limit go by the vectors as given."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        x = rng.normal(size=16)
        y = rng.normal(size=16)
        y -= x * (x @ y) / (x @ x)
        y *= np.sqrt(x @ x) / np.sqrt(y @ y)
        rows += [(2 * i, x.tolist(), i), (2 * i + 1, (0.93 * x + np.sqrt(1 - 0.93**2) * y).tolist(), i)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    want = {}
    for i in range(40):
        a, b = np.array(rows[2 * i][1]), np.array(rows[2 * i + 1][1])
        on = vectors._exact(a, b) >= 0.93
        want |= {2 * i: (int(on), 2 * i), 2 * i + 1: (int(on), 2 * i if on else 2 * i + 1)}
    assert got == want and 0 < sum(n for n, _ in want.values()) < 80


def test_near_vectors_of_one_large_label(spark, monkeypatch):
    """Nine tenths under one label, in small tiles and blocks, and tables too large to broadcast."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 20))
    rows = [(i, (centres[i % 12] + rng.normal(size=20) * 0.3).astype(np.float32).tolist(), "big" if i % 10 else "small") for i in range(260)]
    rows += [(1000 + i, rows[i % 3][1], rows[i % 3][2]) for i in range(20)]
    want = brute_vectors(rows, 0.93)
    monkeypatch.setattr(vectors, "BLOCK", 3)
    monkeypatch.setattr(vectors, "PARTNERS", 2)
    for limit in (10**6, 0):
        monkeypatch.setattr(vectors, "BROADCAST_GROUPS", limit)
        monkeypatch.setattr(common, "BROADCAST_GROUPS", limit)
        monkeypatch.setattr(common, "HOT", 2)
        got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string"), tile=7).collect()}
        assert got == want


def test_near_vectors_where_an_id_has_several(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.0, 1.0], "a")]
    got = [(r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()]
    assert sorted(got) in ([(1, 0, 1), (1, 1, 1), (2, 0, 2), (3, 1, 1)], [(1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)])


RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def plain_rule(url, rules=RULES):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]) if m else ("", "")
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_url_rules(spark):
    urls_ = [None, "", "no scheme", "http://A.Example.com/en/7x?q", "https://example.com/en/1#f", "x://com/en/", "http://xcom/en/", "http://a.net/de/8", "http://example.net/de/8/", "http://b.org?es/", "http://b.org/es/a", "http://b.org/ES/", "a://b://c.com/en/", "http://example.com", "http://é.COM/en/é"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls_)], "page_id long, url string, host string")
    for r in urls.judge_urls(df).collect():
        host, path, best = plain_rule(urls_[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")
        assert r.host or r.verdict == "allow"
    assert urls.judge_urls(df.where("page_id < 0")).count() == 0


def test_url_templates(spark):
    """Unlabelled pages of a template whose labelled ones are blocked are blocked, those of a clean sibling are not."""
    rows = [f"http://s.com/shop/{i}" for i in range(40)] + [f"http://s.com/blog/{i}" for i in range(40)]
    rules = (("block", "s.com/shop/1"), ("block", "s.com/shop/2"), ("block", "s.com/shop/3"), ("allow", "s.com/blog/1"), ("allow", "s.com/blog/2"), ("allow", "s.com/blog/3"))
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {rows[r.page_id]: r for r in urls.judge_urls(df, rules=rules).collect()}
    assert got["http://s.com/shop/7"].verdict == "block" and got["http://s.com/shop/7"].template == "/shop/*"
    assert got["http://s.com/blog/7"].verdict == "allow" and got["http://s.com/blog/7"].template == "/blog/*"


def test_url_branches_without_labels_stay_apart(spark):
    """By labels alone, likeness needs them on both sides: an unlabelled branch is allowed, branches alike by labels are judged together, as deep as paths go."""
    deep = "http://d.com/a/b/c/d/e"
    rows = [f"http://s.com/{b}/{i}" for b in ("shop", "news") for i in range(40)] + [f"{deep}/{b}/{i}" for b in ("x", "y", "z") for i in range(200)]
    rows += [f"http://t.com/{b}/{c}{i}" for b in ("p", "q", "r") for c in ("", "u/") for i in range(40)]
    rules = (("block", "s.com/shop/1"), ("block", "s.com/shop/2"), ("block", "d.com/a/b/c/d/e/x/1"), ("allow", "d.com/a/b/c/d/e/y/1")) + tuple(("block", f"t.com/{b}/{i}") for b in "pq" for i in (1, 2))
    got = {u: r for u, r in zip(rows, sorted(urls.judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules=rules, shapes=None, heads=False).collect(), key=lambda r: r.page_id))}
    for url, verdict, template in (
        ("http://s.com/shop/7", "block", "/shop/*"), ("http://s.com/news/7", "allow", "/news/*"), (f"{deep}/x/7", "block", "/a/b/c/d/e/x/*"), (f"{deep}/y/7", "allow", "/a/b/c/d/e/y/*"), (f"{deep}/z/7", "allow", "/a/b/c/d/e/z/*"),
        ("http://t.com/p/7", "block", "/?/*"), ("http://t.com/q/7", "block", "/?/*"), ("http://t.com/r/7", "allow", "/r/*"), ("http://t.com/p/u/7", "allow", "/?/u/*"),
    ):
        assert (got[url].verdict, got[url].template) == (verdict, template), url


def test_url_branches_of_one_form_lend_their_labels(spark):
    """Unlabelled siblings of a blocked branch are blocked if the same kinds of segments follow in them, those of an allowed one are not, nor is what has a form of its own."""
    rows = [f"http://s.com/{b}/{i}" for b in ("shop", "sale") for i in range(40)] + [f"http://s.com/about/{w}" for w in "abcdefgh" for _ in range(6)] + [f"http://s.com/docs/{i}.html" for i in range(40)]
    rows += [f"http://t.com/{b}/{i}" for b in ("en", "fr") for i in range(40)] + [f"http://u.com/{b}/{i}" for b in ("p", "q", "r") for i in range(40)]
    rules = (("block", "s.com/shop/"), ("allow", "t.com/en/"), ("block", "u.com/p/"), ("allow", "u.com/q/"))
    got = {u: r for u, r in zip(rows, sorted(urls.judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules=rules).collect(), key=lambda r: r.page_id))}
    for url, predicted, template in (
        ("http://s.com/sale/7", "allow", "/sale/*"), ("http://s.com/about/a", "allow", "/about/a"), ("http://s.com/docs/7.html", "allow", "/docs/*"), ("http://t.com/fr/7", "allow", "/?/*"),
        ("http://u.com/p/7", "block", "/p/*"), ("http://u.com/q/7", "allow", "/q/*"), ("http://u.com/r/7", "allow", "/?/*"),
    ):
        assert got[url].predicted == got[url].verdict == predicted and got[url].template == template, (url, got[url])
    rows = [f"http://s.com/{b}/{i}" for b in ("shop", "sale", "gone") for i in range(40)] + [f"http://s.com/docs/{i}.html" for i in range(3)]
    got = {u: r for u, r in zip(rows, sorted(urls.judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules=rules).collect(), key=lambda r: r.page_id))}
    assert {got[f"http://s.com/{b}/7"].verdict for b in ("shop", "sale", "gone")} == {"block"} and got["http://s.com/docs/1.html"].verdict == "allow"


def test_url_predictions_hold_on_labels_kept_back(spark):
    """Over the given pages: a quarter of the urls that rules fit is kept back; unruled pages are neither all blocked nor all allowed."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    m = urls.measure_urls(pages).first()
    assert m.held_out > 150 and m.precision >= 0.9 and m.recall >= 0.5 and 0 < m.unruled_blocked < m.unruled, m
    judged = urls.judge_urls(pages, hide=4).where("hidden and rule is not null").collect()
    assert (m.held_out, m.right) == (len(judged), sum(r.verdict == r.predicted == "block" for r in judged))


def test_url_wildcards_split_by_first_character_where_labels_do(spark):
    rows = [f"http://s.com/{b}/{i}" for b in ("en", "fr") for i in range(100, 1000, 7)]
    rules = (("block", "s.com/en/"), ("allow", "s.com/en/7"))
    got = {u: r for u, r in zip(rows, sorted(urls.judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules=rules).collect(), key=lambda r: r.page_id))}
    for u, r in got.items():
        seven = u.rpartition("/")[2][0] == "7"
        assert (r.template, r.predicted) == (("/?/7*", "allow") if seven else ("/?/*", "block")), u


def plain_kind(s):
    return 0 if s is None else 1 if re.search("^[0-9]+$", s) else 2 if re.search(r"^[0-9]+\.[a-z]+$", s) else 3 if re.search("[0-9a-f]{8}", s) else 4


def plain_unlike(own, other):
    """Chi-square of two lists of kinds."""
    total = 0.0
    for k in range(5):
        d, e = own.count(k), other.count(k)
        if d + e:
            total += (d * math.sqrt(len(other) / len(own)) - e * math.sqrt(len(own) / len(other))) ** 2 / (d + e)
    return total


def plain_urls(rows, rules, variable=0.5, least=8, z=1.96, smooth=4.0, reject=0.7, margin=0.3, shapes=13.28, heads=True):
    """judge_urls in plain Python, a node of the tree at a time: {url: (template, purity, verdict)}. rows: urls."""
    pages = []
    for u in rows:
        host, path, best = plain_rule(u, rules)
        pages.append([u, host, path, best and best[0], [s for s in path.split("/") if s], ""])
    for level in range(max(len(p[4]) for p in pages)):
        nodes = {}
        for p in pages:
            if len(p[4]) > level:
                nodes.setdefault((p[1], p[5]), []).append(p)
        for of in nodes.values():
            children = {}
            for p in of:
                children.setdefault(p[4][level], []).append(p)
            labels = lambda ps: (sum(p[3] is not None for p in ps), sum(p[3] == "block" for p in ps))
            names, (n_all, bad_all) = {}, labels(of)
            for s, ps in children.items():
                n, bad = labels(ps)
                rest = n_all - n
                own, other = (bad + 1) / (n + 2), (bad_all - bad + 1) / (rest + 2)
                error = math.sqrt(own * (1 - own) / (n + 2) + other * (1 - other) / (rest + 2))
                if re.search(r"^[0-9]+(\.[a-z]+)?$|[0-9a-f]{8}", s) or len(of) >= least and len(children) >= variable * len(of):
                    names[s] = "*"
                elif n >= least and rest >= least:
                    names[s] = "?" if abs(own - other) + z * error <= margin else s
                else:
                    others = [p for q in children if q != s for p in children[q]]
                    kinds = [[plain_kind(p[4][level + 1] if len(p[4]) > level + 1 else None) for p in x] for x in (ps, others)]
                    names[s] = "?" if shapes is not None and len(ps) >= least and len(others) >= least and plain_unlike(*kinds) <= shapes else s
            firsts = {}
            for s, ps in children.items():
                if names[s] == "*":
                    firsts.setdefault(s[0], []).extend(ps)
            firsts = {h: labels(ps) for h, ps in firsts.items() if labels(ps)[0]}
            n_all, bad_all = sum(x for x, _ in firsts.values()), sum(x for _, x in firsts.values())
            for h, (n, bad) in firsts.items() if heads and len(firsts) > 1 else ():
                rest = n_all - n
                own, other = (bad + 1) / (n + 2), (bad_all - bad + 1) / (rest + 2)
                error = math.sqrt(own * (1 - own) / (n + 2) + other * (1 - other) / (rest + 2))
                if abs(own - other) - z * error > margin:
                    names |= {s: f"{h}*" for s in children if names[s] == "*" and s[0] == h}
            for p in of:
                p[5] = f"{p[5]}/{names[p[4][level]]}"
    by = {}
    for p in pages:
        for key in ((p[1], p[5]), (p[1],), ()):
            by.setdefault(key, []).append(p[3])
    out = {}
    for u, host, path, ruled, _, template in pages:
        n, bad = (sum(x is not None for x in by[host, template]), sum(x == "block" for x in by[host, template]))
        above = [x for x in by[()] if x]
        share = sum(x == "block" for x in above) / len(above) if above else 0.0
        mine = [x for x in by[(host,)] if x]
        share = (sum(x == "block" for x in mine) + smooth * share) / (len(mine) + smooth)
        purity = (bad + smooth * share) / (n + smooth)
        low = (bad / n + z * z / (2 * n) - z * math.sqrt(bad / n * (1 - bad / n) / n + z * z / (4 * n * n))) / (1 + z * z / n) if n else 0.0
        out[u] = (template, purity, ruled or ("block" if purity >= reject and low >= 0.5 else "allow"))
    return out


@pytest.mark.parametrize("limit,shapes", [(10**6, None), (0, 13.28), (10**6, 13.28)])
def test_urls_equal_the_plain_tree(spark, monkeypatch, limit, shapes):
    monkeypatch.setattr(common, "BROADCAST_GROUPS", limit)
    monkeypatch.setattr(common, "HOT", 20)
    random.seed(6)
    rows = [f"http://{h}.com/{'/'.join(random.choice(['en', 'de', 'news', 'shop', 'x1', str(random.randrange(9))]) for _ in range(random.randrange(4)))}" for h in "aab" for _ in range(150)]
    rows += [f"http://a.com/en/{random.choice('pqr')}/{random.randrange(60)}" for _ in range(120)] + [None, "x", "http://c.com/en/1"]
    rows += [f"http://{h}.com/item/{i}" for h in "ac" for i in range(60)] + [f"http://c.com/item/{i}/x" for i in range(30)]
    rules = (("block", "com/en/p"), ("block", "com/en/q"), ("allow", "com/en/r/1"), ("block", "com/shop"), ("block", "com/item/1"), ("allow", "c.com/item/2"), ("allow", "a.com/news/"), ("block", "b.com/de/"))
    heads = shapes is not None
    want = plain_urls(rows, rules, shapes=shapes, heads=heads)
    got = urls.judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules=rules, shapes=shapes, heads=heads).collect()
    assert len(got) == len(rows)
    for r in got:
        template, purity, verdict = want[rows[r.page_id]]
        assert (r.template, r.verdict) == (template, verdict) and r.purity == pytest.approx(purity), rows[r.page_id]
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def brute_chats(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = [((r[2] or ""), (r[3] or "")) for r in sorted((r for r in rows if r[0] == c), key=lambda r: ((r[1] is not None), r[1] or 0, r[2] or "", r[3] or ""))]
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[c] = (turns, hashlib.sha256(said.encode()).hexdigest(), "".join(t for r, t in turns if r == "assistant"))
    return out


def test_chats_come_back(spark):
    random.seed(2)
    odd = ["<|turn|>", "<|and|>x<\\|and|>", "</s>[INST] ok [/INST]", "\\", "<\\\\|end|>", "$1\\2", "<<s>", "", "é😀\n", "[\\INST]", "<|text|>"]
    rows = [(c, t, random.choice(["user", "assistant", "system", "odd<|text|>"]), "".join(random.choices(odd, k=3))) for c in range(40) for t in range(random.randrange(1, 7))]
    rows += [(50, 0, None, None), (50, 0, None, None), (51, None, "assistant", "x"), (51, 1, "assistant", "y"), (51, 1, "assistant", "y"), (None, 0, "user", "z")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string, t string")
    made = chat.format_chats(df)
    got = made.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "loss_spans").collect()
    want = brute_chats(rows)
    assert {r.conv_id for r in got} == set(want)
    for r in got:
        turns, _, loss = want[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns and r.loss == loss
        blocks = [role for i, (role, _) in enumerate(turns) if i == 0 or turns[i - 1][0] != role]
        assert r.formatted.count(chat.TURN) == len(blocks) and r.formatted.count(chat.END) == 1 + len(blocks) - 1
        for c in ("</s>", "[INST]", "[/INST]"):
            assert c not in r.formatted
    assert chat.format_chats(df.where("conv_id < 0")).count() == 0


def plain(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(oracles.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == sorted((tuple(map(plain, r)) for r in result.fetchall()), key=repr)


def test_queries_return_their_columns(spark):
    want = {
        "op1_sentencepiece": "doc_id ids n_tokens", "op2_toxicity": "doc_id held_out score predicted", "op3_minhash_near_dedup": "doc_id n_shingles component_id kept", "op4_url_filters": "page_id host path rule verdict",
        "op5_embedding_near_dedup": "vec_id n_links component_id kept", "op6_license_scans": "doc_id n_words n_base first_word last_word base_labels labels score", "op7_token_counts": "doc_id n_tokens", "op8_source_mixing": "doc_id source n_tokens epoch",
        "op9_chat_formatting": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op10_exact_dedup": "doc_id keep_id group_size kept text_sha256",
        "op11_suffix_array_dedup": "doc_id n_bytes n_removed n_spans kept_sha256", "op12_tokenizer_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
        "op13_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
    }
    assert set(queries.QUERIES) == set(want)
    for name in set(want) - set(oracles.ORACLES):
        assert set(want[name].split()) <= set(queries.QUERIES[name](spark, SF).columns)


def test_pipeline_stages_equal_plain_python(spark):
    """Each stage against plain Python on what the one before it left; then run() against the stages."""
    import sentencepiece
    from tests.llm.test_documents import brute_components, plain_mix

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    lower = {i: i + 32 for i in range(65, 91)}

    def toxic(rows):
        bad = {r.doc_id for r in toxicity.score_toxicity(docs, labels).where("predicted = 1").collect()}
        return [i for i, _, _ in rows if i not in bad]

    def exact(rows):
        groups = {}
        for i, _, t in rows:
            groups.setdefault((t or "").translate(lower), []).append(i)
        return [max(g) for g in groups.values()]

    def close(rows):
        return [i for i, (_, c) in brute_components([(i, t) for i, _, t in rows], 5, 80).items() if i == c]

    def mixed(rows):
        n = {r.doc_id: r.k for r in with_token_counts(now, queries.MODEL, "k").collect()}
        return [i for (i, _), k in plain_mix([(i, s, t, n[i]) for i, s, t in rows], 1.0, 0.95, 2.0, 1024).items() for _ in range(k)]

    now = docs
    for (name, stage), twin in zip(corpus_pipeline.STAGES[:-1], (toxic, exact, close, mixed)):
        rows = [(r.doc_id, r.source, r.text) for r in now.collect()]
        want = sorted(twin(rows))
        now = common.cut(stage(spark, now, SF))
        assert now.columns == docs.columns
        assert sorted(r.doc_id for r in now.select("doc_id").collect()) == want, name
    model = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    want = sorted((r.doc_id, tuple(model.encode(r.text or ""))) for r in now.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert sorted((r.doc_id, tuple(r.ids)) for r in last.collect()) == want and last.where("not round_trip").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, tuple(r.ids)) for r in whole.collect()) == want


def test_pipeline_stages_on_odd_tables(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, clashing names; and an empty table."""
    long = " ".join(f"w{i}" for i in range(30000)) + " " + "x" * 20000
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t", "en", "a"), (4, "Same text here", None, "a"), (5, "same TEXT here", "en", None), (6, long, "en", "b"), (6, long, "en", "b"), (None, "no id", "en", "a"), (None, None, None, None), (7, "one more text", "en", "a"), (7, "one more text", "en", "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    for c in ("n", "md5", "norm", "best", "gone", "tokens", "epoch", "at", "__key", "id", "score"):
        docs = docs.withColumn(c, F.lit(9))
    left = {"toxicity": 11, "exact_dedup": 6, "near_dedup": 10, "mixing": None}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.where("n <> 9 or md5 <> 9 or gone <> 9 or at <> 9").count() == 0
        assert left[name] is None or got.count() == left[name], name
        assert stage(spark, docs.where("doc_id < 0"), SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(rows) and last.where("not round_trip").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("doc_id < 0"), SF).count() == 0
