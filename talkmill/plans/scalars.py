"""Queries of text, vector and judge functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import judge, text, vectors
from .registry import query

#: A class of white space and the punctuation of text.PUNCTUATION.
PUNCTUATED = r"[ \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}，。！？、,.!?；;：:\"''“”‘’（）()《》<>-]"
SPACES = r"[ \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query("f01_f04_normalise", rf"""SELECT doc_id, md5(trim(regexp_replace(lower(text), '{SPACES}+', ' ', 'g'))) AS normal, length(regexp_replace(text, '[^\x{{4E00}}-\x{{9FFF}}A-Za-z0-9]+', '', 'g')) AS compact,
  md5(regexp_replace(text, '{PUNCTUATED}+', '', 'g')) AS bare FROM documents""")
def _(v):
    t = F.col("text")
    return v.table("documents").select("doc_id", F.md5(text.normalize_text(t)).alias("normal"), F.length(text.compact_for_char(t)).cast("long").alias("compact"), F.md5(text.strip_punctuation(t)).alias("bare"))


@query("f02_nfkc")
def _(v):
    return v.table("documents").select("doc_id", text.nfkc(F.concat("lang", "source")).alias("name"), F.md5(text.nfkc("text")).alias("hash"))


@query("f05_f09_grams", """WITH g AS (SELECT doc_id, text[1:length(text)//2] AS a, text[length(text)//4+1:] AS b FROM documents), s AS (SELECT doc_id, a, b,
  CASE WHEN length(a) = 0 THEN [] WHEN length(a) <= 3 THEN [a] ELSE list_distinct(list_transform(range(1, length(a) - 1), lambda i: substr(a, i, 3))) END AS x,
  CASE WHEN length(b) = 0 THEN [] WHEN length(b) <= 3 THEN [b] ELSE list_distinct(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3))) END AS y FROM g)
SELECT doc_id, len(x)::BIGINT AS n_a, len(y)::BIGINT AS n_b, round(CASE WHEN len(x) + len(y) = 0 THEN 1 ELSE len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) END, 9) AS jaccard,
  round(CASE WHEN len(x) * len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / sqrt(len(x)::DOUBLE * len(y)) END, 9) AS cosine,
  round(CASE WHEN len(x) = 0 THEN 0 ELSE len(list_intersect(x, y))::DOUBLE / len(x) END, 9) AS contained,
  (greatest(length(a) - 1, 0) + greatest(length(a) - 2, 0) + (length(a) - length(replace(a, 'e', ''))))::BIGINT AS bag FROM s""")
def _(v):
    a, b = F.expr("substring(text, 1, length(text) div 2)"), F.expr("substring(text, length(text) div 4 + 1)")
    d = v.table("documents").select("doc_id", a.alias("a"), b.alias("b")).withColumns({"x": text.char_ngrams(F.col("a"), 3), "y": text.char_ngrams(F.col("b"), 3)})
    bag = text.ngram_bag(F.col("a"), 1, 3, F.array(F.lit("e")))
    return d.select("doc_id", F.size("x").cast("long").alias("n_a"), F.size("y").cast("long").alias("n_b"), F.round(vectors.jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"), F.round(vectors.set_cosine(F.col("x"), F.col("y")), 9).alias("cosine"), F.round(vectors.containment(F.col("x"), F.col("y")), 9).alias("contained"), F.size(bag).cast("long").alias("bag"))


@query("f07_f08_tokens", """WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS t FROM documents)
SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_filter(t, lambda x: x NOT IN ('the', 'of', 'and', 'de', 'la', 'der', 'die') AND NOT regexp_matches(x, '^[0-9]+$') AND regexp_matches(x, '[a-z]')))::BIGINT AS n_valid FROM t""")
def _(v):
    tokens = v.table("documents").select("doc_id", text.support_tokens(F.col("text")).alias("t"))
    stop = judge.string_array(("the", "of", "and", "de", "la", "der", "die"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(text.valid_tokens(F.col("t"), stop)).cast("long").alias("n_valid"))


@query("f10_sequence_ratio")
def _(v):
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    d = v.messages.select("conv_id", "turn", F.col("text").alias("a"), F.lag("text").over(w).alias("b")).where("b is not null")
    return d.select("conv_id", "turn", F.round(vectors.sequence_ratio("a", "b"), 9).alias("ratio"))


@query("f12_example_score", """WITH {views}, e AS (SELECT doc_id, tier, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS t FROM examples)
SELECT doc_id, round(CASE WHEN len(t) = 0 THEN 0 ELSE len(list_intersect(t, ['the', 'and', 'with'])) / sqrt(3.0::DOUBLE * len(t)) END + CASE WHEN tier = 'exemplar' THEN 0.08 ELSE 0 END
  + 0.02 * (CASE WHEN tier = 'exemplar' THEN 2 ELSE 1 END), 9) AS score FROM e""")
def _(v):
    from ..operators.retrieval import example_score

    tokens = text.support_tokens(F.col("text"))
    strategies = F.when(F.col("tier") == "exemplar", judge.string_array(("restatement", "other", "guidance", "other", "guidance"))).otherwise(judge.string_array(("other", "restatement")))
    latin = F.filter(tokens, lambda t: t.rlike("^[a-z0-9]+$"))
    return v.examples.select("doc_id", F.round(example_score(judge.string_array(("the", "and", "with")), latin, F.col("tier"), strategies, ("restatement", "guidance")), 9).alias("score"))


@query("f14_f16_vectors", """SELECT vec_id, round(coalesce(list_cosine_similarity(e, list_reverse(e)), 0), 9) AS mirrored, round(sqrt(list_dot_product(n, n)), 6) AS norm, round(1 / (1 + ln(1 + vec_id / 24.0::DOUBLE)), 9) AS recency FROM (
  SELECT vec_id, embedding::DOUBLE[] AS e, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS n FROM embeddings)""")
def _(v):
    e, n = F.col("embedding"), vectors.l2_normalize(F.col("embedding"))
    age = vectors.recency(F.lit(0.0), F.col("vec_id") * 3600.0)
    return v.table("embeddings").select("vec_id", F.round(vectors.cosine(e, F.reverse(e)), 9).alias("mirrored"), F.round(F.sqrt(vectors.dot(n, n)), 6).alias("norm"), F.round(age, 9).alias("recency"))


@query("f16_hashed_embedding", """WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) AS t FROM documents),
b AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 384 AS b, sum(CASE WHEN ('0x' || substr(md5(t), 9, 1))::INT % 2 = 0 THEN 1.0::DOUBLE ELSE -1 END) AS s FROM t GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(s * s)) AS n, sum(s * (b + 1)) AS w FROM b GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(CASE WHEN n = 0 THEN 0 ELSE w / n END, 0), 6) AS weighted FROM documents d LEFT JOIN n USING (doc_id)""")
def _(v):
    from ..operators.models import embedder

    d = embedder("hashing")(v.table("documents"), "doc_id", "text")
    return d.select("doc_id", F.round(F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("weighted"))


@query("f17_f19_f29_sentences", r"""WITH d AS (SELECT doc_id, text, regexp_split_to_array(text, '[.!?\n]+') AS p FROM documents)
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[。！？!?]+'), lambda s: regexp_matches(s, '[^""" + SPACES[1:-1] + r"""]')))::BIGINT AS sentences,
  CASE WHEN length(t) <= 60 THEN t ELSE rtrim(t[1:57]) || '...' END AS short,
  md5(array_to_string(list_filter(list_transform(string_split(trim(text), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS cleaned,
  coalesce(list_filter(list_transform(p, lambda s: trim(s)), lambda s: s <> '')[-1], '') AS last_sentence,
  len(list_filter(list_transform(p, lambda s: trim(s)), lambda s: s <> '' AND NOT regexp_matches(s, 'http')))::BIGINT AS kept
FROM (SELECT *, trim(regexp_replace(text, '""" + SPACES + r"""+', ' ', 'g')) AS t FROM d)""")
def _(v):
    t = F.col("text")
    kept = F.filter(F.transform(F.split(t, r"[.!?\n]+"), lambda x: F.trim(x)), lambda s: (s != "") & ~s.rlike("http"))
    return v.table("documents").select("doc_id", text.sentence_count(t).alias("sentences"), text.truncate(t, 60).alias("short"), F.md5(text.clean_output(t)).alias("cleaned"), text.rationale(t, "last").alias("last_sentence"), F.size(kept).cast("long").alias("kept"))


@query("f20_strip_tags", r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(?:script[^>]*>.*?</script|style[^>]*>.*?</style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g'))) AS plain FROM pages""")
def _(v):
    return v.table("pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("plain"))


TAGGED = "'[restate] ' || text[1:30] || ' [restate] ' || text[31:45] || ' [guide]' || text[46:60] || '[other]'"


@query("f21_f23_segments", rf"""WITH d AS (SELECT doc_id, trim(text[1:30]) AS a, trim(text[31:45]) AS b, trim(text[46:]) AS c FROM documents WHERE NOT regexp_matches(text, '\[[a-z_]+\]')),
s AS (SELECT doc_id, list_filter([{{'s': 'restate', 't': a}}, {{'s': 'restate', 't': b}}, {{'s': 'guide', 't': c}}], lambda x: x.t <> '') AS s FROM d),
g AS (SELECT doc_id, s, list_filter(s, lambda x: length(x.t) >= 8 AND NOT contains(x.t, 'http')) AS g FROM s)
SELECT doc_id, 4::BIGINT AS n_tags, len(s)::BIGINT AS n_segments, 'restate>guide' AS compressed,
  coalesce(array_to_string(list_transform(list_filter([list_filter(g, lambda x: x.s = 'restate')[1], list_filter(g, lambda x: x.s = 'guide')[1]], lambda x: x IS NOT NULL), lambda x: x.t), '|'), '') AS fragments FROM g""")
def _(v):
    d = v.table("documents").where(~F.col("text").rlike(text.TAG)).select(
        "doc_id", F.concat(F.lit("[restate] "), F.substring("text", 1, 30), F.lit(" [restate] "), F.substring("text", 31, 15), F.lit(" [guide]"), F.expr("substring(text, 46)"), F.lit("[other]")).alias("t")
    )
    d = d.select("doc_id", text.tag_sequence(F.col("t")).alias("tags"), text.tag_segments(F.col("t")).alias("segments"))
    return d.select(
        "doc_id", F.size("tags").cast("long").alias("n_tags"), F.size("segments").cast("long").alias("n_segments"), F.array_join(text.compress_sequence(F.col("tags"), "other"), ">").alias("compressed"),
        F.array_join(F.transform(text.select_fragments(F.col("segments"), ["http"]), lambda s: s["text"]), "|").alias("fragments"),
    )


@query("f24_f25_judge_json", """WITH {views} SELECT turn_id, candidate_id, CASE WHEN (er + ip) % 5 = 4 THEN NULL ELSE er END::INT AS strict, CASE WHEN (er + ip) % 5 = 4 THEN 0 ELSE er END::INT AS lenient, least(2, ip + 1)::INT AS clamped,
  boundary AS flag, length('{"ER":' || CASE WHEN (er + ip) % 5 = 4 THEN '"high"' ELSE er::VARCHAR END || ',"IP":' || (ip + 1) || '.5,"flag":' || boundary || '}')::BIGINT AS json_length FROM candidates""")
def _(v):
    er = F.when((F.col("er") + F.col("ip")) % 5 == 4, '"high"').otherwise(F.col("er").cast("string"))
    raw = F.concat(F.lit('judge says: {"ER":'), er, F.lit(',"IP":'), (F.col("ip") + 1).cast("string"), F.lit('.5,"flag":'), F.col("boundary").cast("string"), F.lit("} done"))
    c = v.candidates.select("turn_id", "candidate_id", text.extract_json(raw).alias("j"))
    field = lambda name: F.get_json_object("j", f"$.{name}")
    return c.select("turn_id", "candidate_id", judge.score(field("ER"), "strict").alias("strict"), judge.score(field("ER"), "lenient").alias("lenient"), judge.score(field("IP"), "clamp").alias("clamped"), (field("flag") == "true").alias("flag"), F.length("j").cast("long").alias("json_length"))


@query("f26_t14_pairwise_parse", """WITH {views}, r AS (SELECT turn_id, candidate_id, CASE er WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS w, CASE ip WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS e, ex % 2 = 1 AS ba, tags FROM candidates)
SELECT turn_id, candidate_id, CASE WHEN w = 'tie' OR NOT ba THEN w WHEN w = 'A' THEN 'B' ELSE 'A' END AS winner, CASE WHEN e = 'tie' OR NOT ba THEN e WHEN e = 'A' THEN 'B' ELSE 'A' END AS er_choice, ''::VARCHAR AS error,
  coalesce(array_to_string(list_filter(tags, lambda t: t <> 'adult_coaching_question'), ','), '') AS audit FROM r""")
def _(v):
    from ..operators.pairs import parse_judgement

    raw = v.candidates.select(
        "turn_id", "candidate_id", F.when(F.col("ex") % 2 == 1, "ba").otherwise("ab").alias("order"),
        F.to_json(F.struct(
            F.element_at(judge.string_array(("candidate A", "b", "TIE")), F.col("er") + 1).alias("winner"),
            F.struct(F.element_at(judge.string_array(("A", "B", "tie")), F.col("ip") + 1).alias("ER")).alias("epitome_comparison"), F.col("tags").alias("audit"),
        )).alias("raw"),
    )
    parsed = parse_judgement(raw, "raw", ("ER",), ("template_low_information", "unsupported_third_party_motive", "third_party_excuse", "hard_boundary_fabrication"))
    return parsed.select("turn_id", "candidate_id", judge.map_choice(F.col("winner"), F.col("order")).alias("winner"), judge.map_choice(F.element_at("comparisons", "ER"), F.col("order")).alias("er_choice"), F.coalesce("error", F.lit("")).alias("error"), F.array_join("audit", ",").alias("audit"))


@query("f27_history_json", """WITH h AS (SELECT conv_id, role, text, turn FROM conversations)
SELECT conv_id, count(*) FILTER (role IN ('user', 'assistant') AND text <> '')::BIGINT AS kept, coalesce(sum(length(text)) FILTER (role IN ('user', 'assistant')), 0)::BIGINT AS chars FROM h GROUP BY conv_id""")
def _(v):
    from ..operators.sessions import read_history

    raw = v.table("conversations").groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("turn", "role", "text")))).alias("h"))
    h = raw.select("conv_id", read_history(F.col("h"), ("user", "assistant")).alias("h"))
    return h.select("conv_id", F.size("h").cast("long").alias("kept"), F.aggregate("h", F.lit(0).cast("long"), lambda a, m: a + F.length(m["text"])).alias("chars"))


@query("f28_f30_f42_probes", """WITH {views} SELECT conv_id, turn, (length(text) - length(replace(text, '?', '')))::BIGINT AS questions, ((length(text) - length(replace(text, 'the', ''))) / 3)::BIGINT AS hits,
  array_to_string(list_filter(['the', 'und', 'que', 'zzz'], lambda k: contains(text, k)), ';') AS matched FROM messages""")
def _(v):
    t = F.col("text")
    return v.messages.select("conv_id", "turn", text.occurrences(t, F.lit("?")).alias("questions"), text.occurrences(t, F.lit("the")).alias("hits"), F.array_join(text.hits(t, ["the", "und", "que", "zzz"]), ";").alias("matched"))


@query("f31_keyword_features", """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS t FROM documents), k AS (SELECT unnest(['the', 'of', 'and', 'que']) AS k)
SELECT doc_id, k AS keyword, round(ln(1 + len(list_filter(t, lambda x: x = k))) / sqrt(greatest(len(t), 1)), 9) AS value FROM t, k WHERE len(list_filter(t, lambda x: x = k)) > 0""")
def _(v):
    from ..operators.features import keyword_features

    tokens = v.table("documents").select("doc_id", text.latin_words(F.col("text")).alias("tokens"))
    keywords = v.spark.createDataFrame([(k,) for k in ("the", "of", "and", "que")], "keyword string")
    return keyword_features(tokens, keywords).withColumn("value", F.round("value", 9))


@query("f32_softmax", """WITH {views} SELECT doc_id, round(exp((p_green - m) / 0.5) / s, 9) AS green, round(exp((p_red - m) / 0.5) / s, 9) AS red FROM (
  SELECT *, exp((p_green - m) / 0.5) + exp((p_yellow - m) / 0.5) + exp((p_red - m) / 0.5) AS s FROM (SELECT *, greatest(p_green, p_yellow, p_red) AS m FROM probabilities))""")
def _(v):
    s = v.probabilities.select("doc_id", vectors.softmax(F.array("p_green", "p_yellow", "p_red"), 0.5).alias("s"))
    return s.select("doc_id", F.round(F.col("s")[0], 9).alias("green"), F.round(F.col("s")[2], 9).alias("red"))


@query("f33_f35_f49_ids", """SELECT doc_id, left(sha256(text), 16) AS hash, right('run' || source, 8) || '-' || lpad((doc_id % 10000)::VARCHAR, 4, '0') AS sample, CASE WHEN n_chars = 0 THEN NULL ELSE round(doc_id / n_chars::DOUBLE, 9) END AS ratio,
  printf('%.3f', n_chars / 8.0::DOUBLE) AS fixed FROM documents""")
def _(v):
    return v.table("documents").select(
        "doc_id", text.hash16(F.col("text")).alias("hash"), text.sample_id(F.concat(F.lit("run-"), F.col("source")), F.col("doc_id") % 10000).alias("sample"), F.round(F.try_divide("doc_id", "n_chars"), 9).alias("ratio"), text.fixed3(F.col("n_chars") / 8).alias("fixed")
    )


@query("f36_p13_p38_match", """WITH {views} SELECT turn_id, candidate_id, CASE WHEN er = 2 AND ip = 2 THEN 'ER_IP_2' WHEN er = 2 THEN 'IP_below' WHEN ip = 2 THEN 'ER_below' ELSE 'both_below' END AS side,
  CASE WHEN boundary THEN (er = 2)::INT ELSE (er <> 2)::INT END AS matched, CASE WHEN boundary AND ex = 0 THEN '' WHEN boundary THEN 'c2' WHEN ex = 0 THEN 'c1' WHEN er > ip THEN 'c1' WHEN ip > er THEN 'c2' ELSE 'tie' END AS winner FROM candidates""")
def _(v):
    from ..operators.rules import quadrant

    c = lambda x: F.col(x)
    return v.candidates.select("turn_id", "candidate_id", quadrant(c("er"), c("ip")).alias("side"), F.when(c("boundary"), c("er") == 2).otherwise(c("er") != 2).cast("int").alias("matched"), judge.pointwise_winner(c("er"), c("ip"), c("boundary"), c("ex") == 0).alias("winner"))


@query("f37_f38_reasons", """WITH {views} SELECT turn_id, candidate_id, len(tags)::BIGINT AS n, len(list_filter(tags, lambda t: contains(t, 'third_party'))) > 0 AS boundary_hit, len(list_filter(tags, lambda t: contains(t, 'low_info') OR contains(t, 'fabric'))) > 0 AS hard_hit FROM candidates""")
def _(v):
    from ..operators.labels import reason_hit, safe_list

    raw = F.when(F.size("tags") == 1, F.to_json("tags")).otherwise(F.lit(None).cast("string"))
    listed = v.candidates.select("turn_id", "candidate_id", safe_list(raw).alias("r"))
    return listed.select("turn_id", "candidate_id", F.size("r").cast("long").alias("n"), reason_hit(F.col("r"), ["third_party"]).alias("boundary_hit"), reason_hit(F.col("r"), ["low_info", "fabric"]).alias("hard_hit"))


@query("f39_f43_variants", """WITH {views} SELECT turn_id, candidate_id, ['calm', 'short', 'warm'][(turn_id % 3)::INT + 1] AS tone, array_to_string(list_sort(list_distinct([['calm', 'short', 'warm'][(turn_id % 3)::INT + 1], ['plain', 'calm'][(cand_no % 2)::INT + 1]])), ',') AS tags,
  er AS self_score, 0::INT AS other_score FROM candidates""")
def _(v):
    from ..operators.generation import variant
    from ..operators.scores import fill_dimensions

    tone, style = variant(["calm", "short", "warm"], F.col("turn_id")), variant(["plain", "calm"], F.col("cand_no"))
    filled = fill_dimensions(F.create_map(F.lit("self"), F.col("er").cast("string"), F.lit("other"), F.lit("high")), ["self", "other"])
    return v.candidates.select("turn_id", "candidate_id", tone.alias("tone"), F.array_join(F.array_sort(F.array_distinct(F.array(tone, style))), ",").alias("tags"), F.element_at(filled, "self").alias("self_score"), F.element_at(filled, "other").alias("other_score"))


@query("f41_row_profile", """WITH {views} SELECT doc_id, length(text) AS chars, array_to_string(list_transform([scenario, tier, safety], lambda x: CASE x WHEN 'en' THEN 'E' WHEN 'green' THEN 'G' ELSE x END), '>') AS path, len(list_distinct([scenario, tier, scenario]))::BIGINT AS n_distinct FROM examples""")
def _(v):
    from ..operators.labels import sequence_key

    return v.examples.select("doc_id", F.length("text").cast("long").alias("chars"), sequence_key(F.array("scenario", "tier", "safety"), {"en": "E", "green": "G"}).alias("path"), F.size(F.array_distinct(F.array("scenario", "tier", "scenario"))).cast("long").alias("n_distinct"))


@query("f44_f45_cards", r"""WITH {views} SELECT doc_id, 'Card ' || doc_id || chr(10) || CASE WHEN length(t) <= 40 THEN t ELSE rtrim(t[1:39]) || '…' END || chr(10) || CASE WHEN tier = 'exemplar' THEN 'Listen->Guide' ELSE 'Listen' END || CASE WHEN tier = 'exemplar' THEN chr(10) || 'note: ends with guidance' ELSE '' END AS card
FROM (SELECT *, trim(regexp_replace(text, '""" + SPACES + r"""+', ' ', 'g')) AS t FROM examples)""")
def _(v):
    path = F.when(F.col("tier") == "exemplar", "listen->guide").otherwise("listen")
    named = text.path_labels(path, {"listen": "Listen", "guide": "Guide"})
    note = F.when(F.col("tier") == "exemplar", "note: ends with guidance")
    return v.examples.select("doc_id", F.concat_ws("\n", F.concat(F.lit("Card "), F.col("doc_id")), text.truncate(F.col("text"), 40, "…"), named, note).alias("card"))


@query("f50_time", """SELECT o_orderkey AS turn_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, round((epoch(TIMESTAMP '2030-01-01') - epoch(date_trunc('second', o_orderdate))) / 86400.0, 6) AS age_days, o_orderdate < TIMESTAMP '2030-01-01' - INTERVAL 7 DAY AS expired FROM orders""")
def _(v):
    from ..functions.times import age_days, expired, iso_z

    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return v.turns.select("turn_id", iso_z(F.col("created_at")).alias("iso"), F.round(age_days(F.col("created_at"), now), 6).alias("age_days"), expired(F.col("created_at"), now, 7).alias("expired"))


@query("f33_f49_hashes", r"""WITH b AS (SELECT lang, sha256('common' || chr(10) || string_agg(name || chr(10) || said, chr(10) ORDER BY name, said)) AS bundle FROM (SELECT lang, source AS name, min(left(text, 20)) AS said FROM documents GROUP BY ALL) GROUP BY lang)
SELECT doc_id, bundle, sha256('{"chars": ' || n_chars || ', "lang": ' || to_json(lang) || ', "none": null, "text": ' || to_json(left(text, 40)) || ', "toxic": ' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || '}') AS hash, trim(regexp_replace(lower(left(text, 60)), '[ \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS key FROM documents JOIN b USING (lang)""")
def _(v):
    d = v.table("documents")
    named = d.groupBy("lang", F.col("source").alias("name")).agg(F.min(F.left("text", F.lit(20))).alias("said"))
    hashed = text.stable_hash({"toxic": F.col("doc_id") % 2 == 0, "lang": F.col("lang"), "text": F.left("text", F.lit(40)), "chars": F.col("n_chars"), "none": F.lit(None).cast("string")})
    return d.join(F.broadcast(text.bundle_hash(named, ["lang"], "name", "said", "common")), "lang").select("doc_id", "bundle", hashed.alias("hash"), text.normalize_text(F.left("text", F.lit(60))).alias("key"))
