"""Queries of joins, duplicates and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.judge import string_array
from ..operators import dedup, pairs, retrieval, scores, sessions
from .registry import query
from .scalars import PUNCTUATED

WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{2,}}'))"


@query("j01_candidates_turns", """WITH {views} SELECT turn_id, candidate_id, session_id, scenario, er, ip, ex FROM candidates JOIN turns USING (turn_id) WHERE status = 'answered' AND NOT starts_with(session_id, 's9')""")
def _(v):
    turns = v.turns.where((F.col("status") == "answered") & ~F.col("session_id").startswith("s9"))
    return v.candidates.join(turns, "turn_id").select("turn_id", "candidate_id", "session_id", "scenario", "er", "ip", "ex")


@query("j02_j03_mandatory", """WITH {views} SELECT o.turn_id, o.session_id, c.er AS er, coalesce(d.er, -1) AS optional_er, c.turn_id IS NULL AS missing FROM turns o LEFT JOIN (SELECT * FROM candidates WHERE candidate_id = 'c1') c USING (turn_id) LEFT JOIN (SELECT * FROM candidates WHERE candidate_id = 'c2') d ON d.turn_id = o.turn_id""")
def _(v):
    must, may = (v.candidates.where(F.col("candidate_id") == c).select("turn_id", "er") for c in ("c1", "c2"))
    found = v.turns.join(must, "turn_id").withColumn("missing", F.lit(False))
    lost = v.turns.join(must, "turn_id", "left_anti").withColumns({"er": F.lit(None).cast("int"), "missing": F.lit(True)})
    return found.unionByName(lost).join(may.withColumnRenamed("er", "optional_er"), "turn_id", "left").select("turn_id", "session_id", "er", F.coalesce("optional_er", F.lit(-1)).alias("optional_er"), "missing")


EVAL = """h AS (SELECT turn_id, CASE er WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS human_winner FROM candidates WHERE candidate_id = 'c1'),
p AS (SELECT turn_id, CASE WHEN ip = 0 THEN NULL WHEN ip = 1 THEN 'A' ELSE 'B' END AS pair_winner FROM candidates WHERE candidate_id = 'c2'), q AS (SELECT turn_id, CASE WHEN ex = 0 THEN 'A' ELSE 'B' END AS point_winner FROM candidates WHERE candidate_id = 'c3'),
e AS (SELECT turn_id, human_winner, pair_winner, point_winner, CASE WHEN human_winner = 'tie' THEN 'human' WHEN pair_winner IS NULL THEN 'critic' WHEN point_winner IS NULL THEN 'pointwise' ELSE '' END AS exclusion FROM h LEFT JOIN p USING (turn_id) LEFT JOIN q USING (turn_id))"""


def evaluation(v):
    def side(name, alias, column, values):
        return v.candidates.where(F.col("candidate_id") == name).select("turn_id", F.element_at(F.array(*map(F.lit, values)), F.col(column) + 1).alias(alias))

    return pairs.evaluation_rows(side("c1", "human_winner", "er", ("A", "B", "tie")), side("c2", "pair_winner", "ip", (None, "A", "B")), side("c3", "point_winner", "ex", ("A", "B", "B")), "turn_id")


@query("j04_evaluation_rows", "WITH {views}, " + EVAL + " SELECT * FROM e")
def _(v):
    return evaluation(v)


@query("a27_a46_agreement", "WITH {views}, " + EVAL + """, k AS (SELECT count(*) AS rows, count(*) FILTER (exclusion = '') AS kept, count(*) FILTER (exclusion = 'human') AS without_human, count(*) FILTER (exclusion = 'critic') AS without_critic, count(*) FILTER (exclusion = 'pointwise') AS without_pointwise,
  count(*) FILTER (exclusion = '' AND pair_winner = human_winner) AS p, count(*) FILTER (exclusion = '' AND point_winner = human_winner) AS q, count(*) FILTER (human_winner = 'tie') AS t FROM e)
SELECT rows, kept, without_human, without_critic, without_pointwise, round(p / kept, 9) AS pair_agreement, round(q / kept, 9) AS point_agreement, round((p - q) / kept, 9) AS difference, round(t / rows, 9) AS tie_rate,
  CASE WHEN kept < 12 THEN 'inconclusive' WHEN p / kept >= 0.7 AND p > q THEN 'continue' WHEN p / kept <= 0.55 AND p <= q THEN 'stop' ELSE 'review' END AS verdict FROM k""")
def _(v):
    a = pairs.agreement(evaluation(v))
    a = a.withColumn("verdict", pairs.verdict(F.col("kept"), F.col("pair_agreement"), F.col("difference")))
    return a.withColumns({c: F.round(c, 9) for c in ("pair_agreement", "point_agreement", "difference", "tie_rate")})


@query("j05_new_since_baseline", """WITH {views}, a AS (SELECT * FROM candidates WHERE linestatus = 'F') SELECT b.turn_id, b.candidate_id, b.er, b.ip FROM candidates b LEFT JOIN (SELECT turn_id, max((er = 2 AND ip = 2)::INT) AS high FROM a GROUP BY turn_id) a USING (turn_id) WHERE b.er = 2 AND b.ip = 2 AND coalesce(a.high, 0) = 0""")
def _(v):
    high = (F.col("er") == 2) & (F.col("ip") == 2)
    base = v.candidates.where((F.col("linestatus") == "F") & high).select("turn_id").distinct()
    return v.candidates.where(high).join(base, "turn_id", "left_anti").select("turn_id", "candidate_id", "er", "ip")


@query("j06_a29_model_comparison", """WITH {views}, j AS (SELECT a.turn_id, a.boundary AS human, a.er AS m1, b.er AS m2, c.turn_id IS NOT NULL AS failed1, d.turn_id IS NOT NULL AS failed2 FROM candidates a LEFT JOIN candidates b ON a.turn_id = b.turn_id AND b.cand_no = 2 LEFT JOIN candidates c ON a.turn_id = c.turn_id AND c.cand_no = 3 AND c.boundary LEFT JOIN candidates d ON a.turn_id = d.turn_id AND d.cand_no = 4 AND d.boundary WHERE a.cand_no = 1)
SELECT human, count(*) AS rows, count(*) FILTER (NOT failed1 AND (m1 = 2) = human) AS matches_one, count(*) FILTER (NOT failed2 AND m2 IS NOT NULL AND (m2 = 2) = human) AS matches_other, count(*) FILTER (failed1) AS invalid_one, count(*) FILTER (failed2 OR m2 IS NULL) AS invalid_other FROM j GROUP BY human""")
def _(v):
    c = v.candidates
    one = c.where("cand_no = 1").select("turn_id", F.col("boundary").alias("human"), F.col("er").alias("m1"))
    two = c.where("cand_no = 2").select("turn_id", F.col("er").alias("m2"))
    failures = [c.where(f"cand_no = {k} and boundary").select("turn_id", F.lit(True).alias(f"failed{k - 2}")) for k in (3, 4)]
    j = one.join(two, "turn_id", "left").join(failures[0], "turn_id", "left").join(failures[1], "turn_id", "left").na.fill(False, ["failed1", "failed2"])
    right = lambda m: (F.col(m) == 2) == F.col("human")
    return j.groupBy("human").agg(
        F.count("*").alias("rows"), F.count_if(~F.col("failed1") & right("m1")).alias("matches_one"), F.count_if(~F.col("failed2") & right("m2")).alias("matches_other"), F.count_if("failed1").alias("invalid_one"),
        F.count_if(F.col("failed2") | F.col("m2").isNull()).alias("invalid_other"),
    )


@query("j07_j08_semi_anti", """WITH {views} SELECT turn_id, turn_id IN (SELECT turn_id FROM candidates WHERE boundary AND er = 2) AS edge FROM turns WHERE turn_id NOT IN (SELECT turn_id FROM candidates WHERE cand_no = 1 AND NOT boundary)""")
def _(v):
    todo = v.turns.join(v.candidates.where("cand_no = 1 and not boundary"), "turn_id", "left_anti").select("turn_id")
    edges = v.candidates.where("boundary and er = 2").select("turn_id").distinct().withColumn("edge", F.lit(True))
    return todo.join(edges, "turn_id", "left").select("turn_id", F.coalesce("edge", F.lit(False)).alias("edge"))


@query("j09_g01_cells", """SELECT DISTINCT l.lang AS persona, s.source AS scenario FROM (SELECT DISTINCT lang FROM documents) l, (SELECT DISTINCT source FROM documents) s""")
def _(v):
    from ..operators.generation import cells

    d = v.table("documents")
    return cells(d.select(F.col("lang").alias("persona")).distinct(), d.select(F.col("source").alias("scenario")).distinct())


GRAM_SQL = f"""u AS (SELECT conv_id * 1000 + turn AS id, regexp_replace(text, '{PUNCTUATED}+', '', 'g') AS t FROM messages),
o AS (SELECT min(id) AS id, t FROM u GROUP BY t), g AS (SELECT id, unnest(CASE WHEN length(t) = 0 THEN [] WHEN length(t) <= 3 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) END) AS g FROM o), n AS (SELECT id, count(*) AS n FROM g GROUP BY id)"""


def utterances(v):
    return v.messages.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("cell"), "text")


@query("j10_similar_pairs", "WITH {views}, " + GRAM_SQL + """ SELECT a, b, round(c / (x.n + y.n - c), 9) AS jaccard FROM (SELECT p.id AS a, q.id AS b, count(*) AS c FROM g p JOIN g q ON p.g = q.g AND p.id < q.id GROUP BY ALL) JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / (x.n + y.n - c) >= 0.6""")
def _(v):
    return dedup.similar_pairs(utterances(v), 0.6).withColumn("jaccard", F.round("jaccard", 9))


@query("j10_exact_duplicates", "WITH {views}, " + GRAM_SQL + " SELECT u.id, o.id AS first FROM u JOIN o USING (t) WHERE u.id <> o.id")
def _(v):
    return dedup.exact_duplicates(utterances(v))


KEEP = """, p AS (SELECT a, b FROM (SELECT p.id AS a, q.id AS b, count(*) AS c FROM g p JOIN g q ON p.g = q.g AND p.id < q.id GROUP BY p.id, q.id) JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / (x.n + y.n - c) >= 0.5),
s AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT a AS id FROM p UNION SELECT b FROM p)), f AS (SELECT k, id, coalesce(list(a) FILTER (a IS NOT NULL), []) AS earlier FROM s LEFT JOIN p ON p.b = s.id GROUP BY k, id),
r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT f.k, CASE WHEN list_has_any(f.earlier, r.kept) THEN r.kept ELSE list_append(r.kept, f.id) END FROM r JOIN f ON f.k = r.k + 1), z AS (SELECT kept FROM r ORDER BY k DESC LIMIT 1)
SELECT o.id, list_min(list_intersect(f.earlier, z.kept)) AS kept_by FROM o CROSS JOIN z LEFT JOIN f ON f.id = o.id AND NOT list_contains(z.kept, f.id)"""


@query("j10_keep_decisions", "WITH RECURSIVE {views}, " + GRAM_SQL + KEEP)
def _(v):
    """Which utterances the greedy order keeps, over a table of confirmed pairs of distinct texts; the SQL takes them one by one."""
    pairs = dedup.similar_pairs(utterances(v), 0.5).select("a", "b")
    firsts = utterances(v).groupBy(text.strip_punctuation("text")).agg(F.min("id").alias("id")).select("id")
    return dedup.greedy_keep(firsts, pairs).withColumnRenamed("by", "kept_by")


@query("j10_greedy_dedupe")
def _(v):
    return dedup.dedupe_utterances(utterances(v), by_ratio=True)


#: Examples that may be shown: no reds; scenarios are languages and two small ones. Conversations ask for one of these, or for one that no example has.
SHOWN = """e AS (SELECT doc_id AS example_id, CASE WHEN doc_id % 97 = 0 THEN 'rare' WHEN doc_id % 53 = 0 THEN 'few' ELSE scenario END AS scenario, tier, """ + WORDS.format("text") + """ AS t FROM examples WHERE safety <> 'red'),
q AS (SELECT conv_id * 1000 + turn AS query_id, ['en', 'fr', 'de', 'es', 'rare', 'none', 'few'][conv_id % 7 + 1] AS asked, """ + WORDS.format("text") + """ AS t FROM messages WHERE role = 'student'),
h AS (SELECT asked, (SELECT count(*) FROM e WHERE e.scenario = x.asked AND tier = 'exemplar') AS one, (SELECT count(*) FROM e WHERE e.scenario = x.asked) AS two FROM (SELECT DISTINCT asked FROM q) x)"""


@query("j11_w11_tiered_retrieval", "WITH {views}, " + SHOWN + """, p AS (SELECT query_id, example_id, asked, scenario, tier, count(*) / sqrt(any_value(nq)::DOUBLE * any_value(ne)) AS score FROM (SELECT query_id, asked, unnest(t) AS t, len(t) AS nq FROM q) JOIN (SELECT example_id, scenario, tier, unnest(t) AS t, len(t) AS ne FROM e) USING (t) GROUP BY query_id, example_id, asked, scenario, tier),
r AS (SELECT *, CASE WHEN scenario <> asked THEN 3 WHEN tier = 'exemplar' THEN 1 ELSE 2 END AS level, round(round(score, 9) + CASE WHEN tier = 'exemplar' THEN 0.08 + 0.04 ELSE 0.02 END::DOUBLE, 9) AS s FROM p JOIN h USING (asked) WHERE round(score, 9) >= 0.2),
o AS (SELECT * FROM r WHERE level = 1 OR (level = 2 AND one < 3) OR (level = 3 AND two < 3))
SELECT query_id, example_id, level, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY level, s DESC, example_id) AS rank FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY level, s DESC, example_id) <= 3""")
def _(v):
    asked = F.element_at(string_array(("en", "fr", "de", "es", "rare", "none", "few")), (F.col("conv_id") % 7 + 1).cast("int"))
    q = v.messages.where("role = 'student'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), asked.alias("scenario"), F.array_distinct(text.latin_words(F.col("text"))).alias("tokens"))
    scenario = F.when(F.col("doc_id") % 97 == 0, "rare").when(F.col("doc_id") % 53 == 0, "few").otherwise(F.col("scenario"))
    strategies = F.when(F.col("tier") == "exemplar", string_array(("restatement", "other", "guidance", "other", "guidance"))).otherwise(string_array(("other", "restatement")))
    e = v.examples.where("safety <> 'red'").select(F.col("doc_id").alias("id"), scenario.alias("scenario"), "tier", strategies.alias("strategies"), F.array_distinct(text.latin_words(F.col("text"))).alias("tokens"))
    return retrieval.tiered(q, e, 3, 0.2, ("restatement", "guidance"))


@query("j12_memory_search", """WITH m AS (SELECT vec_id, label, vec_id % 300 // 100 AS session, CASE WHEN vec_id % 6 = 5 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS v, ['w' || vec_id % 7, 'x' || vec_id % 3] AS t FROM embeddings), p AS (SELECT q.vec_id AS query_id, r.vec_id AS record_id,
  round(0.65 * greatest(list_cosine_similarity(q.v, r.v), 0) + 0.3 * len(list_intersect(q.t, r.t)) / 2 + 0.05 / (1 + ln(1 + r.vec_id / 24.0::DOUBLE)), 9) AS score FROM m q JOIN m r ON q.label = r.label WHERE q.vec_id % 100 = 0 AND r.vec_id % 4 <> 3 AND (q.vec_id % 200 = 0 OR q.session = r.session))
SELECT query_id, record_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM p WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) <= 5""")
def _(v):
    e = v.table("embeddings")
    tokens = F.array(F.concat(F.lit("w"), (F.col("vec_id") % 7).cast("string")), F.concat(F.lit("x"), (F.col("vec_id") % 3).cast("string")))
    vector = F.when(F.col("vec_id") % 6 == 5, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    session = F.floor(F.col("vec_id") % 300 / 100)
    records = e.select(
        F.col("vec_id").alias("record_id"), F.col("label").alias("user"), session.alias("session"), vector.alias("vector"), tokens.alias("tokens"),
        F.element_at(string_array(("low", "normal", "medium", "high")), (F.col("vec_id") % 4 + 1).cast("int")).alias("sensitivity"), (-3600.0 * F.col("vec_id")).alias("created"),
    )
    queries = records.where(F.col("record_id") % 100 == 0).select(F.col("record_id").alias("query_id"), "user", F.when(F.col("record_id") % 200 != 0, F.col("session")).alias("session"), "vector", "tokens")
    return retrieval.memory_search(queries, records, 0.0, 5, 0.2, rounded=9)


@query("j13_as_of", """SELECT e.event_id, (SELECT max(g.value) FROM events g WHERE g.user_id = e.user_id AND g.event_id = (SELECT max(x.event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.ts = (SELECT max(y.ts) FROM events y WHERE y.user_id = e.user_id AND y.event_type = 'purchase' AND y.ts <= e.ts))) AS guidance FROM events e WHERE e.event_type = 'click'""")
def _(v):
    ev = v.table("events")
    ready = sessions.latest(ev.where("event_type = 'purchase'").withColumn("k", F.struct("user_id", "ts")), "k", "event_id", "value").select("k.user_id", "k.ts", F.col("value").alias("guidance"))
    return sessions.as_of(ev.where("event_type = 'click'").select("event_id", "user_id", "ts"), ready, "user_id", "ts", "guidance").select("event_id", "guidance")


PAIRS = """best AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY total DESC, cand_no) AS place FROM candidates WHERE NOT boundary),
prefs AS (SELECT a.turn_id, a.candidate_id AS winner, b.candidate_id AS loser, a.er - b.er AS delta FROM best a JOIN best b ON a.turn_id = b.turn_id AND a.place = 1 AND b.place = 2 WHERE a.total > b.total)"""


@query("j14_a24_preferences", "WITH {views}, " + PAIRS + " SELECT * FROM prefs")
def _(v):
    made = scores.preference_pairs(v.candidates, "turn_id", "total", "boundary", "cand_no", "candidate_id")
    return scores.metric_deltas(made, v.candidates, "turn_id", "candidate_id", F.col("er"))


@query("j15_round_robin", """WITH {views}, g AS (SELECT doc_id, scenario, row_number() OVER (PARTITION BY scenario ORDER BY doc_id) - 1 AS k FROM examples WHERE safety = 'green'), b AS (SELECT doc_id AS bad_id, CASE WHEN source IN ('src0', 'src1') THEN 'other' ELSE scenario END AS scenario FROM examples WHERE safety = 'red' AND scenario NOT IN ('fr', 'es')),
c AS (SELECT 'with' AS kind, bad_id, scenario AS s FROM b UNION ALL SELECT 'without', bad_id, scenario FROM b WHERE scenario <> 'other'), r AS (SELECT kind, bad_id, s, row_number() OVER (PARTITION BY kind, s ORDER BY bad_id) - 1 AS r, count(*) OVER (PARTITION BY kind, s) AS n FROM c UNION ALL SELECT kind, bad_id, '*', row_number() OVER (PARTITION BY kind ORDER BY bad_id) - 1, count(*) OVER (PARTITION BY kind) FROM c),
f AS (SELECT kind, scenario, CASE WHEN scenario IN (SELECT s FROM c WHERE c.kind = x.kind) THEN scenario WHEN 'other' IN (SELECT s FROM c WHERE c.kind = x.kind) THEN 'other' ELSE '*' END AS s FROM (SELECT DISTINCT scenario FROM g), (SELECT DISTINCT kind FROM c) x)
SELECT f.kind, g.doc_id, r.bad_id FROM g JOIN f USING (scenario) JOIN r ON r.kind = f.kind AND r.s = f.s AND g.k % r.n = r.r""")
def _(v):
    from ..operators.reshape import round_robin

    good = v.examples.where("safety = 'green'").select("doc_id", "scenario")
    bad = v.examples.where("safety = 'red' and scenario not in ('fr', 'es')").select(F.col("doc_id").alias("bad_id"), F.when(F.col("source").isin("src0", "src1"), "other").otherwise(F.col("scenario")).alias("scenario"))
    made = {"with": bad, "without": bad.where("scenario <> 'other'")}
    one, two = (round_robin(good, b, "scenario", "doc_id", "bad_id").withColumn("kind", F.lit(k)) for k, b in made.items())
    return one.unionByName(two)


@query("j16_j18_scored", """WITH {views} SELECT c.turn_id, c.candidate_id, t.scenario, c.total FROM candidates c JOIN turns t USING (turn_id) WHERE t.status = 'answered' AND c.orientation = 'emotion_first' AND c.er IN (1, 2)""")
def _(v):
    scored = v.candidates.where("orientation = 'emotion_first' and er in (1, 2)").select("turn_id", "candidate_id", "total")
    return scored.join(v.turns.where("status = 'answered'").select("turn_id", "scenario"), "turn_id").select("turn_id", "candidate_id", "scenario", "total")


C8 = "regexp_replace(coalesce(text, ''), '[^\\x{4E00}-\\x{9FFF}A-Za-z0-9]+', '', 'g')"
G8 = "CASE WHEN length(c) = 0 THEN [] WHEN length(c) < 8 THEN [c] ELSE list_distinct(list_transform(range(1, length(c) - 6), lambda i: substr(c, i, 8))) END"


@query("j17_copy_overlap", f"""WITH d AS (SELECT doc_id, {G8} AS g FROM (SELECT doc_id, {C8} AS c FROM documents)), r AS (SELECT item_id, unnest({G8}) AS g FROM (SELECT item_id, {C8} AS c FROM benchmark)),
o AS (SELECT doc_id, item_id, count(*) AS n FROM (SELECT doc_id, unnest(g) AS g FROM d) JOIN r USING (g) GROUP BY doc_id, item_id), t AS (SELECT doc_id, item_id, n FROM o QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, item_id) = 1)
SELECT doc_id AS id, item_id AS best, round(coalesce(n / len(g), 0), 4) AS overlap FROM d LEFT JOIN t USING (doc_id)""")
def _(v):
    compact = lambda t, key: v.table(t).select(F.col(key).alias("id"), text.compact_for_char(F.coalesce("text", F.lit(""))).alias("text"))
    return retrieval.copied_shares(compact("documents", "doc_id"), compact("benchmark", "item_id"))


@query("j19_expected_observed", """WITH {views} SELECT a.turn_id, (a.er = b.er) AS winner_ok, a.boundary = b.boundary AS strict_ok, NOT a.boundary OR b.boundary AS lenient_ok, a.ex = b.ex AS order_ok FROM candidates a JOIN candidates b ON a.turn_id = b.turn_id AND a.cand_no = 1 AND b.cand_no = 2""")
def _(v):
    wide = pairs.pair_table(v.candidates.withColumn("scenario", F.lit("x")), "turn_id", "candidate_id", ["er", "ex", "boundary"], ["scenario"])
    return wide.select("turn_id", F.col("c1_er").eqNullSafe(F.col("c2_er")).alias("winner_ok"), F.col("c1_boundary").eqNullSafe(F.col("c2_boundary")).alias("strict_ok"), (~F.col("c1_boundary") | F.col("c2_boundary")).alias("lenient_ok"), F.col("c1_ex").eqNullSafe(F.col("c2_ex")).alias("order_ok"))


@query("j20_repeats", """WITH {views} SELECT m.conv_id, m.turn, r AS repeat_no, coalesce(h.n, 0) AS history FROM messages m, range(1, 4) t(r) LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'system' GROUP BY conv_id) h ON h.conv_id = m.conv_id""")
def _(v):
    history = v.table("conversations").where("role = 'system'").groupBy("conv_id").agg(F.count("*").alias("n"))
    rows = v.messages.select("conv_id", "turn", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("repeat_no"))
    return rows.join(history, "conv_id", "left").select("conv_id", "turn", "repeat_no", F.coalesce("n", F.lit(0)).alias("history"))


@query("j21_pointwise_baseline", """WITH {views} SELECT a.turn_id, printf('%.3f', a.total) AS total_1, printf('%.3f', b.total) AS total_2, CASE WHEN a.boundary AND b.boundary THEN '' WHEN a.boundary THEN 'c2' WHEN b.boundary THEN 'c1' WHEN a.total > b.total THEN 'c1' WHEN b.total > a.total THEN 'c2' ELSE 'tie' END AS winner FROM candidates a JOIN candidates b ON a.turn_id = b.turn_id AND a.cand_no = 1 AND b.cand_no = 2""")
def _(v):
    from ..functions.judge import pointwise_winner

    wide = pairs.pair_table(v.candidates.withColumn("scenario", F.lit("x")), "turn_id", "candidate_id", ["total", "boundary"], ["scenario"])
    return wide.select("turn_id", text.fixed3(F.col("c1_total")).alias("total_1"), text.fixed3(F.col("c2_total")).alias("total_2"), pointwise_winner(F.col("c1_total"), F.col("c2_total"), F.col("c1_boundary"), F.col("c2_boundary")).alias("winner"))
