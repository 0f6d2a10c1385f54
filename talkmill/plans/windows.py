"""Queries of histories, samples, queues and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import decisions, features, generation, pairs, queues, reshape, sampling, scores, sessions
from .registry import query


@query("w01_w02_history", """WITH {views} SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chars_before, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS recent,
  coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') AS last_role FROM messages""")
def _(v):
    full = sessions.prior_messages(v.messages, "conv_id", "turn").withColumnRenamed("history", "everything")
    both = full.join(sessions.recent_messages(v.messages, "conv_id", "turn", 4).select("conv_id", "turn", "history"), ["conv_id", "turn"])
    chars = F.aggregate("everything", F.lit(0).cast("long"), lambda a, m: a + F.length(m["text"]))
    return both.select("conv_id", "turn", chars.alias("chars_before"), F.size("history").cast("long").alias("recent"), F.coalesce(F.try_element_at("history", F.lit(-1))["role"], F.lit("")).alias("last_role"))


@query("s09_r03_turn_fanout", """WITH {views}, t AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), u AS (SELECT 's' || conv_id AS session_id, conv_id * 1000 + turn AS turn_id, text AS a, CASE WHEN nr = 'assistant' THEN nt END AS b FROM t WHERE role = 'student')
SELECT 'sessions' AS tbl, session_id AS key, ''::VARCHAR AS detail FROM u GROUP BY session_id UNION ALL SELECT 'turns', turn_id::VARCHAR, session_id FROM u UNION ALL SELECT 'messages', turn_id || '/0', 'student' FROM u UNION ALL SELECT 'messages', turn_id || '/1', 'assistant' FROM u WHERE b IS NOT NULL
UNION ALL SELECT 'candidates', c.turn_id || '/' || candidate_id, '' FROM candidates c JOIN u ON u.turn_id = c.turn_id""")
def _(v):
    turns = sessions.paired_turns(v.messages, "conv_id", "turn").select(F.concat(F.lit("s"), "conv_id").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "user_message", "assistant_message", F.lit(None).cast("timestamp").alias("created_at"))
    t = sessions.fan_out(turns, v.candidates, scores.preference_pairs(v.candidates, "turn_id", "total", "boundary", "cand_no", "candidate_id"))
    row = lambda name, key, detail: t[name].select(F.lit(name).alias("tbl"), key.alias("key"), detail.alias("detail"))
    key = lambda *c: F.concat_ws("/", *(F.col(x).cast("string") for x in c))
    parts = [row("sessions", key("session_id"), F.lit("")), row("turns", key("turn_id"), F.col("session_id")), row("messages", key("turn_id", "position"), F.col("role")), row("candidates", key("turn_id", "candidate_id"), F.lit(""))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("s10_critic_run", """WITH {views} SELECT turn_id, (row_number() OVER (PARTITION BY turn_id ORDER BY cand_no) - 1)::INT AS position, candidate_id, er, ip FROM candidates""")
def _(v):
    runs = v.candidates.groupBy("turn_id").agg(F.sort_array(F.collect_list(F.struct("cand_no", "candidate_id", "er", "ip"))).alias("scores"))
    return sessions.critic_run(runs, "turn_id", "scores")[1].drop("cand_no")


@query("s12_t08_manifest", """SELECT count(*) AS rows, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents""")
def _(v):
    from ..sources.tables import manifest

    m = manifest(v.table("documents"), ["lang", "source"])
    return m.select("rows", F.array_join("lang", ",").alias("langs"), F.array_join("source", ",").alias("sources"))


@query("w03_t02_t05_numbering", """WITH {views}, u AS (SELECT 0 AS part, session_id AS key, turn_id FROM turns WHERE status = 'answered' UNION ALL SELECT 1, CASE turn_id % 5 WHEN 0 THEN 'x' || turn_id WHEN 1 THEN (turn_id * 1000000)::VARCHAR ELSE ' ' || turn_id END, turn_id FROM turns WHERE status <> 'answered')
SELECT part::INT AS part, turn_id, row_number() OVER (ORDER BY part, try_cast(trim(key) AS BIGINT) IS NULL, try_cast(trim(key) AS BIGINT), key, turn_id) AS number FROM u""")
def _(v):
    a = v.turns.where("status = 'answered'").select(F.col("session_id").alias("key"), "turn_id")
    b = v.turns.where("status <> 'answered'").select(F.when(F.col("turn_id") % 5 == 0, F.concat(F.lit("x"), "turn_id")).when(F.col("turn_id") % 5 == 1, (F.col("turn_id") * 1000000).cast("string")).otherwise(F.concat(F.lit(" "), "turn_id")).alias("key"), "turn_id")
    rows = queues.ordered_union(a, b).withColumn("n", queues.numeric_key(F.col("key")))
    return queues.numbered(rows, "part", "n", "key", "turn_id").select("part", "turn_id", F.col("number").cast("long").alias("number"))


@query("w04_priority_queue", """WITH {views}, r AS (SELECT turn_id, cand_no, turn_id * 10 + cand_no AS ord, CASE WHEN boundary AND er = 2 THEN 0 WHEN er < 2 AND ip < 2 AND ex = 2 THEN 1 ELSE 2 END AS rule FROM candidates), k AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY rule, ord) AS first FROM r),
p AS (SELECT ord, row_number() OVER (ORDER BY rule, ord) AS rank FROM k WHERE first = 1 QUALIFY row_number() OVER (ORDER BY rule, ord) <= 4000)
SELECT r.turn_id, r.cand_no, CASE WHEN p.rank IS NULL THEN 'backup' ELSE 'priority' END AS bucket, p.rank, CASE WHEN p.rank IS NULL THEN '' WHEN rule = 0 THEN 'edge' WHEN rule = 1 THEN 'low' ELSE 'balanced_fill' END AS reason FROM r LEFT JOIN p USING (ord)""")
def _(v):
    c = v.candidates.withColumn("ord", F.col("turn_id") * 10 + F.col("cand_no"))
    tests = [("edge", F.col("boundary") & (F.col("er") == 2)), ("low", (F.col("er") < 2) & (F.col("ip") < 2) & (F.col("ex") == 2))]
    return queues.priority_queue(c, "turn_id", "ord", tests, 4000).select("turn_id", "cand_no", "bucket", F.col("rank").cast("long").alias("rank"), "reason")


@query("w06_terciles", """WITH {views}, s AS (SELECT turn_id, candidate_id, total, row_number() OVER (ORDER BY total) - 1 AS i, count(*) OVER () AS n FROM candidates), c AS (SELECT max(total) FILTER (i = (n - 1) // 3) AS low, max(total) FILTER (i = 2 * (n - 1) // 3) AS high FROM s)
SELECT turn_id, candidate_id, CASE WHEN total <= low THEN 'low' WHEN total <= high THEN 'mid' ELSE 'high' END AS bucket FROM s, c""")
def _(v):
    rows = v.candidates.crossJoin(F.broadcast(sampling.tercile_cuts(v.candidates, "total")))
    return rows.select("turn_id", "candidate_id", sampling.tercile(F.col("total")).alias("bucket"))


FILL = """s0 AS (SELECT turn_id * 10 + cand_no AS id, scenario, orientation FROM candidates JOIN turns USING (turn_id)), c1 AS (SELECT scenario, count(*) AS a FROM s0 GROUP BY scenario), u1 AS (SELECT scenario, unnest(range(1, least(a, 600) + 1)) AS p FROM c1),
q1 AS (SELECT scenario, count(*) AS q FROM (SELECT *, row_number() OVER (ORDER BY p, md5('seed|' || scenario || '|' || p)) AS r FROM u1) WHERE r <= 600 GROUP BY scenario),
c2 AS (SELECT scenario, orientation, count(*) AS a FROM s0 GROUP BY ALL), u2 AS (SELECT scenario, orientation, q, unnest(range(1, least(a, q) + 1)) AS p FROM c2 JOIN q1 USING (scenario)),
q2 AS (SELECT scenario, orientation, count(*) AS q FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY p, md5('seed|' || orientation || '|' || p)) AS r FROM u2) WHERE r <= q GROUP BY ALL),
picked AS (SELECT s0.*, q FROM s0 JOIN q2 USING (scenario, orientation) QUALIFY row_number() OVER (PARTITION BY scenario, orientation ORDER BY md5('seed|' || id), id) <= q)"""


@query("w05_stratified_sample", "WITH {views}, " + FILL + " SELECT id, scenario, orientation, row_number() OVER (ORDER BY md5('seed|order|' || id), id) AS sample_no FROM picked")
def _(v):
    rows = v.candidates.join(v.turns.select("turn_id", "scenario"), "turn_id").select((F.col("turn_id") * 10 + F.col("cand_no")).alias("id"), "scenario", "orientation")
    return sampling.stratified_sample(rows, "id", ["scenario", "orientation"], 600, "seed").select("id", "scenario", "orientation", F.col("sample_no").cast("long").alias("sample_no"))


@query("w07_balanced_subset", """WITH {views}, s AS (SELECT turn_id, scenario, row_number() OVER (PARTITION BY scenario ORDER BY turn_id) AS k, min(turn_id) OVER (PARTITION BY scenario) AS f FROM turns) SELECT turn_id, scenario FROM s QUALIFY row_number() OVER (ORDER BY k, f) <= 500""")
def _(v):
    return sampling.balanced_subset(v.turns.select("turn_id", "scenario"), "scenario", "turn_id", 500)


@query("w08_keep_one", """WITH {views} SELECT session_id, min(turn_id) AS first_turn, max(turn_id) AS last_turn FROM turns GROUP BY session_id""")
def _(v):
    t = v.turns.select("session_id", "turn_id")
    return sampling.keep_one(t, "session_id", "turn_id").withColumnRenamed("turn_id", "first_turn").join(sampling.keep_one(t, "session_id", "turn_id", last=True).withColumnRenamed("turn_id", "last_turn"), "session_id")


@query("w09_w10_top_keywords", """WITH {views}, k AS (SELECT source AS token, scenario AS label, count(*) AS score FROM examples GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, token) AS w FROM k) SELECT token, label, score FROM r QUALIFY row_number() OVER (ORDER BY w > 5, score DESC, token, label) <= 20""")
def _(v):
    k = v.examples.groupBy(F.col("source").alias("token"), F.col("scenario").alias("label")).agg(F.count("*").alias("score"))
    return features.top_per_class(k, "label", 20, 4, tie="label").select("token", "label", "score")


@query("w12_positions", """WITH {views} SELECT turn_id, candidate_id, 0::INT AS position, tags[1] AS tag FROM candidates WHERE len(tags) > 0""")
def _(v):
    return v.candidates.select("turn_id", "candidate_id", F.posexplode("tags").alias("position", "tag"))


GRID = "g AS (SELECT l.lang AS persona, s.source AS scenario, CASE WHEN lang = 'en' AND source = 'src0' THEN 40 ELSE ceil(30 * CASE WHEN source IN ('src1', 'src2') THEN 1.5::DOUBLE ELSE 1 END)::BIGINT END AS target FROM (SELECT DISTINCT lang FROM documents) l, (SELECT DISTINCT source FROM documents) s), d AS (SELECT lang AS persona, source AS scenario, count(*) AS done FROM documents GROUP BY ALL)"


def quotas(v):
    d = v.table("documents")
    grid = generation.cells(d.select(F.col("lang").alias("persona")).distinct(), d.select(F.col("source").alias("scenario")).distinct())
    explicit = v.spark.createDataFrame([("en", "src0", 40)], "persona string, scenario string, quota long")
    multipliers = v.spark.createDataFrame([("src1", 1.5), ("src2", 1.5)], "scenario string, multiplier double")
    return generation.quotas(grid, explicit, multipliers, 30)


@query("g02_quotas", "WITH " + GRID + " SELECT persona, scenario, target FROM g")
def _(v):
    return quotas(v)


@query("g03_w13_work_list", "WITH " + GRID + """ SELECT persona, scenario, unnest(range(coalesce(done, 0), target)) AS "index" FROM g LEFT JOIN d USING (persona, scenario)""")
def _(v):
    existing = v.table("documents").select(F.col("lang").alias("persona"), F.col("source").alias("scenario"))
    return generation.work_list(quotas(v), existing)


@query("g04_prompts", "WITH " + GRID + """, w AS (SELECT persona, scenario, unnest(range(coalesce(done, 0), target)) AS i FROM g LEFT JOIN d USING (persona, scenario)), p AS (SELECT *, ['exam', 'friends', 'home'][i % 3 + 1] AS sub FROM w)
SELECT persona, scenario, i AS "index", sub AS subscenario, left(sha256('As ' || persona || ' about ' || scenario || ': ' || sub), 16) AS prompt_hash, 'run00001-' || lpad(i::VARCHAR, 4, '0') AS id FROM p""")
def _(v):
    existing = v.table("documents").select(F.col("lang").alias("persona"), F.col("source").alias("scenario"))
    made = generation.prompts(generation.work_list(quotas(v), existing), "As %s about %s: %s", ["exam", "friends", "home"], ["calm", "brief"], "my-run-00001")
    return made.select("persona", "scenario", "index", "subscenario", "prompt_hash", "id")


@query("g05_extraction", "WITH {views}, best AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY total DESC, cand_no) AS place FROM candidates WHERE NOT boundary), prefs AS (SELECT a.turn_id, a.candidate_id AS winner FROM best a JOIN best b ON a.turn_id = b.turn_id AND a.place = 1 AND b.place = 2 WHERE a.total > b.total) SELECT turn_id, status, CASE WHEN status = 'answered' THEN winner END AS winner FROM turns LEFT JOIN prefs USING (turn_id)")
def _(v):
    p = scores.preference_pairs(v.candidates, "turn_id", "total", "boundary", "cand_no", "candidate_id").select("turn_id", "winner")
    return v.turns.join(p, "turn_id", "left").select("turn_id", "status", F.when(F.col("status") == "answered", F.col("winner")).alias("winner"))


@query("w14_split", """WITH {views}, r AS (SELECT doc_id, safety, row_number() OVER (PARTITION BY safety ORDER BY md5('split|' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY safety) AS n FROM examples) SELECT doc_id, safety, CASE WHEN k <= round(n * 0.2::DOUBLE) THEN 'test' WHEN k <= round(n * 0.2::DOUBLE) + round((n - round(n * 0.2::DOUBLE)) * 0.125::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM r""")
def _(v):
    return sampling.stratified_split(v.examples.select("doc_id", "safety"), "safety", "doc_id", 0.2, 0.125, "split")


@query("w15_sample_per_group", """WITH {views} SELECT session_id, turn_id FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY md5('probe|' || turn_id), turn_id) <= 2""")
def _(v):
    return sampling.sample_per_group(v.turns.select("session_id", "turn_id"), "session_id", "turn_id", 2, "probe")


@query("t04_t06_t07_sets", """WITH {views}, a AS (SELECT session_id FROM turns WHERE status = 'answered' AND turn_id BETWEEN 100 AND 9000), b AS (SELECT session_id FROM turns WHERE status = 'module_failed') SELECT session_id, 'both' AS kind FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT session_id, 'only_answered' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def _(v):
    a = v.turns.where("status = 'answered' and turn_id between 100 and 9000").select("session_id")
    b = v.turns.where("status = 'module_failed'").select("session_id")
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.subtract(b).withColumn("kind", F.lit("only_answered")))


@query("t09_t10_pair_filter", """WITH {views}, w AS (SELECT a.turn_id, t.scenario, a.boundary AS f1, b.boundary AS f2, a.orientation || a.er || a.ip || b.er || b.ip || a.ex AS txt FROM candidates a JOIN candidates b ON a.turn_id = b.turn_id AND a.cand_no = 1 AND b.cand_no = 2 JOIN turns t ON t.turn_id = a.turn_id),
m AS (SELECT *, CASE WHEN scenario = '5-LOW' THEN 'fallback_text' WHEN f1 AND f2 THEN 'both_flagged' ELSE '' END AS x FROM w) SELECT turn_id, CASE WHEN x = '' AND turn_id > min(turn_id) FILTER (x = '') OVER (PARTITION BY txt) THEN 'duplicate_text' ELSE x END AS exclusion FROM m""")
def _(v):
    wide = pairs.pair_table(v.candidates.join(v.turns.select("turn_id", "scenario"), "turn_id"), "turn_id", "candidate_id", ["orientation", "er", "ip", "ex", "boundary"], ["scenario"])
    wide = wide.withColumn("text", F.concat("c1_orientation", *(F.col(c).cast("string") for c in ("c1_er", "c1_ip", "c2_er", "c2_ip", "c1_ex"))))
    tests = [("fallback_text", F.col("scenario") == "5-LOW"), ("both_flagged", F.col("c1_boundary") & F.col("c2_boundary"))]
    return pairs.filter_pairs(wide, tests, "text", "turn_id").select("turn_id", "exclusion")


@query("t10_exclusion_counts", """WITH {views}, w AS (SELECT a.boundary AS f1, b.boundary AS f2, t.scenario FROM candidates a JOIN candidates b ON a.turn_id = b.turn_id AND a.cand_no = 1 AND b.cand_no = 2 JOIN turns t ON t.turn_id = a.turn_id), c AS (SELECT count(*) FILTER (scenario = '5-LOW') AS x, count(*) FILTER (scenario <> '5-LOW' AND f1 AND f2) AS y FROM w)
SELECT 0 AS position, 'fallback_text' AS exclusion, x AS n FROM c UNION ALL SELECT 1, 'both_flagged', y FROM c UNION ALL SELECT 2, 'never', 0 FROM c""")
def _(v):
    wide = pairs.pair_table(v.candidates.join(v.turns.select("turn_id", "scenario"), "turn_id"), "turn_id", "candidate_id", ["boundary"], ["scenario"])
    tests = [("fallback_text", F.col("scenario") == "5-LOW"), ("both_flagged", F.col("c1_boundary") & F.col("c2_boundary"))]
    marked = pairs.filter_pairs(wide.withColumn("text", F.col("turn_id").cast("string")), tests, "text", "turn_id")
    return reshape.counted_exclusions(marked, ["fallback_text", "both_flagged", "never"])


@query("t11_t12_blind", """WITH {views} SELECT turn_id, cand_no, '' AS A_ER, unnest(['er', 'ip', 'ex']) AS source, unnest([er, ip, ex]) AS score FROM candidates""")
def _(v):
    sheet = reshape.blind(v.candidates, ["er", "ip", "ex", "total", "boundary", "tags", "casel"], ["A_ER"])
    key = F.col("turn_id") * 10 + F.col("cand_no")
    holdout = reshape.unpivot_scores(v.candidates.withColumn("key", key), "key", ["er", "ip", "ex"])
    return sheet.withColumn("key", key).join(holdout, "key").select("turn_id", "cand_no", "A_ER", "source", "score")


@query("t13_t15_t19_controls", """WITH {views}, g AS (SELECT doc_id, scenario, row_number() OVER (PARTITION BY scenario ORDER BY doc_id) - 1 AS k FROM examples WHERE safety = 'green'), c AS (SELECT CASE safety WHEN 'green' THEN 'clean' WHEN 'red' THEN 'boundary' ELSE 'negative' END AS kind, doc_id AS other, scenario AS s FROM examples WHERE safety IN ('red', 'yellow', 'green') AND NOT (safety = 'red' AND scenario IN ('de', 'fr'))),
o AS (SELECT kind, other, s, row_number() OVER (PARTITION BY kind, s ORDER BY other) - 1 AS r, count(*) OVER (PARTITION BY kind, s) AS n FROM c UNION ALL SELECT kind, other, '*', row_number() OVER (PARTITION BY kind ORDER BY other) - 1, count(*) OVER (PARTITION BY kind) FROM c),
f AS (SELECT kind, scenario, CASE WHEN scenario IN (SELECT s FROM c WHERE c.kind = x.kind) THEN scenario ELSE '*' END AS s FROM (SELECT DISTINCT scenario FROM g), (SELECT DISTINCT kind FROM c) x),
p AS (SELECT f.kind AS pair_type, doc_id AS good, other FROM g JOIN f USING (scenario) JOIN o ON o.kind = f.kind AND o.s = f.s AND k % n = r UNION ALL SELECT 'duplicate_tie', doc_id, doc_id FROM g), s AS (SELECT *, ('0x' || substr(md5('swap|' || pair_type || '/' || good), 1, 1))::INT % 2 = 1 AS swapped FROM p)
SELECT pair_type, good, other, CASE WHEN swapped THEN other ELSE good END AS "left", CASE WHEN swapped THEN good ELSE other END AS "right", swapped FROM s""")
def _(v):
    side = lambda s: v.examples.where(F.col("safety") == s).select("doc_id", "scenario")
    return reshape.control_pairs(side("green"), side("green"), side("yellow"), side("red").where("scenario not in ('de', 'fr')"), "scenario", "doc_id", "swap")


@query("t16_t18_queue_rows", """WITH {views} SELECT turn_id, 'calibration' AS row_type, er::VARCHAR AS human, boundary::VARCHAR AS flag FROM candidates WHERE cand_no = 1 UNION ALL SELECT turn_id, 'review', '', boundary::VARCHAR FROM candidates WHERE cand_no = 2""")
def _(v):
    row = lambda n, kind, human: v.candidates.where(F.col("cand_no") == n).select("turn_id", F.lit(kind).alias("row_type"), human.alias("human"), F.col("boundary").cast("string").alias("flag"))
    return row(1, "calibration", F.col("er").cast("string")).unionByName(row(2, "review", F.lit("")))


@query("t17_erasure", """WITH {views} SELECT count(*) FILTER (session_id = 's1' OR starts_with(session_id, 's7')) AS deleted, count(*) FILTER (NOT (session_id = 's1' OR starts_with(session_id, 's7'))) AS remaining FROM turns""")
def _(v):
    left, counts = sessions.erase(v.turns, None, (F.col("session_id") == "s1") | F.col("session_id").startswith("s7"))
    return counts


@query("r02_latest_guidance", """SELECT user_id, first(event_id ORDER BY ts DESC, event_id DESC) AS event_id, first(event_type ORDER BY ts DESC, event_id DESC) AS status, first(value ORDER BY ts DESC, event_id DESC) AS value FROM events GROUP BY user_id""")
def _(v):
    e = v.table("events").select("user_id", "ts", "event_id", F.col("event_type").alias("status"), "value")
    return sessions.latest(e, "user_id", "ts", "event_id").select("user_id", "event_id", "status", "value")


@query("r06_risk_rates", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS risky, round(count(*) FILTER (event_type = 'purchase') / count(*), 9) AS rate FROM events GROUP BY 1""")
def _(v):
    from ..streaming.signals import risk_rates

    e = v.table("events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("event_type") == "purchase").alias("risky"))
    return risk_rates(e).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "n", "risky", F.round("rate", 9).alias("rate"))


@query("f46_f47_context", """WITH {views}, e AS (SELECT doc_id, scenario, tier, n_chars FROM examples WHERE tier <> 'stats_only' AND safety <> 'red'), r AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY tier, n_chars DESC, doc_id) AS k FROM e) SELECT scenario, string_agg(doc_id::VARCHAR, ',' ORDER BY k) || ',external' AS context FROM r WHERE k <= 3 GROUP BY scenario""")
def _(v):
    e = v.examples.where("tier <> 'stats_only' and safety <> 'red'")
    order = Window.partitionBy("scenario").orderBy("tier", F.desc("n_chars"), "doc_id")
    top = e.withColumn("k", F.row_number().over(order)).where("k <= 3")
    cards = F.transform(F.array_sort(F.collect_list(F.struct("k", "doc_id"))), lambda x: x["doc_id"].cast("string"))
    return top.groupBy("scenario").agg(F.array_join(decisions.context(cards, F.array(F.lit("external")), 3), ",").alias("context"))


@query("m01_scaling", """WITH {views}, c AS (SELECT count(*) - 1 AS d, avg(er) AS me, stddev_samp(er) AS se, avg(total) AS mt, stddev_samp(total) AS st FROM candidates) SELECT turn_id, candidate_id, round((er - me) / se, 6) AS er_scaled, round((total - mt) / st, 6) AS total_scaled FROM candidates, c""")
def _(v):
    from ..operators.models import scale

    s = scale(v.candidates, v.candidates, ["er", "total"])
    return s.select("turn_id", "candidate_id", F.round("er_scaled", 6).alias("er_scaled"), F.round("total_scaled", 6).alias("total_scaled"))


@query("m02_keyword_model")
def _(v):
    from ..operators.models import keyword_models

    rows = sampling.stratified_split(v.examples.where("safety <> 'reject'"), "safety", "doc_id", 0.2, 0.125, "split")
    return keyword_models(rows.select("doc_id", "safety", "split", "text"), "safety", [50, 100])


@query("u03_tokenizers", """WITH w AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS word, length(regexp_replace(text, '[^\\x{4E00}-\\x{9FFF}A-Za-z0-9]+', '', 'g')) AS c FROM documents), g AS (SELECT *, greatest(c - 1, 0) + greatest(c - 2, 0) + greatest(c - 3, 0) AS grams FROM w) SELECT doc_id, word::BIGINT AS word, grams::BIGINT AS char_ngram, (word + grams)::BIGINT AS mixed FROM g""")
def _(v):
    from ..operators.models import tokenizer

    return v.table("documents").select("doc_id", *(F.size(tokenizer(n)(F.col("text"))).cast("long").alias(n) for n in ("word", "char_ngram", "mixed")))


@query("m03_u01_u02_batch_scorer", """SELECT doc_id, length(text) AS score, CASE WHEN length(text) = 0 THEN 'empty' ELSE '' END AS error, round(length(replace(text, 'e', '')) / greatest(length(text), 1), 9) AS green, round(1 - length(replace(text, 'e', '')) / greatest(length(text), 1), 9) AS red FROM documents""")
def _(v):
    """Two outside scorers over whole texts: one number each, and a struct of probabilities."""
    from ..operators.models import classify_batches, score_batches

    lengths = lambda texts: [(len(t), "" if t else "empty") for t in texts]
    shares = lambda texts: [((len(t) - t.count("e")) / max(len(t), 1), 0.0, 1 - (len(t) - t.count("e")) / max(len(t), 1)) for t in texts]
    scored = score_batches(v.table("documents").select("doc_id", "text"), "text", lengths, "long", retries=1)
    both = classify_batches(scored, "text", shares)
    return both.select("doc_id", "score", "error", F.round("probabilities.green", 9).alias("green"), F.round("probabilities.red", 9).alias("red"))


@query("m03_pooled_embeddings", """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS w FROM documents), x AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS a, sum(length(w) - length(replace(w, 'e', ''))) AS b, sum(CASE WHEN starts_with(w, 't') THEN 1 ELSE 0 END) AS c FROM t WHERE length(w) > 3 GROUP BY doc_id)
SELECT doc_id, round(coalesce(a / n, 0)::DOUBLE, 9) AS size, round(coalesce(b / n, 0)::DOUBLE, 9) AS es, round(coalesce(c / n, 0)::DOUBLE, 9) AS ts FROM documents LEFT JOIN x USING (doc_id)""")
def _(v):
    """A token model (a word's length, its e's, whether it begins with t; words of up to three letters masked) pooled in two ways: by batches in Python and as an expression; both must agree."""
    from ..functions.text import latin_words
    from ..operators.models import embed_batches, pooled

    words = v.table("documents").select("doc_id", F.array_join(latin_words(F.lower("text")), " ").alias("text"))
    made = embed_batches(words, "doc_id", "text", lambda: word_model)
    told = F.split("text", " ")
    vectors = F.transform(told, lambda w: F.array(F.length(w).cast("double"), (F.length(w) - F.length(F.replace(w, F.lit("e"), F.lit("")))).cast("double"), w.startswith("t").cast("double")))
    mean = words.select("doc_id", pooled(vectors, F.transform(told, lambda w: (F.length(w) > 3).cast("int"))).alias("mean"))
    both = made.join(mean, "doc_id").where(F.forall(F.zip_with("embedding", "mean", lambda a, b: F.abs(a - b) < 1e-9), lambda x: x))
    return both.select("doc_id", *(F.round(F.get("embedding", F.lit(i)), 9).alias(n) for i, n in enumerate(("size", "es", "ts"))))


def word_model(texts):
    """Vectors and masks of words, filled up to the longest text."""
    import numpy as np

    words = [t.split(" ") for t in texts]
    most = max(map(len, words))
    vectors, mask = np.zeros((len(texts), most, 3)), np.zeros((len(texts), most))
    for i, ws in enumerate(words):
        vectors[i, : len(ws)] = [(len(w), w.count("e"), w.startswith("t")) for w in ws]
        mask[i, : len(ws)] = [len(w) > 3 for w in ws]
    return vectors, mask


@query("w01_shared_histories", """WITH {views} SELECT conv_id, turn, count(*) OVER w AS messages, coalesce(sum(length(text)) OVER w, 0)::BIGINT AS chars FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(v):
    """Full histories stored once per session, in parts of four messages, and put together for each turn."""
    parts, turns = sessions.shared_histories(v.messages, "conv_id", "turn", part=4)
    told = sessions.histories_of(turns, parts, "conv_id", part=4)
    return told.select("conv_id", "turn", F.size("history").cast("long").alias("messages"), F.aggregate("history", F.lit(0).cast("long"), lambda a, m: a + F.length(m["text"])).alias("chars"))
