"""Queries of aggregates, agreement, metrics and keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import agreement, features, labels, metrics, pairs, rules, scores
from .registry import query
from .rules import SIGNALS
from .views import spoken

WORDS = "regexp_extract_all(lower(text), '[a-z0-9]{2,}')"


@query("a01_ordered_counts", """WITH {views} SELECT scenario AS value, count(*) AS n, CASE scenario WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END::BIGINT AS position FROM examples GROUP BY scenario""")
def _(v):
    return labels.ordered_counts(v.examples, "scenario", ["en", "fr"]).withColumn("position", F.col("position").cast("long"))


@query("a02_a03_crosstab", """WITH {views}, c AS (SELECT scenario, count(*) FILTER (safety = 'green') AS green, count(*) FILTER (safety = 'yellow') AS yellow, count(*) FILTER (safety = 'red') AS red FROM examples GROUP BY scenario)
SELECT scenario, round(coalesce(100 * green / nullif(green + yellow + red, 0), 0), 6) AS green, round(coalesce(100 * yellow / nullif(green + yellow + red, 0), 0), 6) AS yellow, round(coalesce(100 * red / nullif(green + yellow + red, 0), 0), 6) AS red FROM c""")
def _(v):
    values = ["green", "yellow", "red"]
    shares = labels.row_shares(labels.crosstab(v.examples, "scenario", "safety", values), values)
    return shares.select("scenario", *(F.round(c, 6).alias(c) for c in values))


@query("a04_coverage", """WITH {views}, t AS (SELECT turn_id, unnest(tags) AS tag FROM candidates) SELECT tag, count(*) AS occurrences, count(DISTINCT turn_id) AS coverage FROM t GROUP BY tag""")
def _(v):
    t = v.candidates.select("turn_id", F.explode("tags").alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("occurrences"), F.count_distinct("turn_id").alias("coverage"))


SEQ = """s AS (SELECT t.turn_id, t.scenario, list(c.orientation || er ORDER BY cand_no) AS items FROM candidates c JOIN turns t USING (turn_id) GROUP BY ALL),
k AS (SELECT scenario, 'rows' AS kind, '' AS name FROM s UNION ALL SELECT scenario, 'strategy', unnest(items) FROM s UNION ALL SELECT scenario, 'first', items[1] FROM s UNION ALL SELECT scenario, 'transition', unnest(list_transform(range(1, len(items)), lambda i: items[i] || '->' || items[i + 1])) FROM s),
st AS (SELECT scenario, kind, name, count(*) AS n FROM k GROUP BY GROUPING SETS ((scenario, kind, name), (kind, name)))"""


def sequences(v):
    c = v.candidates.withColumn("item", F.concat("orientation", F.col("er").cast("string")))
    items = c.groupBy("turn_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("cand_no", "item"))), lambda x: x["item"]).alias("items"))
    return items.join(v.turns.select("turn_id", "scenario"), "turn_id")


@query("a05_a06_strategy_stats", "WITH {views}, " + SEQ + " SELECT coalesce(scenario, 'all') AS scenario, kind, name, n FROM st")
def _(v):
    return labels.strategy_stats(sequences(v), "scenario", "items").withColumn("scenario", F.coalesce("scenario", F.lit("all")))


@query("a07_t03_strategy_prior", "WITH {views}, " + SEQ + """, r AS (SELECT *, row_number() OVER (PARTITION BY scenario, kind ORDER BY n DESC, name) AS rank FROM st)
SELECT coalesce(scenario, 'all') AS scenario, kind, string_agg(name || '(' || n || ')', ', ' ORDER BY rank) AS prior FROM r WHERE rank <= CASE kind WHEN 'first' THEN 3 WHEN 'strategy' THEN 4 WHEN 'transition' THEN 2 ELSE 0 END GROUP BY r.scenario, kind""")
def _(v):
    stats = labels.strategy_stats(sequences(v), "scenario", "items").withColumn("scenario", F.coalesce("scenario", F.lit("all")))
    return labels.strategy_prior(stats, "scenario", {"first": 3, "strategy": 4, "transition": 2})


@query("a08_a09_profile", """WITH {views} SELECT tier, count(*) AS rows, count(*) FILTER (safety = 'green') AS green, round(avg(n_chars), 2) AS mean_chars, round(quantile_cont(n_chars, 0.98), 6) AS p98, round(quantile_cont(n_chars, 0.25), 6) AS q1, round(quantile_cont(n_chars, 0.75), 6) AS q3, round(avg(least(n_chars, (SELECT quantile_cont(n_chars, 0.98) FROM examples))), 6) AS clipped FROM examples GROUP BY tier""")
def _(v):
    whole = v.examples.agg(F.percentile("n_chars", 0.98).alias("cap"))
    p = lambda q: F.round(F.percentile("n_chars", q), 6)
    return v.examples.crossJoin(F.broadcast(whole)).groupBy("tier").agg(
        F.count("*").alias("rows"), F.count_if(F.col("safety") == "green").alias("green"), F.round(F.avg("n_chars"), 2).alias("mean_chars"), p(0.98).alias("p98"), p(0.25).alias("q1"), p(0.75).alias("q3"), F.round(F.avg(F.least("n_chars", "cap")), 6).alias("clipped")
    )


PREFS = """best AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY total DESC, cand_no) AS place FROM candidates WHERE NOT boundary),
prefs AS (SELECT a.turn_id, a.candidate_id AS winner, b.candidate_id AS loser, a.er - b.er AS delta FROM best a JOIN best b ON a.turn_id = b.turn_id AND a.place = 1 AND b.place = 2 WHERE a.total > b.total)"""


def preferences(v):
    return scores.metric_deltas(scores.preference_pairs(v.candidates, "turn_id", "total", "boundary", "cand_no", "candidate_id"), v.candidates, "turn_id", "candidate_id", F.col("er"))


@query("a10_a11_diversity", "WITH {views}, " + PREFS + """ SELECT coalesce(scenario, 'all') AS scenario, winner || '>' || loser AS pattern, count(*) AS n, min(delta) AS least, median(delta) AS middle, max(delta) AS most FROM prefs JOIN turns USING (turn_id) GROUP BY GROUPING SETS ((scenario, winner || '>' || loser), (winner || '>' || loser))""")
def _(v):
    p = preferences(v).join(v.turns.select("turn_id", "scenario"), "turn_id").withColumn("pattern", F.concat_ws(">", "winner", "loser"))
    g = p.groupingSets([["scenario", "pattern"], ["pattern"]], "scenario", "pattern")
    return g.agg(F.count("*").alias("n"), F.min("delta").alias("least"), F.percentile("delta", 0.5).alias("middle"), F.max("delta").alias("most")).withColumn("scenario", F.coalesce("scenario", F.lit("all")))


@query("a12_funnel", "WITH {views}, " + PREFS + """ SELECT scenario, count(*) AS raw, count(*) FILTER (status = 'answered') AS accepted, count(p.turn_id) FILTER (status = 'answered') AS pairs, round(count(*) FILTER (status = 'answered') / count(*), 9) AS accepted_rate, round(count(p.turn_id) FILTER (status = 'answered') / nullif(count(*) FILTER (status = 'answered'), 0), 9) AS pair_rate FROM turns LEFT JOIN prefs p USING (turn_id) GROUP BY scenario""")
def _(v):
    j = v.turns.join(preferences(v).select("turn_id", F.lit(True).alias("pair")), "turn_id", "left")
    ok = F.col("status") == "answered"
    c = j.groupBy("scenario").agg(F.count("*").alias("raw"), F.count_if(ok).alias("accepted"), F.count_if(ok & F.col("pair").isNotNull()).alias("pairs"))
    return c.withColumns({"accepted_rate": F.round(F.try_divide("accepted", "raw"), 9), "pair_rate": F.round(F.try_divide("pairs", "accepted"), 9)})


@query("a13_a16_reliability", """WITH {views}, w AS (SELECT turn_id, 'ER' AS dimension, 0.4::DOUBLE AS threshold, er AS a, ip AS b, ex AS m FROM candidates UNION ALL SELECT turn_id, 'IP', 0.4, ip, ex, er FROM candidates UNION ALL SELECT turn_id, 'EX', 0.6, ex, ex, ip FROM candidates), c AS (SELECT *, floor((a + b) / 2.0 + 0.5)::INT AS c FROM w),
k AS (SELECT dimension, threshold, count(*) AS n, 1 - (count(*) * sum((a - b) ** 2))::DOUBLE / nullif(count(*) * sum(a * a) + count(*) * sum(b * b) - 2 * sum(a) * sum(b), 0) AS h, 1 - (count(*) * sum((c - m) ** 2))::DOUBLE / nullif(count(*) * sum(c * c) + count(*) * sum(m * m) - 2 * sum(c) * sum(m), 0) AS m,
  '{"0":' || count(*) FILTER (a = 0) || ',"1":' || count(*) FILTER (a = 1) || ',"2":' || count(*) FILTER (a = 2) || '}' AS da, '{"0":' || count(*) FILTER (c = 0) || ',"1":' || count(*) FILTER (c = 1) || ',"2":' || count(*) FILTER (c = 2) || '}' AS dc FROM c GROUP BY ALL)
SELECT dimension, n, round(h, 9) AS human_kappa, round(m, 9) AS model_kappa, coalesce(h >= threshold AND m >= threshold, false) AS passed, da AS dist_a, dc AS dist_c FROM k""".replace("FROM c GROUP BY ALL", "FROM c GROUP BY dimension, threshold"))
def _(v):
    cols = {"ER": ("er", "ip", "ex"), "IP": ("ip", "ex", "er"), "EX": ("ex", "ex", "ip")}
    rows = v.candidates.select("turn_id", *(F.col(c).alias(f"{s}_{d}") for d, cs in cols.items() for s, c in zip("abm", cs, strict=True)))
    r = agreement.reliability(rows, {"ER": 0.4, "IP": 0.4, "EX": 0.6})
    return r.select("dimension", "n", F.round("human_kappa", 9).alias("human_kappa"), F.round("model_kappa", 9).alias("model_kappa"), "passed", "dist_a", "dist_c")


@query("a17_a43_gate", """WITH {views}, g AS (SELECT count(*) AS total, count(*) FILTER (er = 2) AS er_two, count(*) FILTER (er = 2 AND ip = 2) AS both_two, bool_and(er = 2 AND ip = 2) AS saturated FROM candidates),
r AS (SELECT *, concat_ws(';', CASE WHEN er_two > floor(total * 0.3) THEN 'er_high' END, CASE WHEN both_two > floor(total * 0.2) THEN 'both_high' END) AS reasons FROM g) SELECT *, CASE WHEN reasons = '' THEN 'PASS' ELSE 'FAIL' END AS decision FROM r""")
def _(v):
    both = (F.col("er") == 2) & (F.col("ip") == 2)
    counts = {"er_two": F.count_if(F.col("er") == 2), "both_two": F.count_if(both), "saturated": F.bool_and(both)}
    return agreement.gate(v.candidates, [("er_high", F.col("er_two") > F.floor(F.col("total") * 0.3)), ("both_high", F.col("both_two") > F.floor(F.col("total") * 0.2))], counts)


RUNS = "runs AS (SELECT turn_id, cand_no, er, ip, ex, first_value(er) OVER w AS first_er, first_value(ip) OVER w AS first_ip, first_value(ex) OVER w AS first_ex FROM candidates WINDOW w AS (PARTITION BY turn_id ORDER BY cand_no))"


def runs(v):
    first = v.candidates.groupBy("turn_id").agg(F.min(F.struct("cand_no", "er", "ip", "ex")).alias("f"))
    return v.candidates.join(first, "turn_id").select("turn_id", "cand_no", "er", "ip", "ex", *(F.col(f"f.{d}").alias(f"first_{d}") for d in ("er", "ip", "ex")))


@query("a18_rescore_summary", "WITH {views}, " + RUNS + """ SELECT turn_id, count(*) AS runs, string_agg(er::VARCHAR, ';' ORDER BY cand_no) AS er_values, count(*) FILTER (er <> first_er) AS er_changes, min(ip) <> max(ip) AS ip_unstable, (bool_or(ex = 1) OR bool_or(first_ex = 1)) AND (bool_or(ex = 2) OR bool_or(first_ex = 2)) AS ex_flip FROM runs GROUP BY turn_id""")
def _(v):
    return scores.rescore_summary(runs(v), ["turn_id"], "cand_no").select("turn_id", "runs", "er_values", "er_changes", "ip_unstable", "ex_flip")


@query("a19_rescore_runs", "WITH {views}, " + RUNS + " SELECT turn_id, cand_no, er <> first_er AS er_changed, ip <> first_ip AS ip_changed, (ex = 1 AND first_ex = 2) OR (ex = 2 AND first_ex = 1) AS ex_flip FROM runs")
def _(v):
    return scores.rescore_runs(runs(v)).select("turn_id", "cand_no", "er_changed", "ip_changed", "ex_flip")


@query("a20_a22_consolidate", """WITH {views} SELECT turn_id, trunc(median(er))::INT AS er, trunc(median(ip))::INT AS ip, bool_or(boundary) AS boundary, coalesce(first(candidate_id ORDER BY cand_no) FILTER (boundary), '') AS reason, first(orientation ORDER BY cand_no) AS rationale, list_sort(list(ex))[count(*) // 2 + 1] AS upper_ex FROM candidates GROUP BY turn_id""")
def _(v):
    c = v.candidates.withColumns({"reason": F.col("candidate_id"), "rationale": F.col("orientation")})
    joined = c.groupBy("turn_id").agg(F.array_join(F.collect_list(F.col("ex").cast("string")), ";").alias("listed"))
    return scores.consolidate(c, ["turn_id"], "cand_no").join(joined, "turn_id").select("turn_id", "er", "ip", "boundary", "reason", "rationale", scores.upper_median(F.concat("listed", F.lit(";x"))).alias("upper_ex"))


@query("a21_upper_median", """WITH {views} SELECT turn_id, list_sort(list(ip))[count(*) // 2 + 1] AS upper_ip FROM candidates GROUP BY turn_id""")
def _(v):
    joined = v.candidates.groupBy("turn_id").agg(F.array_join(F.collect_list(F.col("ip").cast("string")), "; ").alias("l"))
    return joined.select("turn_id", scores.upper_median(F.concat(F.lit("high;"), F.col("l"))).alias("upper_ip"))


@query("a23_best", """WITH {views} SELECT turn_id, coalesce(first(candidate_id ORDER BY total DESC, cand_no) FILTER (NOT boundary), 'none') AS best FROM candidates GROUP BY turn_id""")
def _(v):
    return scores.best_candidates(v.candidates, "turn_id", "total", "boundary", "cand_no", "candidate_id", "none")


JUDGED = """j AS (SELECT a.turn_id, a.cand_no, CASE a.er WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS first, CASE a.ip WHEN 0 THEN 'B' WHEN 1 THEN 'A' ELSE 'tie' END AS second FROM candidates a),
s AS (SELECT *, first IS NULL AS invalid, coalesce(first = second, false) AS stable FROM j)"""


def stability(v):
    ab = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit(None)), F.col("er") + 1)
    ba = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("tie")), F.col("ip") + 1)
    judged = pairs.swap_orders(v.candidates.select("turn_id", "cand_no", ab.alias("x"), ba.alias("y"))).withColumn("winner", F.when(F.col("display") == "ab", F.col("x")).otherwise(F.col("y")))
    return pairs.order_stability(judged, ["turn_id", "cand_no"])


@query("a25_order_stability", "WITH {views}, " + JUDGED + " SELECT turn_id, cand_no, first, second, invalid, stable FROM s")
def _(v):
    return stability(v)


@query("a26_majority", "WITH {views}, " + JUDGED + """, m AS (SELECT turn_id, count(*) AS n, count(*) FILTER (stable AND first = 'A') AS votes_a, count(*) FILTER (stable AND first = 'B') AS votes_b, count(*) FILTER (NOT invalid AND NOT stable) AS unstable, count(*) FILTER (invalid) AS invalid FROM s GROUP BY turn_id), w AS (SELECT *, invalid = 0 AND greatest(votes_a, votes_b) >= ceil(n / 2) AND votes_a <> votes_b AS won FROM m)
SELECT turn_id, n, votes_a, votes_b, unstable, invalid, CASE WHEN won THEN CASE WHEN votes_a > votes_b THEN 'A' ELSE 'B' END END AS winner, CASE WHEN invalid > 0 THEN 'invalid' WHEN NOT won THEN 'unstable' WHEN greatest(votes_a, votes_b) = n THEN 'unanimous' WHEN least(votes_a, votes_b) > 0 THEN 'split_majority' ELSE 'majority_with_unstable' END AS confidence, CASE WHEN invalid > 0 THEN 'invalid' WHEN won THEN 'pairwise_stable' ELSE 'pointwise_tiebreak' END AS method FROM w""")
def _(v):
    return pairs.majority(stability(v), "turn_id")


@query("a28_patterns", "WITH {views}, " + JUDGED + " SELECT coalesce(first, '') AS first, coalesce(second, '') AS second, stable, count(*) AS n FROM s GROUP BY ALL")
def _(v):
    s = stability(v)
    return s.groupBy(F.coalesce("first", F.lit("")).alias("first"), F.coalesce("second", F.lit("")).alias("second"), "stable").agg(F.count("*").alias("n"))


@query("a30_a31_model_agreement", "WITH {views}, " + JUDGED + """, t AS (SELECT s.*, scenario FROM s JOIN turns USING (turn_id)) SELECT coalesce(scenario, 'all') AS scenario, count(*) AS n, count(*) FILTER (NOT invalid) AS valid, round(avg(stable::INT) FILTER (NOT invalid), 9) AS consistency, round(avg((first = second)::INT), 9) AS agreement, count(DISTINCT turn_id) AS pairs FROM t GROUP BY GROUPING SETS ((scenario), ())""")
def _(v):
    t = stability(v).join(v.turns.select("turn_id", "scenario"), "turn_id")
    g = t.groupingSets([["scenario"], []], "scenario").agg(
        F.count("*").alias("n"), F.count_if(~F.col("invalid")).alias("valid"), F.round(F.avg(F.when(~F.col("invalid"), F.col("stable").cast("int"))), 9).alias("consistency"), F.round(F.avg((F.col("first") == F.col("second")).cast("int")), 9).alias("agreement"), F.count_distinct("turn_id").alias("pairs")
    )
    return g.withColumn("scenario", F.coalesce("scenario", F.lit("all")))


@query("a32_probe_summary", """WITH {views} SELECT t.scenario, count(*) AS n, round(avg(a.er - b.er), 9) AS er_gap, round(avg((a.er > b.er AND b.ip > a.ip)::INT), 9) AS separated, count(*) FILTER (a.boundary OR b.boundary) AS flagged FROM candidates a JOIN candidates b ON a.turn_id = b.turn_id AND a.cand_no = 1 AND b.cand_no = 2 JOIN turns t ON t.turn_id = a.turn_id GROUP BY t.scenario""")
def _(v):
    wide = pairs.pair_table(v.candidates.join(v.turns.select("turn_id", "scenario"), "turn_id"), "turn_id", "candidate_id", ["er", "ip", "boundary"], ["scenario"])
    split = (F.col("c1_er") > F.col("c2_er")) & (F.col("c2_ip") > F.col("c1_ip"))
    return wide.groupBy("scenario").agg(F.count("*").alias("n"), F.round(F.avg(F.col("c1_er") - F.col("c2_er")), 9).alias("er_gap"), F.round(F.avg(split.cast("int")), 9).alias("separated"), F.count_if(F.col("c1_boundary") | F.col("c2_boundary")).alias("flagged"))


@query("a33_top_errors", """SELECT left(props, 12) AS error, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, error LIMIT 5""")
def _(v):
    return v.table("events").groupBy(F.left("props", F.lit(12)).alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(5)


CONFUSED = """c AS (SELECT safety AS truth, CASE WHEN p_red >= {red} THEN 'red' WHEN p_yellow + p_red >= {yellow} THEN 'yellow' ELSE 'green' END AS level FROM probabilities JOIN examples USING (doc_id) WHERE safety <> 'reject')"""
COUNTS = ", ".join(f"count(*) FILTER (truth = '{t}' AND level = '{p}') AS n_{t}_{p}" for t in metrics.CLASSES for p in metrics.CLASSES)
ROW = {t: "greatest(" + " + ".join(f"n_{t}_{p}" for p in metrics.CLASSES) + ", 1)" for t in metrics.CLASSES}
F1 = {t: f"2 * n_{t}_{t} / greatest({' + '.join(f'n_{t}_{p}' for p in metrics.CLASSES)} + {' + '.join(f'n_{p}_{t}' for p in metrics.CLASSES)}, 1)" for t in metrics.CLASSES}
MACRO = f"(({F1['green']}) + ({F1['yellow']}) + ({F1['red']})) / 3"
OBJECTIVE = f"{MACRO} - 2 * n_green_red / {ROW['green']} - 1.5 * n_yellow_red / {ROW['yellow']} - 3 * n_red_green / {ROW['red']}"


def truth(v):
    return v.probabilities.join(v.examples.where("safety <> 'reject'").select("doc_id", F.col("safety").alias("truth")), "doc_id")


@query("a34_a35_metrics", "WITH {views}, " + CONFUSED.format(red=0.45, yellow=0.55) + f", n AS (SELECT {COUNTS} FROM c) SELECT n_green_red, n_red_red, round((n_green_green + n_yellow_yellow + n_red_red) / (SELECT count(*) FROM c), 9) AS accuracy, round({MACRO}, 9) AS macro_f1, round((n_green_green / {ROW['green']} + n_yellow_yellow / {ROW['yellow']} + n_red_red / {ROW['red']}) / 3, 9) AS balanced, round({OBJECTIVE}, 9) AS objective FROM n")
def _(v):
    level = rules.thresholds(F.col("p_yellow"), F.col("p_red"), F.lit(0.45), F.lit(0.55))
    m = metrics.confusion(truth(v).withColumn("level", level), []).withColumns(metrics.measures())
    return m.select("n_green_red", "n_red_red", *(F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "balanced", "objective")))


SWEPT = """y AS (SELECT CASE d.doc_id % 3 WHEN 0 THEN 'validation' ELSE 'test' END AS split, safety AS truth, idiom, bullying, negated, necessary, ln(p_green) AS g, ln(p_yellow) AS y, ln(p_red) AS r, CASE WHEN quiet THEN 0.0 ELSE 0.5 END::DOUBLE AS ky, CASE WHEN necessary THEN 1.0 ELSE 0.0 END::DOUBLE AS kr FROM d JOIN examples e ON e.doc_id = d.doc_id WHERE safety <> 'reject' AND d.doc_id % 3 < 2),
h AS (SELECT a::DOUBLE AS alpha, t::DOUBLE AS temperature, red::DOUBLE AS red, yellow::DOUBLE AS yellow, mode FROM (SELECT unnest([0, 0.5, 1.0]) AS a), (SELECT unnest([1.0, 1.5, 3.0]) AS t), (SELECT unnest([0.35, 0.55, 0.85]) AS red), (SELECT unnest([0.4, 0.5, 0.7]) AS yellow), (SELECT unnest(['none', 'context', 'soft', 'strict']) AS mode) WHERE yellow > red * 0.5),
l AS (SELECT *, g AS lg, y + alpha * ky AS ly, r + alpha * kr AS lr FROM y, h), m AS (SELECT *, greatest(lg, ly, lr) AS mx FROM l), q AS (SELECT *, exp((lg - mx) / temperature) AS eg, exp((ly - mx) / temperature) AS ey, exp((lr - mx) / temperature) AS er FROM m),
p AS (SELECT *, ey / (eg + ey + er) AS py, er / (eg + ey + er) AS pr FROM q), c AS (SELECT split, alpha, temperature, red, yellow, mode, truth, CASE WHEN pr < red THEN CASE WHEN py + pr >= yellow THEN 'yellow' ELSE 'green' END WHEN mode = 'none' THEN 'red' WHEN idiom THEN CASE WHEN py + pr >= yellow THEN 'yellow' ELSE 'green' END WHEN bullying OR negated THEN 'yellow'
  WHEN mode = 'soft' AND NOT necessary AND pr < 0.8 THEN 'yellow' WHEN mode = 'strict' AND NOT necessary THEN 'yellow' ELSE 'red' END AS level FROM p)"""


@query("a36_sweep", "WITH {views}, " + SIGNALS + ", " + SWEPT + f""", k9 AS (SELECT split, alpha, temperature, red, yellow, mode, {COUNTS} FROM c GROUP BY ALL), o AS (SELECT *, round({OBJECTIVE}, 9) AS objective, round(n_green_red / {ROW['green']}, 9) AS g2r, round({MACRO}, 9) AS macro FROM k9),
w AS (SELECT alpha, temperature, red, yellow, mode, max(objective) FILTER (split = 'validation') AS val_objective, max(g2r) FILTER (split = 'test') AS test_green_to_red, max(macro) FILTER (split = 'test') AS test_macro_f1 FROM o GROUP BY alpha, temperature, red, yellow, mode)
SELECT *, row_number() OVER (ORDER BY val_objective DESC, test_green_to_red, test_macro_f1 DESC, alpha, temperature, red, yellow, mode) AS rank FROM w""".replace("GROUP BY ALL", "GROUP BY split, alpha, temperature, red, yellow, mode"))
def _(v):
    c, (said, signals) = F.col, rules.with_signals(spoken(v.probabilities).where("doc_id % 3 < 2"))
    marked = said.select("doc_id", "p_green", "p_yellow", "p_red", (F.size(signals["signals"]) == 0).alias("quiet"), *(signals[k].alias(k) for k in ("idiom", "bullying", "negated", "red_necessary")))
    rows = marked.join(v.examples.where("safety <> 'reject'").select("doc_id", c("safety").alias("truth")), "doc_id").select(
        F.when(c("doc_id") % 3 == 0, "validation").otherwise("test").alias("split"), "truth", "idiom", "bullying", "negated", "red_necessary", F.array(F.log("p_green"), F.log("p_yellow"), F.log("p_red")).alias("base"),
        F.array(F.lit(0.0), F.when(c("quiet"), 0.0).otherwise(0.5), F.when(c("red_necessary"), 1.0).otherwise(0.0)).alias("keyword"),
    )
    return metrics.policy_sweep(rows, [0.0, 0.5, 1.0], [1.0, 1.5, 3.0], [0.35, 0.55, 0.85], [0.4, 0.5, 0.7], ["none", "context", "soft", "strict"]).withColumn("rank", c("rank").cast("long"))


@query("a37_latencies", """WITH e AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) SELECT any_value(n) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS least, max(value) AS most, any_value(value) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95 FROM e""")
def _(v):
    return metrics.latencies(v.table("events"), "value").withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6)})


TOKENS = f"t AS (SELECT doc_id, safety, unnest({WORDS}) AS token, 1.0::DOUBLE AS w FROM examples WHERE safety <> 'reject')"


def token_counts(v):
    t = v.examples.where("safety <> 'reject'").select("doc_id", "safety", text.latin_words(F.col("text")).alias("tokens"), F.lit(1.0).alias("w"))
    return features.token_class_counts(t, "safety")


@query("a38_token_counts", "WITH {views}, " + TOKENS + " SELECT token, safety, sum(w) AS weight, count(DISTINCT doc_id) AS rows FROM t GROUP BY ALL")
def _(v):
    return token_counts(v)


@query("a39_t01_keywords", "WITH {views}, " + TOKENS + """, c AS (SELECT token, safety, sum(w) AS weight, count(DISTINCT doc_id) AS rows FROM t GROUP BY ALL), k AS (SELECT token, sum(weight) AS total, sum(rows)::BIGINT AS df FROM c GROUP BY token HAVING sum(weight) >= 5),
s AS (SELECT safety, sum(weight) AS ct FROM c GROUP BY safety), g AS (SELECT sum(weight) AS gt, count(DISTINCT token) AS v FROM c), x AS (SELECT k.token, s.safety, k.total, k.df, coalesce(c.weight, 0) + 0.5 AS m, ct, gt, v FROM k CROSS JOIN s CROSS JOIN g LEFT JOIN c ON c.token = k.token AND c.safety = s.safety),
y AS (SELECT *, (ln(m / (ct + 0.5 * v)) - ln((total - m + 1) / (gt - ct + 0.5 * v))) * ln(1 + total) * sqrt(df) AS score FROM x)
SELECT token, safety, total, df AS doc_freq, round(score, 6) AS score FROM y QUALIFY row_number() OVER (PARTITION BY token ORDER BY round(score, 9) DESC, CASE safety WHEN 'green' THEN 1 WHEN 'yellow' THEN 2 ELSE 3 END) = 1""")
def _(v):
    return features.rank_keywords(token_counts(v), "safety", list(metrics.CLASSES), 5.0).withColumn("score", F.round("score", 6))


@query("a40_keyword_audit", """WITH {views} SELECT k AS keyword, safety, count(*) AS rows FROM examples, (SELECT unnest(['idiot', 'the', 'und']) AS k) WHERE contains(text, k) GROUP BY ALL""")
def _(v):
    keywords = v.spark.createDataFrame([(k,) for k in ("idiot", "the", "und")], "keyword string")
    return features.keyword_audit(v.examples, keywords, "text", "safety")


@query("a41_class_weights", """WITH {views} SELECT safety, count(*) AS n, round((SELECT count(*) FROM examples) / (4.0::DOUBLE * count(*)), 9) AS weight FROM examples GROUP BY safety""")
def _(v):
    return features.class_weights(v.examples, "safety", 4).withColumn("weight", F.round("weight", 9))


@query("a42_a44_distributions", """WITH {views} SELECT 'scenario' AS "column", scenario AS value, count(*) AS n FROM examples GROUP BY scenario UNION ALL SELECT 'safety', safety, count(*) FROM examples GROUP BY safety UNION ALL SELECT 'tier', tier, count(*) FROM examples GROUP BY tier""")
def _(v):
    from ..operators.reshape import distributions

    return distributions(v.examples, ["scenario", "safety", "tier"])


@query("a45_acceptance", """WITH {views}, i AS (SELECT *, CASE WHEN status = 'module_failed' THEN 'failed' WHEN status = 'blocked_by_safety' THEN 'blocked' ELSE '' END AS issue FROM turns) SELECT coalesce(scenario, 'all') AS scenario, count(*) AS n, count(*) FILTER (issue = '') AS ok, round(avg((price > 100000)::INT), 9) AS accuracy, count(*) FILTER (issue = 'failed') AS failed FROM i GROUP BY GROUPING SETS ((scenario), ())""")
def _(v):
    issue = F.when(F.col("status") == "module_failed", "failed").when(F.col("status") == "blocked_by_safety", "blocked").otherwise("")
    g = v.turns.withColumn("issue", issue).groupingSets([["scenario"], []], "scenario").agg(
        F.count("*").alias("n"), F.count_if(F.col("issue") == "").alias("ok"), F.round(F.avg((F.col("price") > 100000).cast("int")), 9).alias("accuracy"), F.count_if(F.col("issue") == "failed").alias("failed")
    )
    return g.withColumn("scenario", F.coalesce("scenario", F.lit("all")))


@query("a47_pairs_per_model", "WITH {views} SELECT count(DISTINCT turn_id) AS pairs, count(*) FILTER (er = 0) // count(DISTINCT candidate_id) AS label_a, count(*) FILTER (er = 1) // count(DISTINCT candidate_id) AS label_b FROM candidates")
def _(v):
    models = F.count_distinct("candidate_id")
    return v.candidates.agg(F.count_distinct("turn_id").alias("pairs"), F.floor(F.count_if(F.col("er") == 0) / models).alias("label_a"), F.floor(F.count_if(F.col("er") == 1) / models).alias("label_b"))


@query("f48_weighted_bag", f"""WITH {{views}}, b AS (SELECT doc_id, unnest({WORDS}) AS token, 1.0::DOUBLE AS w FROM examples UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(source || ' ' || tier), '[a-z0-9]{{2,}}')), 2.0 FROM examples) SELECT doc_id, token, sum(w) AS weight FROM b GROUP BY ALL""")
def _(v):
    fields = [(F.col("text"), 1.0), (F.concat_ws(" ", "source", "tier"), 2.0)]
    parts = [v.examples.select("doc_id", F.explode(text.latin_words(c)).alias("token"), F.lit(w).alias("w")) for c, w in fields]
    return parts[0].unionByName(parts[1]).groupBy("doc_id", "token").agg(F.sum("w").alias("weight"))


@query("a29_comparison_totals", """WITH {views}, j AS (SELECT a.turn_id, a.boundary AS human, b.er = 2 AS e1, b.ip = 2 AS i1, c.er = 2 AS e2, c.ip = 2 AS i2, coalesce(b.casel >= 8, false) AS f1, coalesce(c.casel >= 7, false) AS f2 FROM candidates a LEFT JOIN candidates b ON a.turn_id = b.turn_id AND b.cand_no = 2 LEFT JOIN candidates c ON a.turn_id = c.turn_id AND c.cand_no = 3 WHERE a.cand_no = 1),
t AS (SELECT *, CASE WHEN f1 THEN 0 ELSE coalesce((e1 = human)::INT, 0) + coalesce((i1 = human)::INT, 0) END AS one, CASE WHEN f2 THEN 0 ELSE coalesce((e2 = human)::INT, 0) + coalesce((i2 = human)::INT, 0) END AS other FROM j)
SELECT human, count(*) AS rows, sum(one)::BIGINT AS matches_one, sum(other)::BIGINT AS matches_other, count(*) FILTER (f1) AS invalid_one, count(*) FILTER (f2) AS invalid_other, count(*) FILTER (one > other) AS better_one, count(*) FILTER (other > one) AS better_other, count(*) FILTER (one = other) AS ties FROM t GROUP BY human""")
def _(v):
    c = v.candidates
    side = lambda n, m: c.where(F.col("cand_no") == n).select("turn_id", F.col("er").alias(f"{m}_e"), F.col("ip").alias(f"{m}_i"), F.col("casel").alias(f"{m}_c"))
    j = c.where("cand_no = 1").select("turn_id", F.col("boundary").alias("human")).join(side(2, "one"), "turn_id", "left").join(side(3, "other"), "turn_id", "left")
    matched = {f"{m}_{d}": (F.col(f"{m}_{d[0]}") == 2) == F.col("human") for m in ("one", "other") for d in ("er", "ip")}
    failed = {"one_failed": F.coalesce(F.col("one_c") >= 8, F.lit(False)), "other_failed": F.coalesce(F.col("other_c") >= 7, F.lit(False))}
    return agreement.comparison_totals(j.withColumns({**matched, **failed}), ["human"])


@query("a31_pairwise_summary", "WITH {views}, " + JUDGED + """, r AS (SELECT s.*, c.orientation AS model, t.scenario, c.casel < 9 AS ok, c.casel, first = second AS consistent, CASE c.ex WHEN 0 THEN 'A' WHEN 1 THEN 'tie' END AS expected, CASE c.er WHEN 0 THEN 'none' WHEN 1 THEN 'B' END AS boundary, coalesce(c.ip = 2, false) AS st FROM s JOIN candidates c USING (turn_id, cand_no) JOIN turns t USING (turn_id)),
k AS (SELECT *, coalesce(CASE WHEN stable THEN first END = expected, false) AS correct, st AS strict, st OR er2 AS lenient FROM (SELECT *, casel % 2 = 0 AS er2 FROM r))
SELECT coalesce(model, 'all') AS model, coalesce(scenario, 'all') AS scenario, count(*) AS total, count(*) FILTER (ok) AS valid, round(avg(ok::INT), 4) AS valid_rate, round(avg(stable::INT) FILTER (ok), 4) AS stable_rate, round(avg(coalesce(consistent, false)::INT) FILTER (ok), 4) AS order_rate, round(avg(correct::INT) FILTER (ok AND expected IN ('A', 'B', 'tie')), 4) AS accuracy_all, round(avg(correct::INT) FILTER (ok AND expected IN ('A', 'B')), 4) AS accuracy_no_tie, round(avg(correct::INT) FILTER (ok AND expected = 'tie'), 4) AS accuracy_tie,
  round(avg(strict::INT) FILTER (ok), 4) AS boundary_strict, round(avg(lenient::INT) FILTER (ok), 4) AS boundary_lenient, round(avg(strict::INT) FILTER (ok AND boundary IN ('A', 'B')), 4) AS recall_strict, round(avg(lenient::INT) FILTER (ok AND boundary IN ('A', 'B')), 4) AS recall_lenient, round(avg(strict::INT) FILTER (ok AND boundary = 'none'), 4) AS none_strict,
  count(*) FILTER (ok AND stable AND first = 'A') AS "won_A", count(*) FILTER (ok AND stable AND first = 'B') AS "won_B", 0::BIGINT AS won_tie, count(*) FILTER (ok AND NOT stable) AS won_unstable, round(avg(casel * 10) FILTER (ok), 1) AS mean_duration FROM k GROUP BY GROUPING SETS ((model, scenario), (model), ())""")
def _(v):
    c = F.col
    info = v.candidates.select("turn_id", "cand_no", c("orientation").alias("model"), "casel", "er", "ip", "ex").join(v.turns.select("turn_id", "scenario"), "turn_id")
    r = stability(v).join(info, ["turn_id", "cand_no"])
    expected = F.when(c("ex") == 0, "A").when(c("ex") == 1, "tie")
    strict = c("ip") == 2
    runs_ = r.select(
        "model", "scenario", (c("casel") < 9).alias("ok"), "stable", (c("first") == c("second")).alias("consistent"), expected.alias("expected"), F.when(c("er") == 0, "none").when(c("er") == 1, "B").alias("boundary"),
        F.coalesce(F.when(c("stable"), c("first")) == expected, F.lit(False)).alias("correct"), strict.alias("strict"), (strict | (c("casel") % 2 == 0)).alias("lenient"), F.when(c("stable"), c("first")).alias("winner"), F.lit(False).alias("tie"), (c("casel") * 10).alias("duration"),
    )
    made = agreement.pairwise_summary(runs_, [["model", "scenario"], ["model"], []])
    return made.withColumns({k: F.coalesce(k, F.lit("all")) for k in ("model", "scenario")})


@query("a44_pair_profile", """WITH {views}, p AS (SELECT a.turn_id, t.scenario, CASE a.turn_id % 3 WHEN 0 THEN 'clean' ELSE 'negative' END AS pair_type, CASE a.ex WHEN 0 THEN 'A' ELSE 'tie' END AS winner, repeat('x', (a.turn_id % 50)::INT) AS t1, repeat('y', (b.turn_id % 31)::INT) AS t2, a.tags AS reasons FROM candidates a JOIN candidates b ON a.turn_id = b.turn_id AND a.cand_no = 1 AND b.cand_no = 2 JOIN turns t ON t.turn_id = a.turn_id),
l AS (SELECT length(t1) AS x FROM p UNION ALL SELECT length(t2) FROM p), r AS (SELECT value, count(*) AS n FROM (SELECT unnest(reasons) AS value FROM p) GROUP BY value ORDER BY n DESC, value LIMIT 3)
SELECT 'total' AS part, 'pairs' AS value, count(*)::DOUBLE AS n FROM p UNION ALL SELECT 'by_pair_type', pair_type, count(*) FROM p GROUP BY pair_type UNION ALL SELECT 'by_scenario', scenario, count(*) FROM p GROUP BY scenario UNION ALL SELECT 'by_winner', winner, count(*) FROM p GROUP BY winner
UNION ALL SELECT 'length', 'min', min(x) FROM l UNION ALL SELECT 'length', 'max', max(x) FROM l UNION ALL SELECT 'length', 'avg', round(avg(x), 1) FROM l UNION ALL SELECT 'top_reason', value, n FROM r""")
def _(v):
    from ..operators.reshape import pair_profile

    wide = pairs.pair_table(v.candidates.join(v.turns.select("turn_id", "scenario"), "turn_id"), "turn_id", "candidate_id", ["ex", "tags"], ["scenario"])
    k = F.col("turn_id")
    p = wide.select(
        "scenario", F.when(k % 3 == 0, "clean").otherwise("negative").alias("pair_type"), F.when(F.col("c1_ex") == 0, "A").otherwise("tie").alias("winner"), F.repeat(F.lit("x"), (k % 50).cast("int")).alias("t1"), F.repeat(F.lit("y"), (k % 31).cast("int")).alias("t2"), F.col("c1_tags").alias("reasons")
    )
    return pair_profile(p, ["pair_type", "scenario", "winner"], ["t1", "t2"], "reasons", 3)
