"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES = {
    "op3_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
r AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.v) AS component_id, w.doc_id = min(r.v) AS kept
FROM w JOIN r ON r.u = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id""",
    "op5_embedding_near_dedup": """
WITH RECURSIVE d AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
f AS MATERIALIZED (SELECT vec_id, label, x FROM d WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0
  AND len(list_filter(x, lambda y: y <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id AS u, vec_id AS v FROM d UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)
SELECT d.vec_id, (SELECT count(*) FROM e WHERE e.u = d.vec_id) AS n_links, min(r.v) AS component_id, d.vec_id = min(r.v) AS kept
FROM d JOIN r ON r.u = d.vec_id GROUP BY d.vec_id""",
    "op9_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS same,
    regexp_replace(text, '([<\[])(\\*)(\|turn\|>|\|text\|>|\|and\|>|\|end\|>|s>|/s>|INST\]|/INST\]|\|im_start\|>|\|im_end\|>)', '\1\\\2\3', 'g') AS escaped
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(escaped) + CASE WHEN same THEN 7 ELSE 23 + length(role) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op10_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""",
    "op13_merkle_manifest": """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
-- crc32 of the digits, bit by bit
crc AS (
  SELECT doc_id, 1 AS i, 4294967295::BIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, i + 1, list_reduce(list_concat([xor(c, ascii(substr(doc_id::VARCHAR, i, 1)))], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) FROM crc WHERE i <= strlen(doc_id::VARCHAR)),
hit AS (SELECT doc_id FROM crc WHERE i = strlen(doc_id::VARCHAR) + 1 AND xor(c, 4294967295) % 3 = 0),
d AS MATERIALIZED (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, leaf, changed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT f.doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN hit.doc_id IS NULL THEN sha256(head || coalesce(strlen(text) || ':' || text, '-')) ELSE sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS changed
    FROM f LEFT JOIN hit ON hit.doc_id = f.doc_id)),
low AS (
  SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS m FROM d
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (m + 7) // 8 FROM low WHERE m > 1 GROUP BY tree, level, pos // 8, m),
sub AS MATERIALIZED (SELECT tree, level, h FROM low WHERE m = 1),
high AS (
  SELECT 1000 AS level, tree AS pos, h, (SELECT count(*) FROM sub) AS m FROM sub
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (m + 7) // 8 FROM high WHERE m > 1 GROUP BY level, pos // 8, m),
root AS (SELECT h FROM high WHERE m = 1),
nodes AS MATERIALIZED (SELECT tree, level, pos, h, m FROM low UNION ALL SELECT -1, level, pos, h, m FROM high),
side AS MATERIALIZED (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.m > 1 GROUP BY a.tree, a.level, a.pos),
up AS (
  SELECT doc_id, leaf, tree AS own, pos AS place, tree, 0 AS level, pos, changed AS h, '' AS said, false AS done FROM d
  UNION ALL
  SELECT up.doc_id, up.leaf, own, place,
    CASE WHEN s.l IS NULL THEN -1 ELSE up.tree END, CASE WHEN s.l IS NULL THEN 1000 ELSE up.level + 1 END, CASE WHEN s.l IS NULL THEN own ELSE up.pos // 8 END,
    CASE WHEN s.l IS NULL THEN up.h ELSE sha256(s.l || up.h || s.r) END, said || coalesce(s.l || s.r, ''), s.l IS NULL AND up.tree = -1
  FROM up LEFT JOIN side s ON s.tree = up.tree AND s.level = up.level AND s.pos = up.pos WHERE NOT done)
SELECT up.doc_id, up.leaf, sub.h AS subroot, root.h AS root, sha256(said) AS proof_sha256, up.h AS folded_root, up.h = root.h AS verified
FROM up JOIN sub ON sub.tree = up.own CROSS JOIN root WHERE done""",
}
