"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

OP2 = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS width, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM i WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM windows),
places AS (
  SELECT doc_id, width, k, array_to_string(w[k : k + width - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS k FROM d JOIN widths ON len(w) >= width)),
found AS (SELECT doc_id, k, p.width, item_id FROM places p JOIN windows USING (width, phrase)),
hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + width)) AS place FROM (SELECT DISTINCT doc_id, k, width FROM found)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY n, digest) AS kept FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < kept THEN kept END AS refers_to
FROM q
"""

OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_id AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM least_id LEFT JOIN sizes USING (doc_id)
"""

OP5 = """
WITH v AS (
  SELECT vec_id, [floor(x::DOUBLE * 1024) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scores QUALIFY rank <= 10
"""

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_ITEM_WORDS} AS w FROM documents),
counts AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) GROUP BY 1, 2),
whole AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_ITEM_WORDS}) AS term FROM benchmark WHERE item_id IS NOT NULL)),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
  FROM counts, whole WHERE term IN (SELECT term FROM items) GROUP BY term),
lengths AS (SELECT row, doc_id, 50 + (50 * len(w) * docs) // total AS m FROM d, whole WHERE len(w) > 0),
scores AS (
  SELECT item_id, row, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (row) GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scores JOIN lengths USING (row) WHERE score > 0 QUALIFY rank <= 50
"""

_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT FOR c IN string_split(k, '')]),
  lambda h, c: list_reduce([xor(h, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""

OP12 = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body FROM damaged),
marked AS (
  SELECT *, body = '' AS blank, body <> '' AND min(i) OVER (PARTITION BY conv_id, role, text) < i AS duplicate,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
turns AS (SELECT *, NOT blank AND NOT duplicate AND right(body, 1) NOT IN ('.', '!', '?') AS truncated FROM marked),
steps(s, initial, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
edits(s, initial, letter, t, price, role) AS (
  SELECT s, initial, 'K', t, 0, NULL FROM steps
  UNION ALL SELECT s, NULL, 'R', t, 3, CASE initial WHEN 'u' THEN 'user' ELSE 'assistant' END FROM steps WHERE initial <> 's'
  UNION ALL SELECT unnest(range(4))::INTEGER AS s, NULL, 'D', unnest(range(4))::INTEGER, 4, NULL),
inserts(s, t, letters, lines) AS (VALUES
  (0, 0, '', []::VARCHAR[]), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (3, 2, 'I', ['user:']),
  (2, 3, 'I', ['assistant:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:'])),
best(conv_id, i, s, way) AS (
  SELECT c.conv_id, 0::BIGINT, n.t, {{'cost': 3 * len(n.letters), 'audit': n.letters, 'lines': n.lines}}
  FROM (SELECT DISTINCT conv_id FROM turns) c, inserts n WHERE n.s = 0
  UNION ALL
  SELECT b.conv_id, b.i + 1, n.t, min({{
    'cost': b.way.cost + e.price + CASE WHEN r.truncated AND e.letter <> 'D' THEN 3 ELSE 0 END + 3 * len(n.letters), 'audit': b.way.audit || e.letter || n.letters,
    'lines': b.way.lines || CASE e.letter WHEN 'D' THEN []::VARCHAR[] ELSE [coalesce(e.role, r.role) || ':' || r.text] END || n.lines}})
  FROM best b JOIN turns r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1
    JOIN edits e ON e.s = b.s AND (e.letter = 'D' OR NOT (r.blank OR r.duplicate)) AND (e.letter <> 'K' OR e.initial = r.initial)
    JOIN inserts n ON n.s = e.t GROUP BY 1, 2, 3),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY 1),
ends AS (SELECT b.conv_id, min(b.way) AS way FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i WHERE b.s IN (0, 3) GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(way.cost, 0)::BIGINT AS cost, coalesce(way.audit, '') AS audit, sha256(coalesce(array_to_string(way.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLES = {"op2_decontamination": OP2, "op3_warc": OP3, "op4_jaccard": OP4, "op5_topk": OP5, "op12_conversations": OP12, "op13_search": OP13}
