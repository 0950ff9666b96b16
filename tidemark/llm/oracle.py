"""DuckDB SQL of the operators on pairs, windows and substrings.

Written from the definitions of the results alone: all pairs, all windows, all
strings.  Meant for small tables, on which it takes seconds.
"""

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EMBEDDINGS = r"""
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM {embeddings}
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if isfinite(x)]) = len(embedding) AND len([x for x in embedding if x <> 0]) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
least_ids AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id))::BIGINT AS component_id,
  vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM {embeddings} LEFT JOIN counts USING (vec_id) LEFT JOIN least_ids USING (vec_id)
"""

JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos, len(ws) AS n FROM (
    SELECT doc_id, regexp_extract_all(FOLDED, '[^\x20\x09-\x0D]+') AS ws FROM {documents})),
ahead AS (
  SELECT doc_id, pos, n, list(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS l FROM words),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(l, ' ') AS s FROM ahead WHERE len(l) = 5 OR (n < 5 AND pos = 0)),
sets AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS name FROM shingles GROUP BY doc_id),
firsts AS MATERIALIZED (SELECT name, min(doc_id) AS doc_id, any_value(n) AS n FROM sets GROUP BY name),
distinct_sets AS MATERIALIZED (SELECT doc_id, n, s FROM firsts JOIN shingles USING (doc_id)),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM distinct_sets a JOIN distinct_sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_ids AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a),
named AS (SELECT name, least(doc_id, coalesce(m, doc_id)) AS component_id FROM firsts LEFT JOIN least_ids USING (doc_id))
SELECT d.doc_id, coalesce(sets.n, 0)::BIGINT AS n_shingles, coalesce(named.component_id, d.doc_id)::BIGINT AS component_id
FROM {documents} d LEFT JOIN sets USING (doc_id) LEFT JOIN named USING (name)
""".replace("FOLDED", FOLDED)

CONTAMINATION = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(FOLDED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM {documents}),
item_words AS (
  SELECT item_id, regexp_extract_all(FOLDED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM {benchmark}),
doc_ahead AS (
  SELECT doc_id, pos, list(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS l
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM doc_words)),
item_ahead AS (
  SELECT item_id, pos, n, list(w) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS l
  FROM (SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos, len(ws) AS n FROM item_words)),
windows AS MATERIALIZED (
  SELECT item_id, pos AS i, len(l) AS size, array_to_string(l, ' ') AS win FROM item_ahead WHERE len(l) = 13 OR (n < 13 AND pos = 0)),
sizes AS (SELECT DISTINCT size FROM windows),
found AS MATERIALIZED (
  SELECT doc_id, d.pos, w.item_id, w.i, w.size FROM (
    SELECT doc_id, pos, size, array_to_string(l[1:size], ' ') AS win FROM doc_ahead JOIN sizes ON len(l) >= size) d
  JOIN windows w ON d.size = w.size AND d.win = w.win),
hits AS (
  SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS p FROM (SELECT DISTINCT doc_id, pos, size FROM found)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id),
steps AS (
  SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, pos - i ORDER BY pos) AS run FROM found),
matches AS (
  SELECT doc_id, min(pos) AS word, item_id, min(i) AS item_word, min(size) + count(*) - 1 AS n FROM steps
  GROUP BY doc_id, item_id, pos - i, run),
listed AS (
  SELECT doc_id, string_agg(word || ':' || item_id || ':' || item_word || ':' || n, ',' ORDER BY word, item_id, item_word, n) AS matches
  FROM matches GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated,
  coalesce(matches, '') AS matches
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN listed USING (doc_id)
""".replace("FOLDED", FOLDED)

#: bytes are read as pairs of hex digits, in pieces of 512 bytes so that no long text is cut once for each byte
SUBSTRINGS = r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM {documents}),
pieces AS (
  SELECT doc_id, n, p, substr(h, 2 * p + 1, 2 * (512 + 49)) AS piece FROM (
    SELECT doc_id, h, n, unnest(range(0, n - 49, 512)) AS p FROM texts WHERE n >= 50)),
strings AS (
  SELECT doc_id, p + i AS byte, substr(piece, 2 * i + 1, 100) AS s FROM (
    SELECT doc_id, p, piece, unnest(range(0, least(512, n - 49 - p))) AS i FROM pieces)),
covered AS (
  SELECT doc_id, byte FROM (SELECT doc_id, byte, min(doc_id) OVER (PARTITION BY s) AS m FROM strings) WHERE doc_id > m),
stepped AS (SELECT doc_id, byte, byte > lag(byte, 1, -1000) OVER (PARTITION BY doc_id ORDER BY byte) + 50 AS fresh FROM covered),
numbered AS (SELECT doc_id, byte, sum(fresh::INTEGER) OVER (PARTITION BY doc_id ORDER BY byte) AS run FROM stepped),
spans AS MATERIALIZED (SELECT doc_id, run, min(byte) AS lo, max(byte) + 50 AS hi FROM numbered GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS lo, lo AS hi FROM spans
  UNION ALL SELECT doc_id, max(spans.hi), max(n) FROM spans JOIN texts USING (doc_id) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS h FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept.h, texts.h))) AS kept_sha256
FROM texts LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
