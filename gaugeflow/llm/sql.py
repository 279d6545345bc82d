"""SQL (DuckDB) with the rows of those queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS.format(_LOWER)}, []) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 90 * (x.n + y.n - o)),
k AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT k.b, c.r FROM c JOIN k ON c.doc_id = k.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r) AS component_id FROM n JOIN c USING (doc_id) GROUP BY ALL
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS g FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY g) END AS last FROM p)
SELECT page_id, n AS payload_bytes, g AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM m
"""

_OWN = r"regexp_extract_all({0}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, coalesce({_OWN.format(_LOWER)}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_OWN.format(_LOWER)}, []) AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) END) AS g, least(10, len(w)) AS k FROM b),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM d, ks WHERE len(w) >= k),
h AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, coalesce(t.s, sha256('')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

TRIE = rf"""
WITH t AS (SELECT conv_id AS c, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS k, len({_WORDS.format("coalesce(text, '')")}) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'k': k, 'w': w}} ORDER BY turn NULLS FIRST, md5(k)) AS own FROM t GROUP BY 1),
x AS (SELECT c, own, list_reduce(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(c AS VARCHAR)[i]) AS BIGINT)),
  lambda a, b: list_reduce(range(8), lambda v, s: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(a, b)), CAST(4294967295 AS BIGINT)) AS v FROM o),
h AS (SELECT c, own, CAST(xor(v, 4294967295) % 4 AS INT) AS h FROM x),
r AS (SELECT h.c, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) AS p FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
m AS (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM r),
q AS (SELECT c, d, len(p) = d AS at_end, list_transform(p[1:d], lambda e: e.k) AS g, list_transform(p[1:d - 1], lambda e: e.k) AS up, CASE WHEN d = 0 THEN 0 ELSE p[d].w END AS w FROM m),
n AS (SELECT g, d, CASE WHEN d > 0 THEN any_value(up) END AS up, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(w) AS s, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (at_end), '')) AS e FROM q GROUP BY g, d),
k AS (SELECT up, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(k.n, 0) AS kids FROM n LEFT JOIN k ON k.up = n.g),
u AS (SELECT g[1:j] AS g, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum(s) AS s FROM (SELECT g, kids, s, unnest(range(0, d + 1)) AS j FROM f) GROUP BY 1)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, z.c AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.s AS BIGINT) AS saved_tokens, f.e AS ends_sha256
FROM f JOIN u ON u.g = f.g LEFT JOIN f z ON z.g = f.up
"""

SQL = {"op13_conversation_trie": TRIE, "op1_ngram_jaccard_join": JACCARD, "op6_warc": WARC, "op9_decontamination": DECONTAMINATION}
