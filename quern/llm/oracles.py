"""The training-data queries in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from .license_scan import TEMPLATES, bigrams_of

_TEMPLATES = ",\n  ".join("('{}', [{}])".format(name, ", ".join(f"'{x}'" for x in bigrams_of(text))) for name, text in sorted(TEMPLATES.items()))

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": f"""WITH t(license, g) AS (VALUES
  {_TEMPLATES}),
tn AS (SELECT license, len(g)::BIGINT AS n, greatest(1, ceil(len(g) * 8e-1 / 12e-1 - 1e-9))::BIGINT AS low, floor(len(g) / (8e-1 / 12e-1) + 1e-9)::BIGINT AS high FROM t),
split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, coalesce(text, '') AS text FROM documents),
units AS (SELECT doc_id, 0 AS line, text AS x FROM split UNION ALL SELECT doc_id, i, lines[i] FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM split WHERE len(lines) > 1)),
worded AS (SELECT doc_id, line, regexp_extract_all(lower(x), '[a-z0-9]+') AS w FROM units),
sets AS (SELECT doc_id, line, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS b FROM worded),
dice AS (SELECT doc_id, line, license, 2e0 * len(list_intersect(b, g)) / (len(b) + len(g)) AS dice FROM sets, t JOIN tn USING (license) WHERE len(b) BETWEEN low AND high),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license) AS r FROM dice WHERE dice >= 8e-1),
found AS (SELECT doc_id, count(*) AS n, string_agg(line || ':' || license, ',' ORDER BY line) AS licenses, max(dice) AS best FROM best WHERE r = 1 GROUP BY doc_id),
runs AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM worded WHERE line = 0),
grams AS (SELECT license, unnest(g) AS gram FROM t),
hits AS (SELECT doc_id, license, i, gram FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS gram FROM runs) JOIN grams USING (gram)),
near AS (SELECT doc_id, license, list(i ORDER BY i) AS places, list(gram ORDER BY i) AS gs FROM hits GROUP BY doc_id, license),
firsts AS (SELECT *, unnest(range(1, len(places) + 1)) AS a FROM near JOIN tn USING (license) WHERE len(list_distinct(gs)) >= low),
ends AS (SELECT *, unnest(range(a + low - 1, least(len(places), a + high - 1) + 1)) AS e FROM firsts),
shared AS (SELECT doc_id, license, n, low, places[a] AS s, places[e] AS z, len(list_distinct(gs[a:e])) AS k FROM ends WHERE places[e] - places[a] < high),
windows AS (SELECT doc_id, license, s, z, 2e0 * k / (len(list_distinct(p[s:z])) + n) AS dice FROM shared JOIN runs USING (doc_id) WHERE k >= low),
noticed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, s, z) AS r FROM windows WHERE dice >= 8e-1) WHERE r = 1),
filled AS (SELECT doc_id, line, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY line) AS upto FROM (SELECT * FROM worded WHERE line > 0 UNION ALL SELECT doc_id, 1, w FROM worded WHERE line = 0 AND doc_id IN (SELECT doc_id FROM split WHERE len(lines) = 1))),
placed AS (SELECT x.doc_id, x.license, x.dice, (SELECT min(line) FROM filled f WHERE f.doc_id = x.doc_id AND f.upto >= x.s) AS line FROM noticed x),
notices AS (SELECT doc_id, string_agg(line || ':' || license, ',' ORDER BY license) AS notices, max(dice) AS best_notice FROM placed GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_licenses, coalesce(licenses, '') AS licenses, round(best, 6) AS best_dice, coalesce(notices, '') AS notices, round(best_notice, 6) AS best_notice FROM documents d LEFT JOIN found USING (doc_id) LEFT JOIN notices USING (doc_id)""",
    "op5_ngram_join": """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w, ' ') AS key, list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_ FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p WHERE both_ >= 8e-1 * (na + nb - both_) - 1e-9),
reach(doc, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc, links.b FROM reach JOIN links ON reach.r = links.a),
class AS (SELECT doc AS doc_id, min(r) AS class_id FROM reach GROUP BY doc),
counts AS (SELECT l.a AS doc_id, count(*) AS n_links, count(DISTINCT y.key) FILTER (y.key <> x.key) AS n_text_links FROM links l JOIN s x ON x.doc_id = l.a JOIN s y ON y.doc_id = l.b GROUP BY l.a),
copies AS (SELECT doc_id, count(*) OVER (PARTITION BY key) AS n_copies FROM s)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_text_links, 0) AS n_text_links, coalesce(n_copies, 1) AS n_copies FROM class LEFT JOIN counts USING (doc_id) LEFT JOIN copies USING (doc_id)""",
    "op7_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda j: ('0x' || substr(hex, 5 * j + 1, 5))::INTEGER) AS v FROM x)
SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda n: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', n // 32768 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', n // 1024 % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', n // 32 % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', n % 32 + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM v""",
    "op9_topk_search": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64e0 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_mixing": """WITH d AS (SELECT doc_id, source, coalesce(md5(text), 'null') AS digest, row_number() OVER (PARTITION BY doc_id, source, text) AS nth, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5e0, 2e0, 1e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 2e0 AS cap FROM src),
f AS (SELECT *, sum(source_size) OVER () * 15e-1 AS total, sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS caps, sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT *, (total - coalesce(caps, 0e0)) / rest AS level FROM f),
lvl AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE level * w <= cap),
goal AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM lvl) * w, cap)) AS target FROM l),
q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
k AS (SELECT d.*, g.source_size, g.target, -ln((('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || digest || ':' || nth), 1, 12))::BIGINT::DOUBLE + 5e-1) / 281474976710656e0) / (CASE quality WHEN 1 THEN 2e0 WHEN 0 THEN 5e-1 ELSE 1e0 END) AS key FROM d JOIN goal g ON g.source IS NOT DISTINCT FROM d.source LEFT JOIN q ON q.doc_id = d.doc_id),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, digest, nth ROWS UNBOUNDED PRECEDING) - size / 2e0 AS half, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM k)
SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN size * least(2, epochs + CASE WHEN greatest(0e0, target - epochs * source_size) > 0 AND half < target - epochs * source_size THEN 1 ELSE 0 END) ELSE 0 END::BIGINT AS taken FROM c""",
}
