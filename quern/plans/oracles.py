"""The catalog's queries in DuckDB's SQL. Doubles are written with exponents, so that no decimal arithmetic comes in."""

from __future__ import annotations

from ..operators.evaluation import ABSTAIN_PHRASES
from .catalog import DEPTH, K, SHOWN, WEIGHTS

PAPERS = "papers AS (SELECT doc_id, source, lang, n_chars, split_part(coalesce(text, ''), chr(10), 1) AS title, substr(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 2) AS abstract FROM documents)"


def listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"


def count_in(x: str, words) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({x}, '{w}') THEN 1 ELSE 0 END)" for w in words) + ")"


def occurrences(x: str, w: str) -> str:
    return f"((length({x}) - length(replace({x}, '{w}', ''))) // {len(w)})"


def score(terms) -> str:
    return f"(3e0 * {count_in('lower(title)', [*terms.strong, *terms.weak])} + 15e-1 * {count_in('lower(abstract)', terms.strong)} + 5e-1 * {count_in('lower(abstract)', terms.weak)} + 5e-1 * {count_in('lower(abstract)', terms.context)})"


def found(x: str, words) -> str:
    return f"list_filter({listed(words)}, lambda w: contains({x}, w))"


def decided(terms, rows: str = "papers") -> str:
    """decided: the columns of ``rows`` (title, abstract, ...) with s, the score, and reason."""
    return f"""scored AS (SELECT *, {score(terms)} AS s, lower(title || ' ' || abstract) AS b FROM {rows}),
matched AS (SELECT *, {found('b', terms.veto_hard)} AS hard, {found('b', terms.veto_soft)} AS soft,
  list_concat({found('b', terms.veto_classic)}, CASE WHEN {occurrences('b', terms.classic_unless[0])} > {occurrences('b', terms.classic_unless[1])} THEN ['{terms.classic_unless[0]}'] ELSE []::VARCHAR[] END) AS classic FROM scored),
decided AS (SELECT * EXCLUDE (hard, soft, classic, b), CASE
  WHEN len(hard) > 0 THEN 'veto:domain-hard: ' || array_to_string(hard, ', ') || ' (relevance_score=' || printf('%.1f', s) || ')'
  WHEN len(soft) > 0 AND {count_in('b', terms.strong_context)} = 0 THEN 'veto:domain-soft: ' || array_to_string(soft, ', ') || ' (relevance_score=' || printf('%.1f', s) || ')'
  WHEN len(classic) > 0 AND {count_in('b', terms.rescue)} = 0 THEN 'veto:classic-pipeline: ' || array_to_string(classic, ', ') || ' (relevance_score=' || printf('%.1f', s) || ')'
  WHEN s >= 3 THEN 'relevance_score=' || printf('%.1f', s) || ' >= 3.0'
  ELSE 'relevance_score=' || printf('%.1f', s) || ' < 3.0 (below topic-boundary threshold)' END AS reason FROM matched)"""


INCLUDED = "starts_with(reason, 'relevance_score=') AND contains(reason, ' >= ')"
T = WEIGHTS.terms
SCORE, DECIDED = score(T), decided(T)

LINKED = """keyed AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS key FROM papers),
numbered AS (SELECT key, printf('grp%04d', row_number() OVER (ORDER BY min(doc_id), key)) AS group_id FROM keyed WHERE key <> '' GROUP BY key HAVING count(*) > 1),
linked AS (SELECT k.*, coalesce(n.group_id, '') AS group_id FROM keyed k LEFT JOIN numbered n USING (key))"""


def significant(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{4,}}'))"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0e0 ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both})::DOUBLE END)"


CHUNKS = """words AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 350) / 300e0))::BIGINT + 1)) AS chunk_index FROM words WHERE len(w) > 0),
chunks AS (SELECT doc_id, chunk_index::BIGINT AS chunk_index, doc_id * 100000 + chunk_index AS chunk_id, array_to_string(list_slice(w, chunk_index * 300 + 1, chunk_index * 300 + 350), ' ') AS text FROM windows)"""

INDEX = f"""{CHUNKS},
tokens AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS tk FROM chunks),
lengths AS (SELECT chunk_id, len(tk) AS dl FROM tokens),
postings AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(tk) AS term FROM tokens) GROUP BY ALL),
totals AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 5e-1) - ln(count(*) + 5e-1) AS raw FROM postings, totals GROUP BY term),
mean AS (SELECT avg(raw) AS mean_idf FROM raw),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 25e-2 * mean_idf ELSE raw END AS idf FROM raw, mean)"""


#: The one section of each page: heading and text.
SECTIONS = """a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(x, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS h, regexp_replace(regexp_replace(regexp_replace(x, '(?s)^.*?</h1>', ''), '(?s)<(script|style)>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
u AS (SELECT page_id, unnest(['h', 't']) AS part, replace(replace(replace(replace(replace(unnest([h, t]), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS x FROM b),
c AS (SELECT page_id, regexp_replace(any_value(x) FILTER (part = 'h'), '^[0-9.]+\\s*', '') AS heading, trim(regexp_replace(any_value(x) FILTER (part = 't'), '\\s+', ' ', 'g')) AS text FROM u GROUP BY page_id)"""

#: The queries of the retrieval part, as query_id and text.
ITEMS = "SELECT item_id AS query_id, text FROM benchmark"


def bm25(k: int, queries: str = ITEMS) -> str:
    return f"""{INDEX},
queries AS ({queries}),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM queries) GROUP BY ALL),
bm25_scored AS (SELECT query_id, chunk_id, sum(qtf * idf * (tf * 25e-1) / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl))) AS score FROM postings JOIN asked USING (term) JOIN terms USING (term) JOIN lengths USING (chunk_id), totals GROUP BY ALL),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM bm25_scored) WHERE rank <= {k})"""


def vectors(name: str, key: str, terms: str) -> str:
    """name(key, place, v, n): the offline encoder's sums by place, and each vector's length."""
    return f"""{name}_hashed AS (SELECT {key}, ('0x' || substr(md5(term), 1, 8))::BIGINT AS h FROM ({terms})),
{name}_sums AS (SELECT {key}, h % 64 AS place, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1e0 ELSE -1e0 END) AS v FROM {name}_hashed GROUP BY ALL),
{name} AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY {key})) AS n FROM {name}_sums)"""


def hybrid(queries: str = ITEMS, depth: int = DEPTH) -> str:
    return f"""{bm25(depth, queries)},
{vectors("cv", "chunk_id", "SELECT chunk_id, unnest(tk) AS term FROM tokens")},
{vectors("qv", "query_id", "SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM queries")},
dense_scored AS (SELECT query_id, chunk_id, sum(c.v * q.v) / (max(c.n) * max(q.n)) AS score FROM cv c JOIN qv q USING (place) GROUP BY ALL),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM dense_scored) WHERE rank <= {depth}),
both_lists AS (SELECT query_id, chunk_id, 0 AS list, rank FROM dense UNION ALL SELECT query_id, chunk_id, 1, rank FROM bm25),
summed AS (SELECT query_id, chunk_id, sum(1e0 / (60 + rank)) AS score, min(CASE WHEN list = 0 THEN rank END) AS r0, min(CASE WHEN list = 1 THEN rank END) AS r1 FROM both_lists GROUP BY ALL),
fused AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, r0 NULLS LAST, r1 NULLS LAST, chunk_id) AS rank FROM summed)"""

HYBRID = hybrid()

RANKED = f"""{HYBRID},
ranked AS (SELECT f.query_id, f.rank, f.chunk_id, c.text, c.doc_id, c.chunk_index, (c.doc_id % 100)::VARCHAR AS group_id, d.n_chars < 800 AS is_survey, c.doc_id % 2 = 0 AS is_canonical FROM fused f JOIN chunks c USING (chunk_id) JOIN documents d ON d.doc_id = c.doc_id WHERE f.rank <= {K})"""


#: Near copies of ranked(query_id, rank, chunk_id, group_id, is_canonical, text) folded in rank order: fold has each row's leader by place.
FOLDED = f"""split AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS pos, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM ranked),
placed AS MATERIALIZED (SELECT * EXCLUDE (w), CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 2) + 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) END AS s FROM split),
near AS MATERIALIZED (SELECT a.query_id, a.pos, list(b.pos) AS earlier FROM placed a JOIN placed b ON b.query_id = a.query_id AND b.group_id = a.group_id AND b.pos < a.pos WHERE {jaccard('a.s', 'b.s')} >= 9e-1 GROUP BY ALL),
places AS MATERIALIZED (SELECT query_id, max(pos) AS last FROM placed GROUP BY query_id),
fold(query_id, pos, kept, leader) AS (SELECT query_id, 0::BIGINT, []::BIGINT[], 0::BIGINT FROM places UNION ALL
  SELECT f.query_id, f.pos + 1, CASE WHEN len(list_intersect(f.kept, coalesce(n.earlier, []::BIGINT[]))) > 0 THEN f.kept ELSE list_append(f.kept, f.pos + 1) END, CASE WHEN len(list_intersect(f.kept, coalesce(n.earlier, []::BIGINT[]))) > 0 THEN list_min(list_intersect(f.kept, n.earlier)) ELSE f.pos + 1 END
  FROM fold f JOIN places p ON p.query_id = f.query_id LEFT JOIN near n ON n.query_id = f.query_id AND n.pos = f.pos + 1 WHERE f.pos < p.last)"""

COLLAPSED = f"""WITH RECURSIVE {RANKED},
{FOLDED},
clusters AS (SELECT f.query_id, f.leader, coalesce(min(f.pos) FILTER (p.is_canonical), f.leader) AS survivor FROM fold f JOIN placed p ON p.query_id = f.query_id AND p.pos = f.pos GROUP BY f.query_id, f.leader),
survivors AS (SELECT c.query_id, l.rank, s.chunk_id, l.group_id, l.is_survey FROM clusters c JOIN placed l ON l.query_id = c.query_id AND l.pos = c.leader JOIN placed s ON s.query_id = c.query_id AND s.pos = c.survivor),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY rank, chunk_id) AS n FROM survivors) WHERE n <= 2),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_survey, rank, chunk_id) AS position FROM kept)
SELECT query_id, position, chunk_id FROM ordered WHERE position <= {SHOWN}"""

REDUNDANT = f"""WITH RECURSIVE {RANKED.replace(f'f.rank <= {K}', f'f.rank <= {SHOWN}')},
{FOLDED}
SELECT query_id, round((max(pos) - max(len(kept))) / max(pos)::DOUBLE, 6) AS redundant_rate FROM fold WHERE pos > 0 GROUP BY query_id"""


def capped(cap: int) -> str:
    return f"""WITH {RANKED},
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY rank, chunk_id) AS n FROM ranked) WHERE n <= {cap}),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_survey, rank, chunk_id) AS position FROM kept)
SELECT query_id, position, chunk_id FROM placed WHERE position <= {SHOWN}"""


METRICS = f"""{RANKED},
gold AS (SELECT item_id AS query_id, (item_id % 100)::VARCHAR AS group_id, 0 AS gold_no, text AS span FROM benchmark UNION ALL SELECT item_id, ((item_id * 7 + 3) % 100)::VARCHAR, 1, text FROM benchmark),
compared AS (SELECT g.query_id, g.gold_no, r.rank, regexp_replace(lower(g.span), '[^a-z0-9]+', '', 'g') AS gs, regexp_replace(lower(r.text), '[^a-z0-9]+', '', 'g') AS rt, {significant('g.span')} AS gw, {significant('r.text')} AS rw FROM gold g JOIN ranked r ON r.query_id = g.query_id AND r.group_id = g.group_id),
hit AS (SELECT query_id, gold_no, rank FROM compared WHERE (gs <> '' AND contains(rt, gs)) OR (len(gw) > 0 AND len(list_intersect(gw, rw)) / len(gw)::DOUBLE >= 7e-1)),
per AS (SELECT query_id, count(DISTINCT gold_no) AS n, min(rank) AS first FROM hit GROUP BY query_id),
metrics AS (SELECT g.query_id, (coalesce(any_value(per.n), 0) / count(*)::DOUBLE) AS recall, coalesce(1e0 / any_value(per.first), 0e0) AS rr, any_value(per.n) IS NOT NULL AS hit FROM gold g LEFT JOIN per USING (query_id) GROUP BY g.query_id)"""

ANSWERS = """answers AS (SELECT conv_id, turn, text || CASE WHEN length(text) % 3 > 0 THEN ' [' || (length(text) % 7) || '] and 【' || (length(text) % 5) || '†L1-L4】 [99]' ELSE '' END || CASE WHEN length(text) % 4 = 0 THEN ' The corpus doesn''t contain enough.' ELSE '' END AS answer, (length(text) % 100) / 2000e0 AS top_score FROM conversations WHERE role = 'assistant'),
cited AS (SELECT *, list_filter(list_sort(list_distinct(list_transform(regexp_extract_all(answer, '[\\[【](\\d+)(?:†[^\\]】]*)?[\\]】]', 1), lambda x: x::INTEGER))), lambda i: i >= 1 AND i <= 5) AS used FROM answers)"""

UNKNOWN = " OR ".join("contains(lower(answer), '" + p.replace("'", "''") + "')" for p in ABSTAIN_PHRASES)

ORACLE_SQL = {
    "relevance_score": f"WITH {PAPERS} SELECT doc_id, {SCORE} AS score FROM papers",
    "relevance_decide": f"WITH {PAPERS}, {DECIDED} SELECT doc_id, starts_with(reason, 'relevance_score=') AND contains(reason, ' >= ') AS included, reason FROM decided",
    "survey_flag": f"WITH {PAPERS} SELECT doc_id, regexp_matches(title, '(?i)(^| )(the|und|une|los)( |$)') OR regexp_matches(abstract, '(?i)(^| )(with|from|nicht)( |$)') AS is_survey FROM papers",
    "manifest_rollup": f"""WITH {PAPERS}, {DECIDED}, kept AS (SELECT * FROM decided WHERE starts_with(reason, 'relevance_score=') AND contains(reason, ' >= '))
SELECT 'source' AS kind, coalesce(nullif(source, ''), '(unknown)') AS name, count(*) AS n FROM kept GROUP BY ALL
UNION ALL SELECT 'lang', coalesce(nullif(lang, ''), '(unknown)'), count(*) FROM kept GROUP BY ALL
UNION ALL SELECT 'veto', split_part(reason, ':', 2), count(*) FROM decided WHERE starts_with(reason, 'veto:') GROUP BY ALL
UNION ALL SELECT 'below', 'threshold', count(*) FROM decided WHERE contains(reason, 'below topic-boundary')""",
    "link_groups": f"WITH {PAPERS}, {LINKED} SELECT doc_id, group_id FROM linked",
    "canonical_pick": f"""WITH {PAPERS}, {LINKED}, best AS (SELECT group_id, doc_id AS canonical, row_number() OVER (PARTITION BY group_id ORDER BY CASE source WHEN 'src0' THEN 0 WHEN 'src1' THEN 1 WHEN 'src2' THEN 2 ELSE 9 END, -n_chars, doc_id) AS r FROM linked WHERE group_id <> '')
SELECT l.doc_id, l.group_id, coalesce(b.canonical, l.doc_id) AS canonical_id FROM linked l LEFT JOIN best b ON b.group_id = l.group_id AND b.r = 1""",
    "group_breakdown": f"""WITH {PAPERS}, {LINKED}, per_work AS (SELECT group_id, source, lang, count(*) AS n FROM linked WHERE group_id <> '' GROUP BY ALL),
per_group AS (SELECT group_id, sum(n) AS rows_, count(DISTINCT source) AS sources, max(CASE WHEN lang <> '' THEN n ELSE 0 END) AS most FROM per_work GROUP BY group_id)
SELECT CASE WHEN rows_ < 2 THEN 'degenerate' WHEN sources > 1 AND most > 1 THEN 'both' WHEN most > 1 THEN 'version_only' WHEN sources > 1 THEN 'cross_source' ELSE 'other' END AS kind, count(*) AS n_groups, sum(rows_)::BIGINT AS n_rows FROM per_group GROUP BY 1""",
    "unique_papers": f"WITH {PAPERS}, {LINKED} SELECT count(DISTINCT coalesce(nullif(group_id, ''), doc_id::VARCHAR)) AS n_unique, count(*) AS n_rows FROM linked",
    "merge_first_wins": """WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS status, o_orderpriority AS priority, o_orderstatus AS tags FROM orders),
tagged AS (SELECT o_custkey, string_agg(tags, '; ' ORDER BY first) AS tags FROM (SELECT o_custkey, tags, min(o_orderkey) AS first FROM r GROUP BY ALL) GROUP BY o_custkey)
SELECT r.o_custkey, min(o_orderkey) AS o_orderkey, arg_min(status, o_orderkey) FILTER (status <> '') AS status, arg_min(priority, o_orderkey) FILTER (priority <> '') AS priority, any_value(tagged.tags) AS tags FROM r JOIN tagged USING (o_custkey) GROUP BY r.o_custkey""",
    "anti_resume": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "top_customers": "SELECT o_custkey, c_name, n_orders FROM (SELECT o_custkey, count(*) AS n_orders FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY o_custkey ORDER BY n_orders DESC, o_custkey LIMIT 25) JOIN customer ON c_custkey = o_custkey",
    "exact_dedup": "SELECT min(doc_id) AS keep_id, count(*) AS n_copies FROM documents GROUP BY text",
    "neardup_pairs": """WITH d AS (SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text),
w AS (SELECT doc_id, copies, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM d),
s AS (SELECT doc_id, copies, list_distinct(list_transform(range(1, greatest(1, len(w) - 2) + 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) AS s FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, copies, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.copies) AS n_a, any_value(b.copies) AS n_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_ FROM e a JOIN e b USING (x) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id)
SELECT a, b, n_a, n_b, round(both_::DOUBLE / (na + nb - both_)::DOUBLE, 6) AS similarity FROM p WHERE both_::DOUBLE / (na + nb - both_)::DOUBLE >= 8e-1""",
    "title_word_blocks": f"""WITH {PAPERS}, w AS (SELECT doc_id, {significant('title')} AS w FROM papers), e AS (SELECT doc_id, unnest(w) AS block FROM w),
sizes AS (SELECT block FROM e GROUP BY block HAVING count(*) BETWEEN 2 AND 50), k AS (SELECT e.* FROM e JOIN sizes USING (block)),
pairs AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y USING (block) WHERE x.doc_id < y.doc_id),
scored AS (SELECT a, b, round({jaccard('x.w', 'y.w')}, 6) AS overlap FROM pairs JOIN w x ON x.doc_id = a JOIN w y ON y.doc_id = b)
SELECT * FROM scored WHERE overlap >= 2e-1 AND overlap <= 9e-1""",
    "chunk_words": f"WITH {CHUNKS} SELECT doc_id, chunk_index, md5(text) AS text_md5 FROM chunks",
    "parse_status_report": f"""WITH {CHUNKS}, c AS (SELECT doc_id, count(*) AS chunks FROM chunks GROUP BY doc_id)
SELECT CASE WHEN n_chars >= 200 THEN 'full_text' WHEN trim(text) <> '' THEN 'abstract_only' ELSE 'no_text_not_indexed' END AS status, count(*) AS n_docs, coalesce(sum(c.chunks), 0)::BIGINT AS n_chunks FROM documents LEFT JOIN c USING (doc_id) GROUP BY 1""",
    "html_sections": f"""WITH {SECTIONS}
SELECT page_id, 0::BIGINT AS sec_idx, heading, md5(text) AS text_md5 FROM c WHERE text <> ''""",
    "html_headings": "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS heading FROM pages",
    "repeated_lines": "SELECT source, line, count(DISTINCT doc_id) AS n_pages FROM (SELECT source, doc_id, lower(trim(unnest(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents) WHERE line <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2",
    "bm25_stats": f"WITH {INDEX} SELECT any_value(n) AS n, round(any_value(avgdl), 6) AS avgdl, round(any_value(mean_idf), 6) AS mean_idf, count(*) AS n_terms, count(*) FILTER (df > 1) AS n_shared, round(sum(idf), 3) AS sum_idf FROM terms, totals, mean",
    "bm25_topk": f"WITH {bm25(SHOWN)} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM bm25",
    "dense_topk": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "hybrid_rrf": f"WITH {hybrid(depth=50)} SELECT query_id, rank, chunk_id, round(score, 9) AS score FROM fused WHERE rank <= 10",
    "diversify_cap1": capped(1),
    "diversify_cap2": capped(2),
    "diversify_collapse": COLLAPSED,
    "redundant_rate": REDUNDANT,
    "same_group_share": f"WITH {RANKED} SELECT query_id, round((count(*) - count(DISTINCT group_id)) / count(*)::DOUBLE, 6) AS same_group_share FROM ranked WHERE rank <= {SHOWN} GROUP BY query_id",
    "hit_metrics": f"WITH {METRICS} SELECT query_id, round(recall, 6) AS recall, round(rr, 6) AS rr, hit FROM metrics",
    "metrics_rollup": f"""WITH {METRICS}, k AS (SELECT *, CASE query_id % 3 WHEN 0 THEN 'specific' WHEN 1 THEN 'multi' ELSE 'follow_up' END AS kind FROM metrics)
SELECT kind, count(*) AS n, round(avg(recall), 6) AS mean_recall, round(avg(rr), 6) AS mean_rr FROM k GROUP BY kind UNION ALL SELECT 'overall', count(*), round(avg(recall), 6), round(avg(rr), 6) FROM k""",
    "latency_quantiles": """WITH s AS (SELECT event_type, list_sort(list(value)) AS v, avg(value) AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, len(v) AS n, round(mean, 6) AS mean, round(v[len(v) // 2 + 1], 6) AS p50, round(v[least(len(v) - 1, floor(len(v) * 95e-2)::BIGINT) + 1], 6) AS p95 FROM s""",
    "bootstrap_ci": """WITH p AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, embedding[1]::DOUBLE - embedding[2]::DOUBLE AS d FROM embeddings),
size AS (SELECT count(*) AS n, avg(d) AS mean_diff FROM p),
draws AS (SELECT b, n, unnest(range(0, n)) AS place FROM range(2000) t(b), size),
x1 AS (SELECT b, n, (b * 48271 + place * 69621 + 42) % 2147483647 AS x FROM draws),
x2 AS (SELECT b, n, ((x + 1) * 16807) % 2147483647 AS x FROM x1), x3 AS (SELECT b, n, (x * 48271) % 2147483647 AS x FROM x2),
drawn AS (SELECT b, floor((x * n) / 2147483647e0)::BIGINT AS i FROM x3),
means AS (SELECT b, avg(d) AS m FROM drawn JOIN p USING (i) GROUP BY b), r AS (SELECT m, row_number() OVER (ORDER BY m, b) - 1 AS r FROM means),
ends AS (SELECT max(CASE WHEN r = 50 THEN m END) AS ci_low, max(CASE WHEN r = 1950 THEN m END) AS ci_high FROM r)
SELECT n, round(mean_diff, 6) AS mean_diff, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, ci_low > 0 OR ci_high < 0 AS significant FROM size, ends""",
    "cite_parse": f"WITH {ANSWERS} SELECT conv_id, turn, array_to_string(used, ',') AS cited FROM cited",
    "abstain_flags": f"WITH {ANSWERS} SELECT conv_id, turn, top_score < 225e-4 OR (({UNKNOWN}) AND len(used) = 0) AS abstained FROM cited",
    "confusion": """WITH c AS (SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic <> 1) AS fp, count(*) FILTER (quality <> 0 AND toxic = 1) AS fn, count(*) FILTER (quality <> 0 AND toxic <> 1) AS tn FROM labels)
SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall FROM c""",
    "rewrite_context": """WITH t AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q LEFT JOIN conversations a ON a.role = 'assistant' AND a.conv_id = q.conv_id AND a.turn - 1 = q.turn WHERE q.role = 'user'),
p AS (SELECT conv_id, turn, lag(1) OVER w AS there, lag(question) OVER w AS q, lag(answer) OVER w AS a FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN there = 1 THEN 'Previous question: ' || coalesce(q, '') || chr(10) || 'Summary of its answer: ' || substr(coalesce(a, ''), 1, 200) || chr(10) END AS context FROM p""",
    "sources_block": f"""WITH {RANKED}, b AS (SELECT query_id, string_agg('[' || rank || '] doc ' || doc_id || ' (2020), section: part ' || chunk_index || chr(10) || substr(text, 1, 800), chr(10) || chr(10) ORDER BY rank) AS sources FROM ranked WHERE rank <= {SHOWN} GROUP BY query_id)
SELECT query_id, md5(sources) AS sources_md5, length(sources) AS n_chars FROM b""",
    "bib_parse": """SELECT s_suppkey::VARCHAR AS key, 'Token ' || s_name AS title, 'M\\"uller, A.|' || n_name || ', B.' AS authors, '2020' AS year, 'Proc of x' AS venue FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "safe_keys": "SELECT doc_id, regexp_replace(source || '__' || lang || '/ ä:' || doc_id, '[^A-Za-z0-9_.-]', '_', 'g') AS file_key, substr(sha256(source || '|' || doc_id), 1, 24) AS request_key FROM documents",
}
