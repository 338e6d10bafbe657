"""The composite queries in DuckDB's SQL."""

from __future__ import annotations

from ..operators import relevance
from .collect import QUERY_TERMS
from .composites import SURVEYS, TOLD
from .oracles import ANSWERS, CHUNKS, DECIDED, RANKED, SECTIONS, SHOWN, FOLDED, INCLUDED, PAPERS, UNKNOWN, T, bm25, decided, hybrid, jaccard, listed, significant

D = relevance.DEFAULT


def pick(words, n: str) -> str:
    """The same word that composites.picked() takes."""
    words = tuple(words)
    return f"({listed(words)})[({n}) % {len(words)} + 1]"


def joined(*parts: str) -> str:
    return "(" + " || ' ' || ".join(parts) + ")"


TOLD_PAPERS = f"""{PAPERS}, told AS (SELECT * REPLACE (
  CASE WHEN doc_id % 3 = 0 THEN {joined('title', pick(D.strong, 'doc_id'), pick(TOLD, 'doc_id * 7 + 3'))} ELSE title END AS title,
  CASE WHEN doc_id % 4 > 0 THEN {joined('abstract', pick((*D.weak, ''), 'doc_id'), pick((*D.context, '', ''), 'doc_id * 5'), pick(TOLD, 'doc_id * 3'), pick(TOLD, 'doc_id * 11 + 1'))} ELSE abstract END AS abstract) FROM papers)"""

SURVEY_TITLE = relevance.SURVEY_TITLE.replace("'", "''")
SURVEY_ABSTRACT = relevance.SURVEY_ABSTRACT.replace("'", "''")

LINES = "lines AS (SELECT doc_id AS doc, (i - 1) // 20 AS page, (i - 1) % 20 AS line, l[i] AS text, 904e-2 + length(l[i]) % 3 AS size FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))"

HITS = f"""{PAPERS}, hits AS (SELECT doc_id AS seq, CASE WHEN doc_id % 2 = 0 THEN 'arxiv' ELSE 'semantic_scholar' END AS source, {pick(QUERY_TERMS, 'doc_id * 3')} AS term,
  CASE WHEN doc_id % 2 = 0 OR doc_id % 3 > 0 THEN (doc_id % 97)::VARCHAR ELSE '' END AS arxiv_id, CASE WHEN doc_id % 2 = 0 THEN 'v' || (doc_id % 4 + 1) ELSE '' END AS version,
  CASE WHEN doc_id % 2 = 0 THEN '' ELSE 's' || (doc_id % 131) END AS paper_id, CASE WHEN doc_id % 29 = 1 THEN '' ELSE title || ' x' END AS title,
  CASE WHEN doc_id % 2 = 0 THEN 'arXiv' ELSE {pick(('', 'arXiv', 'arXiv.org', 'ACL', 'EMNLP'), 'doc_id // 7')} END AS venue,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE substr(abstract, 1, 40) END AS abstract, 'http://x/' || doc_id AS url, CASE WHEN doc_id % 5 = 0 THEN doc_id::VARCHAR ELSE '' END AS doi, CASE WHEN doc_id % 2 = 0 THEN '' ELSE '{{' || doc_id || '}}' END AS external_ids FROM papers),
keyed AS (SELECT *, CASE WHEN arxiv_id <> '' THEN 'arxiv:' || arxiv_id ELSE 's2:' || paper_id END AS paper FROM hits WHERE source = 'arxiv' OR title <> ''),
firsts AS (SELECT *, min(seq) OVER (PARTITION BY paper) = seq AS is_first FROM keyed),
merged AS (SELECT paper, min(seq) AS seq, arg_min(source, seq) AS source, arg_min(title, seq) AS title, arg_min(venue, seq) AS first_venue, arg_min(abstract, seq) AS first_abstract, arg_min(arxiv_id, seq) AS arxiv_id,
  arg_min(CASE WHEN source = 'arxiv' THEN 'arxiv:' || arxiv_id ELSE 's2:' || paper_id END, seq) AS key,
  coalesce(arg_min(version, seq) FILTER (version <> '' AND (is_first OR source = 'arxiv')), '') AS version, coalesce(arg_min(url, seq) FILTER (url <> '' AND (is_first OR source = 'arxiv')), '') AS url, coalesce(arg_min(abstract, seq) FILTER (abstract <> '' AND (is_first OR source = 'arxiv')), '') AS abstract,
  coalesce(arg_min(paper_id, seq) FILTER (paper_id <> '' AND (is_first OR (source <> 'arxiv' AND arxiv_id <> ''))), '') AS paper_id, coalesce(arg_min(doi, seq) FILTER (doi <> '' AND (is_first OR (source <> 'arxiv' AND arxiv_id <> ''))), '') AS doi, coalesce(arg_min(external_ids, seq) FILTER (external_ids <> '' AND (is_first OR (source <> 'arxiv' AND arxiv_id <> ''))), '') AS external_ids,
  arg_min(venue, seq) FILTER (NOT is_first AND source <> 'arxiv' AND arxiv_id <> '' AND venue NOT IN ('', 'arXiv') AND lower(venue) <> 'arxiv.org') AS better, coalesce(bool_or(NOT is_first AND source <> 'arxiv' AND arxiv_id <> '' AND venue = 'arXiv'), false) AS plain FROM firsts GROUP BY paper),
terms AS (SELECT paper, list_reduce(list(term ORDER BY seq), lambda a, b: CASE WHEN contains(a, b) THEN a ELSE a || '; ' || b END) AS found_by FROM (SELECT paper, term, min(seq) AS seq FROM keyed GROUP BY ALL) GROUP BY paper),
papers_found AS (SELECT * EXCLUDE (first_venue, better, plain), CASE WHEN first_venue NOT IN ('', 'arXiv') THEN first_venue ELSE coalesce(better, CASE WHEN first_venue = '' AND plain THEN 'arXiv' END, first_venue) END AS venue FROM merged JOIN terms USING (paper))"""

JUDGED = f"""{HITS}, judged_rows AS (SELECT seq, key, title, first_abstract AS abstract FROM papers_found), {decided(T, 'judged_rows')}"""

#: Rows of a whole run in their order: hits, the anthology's, canaries that aren't known.
ADDED = f"""{HITS}, top AS (SELECT max(seq) AS top FROM papers_found),
bulk AS (SELECT doc_id // 5 + top + 1 AS seq, 'acl:' || doc_id AS key, 'acl_anthology' AS source, title || CASE WHEN doc_id % 2 = 0 THEN ' X!' ELSE ' y' END AS title, abstract FROM papers, top WHERE doc_id % 5 = 0),
canaries AS (SELECT doc_id // 50 AS seq, CASE WHEN doc_id % 100 < 50 THEN (doc_id % 97)::VARCHAR ELSE 'new' || doc_id END AS arxiv_id, CASE WHEN doc_id % 150 > 10 THEN title || ' x' END AS title, abstract FROM papers WHERE doc_id % 50 = 2),
known AS (SELECT arxiv_id FROM papers_found WHERE starts_with(key, 'arxiv:')),
new AS (SELECT seq + top + 1099511627776 AS seq, 'arxiv:' || arxiv_id AS key, 'arxiv' AS source, title, abstract FROM canaries, top WHERE title IS NOT NULL AND arxiv_id NOT IN (SELECT arxiv_id FROM known)),
everything AS (SELECT seq, key, source, title, first_abstract AS abstract, false AS added FROM papers_found UNION ALL SELECT *, true FROM bulk UNION ALL SELECT *, true FROM new),
titled AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS t FROM everything),
last AS (SELECT t, max(seq) FILTER (NOT added) AS last, count(*) FILTER (added) AS n_added FROM titled GROUP BY t),
linked AS (SELECT titled.*, n_added > 0 AND (added OR seq = last) AS is_in FROM titled JOIN last USING (t)),
second AS (SELECT t, list_sort(list(seq))[2] AS second FROM linked WHERE is_in GROUP BY t HAVING count(*) > 1),
numbers AS (SELECT t, printf('grp%04d', row_number() OVER (ORDER BY second)) AS group_id FROM second)"""

HTML_TEXT = "regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?s)^.*?</h1>', ''), '(?s)<(script|style)>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')"

CONVERSED = """asked AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
q AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, text, min(turn) OVER (PARTITION BY conv_id) = turn AS alone, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS first_text FROM asked),
seeds AS (SELECT text, min(id) AS seed FROM q WHERE alone GROUP BY text),
follow AS (SELECT q.id, seed, min(q.id) OVER (PARTITION BY conv_id) AS ordered, turn FROM q JOIN seeds ON seeds.text = q.first_text WHERE NOT alone)"""

EVALUATED = f"""WITH RECURSIVE {hybrid("SELECT item_id AS query_id, CASE WHEN item_id % 5 = 0 THEN text ELSE array_to_string(list_slice(string_split(text, ' '), 1, 12), ' ') END AS text FROM benchmark WHERE item_id % 11 <> 10")},
ranked AS (SELECT f.query_id, f.rank, f.chunk_id, c.text, (c.doc_id % 100)::VARCHAR AS group_id FROM fused f JOIN chunks c USING (chunk_id) WHERE f.rank <= 5),
{FOLDED},
gold AS (SELECT item_id AS query_id, (item_id % 100)::VARCHAR AS group_id, 0 AS gold_no, text AS span FROM benchmark WHERE item_id % 11 <> 10 UNION ALL SELECT item_id, ((item_id * 7 + 3) % 100)::VARCHAR, 1, text FROM benchmark WHERE item_id % 11 <> 10),
compared AS (SELECT g.query_id, g.gold_no, r.rank, regexp_replace(lower(g.span), '[^a-z0-9]+', '', 'g') AS gs, regexp_replace(lower(r.text), '[^a-z0-9]+', '', 'g') AS rt, {significant('g.span')} AS gw, {significant('r.text')} AS rw FROM gold g JOIN ranked r ON r.query_id = g.query_id AND r.group_id = g.group_id),
hit AS (SELECT query_id, gold_no, rank FROM compared WHERE (gs <> '' AND contains(rt, gs)) OR (len(gw) > 0 AND len(list_intersect(gw, rw)) / len(gw)::DOUBLE >= 7e-1)),
per AS (SELECT query_id, count(DISTINCT gold_no) AS n, min(rank) AS first FROM hit GROUP BY query_id),
copies AS (SELECT query_id, (max(pos) - max(len(kept))) / max(pos)::DOUBLE AS redundant FROM fold WHERE pos > 0 GROUP BY query_id),
shares AS (SELECT query_id, (count(*) - count(DISTINCT group_id)) / count(*)::DOUBLE AS share FROM ranked GROUP BY query_id),
metrics AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'specific' WHEN 1 THEN 'multi' ELSE 'follow_up' END AS type, coalesce(n, 0) / 2e0 AS recall, coalesce(1e0 / first, 0e0) AS rr, coalesce(share, 0e0) AS share, coalesce(redundant, 0e0) AS redundant FROM benchmark LEFT JOIN per ON per.query_id = item_id LEFT JOIN shares ON shares.query_id = item_id LEFT JOIN copies ON copies.query_id = item_id WHERE item_id % 11 <> 10)
SELECT coalesce(type, 'overall') AS type, count(*) AS n, round(avg(recall), 6) AS mean_recall, round(avg(rr), 6) AS mean_rr, round(avg(share), 6) AS mean_same_group_share, round(avg(redundant), 6) AS mean_redundant_rate FROM metrics GROUP BY ROLLUP (type)"""

ORACLE_SQL = {
    "relevance_default": f"WITH {TOLD_PAPERS}, {decided(D, 'told')} SELECT doc_id, s AS relevance_score, {INCLUDED} AS included, reason FROM decided",
    "survey_default": f"WITH {PAPERS} SELECT doc_id, regexp_matches({joined('title', pick((*SURVEYS, ''), 'doc_id'))}, '{SURVEY_TITLE}') OR regexp_matches({joined('abstract', pick((*SURVEYS, '', ''), 'doc_id * 7'))}, '{SURVEY_ABSTRACT}') AS is_survey FROM papers",
    "heading_case": f"WITH {PAPERS} SELECT doc_id, array_to_string(list_transform(regexp_extract_all(trim(regexp_replace(title, '[^ -~]', '', 'g') || ' self-attention isn''t BPE4all'), '\\p{{L}}+|\\P{{L}}+'), lambda r: upper(r[1]) || lower(r[2:])), '') AS heading FROM papers",
    "name_overlap": f"""WITH {PAPERS}, parts AS (SELECT doc_id, title, string_split(title, ' ')[1] || '; ' || array_to_string(list_slice(string_split(title, ' '), 1, 3), ' ') AS authors FROM papers),
named AS (SELECT doc_id, title, list_distinct(list_transform(list_filter(list_transform(list_filter(list_transform(string_split(authors, ';'), lambda n: trim(n)), lambda n: n <> ''), lambda n: list_filter(string_split_regex(n, '[,\\s]+'), lambda p: p <> '')), lambda p: len(p) > 0), lambda p: lower(list_reduce(p, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END)))) AS names FROM parts)
SELECT a.doc_id, md5(trim(regexp_replace(regexp_replace(lower(a.title), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))) AS words_md5, array_to_string(list_sort(a.names), '|') AS names, round({jaccard('a.names', 'b.names')}, 6) AS overlap FROM named a JOIN named b ON b.doc_id = a.doc_id + 1""",
    "valid_responses": """WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '%PDF-' ELSE '' END || substr(html, 1, (400 + page_id * 3)::INTEGER) AS c, page_id % 10 <> 9 AS ok FROM pages)
SELECT page_id, ok AND length(c) >= 500 AS html, ok AND strlen(c) >= 1000 AS arxiv_pdf, ok AND strlen(c) >= 1000 AND starts_with(c, '%PDF-') AS generic_pdf FROM p""",
    "atom_parse": "SELECT '21' || s_suppkey AS arxiv_id, CASE WHEN s_suppkey % 3 > 0 THEN 'v' || (s_suppkey % 3) ELSE 'v1' END AS version, 'On ' || s_name AS title, 'A B|C' AS authors, 'About it' AS abstract, 'cs.CL' AS categories, 'http://x/pdf' AS pdf_url FROM supplier",
    "json_pages": "SELECT 'p' || s_suppkey AS paper_id, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS abstract, (2000 + s_nationkey)::VARCHAR AS year, 'A|' || s_name AS authors, CASE WHEN s_suppkey % 3 = 0 THEN 'http://x/' || s_suppkey ELSE '' END AS open_access_pdf FROM supplier WHERE s_suppkey // 10 % 7 <> 3",
    "open_copies": "SELECT 'p' || s_suppkey AS paper_id, 'http://x/' || s_suppkey AS url FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey // 10 % 7 <> 3",
    "paged_results": """WITH p AS (SELECT doc_id % 40 AS query, doc_id // 40 * 10 AS start, list_transform(range(1, CASE WHEN doc_id % 7 = 0 THEN n_chars % 10 ELSE 10 END + 1), lambda i: doc_id * 100 + i) AS entries, doc_id % 40 * 5 AS total FROM documents),
k AS (SELECT 'short' AS kind, *, len(entries) < 10 AS over FROM p UNION ALL SELECT 'total', *, len(entries) = 0 OR start + 10 >= total FROM p),
o AS (SELECT *, coalesce(bool_or(over) OVER w, false) AS ended, coalesce(sum(len(entries)) OVER w, 0)::BIGINT AS n FROM k WINDOW w AS (PARTITION BY kind, query ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT kind, query, n + i - 1 AS place, entries[i] AS entry FROM (SELECT *, unnest(range(1, len(entries) + 1)) AS i FROM o WHERE NOT ended)) SELECT * FROM e WHERE place < 95""",
    "fetch_attempts": """SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'arxiv_html html https://arxiv.org/html/' || doc_id END, CASE WHEN doc_id % 2 = 0 THEN 'arxiv_pdf arxiv_pdf https://arxiv.org/pdf/' || doc_id END,
CASE WHEN doc_id % 3 = 0 THEN 'acl_pdf pdf http://x/' || doc_id || '.pdf' END, CASE WHEN doc_id % 5 = 0 THEN 's2_oa_pdf pdf http://open/' END], lambda x: x IS NOT NULL), '|') AS attempts FROM documents""",
    "collect_merge": f"WITH {HITS} SELECT seq, key, source, found_by, version, paper_id, venue, abstract, url, doi, external_ids, first_abstract FROM papers_found",
    "collect_sample": f"""WITH {JUDGED}, r AS (SELECT *, {INCLUDED} AS included, row_number() OVER (PARTITION BY {INCLUDED} ORDER BY s DESC, seq) AS r FROM decided)
SELECT seq, key, s AS relevance_score, included, CASE WHEN included THEN '' ELSE reason END AS rejection_reason FROM r WHERE NOT included OR r <= 20""",
    "collect_groups": f"WITH {ADDED} SELECT key, source, coalesce(group_id, '') AS group_id FROM linked LEFT JOIN numbers ON numbers.t = linked.t AND is_in",
    "canary_report": f"""WITH {ADDED}, before AS (SELECT DISTINCT t FROM titled WHERE key NOT IN (SELECT key FROM new)), {decided(T, 'everything')},
own AS (SELECT key, {INCLUDED} AS included FROM decided WHERE starts_with(key, 'arxiv:'))
SELECT c.seq AS canary_seq, c.arxiv_id AS canary, CASE WHEN own.key IS NULL THEN 'MISSING' WHEN own.included THEN 'INCLUDED' ELSE 'REJECTED' END AS status, c.arxiv_id IN (SELECT arxiv_id FROM known) OR (c.title IS NOT NULL AND regexp_replace(lower(c.title), '[^a-z0-9]+', '', 'g') IN (SELECT t FROM before)) AS naturally_found FROM canaries c LEFT JOIN own ON own.key = 'arxiv:' || c.arxiv_id""",
    "version_pairs": f"""WITH {PAPERS}, rows_ AS (SELECT *, doc_id::VARCHAR || 'v' || (n_chars % 9) AS source_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'v' || (n_chars % 9) END AS version, CASE WHEN doc_id % 4 = 0 THEN printf('grp%04d', doc_id % 50) ELSE '' END AS group_id FROM papers),
chosen AS (SELECT *, n_chars % 9 AS v FROM rows_ WHERE doc_id % 7 > 0 AND doc_id % 3 < 2 AND version NOT IN ('', 'v1') AND doc_id::VARCHAR || 'v1' NOT IN (SELECT source_id FROM rows_) ORDER BY v DESC, doc_id LIMIT 25),
met AS (SELECT *, sum((group_id = '')::INTEGER) OVER (ORDER BY v DESC, doc_id) AS nth FROM chosen WHERE doc_id % 6 > 0), {decided(T, 'met')}
SELECT doc_id AS of_seq, doc_id || 'v1' AS source_id, 'A ' || doc_id AS authors, CASE WHEN group_id <> '' THEN group_id ELSE printf('grp%04d', (SELECT max(substr(group_id, 4)::INTEGER) FROM rows_ WHERE group_id <> '') + nth::INTEGER) END AS group_id, {INCLUDED} AS included, CASE WHEN {INCLUDED} THEN '' ELSE reason END AS rejection_reason FROM decided""",
    "doc_types": f"""WITH {PAPERS}, keyed AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS key FROM papers),
numbered AS (SELECT key, printf('grp%04d', row_number() OVER (ORDER BY min(doc_id), key)) AS group_id FROM keyed WHERE key <> '' GROUP BY key HAVING count(*) > 1),
r AS (SELECT k.*, coalesce(group_id, '') AS group_id, ['acl_anthology', 'arxiv', 'other'][doc_id % 3 + 1] || '__' || doc_id AS id, [0, 1, 9][doc_id % 3 + 1] AS p, doc_id % 6 > 0 AS included FROM keyed k LEFT JOIN numbered USING (key)),
best AS (SELECT group_id, arg_min(id, row(p, -(doc_id % 4), doc_id)) AS canonical FROM r WHERE included AND group_id <> '' GROUP BY group_id)
SELECT doc_id AS seq, CASE WHEN NOT included THEN '' ELSE coalesce(canonical, id) END AS canonical_id, CASE WHEN NOT included THEN '' WHEN regexp_matches({joined('title', pick((*SURVEYS, ''), 'doc_id'))}, '{SURVEY_TITLE}') OR regexp_matches(abstract, '{SURVEY_ABSTRACT}') THEN 'survey' ELSE 'paper' END AS doc_type FROM r LEFT JOIN best ON best.group_id = r.group_id""",
    "eval_run": EVALUATED,
    "session_rounds": f"WITH {CONVERSED} SELECT id, id AS session, 0::BIGINT AS round FROM q WHERE alone UNION ALL SELECT id, seed, row_number() OVER (PARTITION BY seed ORDER BY ordered, turn, id) FROM follow",
    "chat_rates": f"""WITH {ANSWERS}, l AS (SELECT turn % 4 = 1 AND conv_id % 5 <> 0 AS unanswerable, top_score < 225e-4 OR (({UNKNOWN}) AND len(used) = 0) AS abstained, length(answer) % 3 <> 0 AS grounded, len(used) > 0 AS cites FROM cited),
c AS (SELECT count(*) AS n, count(*) FILTER (NOT abstained) AS n_answered, avg(grounded::INTEGER) FILTER (NOT abstained) AS g, avg(cites::INTEGER) FILTER (NOT abstained) AS ci, count(*) FILTER (abstained AND unanswerable) AS tp, count(*) FILTER (abstained AND NOT unanswerable) AS fp, count(*) FILTER (NOT abstained AND unanswerable) AS fn, count(*) FILTER (NOT abstained AND NOT unanswerable) AS tn FROM l)
SELECT n, n_answered, round(g, 6) AS groundedness_rate, round(ci, 6) AS citation_rate, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, tp, fp, fn, tn FROM c""",
    "body_sizes": f"WITH {LINES}, s AS (SELECT doc, round(size, 1) AS s, sum(length(text)) AS n, min(page * 20 + line) AS first FROM lines GROUP BY ALL) SELECT doc, arg_min(s, row(-n, first)) AS body FROM s GROUP BY doc",
    "kept_lines": f"""WITH {LINES}, pages_ AS (SELECT doc, count(DISTINCT page) AS n FROM lines GROUP BY doc), on_ AS (SELECT doc, lower(trim(text)) AS low, count(DISTINCT page) AS n FROM lines GROUP BY ALL),
often AS (SELECT o.doc, low FROM on_ o JOIN pages_ p USING (doc) WHERE p.n >= 3 AND o.n >= greatest(2, floor(p.n * 4e-1)))
SELECT l.doc, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars FROM lines l WHERE NOT regexp_matches(text, '(?i)^(proceedings of|page \\s*\\d+$|^\\d{{1,4}}$|copyright \\d|©|association for computational linguistics)') AND NOT EXISTS (SELECT 1 FROM often o WHERE o.doc = l.doc AND o.low = lower(trim(l.text))) GROUP BY l.doc""",
    "line_sections": f"""WITH {LINES}, plain AS (SELECT doc, page, line, regexp_replace(text, '[^ -~]', '', 'g') AS text, size, length(text) % 17 = 0 AS bold FROM lines),
pages_ AS (SELECT doc, count(DISTINCT page) AS n FROM plain GROUP BY doc), on_ AS (SELECT doc, lower(trim(text)) AS low, count(DISTINCT page) AS n FROM plain GROUP BY ALL),
often AS (SELECT o.doc, low FROM on_ o JOIN pages_ p USING (doc) WHERE p.n >= 3 AND o.n >= greatest(2, floor(p.n * 4e-1))),
kept AS (SELECT * FROM plain l WHERE NOT regexp_matches(text, '(?i)^(proceedings of|page \\s*\\d+$|^\\d{{1,4}}$|copyright \\d|©|association for computational linguistics)') AND NOT EXISTS (SELECT 1 FROM often o WHERE o.doc = l.doc AND o.low = lower(trim(l.text)))),
sized AS (SELECT doc, round(size, 1) AS s, sum(length(text)) AS n, min(page * 20 + line) AS first FROM kept GROUP BY ALL), body AS (SELECT doc, arg_min(s, row(-n, first)) AS body FROM sized GROUP BY doc),
marked AS (SELECT doc, page, line, trim(text) AS x, regexp_matches(trim(text), '^(\\d{{1,2}}(\\.\\d{{1,2}}){{0,2}})\\.?\\s+[A-Z][\\w\\-/ ]{{1,60}}$') OR (length(trim(text)) < 60 AND regexp_matches(trim(text), '(?i)^\\s*(\\d{{1,2}}\\.?\\d{{0,2}}\\.?\\s*)?(abstract|introduction|related work|background|method(ology)?|approach|experiment(s)?|evaluation|result(s)?|discussion|conclusion(s)?|limitations?|acknowledg(e)?ments?|appendix|references|bibliography)\\s*$'))
  OR (length(trim(text)) < 70 AND len(list_filter(string_split_regex(trim(text), '[ \\t\\n\\r]+'), lambda w: w <> '')) <= 8 AND (size > body + 5e-1 OR bold) AND regexp_matches(trim(text), '^\\p{{Lu}}')) AS h FROM kept JOIN body USING (doc) WHERE trim(text) <> ''),
cut AS (SELECT *, max((h AND regexp_matches(x, '(?i)^(\\d+\\.?\\s*)?(references|bibliography)'))::INTEGER) OVER w AS refs, sum(h::INTEGER) OVER w AS sec_idx FROM marked WINDOW w AS (PARTITION BY doc ORDER BY page, line)),
grouped AS (SELECT doc, sec_idx, max(x) FILTER (h) AS head, coalesce(string_agg(x, ' ' ORDER BY page, line) FILTER (NOT h), '') AS text FROM cut WHERE refs = 0 GROUP BY ALL)
SELECT doc, sec_idx::BIGINT AS sec_idx, coalesce(array_to_string(list_transform(regexp_extract_all(trim(regexp_replace(head, '^[0-9.]+\\s*', '')), '\\p{{L}}+|\\P{{L}}+'), lambda r: upper(r[1]) || lower(r[2:])), ''), 'Abstract') AS heading, md5(text) AS text_md5 FROM grouped WHERE text <> ''""",
    "cap_tokens": f"""WITH RECURSIVE {CHUNKS}, pieces(doc_id, chunk_index, w, lo, hi) AS (SELECT doc_id, chunk_index, string_split(text, ' '), 0::BIGINT, len(string_split(text, ' '))::BIGINT FROM chunks UNION ALL
  SELECT doc_id, chunk_index, w, CASE WHEN half = 0 THEN lo ELSE lo + (hi - lo) // 2 END, CASE WHEN half = 0 THEN lo + (hi - lo) // 2 ELSE hi END FROM pieces, (VALUES (0), (1)) AS halves(half) WHERE hi - lo > 100)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, lo) - 1 AS chunk_index, md5(array_to_string(w[lo + 1:hi], ' ')) AS text_md5 FROM pieces WHERE hi - lo <= 100""",
    "manifest_round_trip": f"WITH {PAPERS}, {DECIDED} SELECT source, doc_id::VARCHAR AS source_id, 'a \"quoted\", ' || title AS title, s AS relevance_score, {INCLUDED} AS included, CASE WHEN {INCLUDED} THEN '' ELSE reason END AS rejection_reason FROM decided",
    "saved_index": f"WITH {bm25(SHOWN)} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM bm25",
    "gold_passages": """SELECT item_id AS query_id, (CASE WHEN n = 0 THEN item_id ELSE item_id * 7 + 3 END % 100)::VARCHAR AS group_id, n::BIGINT AS gold_no, text AS span, CASE WHEN item_id % 5 = 0 AND text <> '' THEN text ELSE array_to_string(list_slice(string_split(text, ' '), 1, 12), ' ') END AS asked FROM benchmark, (VALUES (0), (1)) AS g(n) WHERE item_id % 11 <> 10""",
    "response_texts": "SELECT conv_id, turn, CASE WHEN length(text) % 4 > 1 THEN text ELSE '' END AS answer FROM conversations",
    "chat_answers": f"""WITH {RANKED.replace('f.chunk_id, c.text', 'f.chunk_id, f.score, c.text')}, top AS (SELECT item_id AS query_id, score, ranked.text AS text FROM benchmark LEFT JOIN ranked ON ranked.query_id = item_id AND rank = 1)
SELECT query_id, CASE WHEN coalesce(score, 0) < 225e-4 THEN 'The corpus doesn''t contain enough information to answer this.' ELSE rtrim(trim(split_part(substr(text, 1, 800), '. ', 1)), '.') || ' [1].' END AS answer, CASE WHEN coalesce(score, 0) < 225e-4 THEN '' ELSE '1' END AS cited, coalesce(score, 0) < 225e-4 AS abstained, CASE WHEN coalesce(score, 0) < 225e-4 THEN 'retrieval_score_below_threshold' ELSE '' END AS abstain_reason FROM top""",
    "parse_run": f"""WITH {SECTIONS}, r AS (SELECT page_id, coalesce(page_id % 5 > 0 AND page_id % 7 > 0 AND length(text) >= 200, false) AS full_text, text FROM pages LEFT JOIN c USING (page_id) WHERE page_id % 10 > 0)
SELECT 'k' || page_id AS key, CASE WHEN full_text THEN 'full_text' WHEN page_id % 3 > 0 THEN 'abstract_only' ELSE 'no_text_not_indexed' END AS parse_status, CASE WHEN NOT full_text AND page_id % 3 = 0 THEN 'no' ELSE 'yes' END AS indexed,
CASE WHEN full_text THEN greatest(0, ceil((len(string_split(text, ' ')) - 350) / 300e0))::BIGINT + 1 WHEN page_id % 3 > 0 THEN 1 ELSE 0 END AS n_chunks FROM r""",
}
