"""The composite operators: duplicates, collection, parsing, evaluation and chat, on small cases worked out by hand or by plain loops."""

import difflib
import json
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quern.operators import evaluation, linking, relevance, retrieval
from quern.plans import chat, collect, composites, dedup, parse, search
from quern.sources import records

MANIFEST = "seq long, source string, source_id string, title string, authors string, year string, abstract string, arxiv_id string, arxiv_version string, included boolean, group_id string"


def surnames(authors):
    return {max(p, key=len).lower() for a in authors.split(";") if (p := [x for x in re.split(r"[,\s]+", a.strip()) if x])}


def likeness(a, b):
    norm = lambda x: re.sub(r"\s+", " ", re.sub("[^a-z0-9 ]", "", x.lower())).strip()
    return difflib.SequenceMatcher(None, norm(a), norm(b)).ratio()


ROWS = [
    (1, "arxiv", "a1", "Merge rules of byte-pair encoding", "Ann Adler; Bob Baker", "2020", "about merge rules", "a", "v1", True, ""),
    (2, "acl_anthology", "b1", "Merge Rules of Byte Pair Encodings", "Adler, Ann; Bob Baker", "2021", "other words", "", "", True, ""),
    (3, "arxiv", "c1", "Merge rules of byte-pair encodings", "Ann Adler", "2022", "about merge rules", "c", "v2", True, ""),
    (4, "arxiv", "d1", "Merge rules of byte-pair encoding", "Ann Adler; Bob Baker", "2010", "about merge rules", "d", "v1", True, ""),
    (5, "arxiv", "e1", "Proceedings of the merge rules", "Ann Adler; Bob Baker", "2020", "x", "e", "v1", True, ""),
    (6, "arxiv", "f1", "Vocabulary size and byte pairs", "Ann Adler; Zoe Zimmer", "2020", "y", "f", "v1", True, "grp0004"),
    (7, "semantic_scholar", "g1", "Vocabulary sizes and byte pair", "Ann Adler; Zoe Zimmer", "n/a", "y", "", "", True, "grp0004"),
    (8, "semantic_scholar", "h1", "Merge rules of byte-pair encoding", "Ann Adler; Bob Baker", "2020", "about merge rules", "", "", False, ""),
    (9, "semantic_scholar", "i1", "A survey of numbers", "Cy Cole", "2020", "we survey numbers", "", "", True, ""),
    (10, "semantic_scholar", "j1", "Numbers differently", "Dee Dole", "2020", "of numbers", "", "", True, ""),
]


@pytest.fixture(scope="module")
def rows(spark):
    return retrieval.embed(spark.createDataFrame(ROWS, MANIFEST), retrieval.hash_encoder, text_col="abstract", out="vector", kind="array<double>")


def cosine(a, b):
    x, y = retrieval.hash_encoder()([a, b])
    return float(x @ y)


def test_fuzzy_merges_by_brute_force(rows):
    want = {}
    for a, b in combinations([r for r in ROWS if r[9] and not r[10] and not r[3].lower().startswith("proceedings of")], 2):
        shared, sim = len(surnames(a[4]) & surnames(b[4])), likeness(a[3], b[3])
        gap = abs(int(a[5]) - int(b[5]))
        if sim >= 0.85 and gap <= 2 and (shared >= 2 or (shared >= 1 and cosine(a[6], b[6]) >= 0.8)):
            want[a[0], b[0]] = round(sim, 9)
    got = {(r.a, r.b): round(r.title_sim, 9) for r in dedup.fuzzy_merges(rows).collect()}
    assert got == want and (1, 2) in got and (1, 3) in got and (2, 3) not in got and (1, 4) not in got


def test_near_misses_by_brute_force(rows):
    want = []
    for a, b in combinations([r for r in ROWS if r[9]], 2):
        x, y, sim = surnames(a[4]), surnames(b[4]), likeness(a[3], b[3])
        if x & y and not (a[10] and a[10] == b[10]) and 0.4 <= sim <= 0.85 and len(x & y) / len(x | y) >= 0.2:
            want.append((-round(sim, 9), a[0], b[0]))
    found = linking.near_misses(rows.where("included"), id_col="seq", title_col="title", authors_col="authors", group_col="group_id").collect()
    assert [(-round(r.title_sim, 9), r.a, r.b) for r in found] == sorted(want) and want


def test_merge_steps_in_order():
    groups, applied = linking.merge_steps([("a", "b"), ("c", "a"), ("d", "e"), ("b", "d")], {"x": "grp0003", "m": "", "n": ""}, [("m", "n"), ("m", "gone"), ("x", "a")])
    assert groups == {"x": "grp0003", "a": "grp0004", "b": "grp0004", "c": "grp0004", "d": "grp0005", "e": "grp0005", "m": "grp0006", "n": "grp0006"}
    assert applied == [("a", "b", "grp0004"), ("c", "a", "grp0004"), ("d", "e", "grp0005"), ("m", "n", "grp0006")]


def test_dedup_run(spark, rows):
    made = dedup.run(spark.createDataFrame(ROWS, MANIFEST), retrieval.hash_encoder, manual=[("semantic_scholar:i1", "semantic_scholar:j1"), ("semantic_scholar:i1", "gone:x")])
    by = {r.seq: r for r in made.rows.collect()}
    assert by[1].group_id == by[2].group_id == by[3].group_id == "grp0005" and by[9].group_id == by[10].group_id == "grp0006" and by[8].group_id == ""
    assert by[1].canonical_id == "acl_anthology__b1" and by[6].canonical_id == "arxiv__f1" and by[4].canonical_id == "arxiv__d1" and by[8].canonical_id == ""
    assert by[9].doc_type == "survey" and by[1].doc_type == "paper" and by[8].doc_type == ""
    audit = {(r.a, r.b): r for r in made.audit.collect()}
    assert set(audit) == {(1, 2), (1, 3), (2, 3), (6, 7), (9, 10)}
    assert audit[6, 7].title_sim == round(likeness(ROWS[5][3], ROWS[6][3]), 3) and audit[6, 7].author_overlap == 1.0 and audit[6, 7].abstract_cosine == 1.0
    assert audit[1, 2].abstract_cosine == round(cosine(ROWS[0][6], ROWS[1][6]), 3)
    report = made.report
    doubtful = sum(r.abstract_cosine < 0.7 or r.author_overlap == 0 for r in audit.values())
    assert (report["n_groups_audited"], report["n_pairs_audited"], report["n_low_confidence_merges"], report["n_surveys_flagged"], report["n_fuzzy_merges"]) == (3, 5, doubtful, 1, 3)
    assert report["group_breakdown"]["total_groups"] == 3 and report["group_breakdown"]["cross_source_only"] == 2
    text = dedup.audit_markdown(made)
    assert "manual" in text and "Vocabulary sizes and byte pair" in text and f"n_pairs_audited: {report['n_pairs_audited']}" in text


def test_copies_add_no_pairs_to_an_audit(spark):
    df = spark.createDataFrame([(i, "g", "t" if i < 500 else "tt", "A B", [1.0]) for i in range(501)], "seq long, g string, title string, authors string, v array<double>")
    (r,) = linking.audit_groups(df, id_col="seq", group_col="g", title_col="title", authors_col="authors", vector_col="v").collect()
    assert (r.a, r.b, r.n_a, r.n_b) == (0, 500, 500, 1)


def test_members_of_an_audit_by_its_pairs(spark):
    rng, rows = random.Random(5), []
    for i in range(140):
        terms = [rng.choice("abcd") for _ in range(rng.choice((1, 4, 16, 30)))]
        vector = retrieval.hash_encoder(8)([" ".join(terms)])[0].tolist()
        vector = rng.choice([vector] * 12 + [None, [], vector[:5], [0.5] * 4 + [None]])
        title = rng.choice(["One title", "One  Title!", "A title", None, "t" * 210 + " same", "q" * 210 + "t same"])
        rows.append((1000 - 7 * i, rng.choice(["g", "g", "h", "k", "", None]), title, rng.choice(["Ann Adler; Bob Baker", "Ann Adler", "Cy Cole", "", None]), vector))
    rows += [(2000 + i, "copies", "t", "A B", [1.0]) for i in range(5)] + [(3000, "alone", "t", "A B", [1.0])]
    df = spark.createDataFrame(rows, "seq long, g string, title string, authors string, v array<double>").cache()
    names = dict(id_col="seq", group_col="g", title_col="title", authors_col="authors", vector_col="v")
    pairs = linking.audit_groups(df, **names).collect()
    want = {}
    for r in pairs:
        for x, y in ((r.a, r.b), (r.b, r.a)):
            want.setdefault(x, []).append((r.abstract_cosine, y, r.title_sim, r.author_overlap))
    for block_rows in (4096, 7, 1):
        got = linking.audit_members(df, block_rows=block_rows, **names).collect()
        assert [(r.group, r.id) for r in got] == sorted((r[1], r[0]) for r in rows if r[1])
        by = {r.id: r for r in got}
        for r in got:
            met = want.get(r.like, [])
            mean = lambda k: sum(round(m[k] * 1000) for m in met) / (1000 * len(met))  # noqa: E731, B023
            assert (r.n_pairs, r.n_doubtful) == (len(met), sum(m[0] < 0.7 or m[3] == 0 for m in met))
            assert by[r.like].like == r.like <= r.id and r.n == sum(o.like == r.like for o in got)
            if met:
                assert (r.least_abstract_cosine, r.farthest) == min(m[:2] for m in met)
                assert (r.least_title_sim, r.least_author_overlap) == (min(m[2] for m in met), min(m[3] for m in met))
                assert [r.mean_abstract_cosine, r.mean_title_sim, r.mean_author_overlap] == pytest.approx([mean(0), mean(2), mean(3)], abs=6e-7)
            else:
                assert r.farthest is None and r.least_title_sim is None and r.mean_abstract_cosine is None
    assert by[2003].like == 2000 and by[2003].n == 5 and by[2003].n_pairs == 0 and len(pairs) > 500


def test_an_audit_grows_with_the_rows(spark, tmp_path):
    """The query has a row for each row of a group, and in it all of its pairs."""
    spark.createDataFrame([(i, "web", "en", 9, f"One title\nword{i} of many") for i in range(300)] + [(300, "web", "en", 9, "Other")], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = composites.audit_groups(spark, str(tmp_path)).collect()
    assert [r.seq for r in got] == list(range(300)) and {r.n_pairs for r in got} == {len({r.like for r in got}) - 1} and got[0].n_pairs > 100


def test_an_audit_lists_each_pair(spark, monkeypatch):
    rng, rows = random.Random(6), []
    for i in range(90):
        vector = rng.choice([[0.6, 0.8], [1.0, 0.0], [0.28, 0.96], [0.0005, 0.0], [1.0], None, [float("nan"), 1.0]])
        rows.append((500 - 5 * i, rng.choice("gggh"), rng.choice(["One title", "One  titel!", "t" * 210 + " same", "q" * 210 + "t same", None]), rng.choice(["Ann Adler; Bob Baker", "Ann Adler", "; ", None]), vector))
    df = spark.createDataFrame(rows, "seq long, g string, title string, authors string, v array<double>").cache()
    names = dict(id_col="seq", group_col="g", title_col="title", authors_col="authors", vector_col="v")
    usable = df.withColumn("v", F.expr("if(exists(v, x -> isnan(x)), null, v)"))
    want = [tuple(r) for r in linking.audit_groups(usable.where("v is not null or seq % 2 = 0"), **names).collect()]
    whole = linking._compared
    for block_rows, cells in ((4096, 1 << 18), (16, 1 << 18), (16, 40), (1, 1)):
        monkeypatch.setattr(linking, "_compared", lambda *a, cells=cells: whole(*a, cells=cells))
        got = linking.audit_members(usable.where("v is not null or seq % 2 = 0"), block_rows=block_rows, **names).collect()
        n = {r.id: r.n for r in got}
        assert [(r.group, r.id, p.other, r.n, n[p.other], p.title_sim, p.author_overlap, p.abstract_cosine) for r in got for p in r.pairs or []] == want and len(want) > 500
        assert {r.pairs is None for r in got if r.id != r.like} == {True} and not [r for r in got if r.id == r.like and r.pairs is None]
        assert sum(r.n_pairs for r in got if r.id == r.like) == 2 * len(want)


def test_an_audit_tells_how_copies_are_alike(spark):
    """Rows that are equal and have no author or no usable vector are doubtful as any such pair."""
    rows = [(i, "g", "t", names, v) for i, (names, v) in enumerate(2 * [("A Bee", [0.6, 0.8]), ("", [1.0]), ("A Bee", None), ("A Bee", [float("nan"), 1.0])] + [("C Dee", [1.0])])]
    df = spark.createDataFrame(rows, "seq long, g string, title string, authors string, v array<double>")
    got = linking.audit_members(df, id_col="seq", group_col="g", title_col="title", authors_col="authors", vector_col="v").collect()
    assert [(r.id, r.like, r.same_author_overlap, r.same_abstract_cosine) for r in got] == [(i, i % 4, *((1.0, 1.0), (0.0, 1.0), (1.0, 0.0), (1.0, 0.0))[i % 4]) for i in range(8)] + [(8, 8, None, None)]


def test_the_audit_query_lists_the_pairs_of_its_groups(spark, tmp_path):
    texts = ["One title\nalpha beta", "One title\nalpha beta", "one title!\nalpha gamma", "One title\ndelta", "Other\nalpha", None, "Onet itle\nalpha beta"]
    spark.createDataFrame([(i, "web", "en", 9, x) for i, x in enumerate(texts)], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.seq: r for r in composites.audit_groups(spark, str(tmp_path)).collect()}
    titles, rest = [(x or "").partition("\n")[0] for x in texts], [(x or "").partition("\n")[2] for x in texts]
    words = [set(re.findall("[a-z0-9]{4,}", x.lower())) for x in titles]
    want = {(a, b): (round(likeness(titles[a], titles[b]), 3), round(len(words[a] & words[b]) / len(words[a] | words[b]), 3), round(cosine(rest[a], rest[b]), 3)) for a, b in combinations((0, 2, 3, 6), 2)}
    assert set(got) == {0, 1, 2, 3, 6} and got[1].like == 0 and got[1].pairs is None and (got[0].same_author_overlap, got[0].same_abstract_cosine) == (1.0, 1.0)
    assert {(r.seq, p.other): (p.title_sim, p.author_overlap, p.abstract_cosine) for r in got.values() for p in r.pairs or []} == want and want[0, 6][0] < 1


# ---------------------------------------------------------------- collection


def hit(seq, source, term, arxiv="", version="", paper="", title="T", venue="", abstract="", url="", doi="", ext=""):
    return (seq, source, term, arxiv, version, paper, title, "A", "2020", venue, abstract, url, doi, ext)


def test_hits_merge_field_by_field(spark):
    hits = [
        hit(1, "semantic_scholar", "long words", "1", "", "s1", "One", "arXiv", "", "u1", "", "{}"),
        hit(2, "arxiv", "words", "1", "v2", "", "One again", "arXiv", "abs", "u2"),
        hit(3, "semantic_scholar", "other", "1", "", "s1", "One", "ACL", "late", "u3", "d", "{x}"),
        hit(4, "semantic_scholar", "other", "", "", "s2", "Two", "arXiv.org"),
        hit(5, "semantic_scholar", "more", "", "", "s2", "Two", "ACL", "late"),
        hit(6, "semantic_scholar", "more", "", "", "s3", ""),
    ]
    got = {r.key: r for r in collect.merge_hits(spark.createDataFrame(hits, collect.HITS)).collect()}
    one, two = got["s2:s1"], got["s2:s2"]
    assert set(got) == {"s2:s1", "s2:s2"}
    assert (one.found_by, one.version, one.abstract, one.url, one.venue, one.doi, one.external_ids, one.title) == ("long words; other", "v2", "abs", "u1", "ACL", "d", "{}", "One")
    assert (two.found_by, two.venue, two.abstract) == ("other; more", "arXiv.org", "")


def test_pages_end_where_they_are_short(spark):
    df = spark.createDataFrame([("q", 0, 3, [1, 2, 3], 5), ("q", 3, 3, [4], 5), ("q", 6, 3, [9], 5), ("r", 0, 3, [], 0)], "query string, start int, asked int, entries array<int>, total int")
    assert [r.entry for r in collect.paged(df).orderBy("place").collect()] == [1, 2, 3, 4]
    assert [r.entry for r in collect.paged(df, total="total", most=2).orderBy("place").collect()] == [1, 2]


def test_cache_and_ids(spark):
    asked = spark.createDataFrame([("q", 0), ("q", 100)], "query string, start int")
    key = asked.select(records.request_key(F.col("query"), F.col("start").cast("string")).alias("key")).first().key
    assert [r.start for r in collect.cache_misses(asked, spark.createDataFrame([(key, "x")], "key string, body string"), ["query", "start"]).collect()] == [100]
    fetched = spark.createDataFrame([("b", "B"), ("a", "A"), ("z", "Z")], "arxiv_id string, title string")
    assert {r.title for r in collect.by_ids(spark.createDataFrame([("a",), ("b",)], "arxiv_id string"), fetched).collect()} == {"A", "B"}


def test_default_vetoes_name_terms_in_the_lists_order(spark):
    df = spark.createDataFrame([(1, "x", "genomic and molecular"), (2, "x", "midi and automatic speech recognition"), (3, "treebank", "word segmentation in dependency parsing"), (4, "x", "subword segmentation, treebank")], "id int, title string, abstract string")
    got = {r.id: r.reason for r in relevance.decide(df).collect()}
    assert got[1].startswith("veto:domain-hard: molecular, genom (")
    assert got[2].startswith("veto:domain-soft: speech recognition, automatic speech recognition, midi (")
    assert got[3].startswith("veto:classic-pipeline: dependency parsing, treebank, word segmentation (") and not got[4].startswith("veto")


# ---------------------------------------------------------------- parsing


def test_fetch_falls_back_in_order(spark):
    rows = spark.createDataFrame([("k1", "arxiv", "1", "", None), ("k2", "acl_anthology", "", "http://a/x/", None), ("k3", "semantic_scholar", "", "", "http://o"), ("k4", "semantic_scholar", "", "", None)], "key string, source string, arxiv_id string, source_url string, open_url string")
    answers = {"https://arxiv.org/html/1": (200, b"x" * 499), "https://arxiv.org/pdf/1": (200, b"x" * 1000), "http://a/x.pdf": (200, b"%PDF-" + b"x" * 995), "http://o": (200, b"x" * 5000)}
    got = {r.key: (r.method, r.status) for r in parse.fetch(rows, answers.get).collect()}
    assert got == {"k1": ("arxiv_pdf", "ok"), "k2": ("acl_pdf", "ok"), "k3": ("none", "abstract_only"), "k4": ("none", "abstract_only")}


def test_parse_run(spark):
    long = "<article><h2>1 Self-attention</h2><p>" + "word " * 400 + "</p><h2>References</h2><p>gone</p></article>"
    rows = spark.createDataFrame([(1, "k1", "arxiv", "T", "2020", "V", "abstract", "grp0001", True), (2, "k2", "arxiv", "T", "2020", "V", "only this", "", True), (3, "k3", "arxiv", "T", "2020", "V", "", "", True), (4, "k4", "arxiv", "T", "2020", "V", "x", "", False)], "seq long, key string, source string, title string, year string, venue string, abstract string, group_id string, included boolean")
    raw = spark.createDataFrame([("k1", "arxiv_html", "ok", "/r/k1.html", long), ("k2", "arxiv_html", "ok", "/r/k2.html", "<p>short</p>")], "key string, method string, status string, path string, html string")
    made = parse.run(rows, raw)
    assert made.report == {"total_rows": 3, "by_fetch_method": {"arxiv_html": 2, "none": 1}, "full_text_parsed": 1, "abstract_only": 1, "no_text_not_indexed": 1, "total_chunks": 3}
    assert {r.key: (r.parse_status, r.indexed) for r in made.status.collect()} == {"k1": ("full_text", "yes"), "k2": ("abstract_only", "yes"), "k3": ("no_text_not_indexed", "no")}
    chunks = {(r.paper_id, r.chunk_index): r for r in made.chunks.collect()}
    assert chunks["k1", 0].canonical_paper_id == "grp0001" and chunks["k1", 1].section_title == "Self-attention" and chunks["k2", 0].text == "only this" and chunks["k2", 0].abstract_only
    assert parse.run(rows, raw, limit=1).report["total_rows"] == 1


def test_kinds_of_files(spark):
    assert [r.k for r in spark.createDataFrame([("a.html",), ("b.pdf",)], "p string").select(parse.source_kind(F.col("p")).alias("k")).collect()] == ["html", "pdf"]
    with pytest.raises(Exception, match="unsupported"):
        spark.createDataFrame([("a.txt",)], "p string").select(parse.source_kind(F.col("p"))).collect()


# ---------------------------------------------------------------- evaluation and chat

TEXTS = ["the merge rules of byte pairs are learned from counts", "vocabulary size matters for rare words", "numbers are split into digits by some tokenizers", "characters need no vocabulary at all"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, f"p{i}", f"g{i % 3}", f"Title {i}", "2020", "Sec", x) for i, x in enumerate(TEXTS)], "chunk_id long, paper_id string, group_id string, title string, year string, section string, text string")


@pytest.fixture(scope="module")
def hybrid(corpus):
    vectors = retrieval.embed(corpus, retrieval.hash_encoder, kind="array<double>").select("chunk_id", "embedding")
    return search.Hybrid(search.Dense(vectors, retrieval.hash_encoder), search.Lexical(retrieval.lexical_index(corpus)))


def questions_of(spark, rows):
    told = [(i, f"{q}", kind, conv, turn, [{"question": p, "answer": ""}] if p else [], [{"paper_title": "", "group_id": g, "section": "", "supporting_span": s}] if g else [], False, "", rewrite) for i, q, kind, conv, turn, p, g, s, rewrite in rows]
    return spark.createDataFrame(told, records.QUESTIONS).withColumn("seq", F.monotonically_increasing_id())


QUESTIONS = [
    ("q1", "how are merge rules of byte pairs learned", "specific", None, 1, None, "g0", "learned from counts", None),
    ("q2", "what of numbers", "unanswerable", None, 1, None, None, None, None),
    ("q3", "and their digits", "follow_up", "c1", 2, "how are merge rules of byte pairs learned", "g2", "split into digits", "numbers split into digits"),
    ("q4", "lost", "follow_up", "c2", 2, "never asked", "g2", "x", None),
]


def test_evaluation_leaves_out_what_has_no_answer(spark, corpus, hybrid):
    questions = questions_of(spark, QUESTIONS[:3])
    per = {r.query_id: r for r in search.evaluate(hybrid, corpus, questions, k=2, use_rewrite=True).collect()}
    assert set(per) == {"q1", "q3"} and per["q1"].recall == 1.0 and per["q1"].rr == 1.0 and per["q3"].hit
    report = search.report(hybrid, corpus, questions, k=2, mode="new", use_rewrite=True)
    assert report["overall"]["n"] == 2 and set(report["by_type"]) == {"specific", "follow_up"} and report["overall"]["recall_at_k"] == 1.0


def test_vectors_are_built_on(spark, corpus, tmp_path):
    path = (tmp_path / "index").as_uri()
    first = search.build_vectors(corpus.where("chunk_id < 2"), retrieval.hash_encoder, path)
    again = search.build_vectors(corpus, retrieval.hash_encoder, path, slices=3)
    assert (first["n_chunks"], again["n_chunks"], again["n_new"], again["dim"]) == (2, 4, 2, 64)
    assert search.load_vectors(spark, path).count() == 4 and search.load_vectors(spark, (tmp_path / "none").as_uri()) is None
    assert search.index_name("org/bge-small-en") == "bge_small_en"


def test_chat_evaluation(spark, corpus, hybrid):
    seen = []

    def provider(messages):
        content = messages[-1]["content"]
        if "Standalone question:" in content:
            return '"numbers split into digits"'
        if content.startswith(chat.JUDGE):
            return "GROUNDED\nyes"
        if "what of numbers" in content:
            return "The corpus does not contain it."
        return chat.extractive(messages)

    made = chat.evaluate(questions_of(spark, QUESTIONS), hybrid, corpus, provider, k=2)
    log = {r.query_id: r for r in made.log.collect()}
    assert set(log) == {"q1", "q2", "q3"} and log["q3"].standalone == "numbers split into digits" and log["q1"].standalone == QUESTIONS[0][1]
    assert log["q2"].abstained and log["q2"].abstain_reason == "model_self_assessment" and not log["q1"].abstained and list(log["q1"].cited) == [1]
    (s,) = made.summary.collect()
    assert (s.n, s.n_answered, s.groundedness_rate, s.citation_rate, s.tp, s.fp, s.fn, s.tn) == (3, 2, 1.0, 1.0, 1, 0, 0, 2)
    (f,) = made.followups.collect()
    assert (f.query_id, f.recall_system, f.recall_gold) == ("q3", 1.0, 1.0)
    assert not seen


def test_asking_once_more():
    answers = iter(["I cannot answer.", "Yes [1]."])
    assert chat.asked_twice(lambda m: next(answers))([], 1) == "Yes [1]."
    answers = iter(["I cannot answer [7].", "no information"])
    assert chat.asked_twice(lambda m: next(answers))([], 1) == "I cannot answer [7]."
    assert chat.asked_twice(lambda m: "cannot answer all, but [1]")([], 1).endswith("[1]")


def test_answers_outlive_the_process(tmp_path):
    calls = []
    make = lambda: chat.Cached(lambda m: calls.append(1) or "ok", folder=tmp_path.as_uri())
    assert make()([{"role": "user", "content": "x"}]) == make()([{"role": "user", "content": "x"}]) == "ok" and len(calls) == 1
    assert make().fresh([{"role": "user", "content": "x"}]) == "ok" and len(calls) == 2


def test_one_turn(spark, corpus, hybrid, tmp_path):
    made = chat.ask("merge rules of byte pairs", hybrid, corpus, chat.extractive, k=2)
    assert made["answer"].endswith("[1].") and made["sources"][0]["paper_id"] == "p0" and not made["abstained"]
    log = spark.createDataFrame([("q", "a", [1])], "query_id string, answer string, cited array<int>")
    chat.write_log(log, (tmp_path / "log").as_uri())
    (file,) = (tmp_path / "log").glob("part-*")
    assert json.loads(file.read_text()) == {"query_id": "q", "answer": "a", "cited": [1]}


def test_collapse_takes_the_canonical_copy(spark, corpus, hybrid):
    copies = spark.createDataFrame([(1, "a", "g", "one two three four five six"), (2, "b", "g", "one two three four five six"), (3, "c", "g", "seven eight nine ten")], "chunk_id long, paper_id string, group_id string, text string")
    ranked = spark.createDataFrame([(1, 1, 0.5, 1), (1, 2, 0.4, 2), (1, 3, 0.3, 3)], "query_id long, chunk_id long, score double, rank int")
    papers = spark.createDataFrame([("g", "b", False)], "group_id string, canonical_id string, is_survey boolean")
    assert [r.chunk_id for r in search.shown(ranked, copies, 5, "new", papers).orderBy("position").collect()] == [2, 3]
    assert [r.chunk_id for r in search.shown(ranked, copies, 5, "none").orderBy("position").collect()] == [1, 2, 3]
    assert evaluation.summary(spark.createDataFrame([], "type string, recall double"), "type", ["recall"]).count() <= 1


# ---------------------------------------------------------------- command line


def test_commands_from_hits_to_evaluation(spark, tmp_path, capsys, monkeypatch):
    from quern import __main__ as cli

    monkeypatch.setattr(cli, "session", lambda master: spark)
    root = tmp_path.as_uri()
    hits = [hit(i, "arxiv", "words", str(i), "v1", "", f"Tokenizer-free models {i}", "arXiv", "A tokenizer for merge rules of a language model. " + TEXTS[i % 4]) for i in range(1, 5)] + [hit(9, "arxiv", "words", "9", "v1", "", "Whales")]
    spark.createDataFrame(hits, collect.HITS).write.parquet(f"{root}/raw/hits")
    spark.createDataFrame([("arxiv__1v1", "arxiv_html", "ok", "/r/1.html", "<article><h2>Method</h2><p>" + TEXTS[0] * 9 + "</p></article>")], "key string, method string, status string, path string, html string").write.parquet(f"{root}/raw/documents")
    (tmp_path / "eval").mkdir()
    (tmp_path / "eval" / "questions.jsonl").write_text(json.dumps({"id": "q1", "question": "merge rules of byte pairs", "type": "specific", "prior_turns": [], "gold": [{"paper_title": "", "group_id": "arxiv__1v1", "section": "", "supporting_span": "learned from counts"}]}) + "\n")
    out = {}
    for command in (["collect"], ["parse"], ["index"], ["index", "--model", "bm25"], ["dedup"], ["eval", "--retrieval", "hybrid", "--diversify"], ["eval", "--retrieval", "bm25"], ["eval"]):
        capsys.readouterr()
        assert cli.main([*command, "--root", root]) == 0
        out[" ".join(command)] = json.loads(capsys.readouterr().out)
    assert out["collect"]["candidates"] == 5 and out["collect"]["included"] == 4
    assert out["parse"]["full_text_parsed"] == 1 and out["parse"]["abstract_only"] == 3
    assert out["index"]["n_chunks"] == out["index --model bm25"]["n_chunks"] == 4
    assert out["dedup"]["n_near_miss_pairs"] == 0 and out["eval --retrieval hybrid --diversify"]["overall"]["recall_at_k"] == out["eval --retrieval bm25"]["overall"]["recall_at_k"] == out["eval"]["overall"]["recall_at_k"] == 1.0
    answers = iter(["merge rules of byte pairs", "exit"])
    monkeypatch.setattr("builtins.input", lambda _: next(answers))
    capsys.readouterr()
    assert cli.main(["chat", "--root", root]) == 0 and "Sources:" in capsys.readouterr().out
    assert cli.main(["run", "no such", root]) == 2


# ---------------------------------------------------------------- PDF files


def pdf_of(pages, packed):
    """A file with (text, size, bold) lines on each page, drawn from the top down."""
    import zlib

    bodies = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{5 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>"]
    for i, lines in enumerate(pages):
        drawn = "\n".join(f"BT /{'F2' if bold else 'F1'} {size} Tf 1 0 0 1 72 {720 - 20 * j} Tm ({text}) Tj ET" for j, (text, size, bold) in enumerate(lines)).encode()
        data = zlib.compress(drawn) if packed else drawn
        bodies.append(f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents {6 + 2 * i} 0 R >>")
        bodies.append(f"<< /Length {len(data)} {'/Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + data + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(f"{i} 0 obj\n".encode() + (b if isinstance(b, bytes) else b.encode()) + b"\nendobj\n" for i, b in enumerate(bodies, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("packed", [False, True])
def test_sections_of_pdf_files(spark, packed):
    from quern.operators import extraction
    from quern.sources import pdf

    head = ("Journal of Tokens", 9, False)
    pages = [[head, ("1 Introduction", 14, True), ("We look \\(closely\\) at", 11, False), ("merge rules.", 11, False)], [head, ("2 Method", 14, True), ("Counts are kept.", 11, False)], [head, ("More is said.", 11, False), ("References", 14, True), ("Nobody 2020.", 11, False)]]
    files = spark.createDataFrame([("a", bytearray(pdf_of(pages, packed))), ("b", bytearray(b"no pdf")), ("c", None)], "doc string, content binary")
    lines = pdf.page_lines(files)
    first = [(r.text, r.size, r.bold) for r in lines.where("page = 0").orderBy("line").collect()]
    assert first == [("Journal of Tokens", 9.0, False), ("1 Introduction", 14.0, True), ("We look (closely) at", 11.0, False), ("merge rules.", 11.0, False)]
    got = [(r.heading, r.text) for r in extraction.line_sections(lines).orderBy("sec_idx").collect()]
    assert got == [("Introduction", "We look (closely) at merge rules."), ("Method", "Counts are kept. More is said.")]
    docs = spark.createDataFrame([("a", "/r/a.pdf", None), ("h", "/r/h.html", "<p>some text</p>")], "doc string, path string, html string")
    assert {r.doc for r in parse.extract_sections(docs, lines).collect()} == {"a", "h"}


def test_pieces_of_a_pdf_line():
    from quern.sources import pdf

    table = "beginbfchar <01> <0041> <02> <00E9> endbfchar"
    content = "BT /F1 2 Tf 5 0 0 5 10 700 Tm [(ab) -300 (cd)] TJ 0 -3 TD <0102> Tj T* (x\\\\\\)\\101) Tj ET"
    data = f"1 0 obj << /Type /Page /Resources << /Font << /F1 2 0 R >> >> /Contents [3 0 R] >> endobj 2 0 obj << /BaseFont /X /ToUnicode 4 0 R >> endobj 3 0 obj << >> stream\n{content}\nendstream endobj 4 0 obj << >> stream\n{table}\nendstream endobj".encode()
    assert pdf.read_lines(data) == [(0, 0, "ab cd", 10.0, False), (0, 1, "Aé", 10.0, False), (0, 2, "x\\)A", 10.0, False)]


def test_downloads_happen_once(spark, tmp_path):
    calls = []
    get = lambda url: calls.append(url) or (200, b"bulk")
    path = (tmp_path / "bulk").as_uri()
    assert parse.download_once(spark, "u", path, get) and not parse.download_once(spark, "u", path, get) and calls == ["u"]
    assert (tmp_path / "bulk").read_bytes() == b"bulk"
    with pytest.raises(OSError):
        parse.download_once(spark, "u", path + "2", lambda url: (404, b""))
