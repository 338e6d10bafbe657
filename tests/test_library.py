"""The library's own operators on small inline cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators import evaluation, extraction, linking, relevance, retrieval
from quern.plans import chat
from quern.sources import records


def values(spark, column_of, *args):
    """Evaluates an expression over one row of string columns a, b, ..."""
    names = "abcdefg"[: len(args)]
    df = spark.createDataFrame([args], ", ".join(f"{n} {'double' if isinstance(x, float) else 'int' if isinstance(x, int) else 'string'}" for n, x in zip(names, args)))
    return df.select(column_of(*[F.col(n) for n in names]).alias("v")).first()["v"]


# ---------------------------------------------------------------- text


def test_text_functions(spark):
    v = lambda f, *a: values(spark, f, *a)
    assert v(t.collapse_space, " a \n\t b ") == "a b"
    assert v(t.title_key, "BPE-Drop: A (new) Way!") == "bpedropanewway"
    assert v(t.title_words, "BPE-Drop:  A Way!") == "bpedrop a way"
    assert v(t.surnames, "Smith, J.; Ana de la Cruz;; van Ek") == ["smith", "cruz", "van"]
    assert v(t.shingles, "a b c d a b c") == ["a b c", "b c d", "c d a", "d a b"]
    assert v(t.shingles, "one two") == ["one two"] and v(t.shingles, "  ") == []
    assert v(t.section_label, "3.1 Method & Data") == "method  data"
    assert v(lambda x: t.file_key(x, x), "a/b c") == "a_b_c__a_b_c"
    assert v(t.cited_numbers, "x [2] 【1】 y 【3†L1-L4】 [2] [a]") == [1, 2, 3]
    assert v(lambda a, b: t.jaccard(t.surnames(a), t.surnames(b)), "A Doe; B Smith", "C Doe; D Brown") == pytest.approx(1 / 3)
    assert v(lambda a, b: t.jaccard(t.surnames(a), t.surnames(b)), "", "C Doe") == 0.0
    assert v(t.first_line, "a\nb\nc") == "a" and v(t.after_first_line, "a\nb\nc") == "b\nc" and v(t.after_first_line, "a") == ""


# ---------------------------------------------------------------- relevance


def decided(spark, title, abstract=""):
    df = spark.createDataFrame([(title, abstract)], "title string, abstract string")
    return relevance.decide(df).first()


def test_relevance(spark):
    assert decided(spark, "Gardening in spring").relevance_score == 0.0
    core = decided(spark, "Subword regularization for sentencepiece", "We study vocabulary size and wordpiece tokenization of a large language model.")
    assert core.included and core.relevance_score >= 10
    assert decided(spark, "Tokenization of dna sequence data", "language model sentencepiece").reason.startswith("veto:domain-hard: dna sequence")
    assert decided(spark, "BPE for symbolic music").reason.startswith("veto:domain-soft: symbolic music")
    assert decided(spark, "BPE for symbolic music", "a language model").included
    assert decided(spark, "Chinese tokenizers", "word segmentation by characters").reason.startswith("veto:classic-pipeline: word segmentation")
    assert not decided(spark, "Tokenizer", "subword segmentation").reason.startswith("veto")
    low = decided(spark, "On text", "bpe")
    assert not low.included and low.reason == "relevance_score=0.5 < 3.0 (below topic-boundary threshold)"
    assert decided(spark, None, None).relevance_score == 0.0


def test_surveys(spark):
    flag = lambda a, b: values(spark, lambda x, y: relevance.is_survey(x, y), a, b)
    assert flag("A Survey of Tokenizers", "") and flag("Tokens", "In this survey we look") and flag("x", "we provide a comprehensive overview")
    assert not flag("Surveying land", "we measure") and not flag("", "")


# ---------------------------------------------------------------- linking


def test_links(spark):
    rows = spark.createDataFrame([(1, "A Title!"), (2, "other"), (3, "a title"), (4, "A-TITLE"), (5, "!!"), (6, "??"), (7, "Other")], "pos int, title string")
    got = {r.pos: r.group_id for r in linking.link_groups(rows, F.col("title"), "pos").collect()}
    assert got == {1: "grp0001", 3: "grp0001", 4: "grp0001", 2: "grp0002", 7: "grp0002", 5: "", 6: ""}


def test_merge_first_wins(spark):
    rows = spark.createDataFrame([("x", 1, "", "a", "q1"), ("x", 2, "v", "b", "q2"), ("x", 3, "w", "c", "q1"), ("y", 4, "", "", "q1")], "key string, seq int, venue string, url string, term string")
    got = {r.key: (r.venue, r.url, r.term) for r in linking.merge_first_wins(rows, "key", "seq", ["venue", "url"], "term").collect()}
    assert got == {"x": ("v", "a", "q1; q2"), "y": (None, None, "q1")}


def test_canonical(spark):
    rows = spark.createDataFrame([("k1", "g", "arxiv", 1, 1), ("k2", "g", "arxiv", 3, 2), ("k3", "g", "semantic_scholar", 0, 3), ("k4", "", "arxiv", 0, 4), ("k5", "h", "arxiv", 0, 5), ("k6", "h", "acl_anthology", 0, 6)], "key string, g string, source string, version int, pos int")
    got = {r.key: r.canonical_id for r in linking.canonical(rows, "g", F.col("key"), linking.priority(F.col("source")), F.col("version"), F.col("pos")).collect()}
    assert got == {"k1": "k2", "k2": "k2", "k3": "k2", "k4": "k4", "k5": "k6", "k6": "k6"}


def test_fuzzy_titles(spark):
    rows = spark.createDataFrame(
        [(1, "Byte Pair Encoding is Suboptimal", "Ann Bostrom; Greg Durrett", "2020"), (2, "Byte pair encoding is sub-optimal", "A Bostrom; G Durrett", "2021"), (3, "Byte pair encoding is suboptimal", "A Bostrom; G Durrett", "2030"), (4, "Proceedings of the byte pair", "A Bostrom; G Durrett", "2020"), (5, "Something else altogether", "A Bostrom; G Durrett", "2020"), (6, "Byte pair encoding is suboptimal", "Other Person", "")],
        "id int, title string, authors string, year string",
    )
    got = {(r.a, r.b) for r in linking.fuzzy_title_pairs(rows, id_col="id", title_col="title", authors_col="authors", year_col="year").collect()}
    assert got == {(1, 2)}


def test_block_limit(spark):
    rows = spark.createDataFrame([(i, ["common", f"w{i // 2}"]) for i in range(10)], "id int, b array<string>")
    assert linking.blocked_pairs(rows, "id", F.col("b"), 5).count() == 5
    assert linking.blocked_pairs(rows, "id", F.col("b")).count() == 45


def test_merges_in_order():
    assert linking.apply_merges([("a", "b"), ("c", "d"), ("b", "c")], {}) == {"a": "grp0001", "b": "grp0001", "c": "grp0002", "d": "grp0002"}
    assert linking.apply_merges([("x", "a")], {"a": "grp0007"}) == {"a": "grp0007", "x": "grp0007"}


def test_shingle_pairs(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words[:-1], "zz"])), (4, " ".join(words[:40])), (5, "a b"), (6, "a b"), (7, "")]
    rows = spark.createDataFrame(texts, "id int, text string")
    got = {(r.a, r.b): r for r in linking.same_shingle_pairs(rows, id_col="id", text_col="text", least=0.9).collect()}
    # equal texts are one, under their least id
    assert set(got) == {(1, 3)} and (got[1, 3].n_a, got[1, 3].n_b) == (2, 1) and got[1, 3].similarity == pytest.approx(57 / 59)


# ---------------------------------------------------------------- chunks


def test_chunks(spark):
    df = spark.createDataFrame([(1, 0, " ".join(f"w{i}" for i in range(100))), (1, 1, "short"), (2, 0, "  ")], "doc int, sec int, text string")
    got = retrieval.chunk_words(df, keys=["doc", "sec"], text_col="text", target=40, overlap=10).orderBy("doc", "sec", "chunk_index").collect()
    assert [(r.doc, r.sec, r.chunk_index) for r in got] == [(1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 1, 0)]
    assert got[0].text.split()[-10:] == got[1].text.split()[:10] and got[2].text.split()[-1] == "w99"


def test_token_cap_loses_nothing(spark):
    df = spark.createDataFrame([(1, 0, " ".join(f"w{i}" for i in range(50))), (1, 1, "one")], "doc int, chunk_index int, text string")
    got = retrieval.cap_tokens(df, keys=["doc"], count=lambda s: 3 * len(s.split()), most=30).orderBy("chunk_index").collect()
    assert " ".join(r.text for r in got).split() == [f"w{i}" for i in range(50)] + ["one"]
    assert all(len(r.text.split()) <= 10 for r in got) and [r.chunk_index for r in got] == list(range(len(got)))


# ---------------------------------------------------------------- retrieval


def plain_bm25(corpus, query):
    docs = [d.lower().split() for d in corpus]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {w: sum(w in d for d in docs) for d in docs for w in d}
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
    return [sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in query.split()) for d in docs]


def test_bm25(spark, tmp_path):
    corpus = ["the cat sat on the mat", "the dog and the cat", "the bird", "fish the swim the sea the", "dog dog dog the"]
    chunks = spark.createDataFrame(list(enumerate(corpus)), "chunk_id int, text string")
    queries = spark.createDataFrame([(1, "the cat dog dog"), (2, "bird"), (3, "nothing")], "query_id int, text string")
    index = retrieval.lexical_index(chunks)
    index.save(str(tmp_path / "index"))
    for ix in (index, retrieval.LexicalIndex.load(spark, str(tmp_path / "index"))):
        got = {(r.query_id, r.chunk_id): (r.score, r["rank"]) for r in retrieval.lexical_search(ix, queries, 10).collect()}
        want = plain_bm25(corpus, "the cat dog dog")
        assert all(got[1, i][0] == pytest.approx(s) for i, s in enumerate(want) if (1, i) in got) and len([k for k in got if k[0] == 1]) == 5
        assert got[1, max(range(5), key=lambda i: want[i])][1] == 1
    filled = retrieval.lexical_search(index, queries, 3, fill_zero=True).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.score > 0) for r in filled if r.query_id != 1] == [(2, 2, True), (2, 0, False), (2, 1, False), (3, 0, False), (3, 1, False), (3, 2, False)]


def test_vectors(spark):
    vectors = spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.0]) for i in range(40)] + [(99, None)], "chunk_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.5])], "query_id long, embedding array<double>")
    for block in (1, 1024):
        got = {}
        for r in retrieval.vector_search(vectors, queries, 4, block_rows=block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.score))
        assert sorted(got[1]) == [(n, c, 2.0) for n, c in enumerate([2, 5, 8, 11], 1)]
        assert sorted(got[2]) == [(n, c, 4.5) for n, c in enumerate([4, 9, 14, 19], 1)]
    assert retrieval.vector_search(vectors, queries.limit(0), 3).count() == 0


def test_embed_and_encoder(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    got = {r.id: r.embedding for r in retrieval.embed(df, retrieval.hash_encoder).collect()}
    assert len(got[1]) == 64 and sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-6) and sum(got[2]) == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, chunk_id string, rank int")
    got = [(r.chunk_id, r.score) for r in retrieval.fuse([a, b], 3).orderBy("rank").collect()]
    assert got == [("y", pytest.approx(1 / 61 + 1 / 62)), ("x", pytest.approx(1 / 61)), ("z", pytest.approx(1 / 62))]
    assert retrieval.fetch_depth(5) == 50 and retrieval.fetch_depth(50) == 200


def ranking(spark, rows):
    """(chunk_id, group, text, canonical, survey) in rank order."""
    df = spark.createDataFrame([(1, i, c, g, x, k, s) for i, (c, g, x, k, s) in enumerate(rows, 1)], "query_id int, rank int, chunk_id string, group_id string, text string, is_canonical boolean, is_survey boolean")
    return df.withColumn("shingles", t.shingles(F.col("text")))


def order(df):
    return [r.chunk_id for r in df.orderBy("position").collect()]


def test_diversify(spark):
    same, other = "one two three four five six seven", "a b c d e f g"
    ranked = ranking(spark, [("a1", "A", same, False, False), ("s1", "S", other, False, True), ("b1", "B", same, False, False), ("a2", "A", same, True, False), ("a3", "A", other, False, False), ("a4", "A", "other words here now", False, False), ("c1", "C", same, False, False)])
    assert order(retrieval.diversify(ranked, 5, "none")) == ["a1", "s1", "b1", "a2", "a3"]
    assert order(retrieval.diversify(ranked, 5, "cap1_naive", demoted="is_survey")) == ["a1", "b1", "c1", "s1"]
    assert order(retrieval.diversify(ranked, 5, "new", demoted="is_survey")) == ["a2", "b1", "a3", "c1", "s1"]
    with pytest.raises(ValueError):
        retrieval.diversify(ranked, 5, "other")


def test_collapse_compares_with_leaders_only(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:58], "x", "y"]
    far = [*base[:56], "p", "q", "x", "y"]
    rows = ranking(spark, [("l", "A", " ".join(base), False, False), ("n", "A", " ".join(near), False, False), ("f", "A", " ".join(far), False, False)])
    kept = {r.chunk_id for r in retrieval.collapse(rows).collect()}
    assert kept == {"l", "f"}


# ---------------------------------------------------------------- evaluation


def test_hits(spark):
    hit = lambda a, b: values(spark, lambda x, y: evaluation.is_hit(x, y), a, b)
    assert hit("We got 1,234 tokens.", "1234 tokens") and hit("alpha beta gamma delta words", "alpha beta gamma missing")
    assert not hit("alpha beta", "gamma delta epsilon") and not hit("", "x") and not hit("x", "") and not hit("abc", "??")


def test_metrics(spark):
    got = spark.createDataFrame([(1, "A", 1, "nothing"), (1, "B", 2, "the span of words"), (2, "A", 1, "x")], "query_id int, group_id string, position int, text string")
    gold = spark.createDataFrame([(1, "B", 0, "the span of words"), (1, "C", 1, "lost"), (2, "A", 0, "unfound"), (3, "A", 0, "never asked")], "query_id int, group_id string, gold_no int, span string")
    per = evaluation.ranking_metrics(got, gold, 5)
    assert {r.query_id: (r.recall, r.rr) for r in per.collect()} == {1: (0.5, 0.5), 2: (0.0, 0.0), 3: (0.0, 0.0)}
    total = {r.kind: (r.n, r.mean_recall) for r in evaluation.summary(per.withColumn("kind", F.lit("k")), "kind", ["recall"]).collect()}
    assert total == {"k": (3, pytest.approx(1 / 6)), "overall": (3, pytest.approx(1 / 6))}
    shares = spark.createDataFrame([(1, g, i, str(i)) for i, g in enumerate("AAABC", 1)], "query_id int, group_id string, position int, chunk_id string")
    assert evaluation.same_group_share(shares, 5).first().same_group_share == pytest.approx(2 / 5)
    copies = shares.withColumn("shingles", F.array(F.lit("same")))
    assert evaluation.redundant_rate(copies, 5).first().redundant_rate == pytest.approx(2 / 5)


def test_latency(spark):
    df = spark.createDataFrame([(float(x),) for x in (3, 1, 4, 2)] + [(None,)], "v double")
    r = evaluation.latency(df, "v").first()
    assert (r.n, r.mean, r.p50, r.p95) == (4, 2.5, 3.0, 4.0)


def test_bootstrap(spark):
    a = spark.createDataFrame([(i, 1.0 if i % 4 else 0.0) for i in range(20)], "query_id int, recall double")
    b = spark.createDataFrame([(i, 0.0) for i in range(20)], "query_id int, recall double")
    clear = evaluation.paired_bootstrap(a, b, resamples=200).first()
    assert clear.significant and clear.n == 20 and clear.ci_low <= clear.mean_diff <= clear.ci_high and clear.mean_diff == pytest.approx(0.75)
    assert evaluation.paired_bootstrap(a, b, resamples=200, most_sent=0).first() == clear
    same = evaluation.paired_bootstrap(a, a, resamples=200).first()
    assert not same.significant and same.mean_diff == 0.0
    with pytest.raises(Exception, match="different queries"):
        evaluation.paired_bootstrap(a, b.where("query_id > 0"), resamples=50).collect()


def test_answers(spark):
    used = lambda a: values(spark, lambda x: evaluation.used_citations(x, F.lit(3)), a)
    assert used("as [1] and [1]") == [1] and used("【2】") == [2] and used("【3†L1-L4】") == [3] and used("[4] [0]") == [] and used("") == []
    gone = lambda s, a: values(spark, lambda x, y: evaluation.abstained(x, y, F.lit(3)), s, a)
    assert gone(0.01, "fine [1]") and gone(0.5, "The corpus doesn't contain it.") and not gone(0.5, "It cannot answer that part, but [1].") and not gone(0.5, "yes")
    assert values(spark, evaluation.grounded, "grounded: yes\nno") and not values(spark, evaluation.grounded, "not grounded")
    c = evaluation.confusion(spark.createDataFrame([(True, True), (True, False), (False, False)], "p boolean, a boolean"), F.col("p"), F.col("a")).first()
    assert (c.tp, c.fp, c.fn, c.tn, c.precision, c.recall) == (1, 1, 0, 1, 0.5, 1.0)
    none = evaluation.confusion(spark.createDataFrame([(False, False)], "p boolean, a boolean"), F.col("p"), F.col("a")).first()
    assert none.precision is None and none.recall is None


# ---------------------------------------------------------------- extraction


def test_html():
    page = "<html><body><p>out</p><article><h1>1. Intro</h1><p>a <b>b</b><p>c<script>var x='</p>'</script></p><ul><li><p>x</p></li></ul><h2>2 Data</h2><figcaption>cap</figcaption><h2>References</h2><p>gone</p></article></body></html>"
    body = page[page.index("<article") : page.index("</article")]
    assert extraction.sections_of(body) == [("Intro", "a b c x"), ("Data", "cap")]
    assert extraction.sections_of("<p>first</p>") == [("Abstract", "first")] and extraction.sections_of("") == []


def test_references_end_with_a_semicolon():
    page = "<h1>R&amp;D &#39;x&#x27; cut &amp</h1><p>&lt;b&gt; &quot &ampx; &amp;amp; &eacute; &nosuch; a&b & &#; &am</p>"
    assert extraction.sections_of(page) == [("R&D 'x' cut &amp", "<b> &quot &ampx; &amp; é &nosuch; a&b & &#; &am")]


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "<body><p>out</p><article><p>in &amp; on</p>"), (2, None), (3, "<body><p>only</p></body>")], "page_id int, html string")
    assert {(r.page_id, r.heading, r.text) for r in extraction.html_sections(pages, keys=["page_id"]).collect()} == {(1, "Abstract", "in & on"), (3, "Abstract", "only")}


def test_page_lines(spark):
    rows = []
    for page in range(4):
        rows.append((1, page, 0, "Proceedings of a Venue", 9.0, False))
        rows.append((1, page, 1, "Running Header", 9.0, False))
    rows += [(1, 0, 2, "opening words here in the text", 11.0, False), (1, 1, 2, "3 Method", 11.0, True), (1, 1, 3, "we do things in many words", 11.0, False), (1, 2, 2, "Results", 11.0, False), (1, 2, 3, "numbers went up by a lot", 11.0, False), (1, 3, 2, "References", 11.0, False), (1, 3, 3, "someone 2020", 11.0, False)]
    lines = spark.createDataFrame(rows, "doc int, page int, line int, text string, size double, bold boolean")
    assert extraction.body_size(extraction.strip_repeated(lines)).first().body == 11.0
    got = [(r.heading, r.text) for r in extraction.line_sections(lines).orderBy("sec_idx").collect()]
    assert got == [("Abstract", "opening words here in the text"), ("Method", "we do things in many words"), ("Results", "numbers went up by a lot")]


# ---------------------------------------------------------------- sources

BIB = """@inproceedings{key-1,
    title = "{BPE} and
      Tokens",
    author = {{\\"U}st{\\"u}n, Ahmet  and
      Smith, Bo},
    editor = "Editor, The",
    booktitle = "Proc. of X",
    year = "2020",
    abstract = "About subword units"
}
@article{key-2,
    title = "Cooking",
    author = "Cook, A",
    journal = "Food"
}
@misc{key-3,
    author = "No Title and token",
    year = "2021"
}
"""


def test_bib(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB)
    got = records.parse_bib(records.read_bib(spark, str(tmp_path / "a.bib"))).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.key, r.title, r.year, r.venue, r.abstract) == ("key-1", "BPE and Tokens", "2020", "Proc. of X", "About subword units")
    assert r.authors == ['\\"Ust\\"un, Ahmet', "Smith, Bo"]


ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2001.00001v3</id><title>A
  title</title><summary> text </summary><published>2020-01-01</published><updated>2020-02-01</updated><author><name>Ann A</name></author><author><name>Bob B</name></author><category term="cs.CL"/><link href="http://x/abs" rel="alternate"/><link title="pdf" href="http://x/pdf" rel="related"/></entry>
<entry><id>http://arxiv.org/abs/cs/0101001</id><title>B</title><summary>s</summary><published>2001</published><updated>2001</updated><author><name>C</name></author></entry></feed>"""


def test_atom(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ATOM)
    got = {r.arxiv_id: r for r in records.read_atom(spark, str(tmp_path / "a.xml")).collect()}
    a, b = got["2001.00001"], got["cs/0101001"]
    assert (a.version, a.title, a.authors, a.abstract, a.categories, a.pdf_url) == ("v3", "A title", ["Ann A", "Bob B"], "text", ["cs.CL"], "http://x/pdf")
    assert b.version == "v1" and b.pdf_url == "" and b.categories == []


def test_papers_json(spark):
    page = json.dumps({"data": [{"paperId": "p", "title": None, "year": 2020, "authors": [{"name": "A"}], "externalIds": {"DOI": "d"}, "openAccessPdf": {"url": "u"}}, {"paperId": "q"}]})
    got = {r.paper_id: r for r in records.parse_papers(spark.createDataFrame([(page,), ("{broken",)], "value string")).collect()}
    assert set(got) == {"p", "q"} and (got["p"].title, got["p"].year, got["p"].authors, got["p"].external_ids, got["p"].open_access_pdf) == ("", "2020", ["A"], {"DOI": "d"}, "u") and got["q"].authors == []


def test_manifest(spark, tmp_path):
    names = [c.split()[0] for c in records.MANIFEST.split(", ")]
    rows = [{**dict.fromkeys(names, ""), "source": "arxiv", "source_id": str(i), "title": f'T, "{i}"', "relevance_score": s, "included": inc, "rejection_reason": why, "year": y} for i, (s, inc, why, y) in enumerate([("1.5", "True", "", "2020"), ("", "0", "veto:domain-hard: x", ""), ("7", "1", "", ""), ("2", "false", "relevance_score=2.0 < 3.0 (below topic-boundary threshold)", "")])]
    spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).coalesce(1).write.csv(str(tmp_path / "m"), header=True, escape='"')
    read = records.read_manifest(spark, str(tmp_path / "m"))
    assert sorted((r.relevance_score, r.included, r.title) for r in read.collect()) == [(0.0, False, 'T, "1"'), (1.5, True, 'T, "0"'), (2.0, False, 'T, "3"'), (7.0, True, 'T, "2"')]
    s = records.manifest_summary(read)
    assert (s["candidates"], s["included"], s["unique"], s["below"]) == (4, 2, 2, 1) and s["by_year"] == [("(unknown)", 1), ("2020", 1)] and s["vetoes"] == [("domain-hard", 1)]
    assert "- included: 2" in records.summary_markdown(s)
    records.write_manifest(read, str(tmp_path / "out"))
    assert [r.relevance_score for r in records.read_manifest(spark, str(tmp_path / "out")).collect()] == [7.0, 2.0, 1.5, 0.0]
    assert records.index_size_mb(spark, str(tmp_path / "out")) >= 0


def test_fetch_plan(spark):
    rows = spark.createDataFrame([("1", True, True, "arxiv", "", ""), ("1", False, True, "arxiv", "", ""), ("", False, False, "acl_anthology", "http://a/b/", ""), ("", False, False, "x", "", "http://o"), ("", False, False, "x", "", None)], "arxiv_id string, has_html boolean, has_pdf boolean, source string, source_url string, open_url string")
    assert [(r.method, r.url) for r in records.fetch_plan(rows).collect()] == [("arxiv_html", None), ("arxiv_pdf", None), ("acl_pdf", "http://a/b.pdf"), ("s2_oa_pdf", "http://o"), ("abstract_only", None)]
    ok = spark.createDataFrame([(b"%PDF-" + b"x" * 1000, "pdf", 200), (b"x" * 2000, "pdf", 200), (b"x" * 600, "html", 200), (b"x" * 600, "html", 404)], "c binary, k string, s int").select(records.valid_content(F.col("c"), F.col("k"), F.col("s")).alias("ok")).collect()
    assert [r.ok for r in ok] == [True, False, True, False]


def test_questions(spark, tmp_path):
    q = {"id": "q1", "question": "what?", "type": "follow_up", "turn": 2, "prior_turns": [], "gold": [{"group_id": "g", "supporting_span": "s"}], "gold_standalone_rewrite": ""}
    (tmp_path / "q.jsonl").write_text(json.dumps(q) + "\n")
    df = records.read_questions(spark, str(tmp_path / "q.jsonl"))
    assert df.select(records.query_text()).first()[0] == "what?"
    assert [tuple(r) for r in records.gold_pairs(df).collect()] == [("q1", "g", 0, "s")]


def test_numbered(spark):
    df = spark.range(100).withColumn("x", 100 - F.col("id"))
    assert all(r.seq == r.x for r in records.numbered(df, ["x"]).collect())


# ---------------------------------------------------------------- chat, streams


def test_answers_of_a_provider(spark):
    ranked = spark.createDataFrame([(1, "c1", 0.03, 1, "g1", "T1", "2020", "s", "The answer is seven. More."), (1, "c2", 0.02, 2, "g2", "T2", "2021", "s", "Other"), (2, "c1", 0.001, 1, "g1", "T1", "2020", "s", "x")], "query_id int, chunk_id string, score double, rank int, group_id string, title string, year string, section string, text string")
    questions = spark.createDataFrame([(1, "how many?"), (2, "weak?"), (3, "nothing?")], "query_id int, question string")
    got = {r.query_id: (r.answer, r.cited, r.abstained) for r in chat.answer(questions, ranked, chat.extractive).collect()}
    unknown = ("The corpus doesn't contain enough information to answer this.", [], True)
    assert got == {1: ("The answer is seven [1].", [1], False), 2: unknown, 3: unknown}


def test_provider_cache():
    calls, waits = [], []

    def flaky(messages):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    p = chat.Cached(flaky, sleep=waits.append)
    assert p([{"role": "user", "content": "x"}]) == p([{"role": "user", "content": "x"}]) == "ok" and len(calls) == 3 and waits == [2.0, 4.0]


def test_rewrites(spark):
    turns = spark.createDataFrame([(1, 1, "first?", "a" * 300), (1, 2, "and then?", "b")], "conv_id int, turn int, question string, answer string")
    context = evaluation.rewrite_context(turns)
    rows = {r.turn: r.context for r in context.collect()}
    assert rows[1] is None and rows[2] == "Previous question: first?\nSummary of its answer: " + "a" * 200 + "\n"
    got = {r.turn: r.standalone for r in chat.rewrite_questions(context, lambda m: '"full question"').collect()}
    assert got == {1: "first?", 2: "full question"}
    failed = {r.turn: r.standalone for r in chat.rewrite_questions(context, lambda m: 1 / 0).collect()}
    assert failed == {1: "first?", 2: "and then?"}


def test_message_text(spark):
    df = spark.createDataFrame([('{"choices":[{"message":{"content":"hi"}}]}',), ("{}",), ("broken",)], "response string")
    assert [r.text for r in chat.message_text(df).collect()] == ["hi", "", ""]


def test_resumed_stream(spark, tmp_path):
    from quern.streaming import resume

    source = tmp_path / "in"
    source.mkdir()
    run = lambda: resume.work_on_new_files(spark, str(source), "id int, x string", str(tmp_path / "check"), lambda b: b.withColumn("n", F.length("x")), str(tmp_path / "out"), key="id")
    (source / "a.json").write_text('{"id":1,"x":"abc"}\n')
    run()
    (source / "b.json").write_text('{"id":1,"x":"abc"}\n{"id":2,"x":"z"}\n')
    run()
    assert sorted((r.id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 3), (2, 1)]
    last = resume.last_turns(spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b")], "conv_id int, turn int, text string"), columns=["text"]).first()
    assert (last.turn, last.text) == (3, "c")


def test_command_line(capsys):
    from quern.__main__ import main

    assert main(["queries"]) == 0 and "bm25_topk" in capsys.readouterr().out
    assert main(["run", "no such", "x"]) == 2


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
