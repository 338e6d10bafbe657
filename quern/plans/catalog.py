"""The queries of the library's operators over the driver's tables, each with its name.

Fixture prose is of invented words, so term lists and gold passages are
parameters of the queries; defaults live with the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import evaluation, extraction, linking, relevance, retrieval
from ..session import table
from ..sources import records
from ..storage import written
from . import search

K, DEPTH, SHOWN = 50, 200, 5

#: Lists that do occur in the fixtures.
WEIGHTS = relevance.Weights(
    terms=relevance.Terms(
        strong=("licen", "tion", "version"), weak=("heit", "ciones"), context=("the", "of", "que"), strong_context=("with", "from"), veto_hard=("password", "akia"), veto_soft=("token", "secret"), veto_classic=("copyright", "mit license"), rescue=("apache", "gnu"), classic_unless=("license", "gpl license")
    )
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the first line is the title, the rest the abstract."""
    return documents(spark, sf_dir).select("doc_id", "source", "lang", "n_chars", t.first_line(F.col("text")).alias("title"), t.after_first_line(F.col("text")).alias("abstract"))


# ---------------------------------------------------------------- relevance


def relevance_score(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", relevance.score(F.col("title"), F.col("abstract"), WEIGHTS).alias("score"))


def relevance_decide(spark, sf_dir):
    return relevance.decide(papers(spark, sf_dir), w=WEIGHTS).select("doc_id", "included", "reason")


def survey_flag(spark, sf_dir):
    flag = relevance.is_survey(F.col("title"), F.col("abstract"), "(?i)(^| )(the|und|une|los)( |$)", "(?i)(^| )(with|from|nicht)( |$)")
    return papers(spark, sf_dir).select("doc_id", flag.alias("is_survey"))


def manifest_rollup(spark, sf_dir):
    """Counts by source and language of what is included, and of vetoes by kind, in one table."""
    rows = relevance.decide(papers(spark, sf_dir), w=WEIGHTS)
    kept = rows.where("included")
    parts = [kept.groupBy(F.lit(kind).alias("kind"), F.coalesce(t.blank_to_null(F.col(c)), F.lit("(unknown)")).alias("name")).agg(F.count(F.lit(1)).alias("n")) for kind, c in (("source", "source"), ("lang", "lang"))]
    parts.append(rows.where(F.startswith("reason", F.lit("veto:"))).groupBy(F.lit("veto").alias("kind"), F.split_part("reason", F.lit(":"), F.lit(2)).alias("name")).agg(F.count(F.lit(1)).alias("n")))
    parts.append(rows.agg(F.count_if(F.contains("reason", F.lit("below topic-boundary"))).alias("n")).select(F.lit("below").alias("kind"), F.lit("threshold").alias("name"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- linking


def _linked(spark, sf_dir):
    return linking.link_groups(papers(spark, sf_dir), F.col("title"), "doc_id")


def link_groups(spark, sf_dir):
    return _linked(spark, sf_dir).select("doc_id", "group_id")


def canonical_pick(spark, sf_dir):
    rank = linking.priority(F.col("source"), {"src0": 0, "src1": 1, "src2": 2})
    return linking.canonical(_linked(spark, sf_dir), "group_id", F.col("doc_id"), rank, F.col("n_chars"), F.col("doc_id")).select("doc_id", "group_id", "canonical_id")


def group_breakdown(spark, sf_dir):
    return linking.group_breakdown(_linked(spark, sf_dir), "group_id", "source", "lang")


def unique_papers(spark, sf_dir):
    group = F.coalesce(t.blank_to_null(F.col("group_id")), F.col("doc_id").cast("string"))
    return _linked(spark, sf_dir).agg(F.count_distinct(group).alias("n_unique"), F.count(F.lit(1)).alias("n_rows"))


def merge_first_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("tags"))
    return linking.merge_first_wins(rows, "o_custkey", "o_orderkey", ["status", "priority"], "tags")


def anti_resume(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id")
    return linking.resume(documents(spark, sf_dir).select("doc_id", "source"), done, "doc_id")


def top_customers(spark, sf_dir):
    """The 25 customers of the most orders whose id isn't also a supplier's, with their nation: anti-join, ordered limit, lookup."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    top = o.join(s, F.col("o_custkey") == F.col("s_suppkey"), "left_anti").orderBy(F.desc("n_orders"), "o_custkey").limit(25)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return top.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "c_name", "n_orders")


def exact_dedup(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies")).select("keep_id", "n_copies")


def neardup_pairs(spark, sf_dir):
    found = linking.same_shingle_pairs(documents(spark, sf_dir), id_col="doc_id", text_col="text", least=0.8)
    return found.select("a", "b", "n_a", "n_b", F.round("similarity", 6).alias("similarity"))


def title_word_blocks(spark, sf_dir):
    """Pairs of documents in blocks of at most 50 by a word of the title, with word likeness between 0.2 and 0.9."""
    words = papers(spark, sf_dir).select("doc_id", t.significant_words(F.col("title")).alias("w"))
    pairs = linking.blocked_pairs(words, "doc_id", F.col("w"), 50)
    side = lambda x: words.select(F.col("doc_id").alias(f"id_{x}"), F.col("w").alias(f"w_{x}"))
    met = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    return met.select("a", "b", F.round(t.jaccard(F.col("w_a"), F.col("w_b")), 6).alias("overlap")).where((F.col("overlap") >= 0.2) & (F.col("overlap") <= 0.9))


def fuzzy_title_pairs(spark, sf_dir):
    rows = papers(spark, sf_dir).select("doc_id", "title", F.array_join(t.significant_words(F.col("title")), "; ").alias("authors"), F.lit("2020").alias("year"))
    return linking.fuzzy_title_pairs(rows, id_col="doc_id", title_col="title", authors_col="authors", year_col="year")


# ---------------------------------------------------------------- chunks and extraction


def _chunks(spark, sf_dir):
    cut = retrieval.chunk_words(documents(spark, sf_dir), keys=["doc_id"], text_col="text")
    return cut.withColumn("chunk_id", F.col("doc_id") * 100_000 + F.col("chunk_index"))


def chunk_words(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("text").alias("text_md5"))


def parse_status_report(spark, sf_dir):
    """Documents by parse status (text, too short, empty) and their chunks, in one table."""
    status = F.when(F.col("n_chars") >= 200, "full_text").when(F.trim("text") != "", "abstract_only").otherwise("no_text_not_indexed")
    docs = documents(spark, sf_dir).select("doc_id", status.alias("status"))
    counts = _chunks(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    return docs.join(counts, "doc_id", "left").groupBy("status").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("n_chunks"))


def html_sections(spark, sf_dir):
    return extraction.html_sections(table(spark, sf_dir, "pages"), keys=["page_id"]).select("page_id", F.col("sec_idx").cast("long").alias("sec_idx"), "heading", F.md5("text").alias("text_md5"))


def html_headings(spark, sf_dir):
    """The first heading of each page, tags taken out, by SQL expressions alone."""
    h1 = F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace(h1, "<[^>]*>", " "), "[ \\t\\n\\r]+", " ")).alias("heading"))


def repeated_lines(spark, sf_dir):
    """Lines that two or more documents of a source hold, as running headers are found on pages."""
    return extraction.repeated_lines(documents(spark, sf_dir), group="source", page="doc_id", text_col="text", least=2)


# ---------------------------------------------------------------- retrieval


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_stats(spark, sf_dir):
    index = retrieval.lexical_index(_chunks(spark, sf_dir))
    n = index.totals.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"))
    return n.crossJoin(index.terms.agg(F.count(F.lit(1)).alias("n_terms"), F.count_if(F.col("df") > 1).alias("n_shared"), F.round(F.sum("idf"), 3).alias("sum_idf")))


def _bm25(spark, sf_dir, k):
    return retrieval.lexical_search(retrieval.lexical_index(_chunks(spark, sf_dir)), _queries(spark, sf_dir), k, decimals=6)


def bm25_topk(spark, sf_dir):
    found = _bm25(spark, sf_dir, SHOWN)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


def entry(spark, sf_dir):
    return bm25_topk(spark, sf_dir)


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("chunk_id"), "embedding", "label"), v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def dense_topk(spark, sf_dir):
    vectors, asked = _vectors(spark, sf_dir)
    found = retrieval.vector_search(vectors, asked, 10)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


def hybrid_chunks(spark, sf_dir):
    """The chunks, cut once into a written table that index, vectors and results are made from."""
    return written(_chunks(spark, sf_dir), "chunks")


def hybrid(chunks):
    """BM25 and vectors of the same chunks; the encoder is the offline one."""
    vectors = retrieval.embed(chunks, retrieval.hash_encoder, kind="array<double>").select("chunk_id", "embedding")
    return search.Hybrid(search.Dense(vectors, retrieval.hash_encoder, 6), search.Lexical(retrieval.lexical_index(chunks), 6))


def _hybrid(spark, sf_dir, k=K):
    chunks = hybrid_chunks(spark, sf_dir)
    return hybrid(chunks).search(_queries(spark, sf_dir), k), chunks


def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir, 10)[0].select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 9).alias("score"))


def _ranked(spark, sf_dir):
    """Fused chunks with their text, group (the document) and whether the document is short, which stands for a survey."""
    found, chunks = _hybrid(spark, sf_dir)
    held = chunks.select(F.col("chunk_id").alias("__c"), "doc_id", "chunk_index", "text")
    out = found.join(held, F.col("chunk_id") == F.col("__c"))
    kinds = documents(spark, sf_dir).select(F.col("doc_id").alias("__d"), (F.col("n_chars") < 800).alias("is_survey"))
    return out.join(kinds, F.col("doc_id") == F.col("__d")).withColumn("group_id", (F.col("doc_id") % 100).cast("string")).withColumn("is_canonical", F.col("doc_id") % 2 == 0).drop("__c", "__d")


def _shown(df):
    return df.select("query_id", F.col("position").cast("long").alias("position"), "chunk_id")


def diversify_cap1(spark, sf_dir):
    return _shown(retrieval.cap_groups(_ranked(spark, sf_dir), SHOWN, cap=1, demoted="is_survey"))


def diversify_cap2(spark, sf_dir):
    return _shown(retrieval.cap_groups(_ranked(spark, sf_dir), SHOWN, cap=2, demoted="is_survey"))


def diversify_collapse(spark, sf_dir):
    ranked = _ranked(spark, sf_dir).withColumn("shingles", t.shingles(F.col("text")))
    return _shown(retrieval.diversify(ranked, SHOWN, "new", demoted="is_survey"))


def _top(spark, sf_dir):
    return retrieval.first_k(_ranked(spark, sf_dir), SHOWN)


def redundant_rate(spark, sf_dir):
    top = _top(spark, sf_dir).withColumn("shingles", t.shingles(F.col("text")))
    return evaluation.redundant_rate(top, SHOWN).select("query_id", F.round("redundant_rate", 6).alias("redundant_rate"))


def same_group_share(spark, sf_dir):
    return evaluation.same_group_share(_top(spark, sf_dir), SHOWN).select("query_id", F.round("same_group_share", 6).alias("same_group_share"))


# ---------------------------------------------------------------- evaluation


def _gold(spark, sf_dir):
    """Gold passages: of each item the documents' chunks that share most of its words, as (group, span)."""
    q = _queries(spark, sf_dir)
    return q.select("query_id", (F.col("query_id") % 100).cast("string").alias("group_id"), F.lit(0).alias("gold_no"), F.col("text").alias("span")).unionByName(q.select("query_id", ((F.col("query_id") * 7 + 3) % 100).cast("string").alias("group_id"), F.lit(1).alias("gold_no"), F.col("text").alias("span")))


def _metrics(spark, sf_dir, ranked=None):
    ranked = ranked if ranked is not None else _hybrid_docs(spark, sf_dir)
    return evaluation.ranking_metrics(ranked, _gold(spark, sf_dir), K)


def _hybrid_docs(spark, sf_dir):
    return _ranked(spark, sf_dir).withColumn("position", F.col("rank"))


def hit_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select("query_id", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"), "hit")


def metrics_rollup(spark, sf_dir):
    kind = F.when(F.col("query_id") % 3 == 0, "specific").when(F.col("query_id") % 3 == 1, "multi").otherwise("follow_up")
    out = evaluation.summary(_metrics(spark, sf_dir).withColumn("kind", kind), "kind", ["recall", "rr"])
    return out.select("kind", "n", F.round("mean_recall", 6).alias("mean_recall"), F.round("mean_rr", 6).alias("mean_rr"))


def latency_quantiles(spark, sf_dir):
    out = evaluation.latency(table(spark, sf_dir, "events"), "value", ["event_type"])
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def bootstrap_ci(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings")
    a = base.select(F.col("vec_id").alias("query_id"), F.element_at("embedding", 1).cast("double").alias("recall"))
    b = base.select(F.col("vec_id").alias("query_id"), F.element_at("embedding", 2).cast("double").alias("recall"))
    out = evaluation.paired_bootstrap(a, b)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mean_diff", "ci_low", "ci_high")], "significant")


# ---------------------------------------------------------------- answers


def _answers(spark, sf_dir):
    """Assistant turns as answers: with citations put in by their length."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    n = F.length("text")
    cites = F.concat(F.lit(" ["), (n % 7).cast("string"), F.lit("] and 【"), (n % 5).cast("string"), F.lit("†L1-L4】 [99]"))
    unknown = F.when(n % 4 == 0, F.lit(" The corpus doesn't contain enough.")).otherwise(F.lit(""))
    return c.select("conv_id", "turn", F.concat("text", F.when(n % 3 > 0, cites).otherwise(F.lit("")), unknown).alias("answer"), ((n % 100) / F.lit(2000.0)).alias("top_score"))


def cite_parse(spark, sf_dir):
    used = evaluation.used_citations(F.col("answer"), F.lit(5))
    return _answers(spark, sf_dir).select("conv_id", "turn", F.array_join(used.cast("array<string>"), ",").alias("cited"))


def abstain_flags(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", evaluation.abstained(F.col("top_score"), F.col("answer"), F.lit(5)).alias("abstained"))


def confusion(spark, sf_dir):
    out = evaluation.confusion(table(spark, sf_dir, "labels"), F.col("quality") == 0, F.col("toxic") == 1)
    return out.select("tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def rewrite_context(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = c.where("role = 'assistant'").select(F.col("conv_id").alias("c2"), (F.col("turn") - 1).alias("t2"), F.col("text").alias("answer"))
    turns = asked.join(said, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2")), "left").select("conv_id", "turn", "question", "answer")
    return evaluation.rewrite_context(turns).select("conv_id", "turn", "context")


def sources_block(spark, sf_dir):
    top = _top(spark, sf_dir).select("query_id", "position", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.lit("2020").alias("year"), F.concat(F.lit("part "), F.col("chunk_index").cast("string")).alias("section"), "text")
    return evaluation.source_block(top).select("query_id", F.md5("sources").alias("sources_md5"), F.length("sources").cast("long").alias("n_chars"))


# ---------------------------------------------------------------- sources


def bib_parse(spark, sf_dir):
    """Suppliers and nations written as entries and parsed again."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    rows = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    body = F.concat(F.lit('    title = "{Token} '), F.col("s_name"), F.lit('",\n    author = {M{\\"u}ller, A. and '), F.col("n_name"), F.lit(', B.},\n    editor = "Nobody",\n    year = "2020",\n    booktitle = "Proc  of\n x"\n'))
    entries = records.prefilter_bib(rows.select(F.col("s_suppkey").cast("string").alias("key"), body.alias("body")))
    return records.parse_bib(entries).select(F.col("key"), "title", F.array_join("authors", "|").alias("authors"), "year", "venue")


def safe_keys(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", t.file_key(F.col("source"), F.concat(F.col("lang"), F.lit("/ ä:"), F.col("doc_id").cast("string"))).alias("file_key"), records.request_key(F.col("source"), F.col("doc_id").cast("string")).alias("request_key"))


QUERIES = {
    f.__name__: f
    for f in (
        relevance_score, relevance_decide, survey_flag, manifest_rollup, link_groups, canonical_pick, group_breakdown, unique_papers, merge_first_wins, anti_resume, top_customers, exact_dedup, neardup_pairs, title_word_blocks, fuzzy_title_pairs, chunk_words, parse_status_report, html_sections, html_headings, repeated_lines, bm25_stats, bm25_topk, dense_topk, hybrid_rrf,
        diversify_cap1, diversify_cap2, diversify_collapse, redundant_rate, same_group_share, hit_metrics, metrics_rollup, latency_quantiles, bootstrap_ci, cite_parse, abstain_flags, confusion, rewrite_context, sources_block, bib_parse, safe_keys,
    )
}
