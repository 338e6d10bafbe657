"""Collection: pages of search results to a manifest of candidates.

Results are staged tables (of what was fetched, when and for which term), so a run
is one plan over them: the order of finding is a column, and what comes first is a
grouped minimum, not a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import linking, relevance
from ..sources import records

# What is searched for, within which categories, and the papers that must be there.
QUERY_TERMS = ("byte-level tokenization language model", "subword tokenization", "byte pair encoding tokenizer", "WordPiece tokenization", "SentencePiece tokenizer", "unigram language model tokenizer", "tokenizer-free language model", "character-level language model tokenization", "vocabulary size language model", "multilingual tokenizer fairness", "tokenizer fertility multilingual", "tokenization arithmetic reasoning", "tokenization code generation", "subword regularization", "tokenizer training algorithm", "unfairness between languages", "tokenizer fairness", "number tokenization arithmetic", "digit tokenization", "tokenization numeracy")
CATEGORIES = "(cat:cs.CL OR cat:cs.LG OR cat:cs.AI)"
CANARIES = ("1508.07909", "1808.06226", "2105.13626", "2103.06874", "2305.15425", "2402.14903")

#: Columns of a staged hit: when it was found (seq), by which search (source: arxiv or semantic_scholar) and term, and what it says.
HITS = "seq long, source string, term string, arxiv_id string, version string, paper_id string, title string, authors string, year string, venue string, abstract string, url string, doi string, external_ids string"


def search_expression(term: Column) -> Column:
    """The phrase and the categories, as the preprint search wants it."""
    return F.concat(F.lit('all:"'), term, F.lit(f'" AND {CATEGORIES}'))


def paged(pages: DataFrame, *, query: str = "query", start: str = "start", asked: str = "asked", entries: str = "entries", total: str | None = None, most: int = 100) -> DataFrame:
    """query, place (from 0) and entry of what a page loop over staged pages takes, at most ``most`` for each query.

    The loop ends after a page that is empty or, without ``total``, has fewer entries
    than were asked for; with ``total`` after the page that reaches it. So a page counts
    if no earlier one of its query ended the loop: a running maximum by start.
    """
    n = F.size(entries)
    over = (n == 0) | (n < F.col(asked)) if total is None else (n == 0) | (F.col(start) + F.col(asked) >= F.col(total))
    before = W.partitionBy(query).orderBy(start).rowsBetween(W.unboundedPreceding, -1)
    open_ = pages.where(F.col(entries).isNotNull()).withColumn("__ended", F.coalesce(F.max(over.cast("int")).over(before), F.lit(0))).withColumn("__n", F.coalesce(F.sum(n).over(before), F.lit(0)))
    taken = open_.where("__ended = 0").select(query, "__n", F.posexplode(entries).alias("__i", "entry"))
    return taken.select(query, (F.col("__n") + F.col("__i")).cast("long").alias("place"), "entry").where(F.col("place") < most)


def cache_misses(requests: DataFrame, cache: DataFrame, parts: list[str]) -> DataFrame:
    """The requests whose key (records.request_key of ``parts``) the cache (key, body) doesn't hold, with that key."""
    return linking.resume(requests.withColumn("key", records.request_key(*[F.col(p).cast("string") for p in parts])), cache, "key")


def by_ids(wanted: DataFrame, fetched: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Fetched rows of the wanted ids: by id, as an answer's order says nothing of the request's."""
    return fetched.join(wanted.select(F.col(key).alias("__w")).distinct(), F.col(key) == F.col("__w"), "left_semi")


def first_value(column: str, when: Column | None = None) -> Column:
    """The first value by seq that isn't blank, among the rows that ``when`` takes."""
    there = t.blank_to_null(F.col(column)).isNotNull()
    return F.min(F.when(there if when is None else there & when, F.struct("seq", F.col(column).alias("v"))))["v"]


def merge_hits(hits: DataFrame) -> DataFrame:
    """One candidate for each paper of the hits (columns HITS), with the columns of HITS and key, found_by, first_abstract.

    A paper is its preprint id, or else its id in the other search. Its first hit makes
    the row. Later preprint hits fill in version, address and abstract where blank; later
    hits of the other search fill in its id, doi and external ids, and the venue where that
    is blank or "arXiv" and theirs isn't "arxiv.org". found_by lists the terms, a term that the
    list holds already (also within a longer one) left out. Hits without a title of the other search are left out.
    """
    hits = hits.where((F.col("source") == "arxiv") | (t.or_blank(F.col("title")) != ""))
    paper = F.when(t.or_blank(F.col("arxiv_id")) != "", F.concat(F.lit("arxiv:"), F.col("arxiv_id"))).otherwise(F.concat(F.lit("s2:"), F.col("paper_id")))
    keyed = hits.withColumn("paper", paper).withColumn("first_seq", F.min("seq").over(W.partitionBy("paper")))
    first, preprint = F.col("seq") == F.col("first_seq"), F.col("source") == "arxiv"
    # a hit of the other search enriches only a paper with a preprint id
    other = (F.col("source") == "semantic_scholar") & (t.or_blank(F.col("arxiv_id")) != "")
    whole = F.min(F.struct("seq", "source", "arxiv_id", "title", "authors", "year", "venue", "abstract", F.concat(F.when(preprint, F.lit("arxiv:")).otherwise(F.lit("s2:")), F.when(preprint, F.col("arxiv_id")).otherwise(F.col("paper_id"))).alias("key")))
    better = other & ~F.col("venue").isin("", "arXiv") & (F.lower("venue") != "arxiv.org")
    merged = keyed.groupBy("paper").agg(
        whole.alias("w"), first_value("version", first | preprint).alias("version"), first_value("url", first | preprint).alias("url"), first_value("abstract", first | preprint).alias("abstract"),
        first_value("paper_id", first | other).alias("paper_id"), first_value("doi", first | other).alias("doi"), first_value("external_ids", first | other).alias("external_ids"), first_value("venue", better & ~first).alias("better"), F.max(other & ~first & (F.col("venue") == "arXiv")).alias("plain"),
    )
    terms = keyed.groupBy("paper", "term").agg(F.min("seq").alias("seq")).groupBy(F.col("paper").alias("__p")).agg(F.array_sort(F.collect_list(F.struct("seq", "term"))).alias("terms"))
    listed = F.aggregate("terms", F.lit(""), lambda s, x: F.when(s == "", x["term"]).when(F.contains(s, x["term"]), s).otherwise(F.concat(s, F.lit("; "), x["term"])))
    own = t.or_blank(F.col("w.venue"))
    venue = F.when(~own.isin("", "arXiv"), own).otherwise(F.coalesce("better", F.when((own == "") & F.col("plain"), F.lit("arXiv")), own))
    blank = lambda c: t.or_blank(F.col(c)).alias(c)
    return merged.join(terms, F.col("paper") == F.col("__p")).select(F.col("w.seq").alias("seq"), F.col("w.source").alias("source"), listed.alias("found_by"), t.or_blank(F.col("w.arxiv_id")).alias("arxiv_id"), blank("version"), blank("paper_id"), F.col("w.title").alias("title"), t.or_blank(F.col("w.authors")).alias("authors"), t.or_blank(F.col("w.year")).alias("year"), venue.alias("venue"), blank("abstract"), blank("url"), blank("doi"), blank("external_ids"), F.col("w.key").alias("key"), t.or_blank(F.col("w.abstract")).alias("first_abstract"))


def decided(rows: DataFrame, abstract: str = "abstract", w: relevance.Weights = relevance.Weights()) -> DataFrame:
    """Adds relevance_score, included and rejection_reason (blank where included)."""
    out = relevance.decide(rows, abstract_col=abstract, w=w)
    return out.withColumn("rejection_reason", F.when(F.col("included"), F.lit("")).otherwise(F.col("reason"))).drop("reason")


def link_added(rows: DataFrame) -> DataFrame:
    """Adds group_id to rows (seq, title, added): added rows are linked to what bears their title already.

    The linked rows of a title are its added ones and the last of the others. A group
    of two or more is numbered (grp0001 ...) by when its second row came; '' if alone.
    """
    keyed = rows.withColumn("__key", t.title_key(F.col("title")))
    last = keyed.groupBy(F.col("__key").alias("__k")).agg(F.max(F.when(~F.col("added"), F.col("seq"))).alias("__last"), F.count_if("added").alias("__added"))
    linked = keyed.join(last, F.col("__key") == F.col("__k")).withColumn("__in", (F.col("__added") > 0) & (F.col("added") | (F.col("seq") == F.col("__last"))))
    # the two least of a set of numbers, with partial results: the least, and the least above it
    firsts = linked.where("__in").groupBy("__key").agg(F.min("seq").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    second = linked.where("__in").join(firsts.select(F.col("__key").alias("__f"), "__first"), F.col("__key") == F.col("__f")).where("seq > __first").groupBy(F.col("__key").alias("__g")).agg(F.min("seq").alias("__second"))
    numbers = records.numbered(second, ["__second"], "__number").select("__g", F.format_string("grp%04d", "__number").alias("group_id"))
    return linked.join(numbers, (F.col("__key") == F.col("__g")) & F.col("__in"), "left").withColumn("group_id", F.coalesce("group_id", F.lit(""))).drop("__key", "__k", "__last", "__added", "__in", "__g")


def collect(hits: DataFrame, bulk: DataFrame | None = None, canaries: DataFrame | None = None, sample: int | None = None, w: relevance.Weights = relevance.Weights()) -> tuple[DataFrame, DataFrame | None]:
    """The manifest's rows, and the report on the canaries (None in a sample).

    hits: HITS; bulk: seq, key, title, authors, year, venue, abstract, url, doi of the
    anthology; canaries: seq, arxiv_id, and title, authors, version, year, abstract, url of
    what was fetched (title null if nothing was). A sample has the ``sample`` best included
    rows, of equal scores the first, and all rejected ones; bulk and canaries are left out.
    """
    merged = decided(merge_hits(hits), "first_abstract", w).drop("first_abstract").withColumn("added", F.lit(False))
    if sample is not None:
        best = F.row_number().over(W.partitionBy("included").orderBy(F.desc("relevance_score"), "seq"))
        return merged.withColumn("__r", best).where(~F.col("included") | (F.col("__r") <= sample)).drop("__r", "added").withColumn("group_id", F.lit("")), None
    names, everything = merged.columns, merged
    complete = lambda df, **fixed: df.select(*[F.lit(fixed[c]).alias(c) if c in fixed else (F.col(c) if c in df.columns else F.lit("").alias(c)) for c in names])
    after = merged.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("__after"))  # one row
    later = lambda df, off: df.crossJoin(F.broadcast(after)).withColumn("seq", F.col("seq") + F.col("__after") + F.lit(off)).drop("__after")
    if bulk is not None:
        first = bulk.groupBy(F.col("key").alias("__k")).agg(F.min("seq").alias("__s"))
        once = bulk.join(first, (F.col("key") == F.col("__k")) & (F.col("seq") == F.col("__s"))).drop("__k", "__s")
        everything = everything.unionByName(complete(decided(later(once, 1), w=w), source="acl_anthology", found_by="acl_bulk_prefilter", added=True))
    report = None
    if canaries is not None:
        fetched = canaries.where(F.col("title").isNotNull())
        known = merged.where(F.startswith("key", F.lit("arxiv:"))).select(F.col("arxiv_id").alias("__id"), F.lit(True).alias("__known"))
        titles = everything.select(t.title_key(F.col("title")).alias("__t")).distinct()
        looked = canaries.join(known, F.col("arxiv_id") == F.col("__id"), "left").join(titles, t.title_key(F.col("title")) == F.col("__t"), "left")
        found = F.coalesce("__known", F.lit(False)) | (F.col("title").isNotNull() & F.col("__t").isNotNull())
        looked = looked.select(F.col("arxiv_id").alias("canary"), F.col("seq").alias("canary_seq"), found.alias("naturally_found"))
        new = linking.resume(fetched, known.select(F.col("__id").alias("arxiv_id")), "arxiv_id").withColumn("key", F.concat(F.lit("arxiv:"), F.col("arxiv_id")))
        everything = everything.unionByName(complete(decided(later(new, 1 << 40), w=w), source="arxiv", venue="arXiv", found_by="canary_injected", added=True))
        own = everything.where(F.startswith("key", F.lit("arxiv:"))).select(F.col("key").alias("__key"), F.col("included").alias("__included"), F.col("relevance_score").alias("__score"), F.col("rejection_reason").alias("__reason"))
        told = looked.join(own, F.concat(F.lit("arxiv:"), F.col("canary")) == F.col("__key"), "left")
        status = F.when(F.col("__key").isNull(), "MISSING").when(F.col("__included"), "INCLUDED").otherwise("REJECTED")
        report = told.select("canary_seq", "canary", status.alias("status"), "naturally_found", F.col("__score").alias("relevance_score"), F.col("__reason").alias("rejection_reason"))
    return link_added(everything).drop("added"), report


def version_pairs(rows: DataFrame, fetched: DataFrame, limit: int = 25, w: relevance.Weights = relevance.Weights()) -> tuple[DataFrame, DataFrame]:
    """The first versions of papers of which a later one is there: (rows with their groups, new rows).

    rows: seq, source, source_id, arxiv_id, arxiv_version, authors, included, group_id;
    fetched: arxiv_id, version, title, year, abstract, url. Of the included preprints with a
    version beyond v1, whose v1 isn't a row yet, the ``limit`` of the highest version (then the
    first) are asked for. A paper without group starts one, numbered on from the highest.
    """
    number = F.coalesce(F.expr("try_cast(regexp_replace(arxiv_version, '^v+', '') as int)"), F.lit(1))
    later = rows.where(F.col("included") & (F.col("source") == "arxiv") & ~F.col("arxiv_version").isin("", "v1")).withColumn("__v1", F.concat("arxiv_id", F.lit("v1")))
    missing = later.join(rows.select(F.col("source_id").alias("__there")), F.col("__v1") == F.col("__there"), "left_anti")
    chosen = missing.withColumn("__version", number).orderBy(F.desc("__version"), "seq").limit(limit)
    met = chosen.join(F.broadcast(by_ids(chosen, fetched).select(F.col("arxiv_id").alias("__id"), F.col("version").alias("__fetched"), F.col("title").alias("__title"), F.col("year").alias("__year"), F.col("abstract").alias("__abstract"), F.col("url").alias("__url"))), F.col("arxiv_id") == F.col("__id"))  # at most ``limit`` rows
    top = rows.agg(F.coalesce(F.max(F.substring(t.blank_to_null(F.col("group_id")), 4, 20).cast("int")), F.lit(0)).alias("__top"))  # one row
    nth = F.sum((F.col("group_id") == "").cast("int")).over(W.orderBy(F.desc("__version"), "seq"))  # of at most ``limit`` rows
    grouped = met.crossJoin(F.broadcast(top)).withColumn("__group", F.when(F.col("group_id") == "", F.format_string("grp%04d", (F.col("__top") + nth).cast("int"))).otherwise(F.col("group_id")))
    new = decided(grouped.select(F.col("seq").alias("of_seq"), F.lit("arxiv").alias("source"), F.concat("arxiv_id", "__fetched").alias("source_id"), "arxiv_id", F.col("__fetched").alias("arxiv_version"), F.col("__title").alias("title"), "authors", F.col("__year").alias("year"), F.lit("arXiv").alias("venue"), F.col("__abstract").alias("abstract"), F.col("__url").alias("source_url"), F.lit("arxiv_version_pair").alias("query_matched"), F.col("__group").alias("group_id")), w=w)
    back = grouped.select(F.col("seq").alias("__seq"), "__group")
    out = rows.join(F.broadcast(back), F.col("seq") == F.col("__seq"), "left").withColumn("group_id", F.coalesce("__group", "group_id")).drop("__seq", "__group")
    return out, new


def manifest(rows: DataFrame) -> DataFrame:
    """The rows of collect() under the manifest's names, with seq and key."""
    own = F.when(F.col("source") == "arxiv", F.concat("arxiv_id", "version")).when(F.col("source") == "semantic_scholar", F.col("paper_id")).otherwise(F.regexp_replace("key", "^acl:", ""))
    named = rows.withColumn("source_id", own)
    return named.select("seq", t.file_key(F.col("source"), F.col("source_id")).alias("key"), "source", "source_id", "title", "authors", "year", "venue", "abstract", F.col("url").alias("source_url"), "arxiv_id", F.col("version").alias("arxiv_version"), "doi", F.col("paper_id").alias("semantic_scholar_id"), "external_ids", F.col("found_by").alias("query_matched"), "relevance_score", "included", "rejection_reason", "group_id")
