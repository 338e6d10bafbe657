"""Readers and writers of bibliographic records, raw documents, questions and indexes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t

# The columns of the manifest, in order.
MANIFEST = "source string, source_id string, title string, authors string, year string, venue string, abstract string, source_url string, arxiv_id string, arxiv_version string, doi string, semantic_scholar_id string, external_ids string, license string, query_matched string, relevance_score double, included boolean, rejection_reason string, candidate_group_id string, canonical_id string, doc_type string, parse_status string, indexed string"
QUESTIONS = "id string, question string, type string, conversation_id string, turn int, prior_turns array<struct<question:string,answer:string>>, gold array<struct<paper_title:string,group_id:string,section:string,supporting_span:string>>, targets_duplicate_group boolean, notes string, gold_standalone_rewrite string"
CHUNKS = "paper_id string, canonical_paper_id string, source string, title string, year string, venue string, abstract_only boolean, fetch_method string, section_title string, chunk_index int, text string"
PAPER_JSON = "paperId string, title string, abstract string, year int, venue string, authors array<struct<name:string>>, externalIds map<string,string>, url string, openAccessPdf struct<url:string>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; true, True and 1 are true, blank scores 0."""
    text_schema = ", ".join(f"{c.split()[0]} string" for c in MANIFEST.split(", "))
    raw = spark.read.csv(path, header=True, schema=text_schema, multiLine=True, escape='"')
    return raw.withColumns({c.split()[0]: t.or_blank(F.col(c.split()[0])) for c in MANIFEST.split(", ") if c.endswith("string")}).withColumn("relevance_score", F.coalesce(F.try_to_number(t.blank_to_null("relevance_score"), F.lit("S99999D999")).cast("double"), F.expr("try_cast(relevance_score as double)"), F.lit(0.0))).withColumn("included", F.coalesce(F.lower(F.trim("included")).isin("true", "1"), F.lit(False)))


def write_manifest(rows: DataFrame, path: str) -> None:
    """Sorted by falling score, then title: a range partitioning, so files are sorted one after the other."""
    rows.orderBy(F.desc("relevance_score"), "title").write.mode("overwrite").csv(path, header=True, escape='"')


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=QUESTIONS)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=CHUNKS)


def gold_pairs(questions: DataFrame) -> DataFrame:
    """(query_id, group_id, gold_no, span) of each gold passage."""
    return questions.select(F.col("id").alias("query_id"), F.posexplode("gold").alias("gold_no", "g")).select("query_id", F.col("g.group_id").alias("group_id"), "gold_no", F.col("g.supporting_span").alias("span"))


def query_text(use_rewrite: bool = True) -> Column:
    """The gold rewrite if asked for and there, else the question."""
    rewrite = t.blank_to_null(F.col("gold_standalone_rewrite"))
    return F.coalesce(rewrite, F.col("question")) if use_rewrite else F.col("question")


# ---------------------------------------------------------------- BibTeX

# Fixed value: what a bulk entry must mention to be parsed.
BIB_TERMS = ("token", "bpe", "subword", "sentencepiece", "wordpiece", "byte-pair", "byte pair")

# Fixed value: name = "quoted" or {braced, one level nested}, before the next field, a closing brace on a line of its own, or the end.
BIB_FIELD = r'(?s)(\w+)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|\{((?:[^{}]|\{[^{}]*\})*)\})(?=,\s*\n\s*\w+\s*=|\s*\n\}|\s*$)'


def read_bib(spark: SparkSession, path: str, partitions: int | None = None, terms: tuple[str, ...] = BIB_TERMS) -> DataFrame:
    """(key, body) of the entries that mention a term. A compressed file is read by one task, so what it keeps is dealt out again."""
    raw = spark.read.option("lineSep", "\n}\n").text(path)
    kept = prefilter_bib(raw.withColumnRenamed("value", "body"), terms)
    return (kept.repartition(partitions) if partitions else kept).select(F.regexp_extract("body", r"@\w+\{([^,\n]+),", 1).alias("key"), F.regexp_replace("body", r"(?s)^.*?@\w+\{[^,\n]+,\n", "").alias("body")).where("key <> ''")


def prefilter_bib(entries: DataFrame, terms: tuple[str, ...] = BIB_TERMS) -> DataFrame:
    return entries.where(t.count_contained(F.lower("body"), list(terms)) > 0) if terms else entries


def parse_bib(entries: DataFrame) -> DataFrame:
    """key, title, authors, year, venue, abstract, url, doi of entries (key, body); those without a title are dropped.

    Authors come before editors, a book title before a journal; braces go, white space is collapsed.
    """
    field = F.lit(BIB_FIELD)
    names = F.transform(F.regexp_extract_all("body", field, F.lit(1)), F.lower)
    values = F.zip_with(F.regexp_extract_all("body", field, F.lit(2)), F.regexp_extract_all("body", field, F.lit(3)), lambda a, b: F.when(a != "", a).otherwise(b))
    last = F.aggregate(F.arrays_zip(names.alias("k"), values.alias("v")), F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))
    parsed = entries.withColumn("__f", last)
    get = lambda k: t.collapse_space(t.strip_braces(t.or_blank(F.try_element_at("__f", F.lit(k)))))
    people = F.coalesce(t.blank_to_null(get("author")), get("editor"))
    authors = F.filter(F.transform(F.split(people, r"\s+and\s+"), F.trim), lambda x: x != "")
    return parsed.select("key", get("title").alias("title"), authors.alias("authors"), get("year").alias("year"), F.coalesce(t.blank_to_null(get("booktitle")), get("journal")).alias("venue"), get("abstract").alias("abstract"), get("url").alias("url"), get("doi").alias("doi")).where("title <> ''")


# ---------------------------------------------------------------- Atom, JSON

ATOM = "id string, title string, summary string, published string, updated string, author array<struct<name:string>>, category array<struct<_term:string>>, link array<struct<_href:string,_title:string,_rel:string>>"


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    return parse_atom(spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path))


def parse_atom(entries: DataFrame) -> DataFrame:
    """arxiv_id, version (v1 if none), title, authors, abstract, categories, published, updated, pdf_url, abs_url."""
    name = F.regexp_extract(F.substring_index("id", "/abs/", -1), r"^(.*?)(v\d+)?$", 1)
    version = F.regexp_extract(F.substring_index("id", "/abs/", -1), r"^(.*?)(v\d+)?$", 2)
    pdf = F.filter("link", lambda x: x["_title"] == "pdf")
    empty = F.array().cast("array<string>")
    return entries.select(
        name.alias("arxiv_id"), F.coalesce(t.blank_to_null(version), F.lit("v1")).alias("version"), t.collapse_space(F.col("title")).alias("title"), F.coalesce(F.transform("author", lambda a: a["name"]), empty).alias("authors"), t.collapse_space(F.col("summary")).alias("abstract"),
        F.coalesce(F.transform("category", lambda c: c["_term"]), empty).alias("categories"), F.col("published"), F.col("updated"), t.or_blank(F.try_element_at(pdf, F.lit(1))["_href"]).alias("pdf_url"), F.col("id").alias("abs_url"),
    )


def parse_papers(raw: DataFrame, column: str = "value") -> DataFrame:
    """Decodes pages of {"data": [...]}; missing values become defaults, broken pages give no rows."""
    page = F.from_json(column, f"data array<struct<{PAPER_JSON.replace(' ', ':').replace(',:', ',')}>>")
    rows = raw.select(F.explode(page["data"]).alias("p"))
    blank = lambda c: t.or_blank(F.col(f"p.{c}"))
    return rows.select(blank("paperId").alias("paper_id"), blank("title").alias("title"), blank("abstract").alias("abstract"), F.coalesce(F.col("p.year").cast("string"), F.lit("")).alias("year"), blank("venue").alias("venue"), F.coalesce(F.transform("p.authors", lambda a: t.or_blank(a["name"])), F.array().cast("array<string>")).alias("authors"), F.col("p.externalIds").alias("external_ids"), blank("url").alias("url"), t.or_blank(F.col("p.openAccessPdf.url")).alias("open_access_pdf"))


# ---------------------------------------------------------------- raw documents


def fetch_plan(rows: DataFrame) -> DataFrame:
    """Adds method and url: the first available of HTML, PDF, the anthology's PDF, an open copy; else abstract_only.

    Expects has_html, has_pdf (booleans), source, arxiv_id, source_url and open_url.
    """
    arxiv = t.or_blank(F.col("arxiv_id")) != ""
    anthology = (F.col("source") == "acl_anthology") & (t.or_blank(F.col("source_url")) != "")
    method = F.when(arxiv & F.col("has_html"), "arxiv_html").when(arxiv & F.col("has_pdf"), "arxiv_pdf").when(anthology, "acl_pdf").when(t.or_blank(F.col("open_url")) != "", "s2_oa_pdf").otherwise("abstract_only")
    out = rows.withColumn("method", method)
    url = F.when(F.col("method") == "acl_pdf", F.concat(F.rtrim("source_url", F.lit("/")), F.lit(".pdf"))).when(F.col("method") == "s2_oa_pdf", F.col("open_url"))
    return out.withColumn("url", url)


def valid_content(content: Column, kind: Column, status: Column) -> Column:
    """Whether a response can be used, by its kind.

    All need status 200. html: 500 characters or more, whatever bytes they take (what
    is no UTF-8 counts as replaced); arxiv_pdf: 1000 bytes or more; any other PDF also
    begins with %PDF-.
    """
    n = F.octet_length(content)
    chars = F.length(content.cast("string"))
    fits = F.when(kind == "html", chars >= 500).when(kind == "arxiv_pdf", n >= 1000).otherwise((n >= 1000) & (F.substring(content, 1, 5) == F.lit(b"%PDF-")))
    return (status == 200) & fits


def request_key(*parts: Column) -> Column:
    """The name under which a response is kept: the start of a SHA-256."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def index_size_mb(spark: SparkSession, path: str) -> float:
    """Size of a file or folder in MB, two places, in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return round(fs.getContentSummary(at).getLength() / 1e6, 2)


# ---------------------------------------------------------------- reports


def manifest_summary(rows: DataFrame) -> dict:
    """The counts of the manifest's report; each is an aggregate, only its few rows come to the driver."""
    kept = rows.where("included")
    group = F.coalesce(t.blank_to_null(F.col("candidate_group_id")), F.concat(F.lit("row:"), t.file_key(F.col("source"), F.col("source_id"))))
    by = lambda c, order: [(r[0], r[1]) for r in kept.groupBy(F.coalesce(t.blank_to_null(F.col(c)), F.lit("(unknown)")).alias(c)).agg(F.count(F.lit(1)).alias("n")).orderBy(*order).collect()]
    vetoes = rows.where(F.startswith("rejection_reason", F.lit("veto:"))).groupBy(F.split_part("rejection_reason", F.lit(":"), F.lit(2)).alias("veto")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "veto")
    total = rows.agg(F.count(F.lit(1)).alias("candidates"), F.count_if("included").alias("included"), F.count_if(F.contains("rejection_reason", F.lit("below topic-boundary"))).alias("below")).first()
    return {**total.asDict(), "unique": kept.select(F.count_distinct(group)).first()[0], "by_source": by("source", (F.desc("n"), "source")), "by_year": by("year", ("year",)), "vetoes": [tuple(r) for r in vetoes.collect()]}


def summary_markdown(s: dict) -> str:
    lines = ["# Manifest summary", "", f"- candidates: {s['candidates']}", f"- included: {s['included']}", f"- unique papers: {s['unique']}", f"- below the threshold: {s['below']}"]
    for title, rows in (("By source", s["by_source"]), ("By year", s["by_year"]), ("Vetoes", s["vetoes"])):
        lines += ["", f"## {title}", "", *(f"- {k}: {n}" for k, n in rows)]
    return "\n".join(lines) + "\n"


def to_json_report(report: dict) -> str:
    return json.dumps(report, indent=2, sort_keys=True)


def numbered(rows: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Adds a global number from 1 by the columns ``order`` (rising, nulls first; rows equal in all of them share a number's place in no fixed order).

    The keys are cut into ranges, whose first keys are known to the driver; a row's
    number is its place in its range after the counts of the ranges before. The ranges
    are fixed by those literal keys, so counting and numbering see the same ones.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = F.struct(*order)
    starts = [r.first for r in rows.select(keys.alias("k")).repartitionByRange(parts, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("first")).collect()]
    bounds = sorted(starts, key=lambda r: tuple((x is not None, x) for x in r))[1:]
    schema = rows.select(keys.alias("k")).schema["k"].dataType
    literal = F.from_json(F.lit(json.dumps([r.asDict() for r in bounds], default=str)), T.ArrayType(schema)) if bounds else F.array().cast(T.ArrayType(schema))
    ranged = rows.withColumn("__p", F.size(F.filter(literal, lambda b: b <= keys)))
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.select(F.col("__p").alias("__q"), F.coalesce(F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__s"))  # a row for each range
    within = F.row_number().over(W.partitionBy("__p").orderBy(*order))
    return ranged.join(F.broadcast(before), F.col("__p") == F.col("__q")).withColumn(name, (F.col("__s") + within).cast("long")).drop("__p", "__q", "__s")
