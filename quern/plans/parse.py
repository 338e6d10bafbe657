"""Parsing: raw documents of included rows to sections, chunks and a report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..operators import extraction, retrieval
from ..sources import records
from ..storage import written

#: Fewer characters than this are no parsed text.
LEAST_CHARS = 200

#: A fetcher takes an address and returns a status and the bytes, or None where there was no answer.
Fetcher = Callable[[str], tuple[int, bytes] | None]


def source_kind(path: Column) -> Column:
    """html or pdf by a path's ending; any other is an error."""
    low = F.coalesce(path, F.lit(""))
    return F.when(F.endswith(low, F.lit(".html")), "html").when(F.endswith(low, F.lit(".pdf")), "pdf").otherwise(F.raise_error(F.concat(F.lit("unsupported file type: "), low)))


def extract_sections(docs: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """doc, sec_idx, heading, text of raw documents (doc, path, html): HTML is read from the text, a PDF from its page lines (as extraction.line_sections)."""
    kinds = docs.withColumn("__kind", source_kind(F.col("path")))
    out = extraction.html_sections(kinds.where("__kind = 'html'"), keys=["doc"])
    if lines is not None:
        mine = lines.join(kinds.where("__kind = 'pdf'").select(F.col("doc").alias("__d")), F.col("doc") == F.col("__d"), "left_semi")
        out = out.unionByName(extraction.line_sections(mine).select("doc", "sec_idx", "heading", "text"))
    return out


def open_copies(pages: DataFrame, column: str = "value") -> DataFrame:
    """paper_id and url of the open copies that cached result pages name; of a repeated paper the greatest, broken pages give nothing."""
    found = records.parse_papers(pages, column).where("open_access_pdf <> '' and paper_id <> ''")
    return found.groupBy("paper_id").agg(F.max("open_access_pdf").alias("url"))


def attempts(rows: DataFrame) -> DataFrame:
    """Adds attempts, in order, as (method, kind, url): the preprint's HTML, its PDF, the anthology's PDF, an open copy.

    rows: source, arxiv_id, source_url, open_url.
    """
    arxiv, has = t.or_blank(F.col("arxiv_id")), lambda c: t.or_blank(F.col(c)) != ""
    one = lambda when, method, kind, url: F.when(when, F.struct(F.lit(method).alias("method"), F.lit(kind).alias("kind"), url.alias("url")))
    tried = F.array(
        one(has("arxiv_id"), "arxiv_html", "html", F.concat(F.lit("https://arxiv.org/html/"), arxiv)),
        one(has("arxiv_id"), "arxiv_pdf", "arxiv_pdf", F.concat(F.lit("https://arxiv.org/pdf/"), arxiv)),
        one((F.col("source") == "acl_anthology") & has("source_url"), "acl_pdf", "pdf", F.concat(F.rtrim("source_url", F.lit("/")), F.lit(".pdf"))),
        one(has("open_url"), "s2_oa_pdf", "pdf", F.col("open_url")),
    )
    return rows.withColumn("attempts", F.filter(tried, lambda x: x.isNotNull()))


def fetch(rows: DataFrame, fetcher: Fetcher, *, key: str = "key", together: int = 4) -> DataFrame:
    """key, method, status and content of each row: its attempts in order until one is valid; else method none, status abstract_only.

    The fetcher is called where the rows are, in ``together`` tasks at most, as the
    other side sets the pace.
    """
    kind = {"html": lambda b: len(b.decode("utf-8", "replace")) >= 500, "arxiv_pdf": lambda b: len(b) >= 1000, "pdf": lambda b: len(b) >= 1000 and b.startswith(b"%PDF-")}
    schema = T.StructType([rows.schema[key], T.StructField("method", T.StringType()), T.StructField("status", T.StringType()), T.StructField("content", T.BinaryType())])

    def work(batches):
        for pdf in batches:
            out = []
            for name, tried in zip(pdf[key], pdf["attempts"], strict=True):
                found = (name, "none", "abstract_only", None)
                for x in tried:
                    answer = fetcher(x["url"])
                    if answer and answer[0] == 200 and kind[x["kind"]](answer[1]):
                        found = (name, x["method"], "ok", answer[1])
                        break
                out.append(found)
            import pandas as pd

            yield pd.DataFrame(out, columns=[key, "method", "status", "content"])

    return attempts(rows).select(key, "attempts").coalesce(together).mapInPandas(work, schema)


@dataclass
class Parsed:
    """chunks as records.CHUNKS; status (key, parse_status, indexed) of each row; the counts."""

    chunks: DataFrame
    status: DataFrame
    report: dict


def run(rows: DataFrame, raw: DataFrame, lines: DataFrame | None = None, *, limit: int | None = None, count: Callable[[str], int] | None = None, most: int = 450, target: int = 350, overlap: int = 50) -> Parsed:
    """Sections and chunks of the included rows of a manifest.

    rows: seq, key, source, title, year, venue, abstract, group_id, included; raw: key,
    method, status, path, html. A row has its document's sections if they hold enough
    characters, else its abstract as one section, else nothing. ``count`` caps chunks by a tokenizer.
    """
    kept = rows.where("included")
    kept = kept.orderBy("seq").limit(limit) if limit else kept
    told = raw.select(F.col("key").alias("__k"), "method", "status", "path", "html")
    joined = kept.join(told, F.col("key") == F.col("__k"), "left").drop("__k").withColumn("method", F.coalesce("method", F.lit("none")))
    read = joined.where("status = 'ok' and path is not null").select(F.col("key").alias("doc"), "path", "html")
    sections = written(extract_sections(read, lines), "parse-sections")
    enough = sections.groupBy(F.col("doc").alias("__d")).agg(F.sum(F.length("text")).alias("__n")).where(F.col("__n") >= LEAST_CHARS)
    status = F.when(F.col("__d").isNotNull(), "full_text").when(t.or_blank(F.col("abstract")) != "", "abstract_only").otherwise("no_text_not_indexed")
    marked = written(joined.drop("html").join(enough, F.col("key") == F.col("__d"), "left").withColumn("parse_status", status).drop("__d", "__n"), "parse-status")
    full = sections.join(marked.where("parse_status = 'full_text'").select(F.col("key").alias("__f")), F.col("doc") == F.col("__f"), "left_semi").select(F.col("doc").alias("key"), "sec_idx", "heading", "text")
    short = marked.where("parse_status = 'abstract_only'").select("key", F.lit(0).alias("sec_idx"), F.lit("Abstract").alias("heading"), F.col("abstract").alias("text"))
    keys = ["key", "sec_idx", "heading"]
    cut = retrieval.chunk_words(full.unionByName(short), keys=keys, text_col="text", target=target, overlap=overlap)
    if count is not None:
        cut = retrieval.cap_tokens(cut, keys=keys, count=count, most=most)
    about = marked.select(F.col("key").alias("__k"), "source", "title", "year", "venue", "group_id", "parse_status", "method")
    chunks = written(cut.join(about, F.col("key") == F.col("__k")).select(F.col("key").alias("paper_id"), F.coalesce(t.blank_to_null(F.col("group_id")), F.col("key")).alias("canonical_paper_id"), "source", "title", "year", "venue", (F.col("parse_status") == "abstract_only").alias("abstract_only"), F.col("method").alias("fetch_method"), F.col("heading").alias("section_title"), "sec_idx", "chunk_index", "text"), "parse-chunks")
    done = marked.select("key", "parse_status", F.when(F.col("parse_status") == "no_text_not_indexed", "no").otherwise("yes").alias("indexed"))
    return Parsed(chunks, done, report(marked, chunks))


def report(marked: DataFrame, chunks: DataFrame) -> dict:
    """Counts by method of fetching and by what became of the rows; the three kinds add up to all rows."""
    methods = {r.method: r.n for r in marked.groupBy("method").agg(F.count(F.lit(1)).alias("n")).orderBy("method").collect()}
    kinds = [("full_text_parsed", "full_text"), ("abstract_only", "abstract_only"), ("no_text_not_indexed", "no_text_not_indexed")]
    total = marked.agg(F.count(F.lit(1)).alias("total_rows"), *[F.count_if(F.col("parse_status") == kind).alias(name) for name, kind in kinds]).first()
    return {"total_rows": total.total_rows, "by_fetch_method": methods, **{name: total[name] for name, _ in kinds}, "total_chunks": chunks.count()}


def write_report(spark: SparkSession, made: dict, path: str) -> None:
    spark.createDataFrame([(records.to_json_report(made),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def download_once(spark: SparkSession, url: str, path: str, fetcher: Fetcher) -> bool:
    """Puts what is at an address into a file, once; whether it had to be fetched. A failed answer is an error and leaves no file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(at):
        return False
    answer = fetcher(url)
    if not answer or answer[0] != 200:
        raise OSError(f"{url} gave {answer and answer[0]}")
    half = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = store.create(half)
    out.write(bytearray(answer[1]))
    out.close()
    store.rename(half, at)
    return True
