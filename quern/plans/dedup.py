"""The duplicates' plan: fuzzy merges, canonical rows, document types, the audit of what was merged and what nearly was."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import linking, relevance, retrieval
from ..storage import written
from .search import Encoder

#: What makes a merge doubtful: abstracts less alike than this, or no author in common.
LEAST_COSINE = 0.7


@dataclass
class Result:
    """rows with group_id, canonical_id and doc_type; the merges applied (a, b, group, reason); audit and near misses; the counts."""

    rows: DataFrame
    merges: DataFrame
    audit: DataFrame
    near: DataFrame
    report: dict


def fuzzy_merges(rows: DataFrame, max_block: int | None = 50) -> DataFrame:
    """Likely pairs among the included rows without a group (seq, title, authors, year, vector, included, group_id)."""
    return linking.fuzzy_title_pairs(rows.where(F.col("included") & (F.col("group_id") == "")), id_col="seq", title_col="title", authors_col="authors", year_col="year", vector_col="vector", max_block=max_block)


def merged(rows: DataFrame, pairs: DataFrame, manual: list[tuple[str, str]] = ()) -> tuple[DataFrame, DataFrame]:
    """rows with group_id after the merges, and the merges (a, b, group_id, reason); manual pairs are of keys (source:source_id).

    The pairs come to the driver in order of their first and second row; with them the
    groups of the rows that they and the manual pairs name, and the highest number.
    """
    spark = rows.sparkSession
    found = pairs.orderBy("a", "b").collect()
    names = [x for p in manual for x in p]
    by_key = {r.key: r.seq for r in rows.where(F.concat_ws(":", "source", "source_id").isin(names or [""])).select(F.concat_ws(":", "source", "source_id").alias("key"), "seq").collect()} if names else {}
    asked = sorted({x for r in found for x in (r.a, r.b)} | set(by_key.values()))
    told = spark.createDataFrame([(x,) for x in asked], "__asked long")
    groups = {r.seq: r.group_id for r in rows.join(told, F.col("seq") == F.col("__asked"), "left_semi").select("seq", "group_id").collect()}
    top = rows.agg(F.max(F.when(F.col("group_id") != "", F.col("group_id")))).first()[0]
    after, applied = linking.merge_steps([(r.a, r.b) for r in found], groups | ({-1: top} if top else {}), [(by_key.get(a), by_key.get(b)) for a, b in manual])
    told = lambda x: "None" if x is None else f"{x:.3f}".rstrip("0").rstrip(".") if x != int(x) else f"{x:.1f}"
    why = {(r.a, r.b): f"fuzzy: title_sim={told(r.title_sim)} shared_authors={r.shared_authors} year_diff={r.year_gap} abstract_sim={told(r.abstract_cosine)}" for r in found}
    merges = spark.createDataFrame([(a, b, g, why.get((a, b), "manual")) for a, b, g in applied], "a long, b long, group_id string, reason string")
    new = spark.createDataFrame([(x, g) for x, g in after.items() if x != -1], "__seq long, __group string")
    out = rows.join(new, F.col("seq") == F.col("__seq"), "left").withColumn("group_id", F.coalesce("__group", "group_id")).drop("__seq", "__group")
    return out, merges


def typed(rows: DataFrame) -> DataFrame:
    """Adds canonical_id and doc_type to included rows; others have neither."""
    number = F.coalesce(F.expr("try_cast(regexp_replace(arxiv_version, '^v+', '') as int)"), F.lit(0))
    key = F.concat_ws("__", "source", "source_id")
    kept, rest = rows.where("included"), rows.where("not included")
    named = linking.canonical(kept, "group_id", key, linking.priority(F.col("source")), number, F.col("seq"))
    kind = F.when(relevance.is_survey(F.col("title"), F.col("abstract")), "survey").otherwise("paper")
    return named.withColumn("doc_type", kind).unionByName(rest.withColumns({"canonical_id": F.lit(""), "doc_type": F.lit("")}))


def run(rows: DataFrame, encoder: Encoder, *, manual: list[tuple[str, str]] = (), max_block: int | None = 50) -> Result:
    """The whole plan over a manifest (seq, source, source_id, title, authors, year, abstract, arxiv_id, arxiv_version, included, group_id)."""
    held = written(retrieval.embed(rows, encoder, text_col="abstract", out="vector", kind="array<double>"), "dedup-rows")
    grouped, merges = merged(held, fuzzy_merges(held, max_block), manual)
    done = written(typed(grouped), "dedup-done")
    kept = done.where("included")
    audit = written(linking.audit_groups(kept, id_col="seq", group_col="group_id", title_col="title", authors_col="authors", vector_col="vector"), "dedup-audit")
    near = written(linking.near_misses(kept, id_col="seq", title_col="title", authors_col="authors", group_col="group_id", max_block=max_block), "dedup-near")
    work = F.when(F.col("source") == "arxiv", F.col("arxiv_id")).otherwise(F.lit(""))
    return Result(done.drop("vector"), merges, audit, near, report(kept.withColumn("work", work), merges, audit, near))


def doubtful(audit: DataFrame) -> DataFrame:
    return audit.where((F.col("abstract_cosine") < LEAST_COSINE) | (F.col("author_overlap") == 0))


def report(kept: DataFrame, merges: DataFrame, audit: DataFrame, near: DataFrame) -> dict:
    """The counts of a run; each is an aggregate."""
    kinds = {r.kind: r.n_groups for r in linking.group_breakdown(kept, "group_id", "source", "work").collect()}
    groups, pairs = audit.agg(F.count_distinct("group"), F.count(F.lit(1))).first()
    total = kept.where("group_id <> ''").agg(F.count_distinct("group_id").alias("g"), F.count(F.lit(1)).alias("n")).first()
    breakdown = {"total_groups": total.g, "total_rows_in_groups": total.n} | {name: kinds.get(kind, 0) for name, kind in (("version_pair_only", "version_only"), ("cross_source_only", "cross_source"), ("both_version_and_cross_source", "both"), ("degenerate_single_member", "degenerate"), ("same_source_duplicate_other", "other"))}
    return {"n_groups_audited": groups, "n_pairs_audited": pairs, "n_low_confidence_merges": doubtful(audit).count(), "n_surveys_flagged": kept.where("doc_type = 'survey'").count(), "n_near_miss_pairs": near.count(), "n_fuzzy_merges": merges.count(), "group_breakdown": breakdown}


def audit_markdown(result: Result, most: int = 1000) -> str:
    """The report for a reader: the counts, and of each list the first ``most`` lines."""
    titles = result.rows.select("seq", "title")

    def lines(pairs: DataFrame, columns: list[str]) -> list[str]:
        shown = pairs.limit(most)
        both = shown.join(titles.select(F.col("seq").alias("sa"), F.col("title").alias("title_a")), F.col("a") == F.col("sa"), "left").join(titles.select(F.col("seq").alias("sb"), F.col("title").alias("title_b")), F.col("b") == F.col("sb"), "left")
        return ["- " + " ".join(f"{c}={r[c]}" for c in columns) + f" | A: {r.title_a} ({r.a}) | B: {r.title_b} ({r.b})" for r in both.orderBy("a", "b").collect()] or ["(none)"]

    counts = result.report
    out = ["# Audit of merges", "", *(f"- {k}: {v}" for k, v in counts.items() if k != "group_breakdown"), "", "## Groups", "", *(f"- {k}: {v}" for k, v in counts["group_breakdown"].items())]
    likeness = ["group", "title_sim", "author_overlap", "abstract_cosine"]
    for title, pairs, columns in (("Fuzzy merges", result.merges, ["group_id", "reason"]), ("Doubtful merges", doubtful(result.audit), likeness), ("All pairs within groups", result.audit, likeness), ("Near misses", result.near, ["title_sim", "author_overlap"])):
        out += ["", f"## {title}", "", *lines(pairs, columns)]
    return "\n".join(out) + "\n"
