"""The corpus pipeline: five stages from documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and
read again as the docs of the next. All but the last return the columns of
documents; each works on all rows that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm import bpe_codec, language_id, mixing, ngram_join, secret_scan
from quern.llm.common import discard, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Least share of a text's n-grams that its language must hold, where the text has so many characters that the share says something.
LEAST_COVERAGE, LEAST_CHARS = 0.1, 200


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and long ones of which no learned language holds a tenth of the n-grams.

    Where nothing could be learned (no row with text and lang) only the first go.
    """
    filters = language_id.train(docs)
    judged = language_id.predict(docs.select(*COLUMNS), filters)
    if not filters.languages:
        return judged.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).select(*COLUMNS)
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & ((F.col("coverage") >= LEAST_COVERAGE) | (F.length("text") < LEAST_CHARS))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near duplicates the row of the least doc_id, of equal rows one. Documents without words stay."""
    return ngram_join.keep_one(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of each secret; documents stay, n_chars is counted anew where a text changed."""
    found = secret_scan.scan(docs.select(*COLUMNS), secret_scan.default_models(docs))
    text = F.when(F.size("all_spans") > 0, secret_scan.redacted(F.col("text"), F.col("all_spans"))).otherwise(F.col("text"))
    n_chars = F.when(F.size("all_spans") > 0, F.length("clean").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("clean", text).select("doc_id", F.col("clean").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; those that it doesn't take go.

    Rows meet their copies by a digest of all columns, as ids may be repeated or null.
    Rows equal in all of them are one, repeated by the sum of their copies.
    """
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("null"))
    named = docs.select(*COLUMNS, F.sha2(F.concat(*map(part, COLUMNS)), 256).alias("row_name"))
    taken = mixing.mix(named, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("row_name",)).where("copies > 0")
    copies = taken.groupBy(F.col("row_name").alias("taken_name")).agg(F.sum("copies").alias("copies"))
    single = named.withColumn("nth", F.row_number().over(W.partitionBy("row_name").orderBy("row_name"))).where("nth = 1")
    met = single.join(copies, F.col("row_name") == F.col("taken_name"))
    return met.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    done = bpe_codec.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id", "lang", "source"], decoded=None, same="round_trip")
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("language_id", languages), ("near_duplicates", near_duplicates), ("secret_scan", secrets), ("mixing", mixture), ("bpe_codec", tokens)]

#: No SQL: n-gram filters and merges can't be expressed in it; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again; the last but one stays there, as the result is read from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
