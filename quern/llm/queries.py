"""The queries of the training-data operators: each applies its operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe_codec, language_id, license_scan, lz_fingerprint, mixing, ngram_join, secret_scan, token_counts, topk_search, warc
from .oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    names = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["line"].cast("string"), x["license"])), ",")
    best = lambda c: F.round(F.array_max(F.transform(c, lambda x: x["dice"])), 6)
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), names("licenses").alias("licenses"), best("licenses").alias("best_dice"), names("notices").alias("notices"), best("notices").alias("best_notice"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.default_models(docs), keep=["doc_id"])
    counts = [secret_scan.count_kind(F.col("base_spans"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    added = (F.size("all_spans") - F.size("base_spans")).cast("long").alias("n_markov")
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(F.col("base_spans")), 256).alias("base_sha256"), secret_scan.listed(F.col("all_spans")).alias("spans"), added)


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("copies")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_lz_fingerprint, op3_license_scan, op4_bpe_codec, op5_ngram_join, op6_language_id, op7_warc, op8_secret_scan, op9_topk_search, op10_mixing)}
