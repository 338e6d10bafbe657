"""The pipeline's mixing stage on repeated and null ids: each row by its own copies."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import mixing

from .test_operators import DOC


def test_rows_of_one_id_have_their_own_copies(spark, tmp_path):
    rows = [(None if i % 3 == 0 else i % 5 if i % 3 == 1 else 1000 + i, f"w{i} " * (i % 40 + 1), "en", ["a", "b", "c", "d", None][i * i % 5 if i < 150 else 2], 2) for i in range(200)]
    rows += [(7, "the same row again", "en", "b", 4)] * 3
    docs = spark.createDataFrame(rows, DOC)
    spark.createDataFrame([(1, 1, 0), (1001, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    mixed = mixing.mix(docs, spark.read.parquet(str(tmp_path / "labels.parquet")), carry=("text", "source")).collect()
    want = Counter()
    for r in mixed:
        want[r.doc_id, r.source, r.text] += r.copies
    for key in (None, 1):
        assert len({r.copies for r in mixed if r.doc_id == key}) > 1
    got = corpus_pipeline.mixture(spark, docs, str(tmp_path))
    assert Counter((r.doc_id, r.source, r.text) for r in got.collect()) == +want
    words = {r.source: r.n for r in got.groupBy("source").agg(F.sum(mixing.size_in_words(F.col("text"))).alias("n")).collect()}
    for r in mixed:
        assert words.get(r.source, 0) <= r.target + 40
