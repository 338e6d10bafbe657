"""The pipeline's stages against plain versions, and on odd rows."""

import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import mixing, secret_scan
from quern.llm.common import written

from .test_operators import DOC, plain_classes, plain_spans


def rows_of(df):
    return [tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What goes into each stage and what comes out."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, docs, sf), name)
        out[name] = (docs, made)
        docs = made
    return out


def test_columns(stages):
    for name, (_, made) in stages.items():
        if name != "bpe_codec":
            assert made.columns == corpus_pipeline.COLUMNS
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scan", "mixing", "bpe_codec"]


def test_languages_keep_what_has_letters(stages):
    before, after = map(rows_of, stages["language_id"])
    assert sorted(after) == sorted(r for r in before if r[1] and any(c.isalpha() for c in r[1]))


def test_one_of_each_class(stages):
    before, after = map(rows_of, stages["near_duplicates"])
    classes = plain_classes([(r[0], r[1]) for r in before])
    assert sorted(after) == sorted(r for r, (c, _) in zip(before, classes) if r[0] == c)


def test_no_secret_is_left(stages):
    before, after = map(rows_of, stages["secret_scan"])
    assert [r[0] for r in sorted(before)] == [r[0] for r in sorted(after)]
    texts = {r[0]: r[1] for r in before}
    changed = 0
    for i, text, _, _, n in after:
        assert n == len(text)
        assert not plain_spans(text)
        if text != texts[i]:
            changed += 1
            assert secret_scan.MARK in text and plain_spans(texts[i])
    assert changed == sum(bool(plain_spans(t)) for t in texts.values())


def test_mix_repeats_what_it_takes(stages, spark, sf):
    before, after = stages["mixing"]
    taken = {r.doc_id: r.copies for r in mixing.mix(before, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert Counter(r[0] for r in rows_of(after)) == Counter({i: n for i, n in taken.items() if n})
    assert set(rows_of(after)) <= set(rows_of(before))


def test_tokens(stages):
    before, after = stages["bpe_codec"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in before.collect()}
    got = after.collect()
    assert len(got) == before.count() and all(r.ids == want[r.doc_id] and r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_odd_rows(spark, sf, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "a text of no id at all here", "en", None, 27), (3, "token = abcdef0123456789abcdef01", "en", "a", 32), (3, "token = abcdef0123456789abcdef01", "en", "a", 32), (4, "word " * 20_000, None, "b", 100_000), (5, "123", "fr", "b", 3)]
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, DOC).withColumn("key", F.lit(1)).write.parquet(str(tmp_path / "in/documents.parquet"))
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "in/labels.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path / "in")).collect()}
    assert set(got) <= {None, 3, 4} and all(r.round_trip for r in got.values())
    spark.createDataFrame([], DOC).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_marks_don_t_look_like_secrets():
    assert not plain_spans(secret_scan.MARK) and not re.search(secret_scan.TOKEN.replace("}+", "}"), secret_scan.MARK)
