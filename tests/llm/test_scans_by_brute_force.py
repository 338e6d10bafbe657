"""Predictions of the language filters and spans of the Markov models against plain versions of both."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import language_id, license_scan, ngram_join, secret_scan
from quern.llm.common import bounded_sample

M = (1 << 64) - 1


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & M
    return x ^ x >> 31


def plain_prediction(filters, text):
    """Bit by bit, n-gram by n-gram."""
    if not text or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    data = re.sub(rb"[^a-z\x80-\xff]+", b" ", (" " + text.lower() + " ").encode())
    grams = [int.from_bytes(data[j : j + filters.n], "big") for j in range(len(data) - filters.n + 1)]
    shares = []
    for i in range(len(filters.languages)):
        slots, bit, held = filters.slots[i // 64], i % 64, 0
        for g in grams:
            x = mixed(g)
            places = [(x + j * ((x >> 32) | 1) & M) % len(slots) for j in range(filters.hashes)]
            held += all(int(slots[p]) >> bit & 1 for p in places)
        chance = filters.false_rate[i]
        share = max(0.0, (held - chance * len(grams)) / (1 - min(chance, 0.99)))
        shares.append(min(1.0, share / len(grams)) if grams else 0.0)
    best = max(range(len(shares)), key=lambda i: (shares[i], -i))
    return filters.languages[best], shares[best] / sum(shares) if sum(shares) else 0.0


def test_prediction_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    filters = language_id.train(docs)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 !"), (-4, "Ünïcode straße"), (-5, "a"), (-6, "the " * 20_000)], "doc_id long, text string")
    some = docs.select("doc_id", "text").where("length(text) < 3000").unionByName(odd).withColumn("lang_pred", F.lit("x"))
    got = {r.doc_id: r for r in language_id.predict(some, filters).collect()}
    for r in some.collect():
        lang, score = plain_prediction(filters, r.text)
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=1e-9)


def test_learned_grams_by_brute_force(spark):
    rows = [(i, "der hund und der baum" if i % 2 else "the dog and the tree", "de" if i % 2 else "en", None) for i in range(40)] + [(50, None, "en", 1), (None, "la la", "fr", 1), (51, "x y", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int").withColumn("h", F.lit(1))
    filters = language_id.train(docs, least_ratio=0.5)
    assert sorted(filters.languages) == ["de", "en"]
    counts = {lang: {} for lang in filters.languages}
    for lang, text in (("de", "der hund und der baum"), ("en", "the dog and the tree")):
        data = (" " + text + " ").encode()
        for j in range(len(data) - 3):
            g = int.from_bytes(data[j : j + 4], "big")
            counts[lang][g] = counts[lang].get(g, 0) + 1
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    for i, lang in enumerate(filters.languages):
        for g, p in share[lang].items():
            if p >= 0.5 * max(s.get(g, 0) for s in share.values()):
                assert int(filters.masks(np.array([g], np.uint64))[0][0]) >> i & 1


def test_sample_is_bounded_whatever_is_repeated(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    hot = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same").alias("text"))
    got = [bounded_sample(x, "doc_id", "text", 100).collect() for x in (rows.unionByName(hot), rows.unionByName(hot).repartition(7))]
    assert sorted(got[0]) == sorted(got[1]) and 40 <= len(got[0]) <= 100  # the hot row counts in the share
    assert bounded_sample(hot, "doc_id", "text", 100).count() <= 1 and bounded_sample(rows.limit(0), "doc_id", "text", 100).count() == 0


def plain_spans(text, models, least=14.0):
    text, k, out = text or "", len(secret_scan.ALPHABET), []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    added = []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]+", text):
        at = [secret_scan.ALPHABET.index(c) for c in m.group()]
        ratio = math.fsum(float(f"{models.ratios[a * k + b]:.6f}") for a, b in zip(at, at[1:], strict=False))
        if len(at) >= 20 and ratio >= least and not any(b[0] < m.end() and m.start() < b[2] for b in out):
            added.append((m.start(), 3, m.end()))
    return sorted(out), sorted(out + added)


def plain_redacted(text, spans):
    covered = [False] * len(text)
    for a, _, b in spans:
        covered[a:b] = [True] * (b - a)
    marks = {a for a, _, _ in spans if all(not (s < a < e) for s, _, e in spans)}
    return "".join((secret_scan.MARK if i in marks else "") + ("" if covered[i] else c) for i, c in enumerate(text))


def test_spans_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    models = secret_scan.default_models(docs)
    rng = random.Random(4)
    token = lambda n: "".join(rng.choice(secret_scan.ALPHABET) for _ in range(n))
    made = [(-1, None), (-2, ""), (-3, "ü" * 30 + " " + token(40) + " token=" + token(30)), (-4, " ".join(token(rng.randrange(15, 40)) for _ in range(300))), (-5, "token=AKIA" + "A" * 20 + " " + "0123456789abcdef" * 3), (-6, "-".join(["0123456789abcdef01234567"] * 9))]
    some = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string")).withColumn("__text", F.lit(1)).withColumn("__tokens", F.lit(2))
    found = secret_scan.scan(some, models).withColumn("clean", secret_scan.redacted(F.coalesce("text", F.lit("")), F.col("all_spans")))
    added = 0
    for r in found.collect():
        base, spans = plain_spans(r.text, models)
        assert [tuple(s) for s in r.base_spans] == base and [tuple(s) for s in r.all_spans] == spans
        assert r.clean == plain_redacted(r.text or "", spans)
        added += len(spans) > len(base)
    assert added >= 2


def test_many_matches_take_little_longer(spark):
    text = " ".join(f"{i:024x}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    models = secret_scan.Models(tuple([0.0] * 66**2))
    row = secret_scan.scan(docs, models).select(F.size("base_spans").alias("n"), F.element_at("base_spans", -1).alias("last")).first()
    assert row.n == 20_000 and row.last.start == 25 * 19_999


def test_clashing_names(spark):
    names = ("kept", "__name", "__text", "__t", "__tokens", "__asked", "name", "key", "copy")
    docs = spark.createDataFrame([(1, "a b c d e f token=abcdef1", "en"), (2, "a b c d e f token=abcdef1", "en"), (3, "Licensed under the MIT License.", "en")], "doc_id long, text string, lang string").withColumns({n: F.lit(n) for n in names})
    assert {r.doc_id for r in ngram_join.keep_one(docs).collect()} == {1, 3} and set(names) < set(ngram_join.keep_one(docs).columns)
    assert secret_scan.scan(docs, secret_scan.Models(tuple([0.0] * 66**2))).where("__text = '__text' and size(base_spans) = 1").count() == 2
    assert license_scan.scan(docs).where("kept = 'kept' and size(licenses) = 1").count() == 1
    assert language_id.predict(docs, language_id.train(docs)).where("__text = '__text'").count() == 3
    assert language_id.identify(docs).count() == 3


def test_chains_are_joined_by_bucket(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    # each text differs from the next in few words, so all hang together and most pairs aren't alike
    texts, now = [], [rng.choice(words) for _ in range(120)]
    for _ in range(150):
        now = [rng.choice(words) if rng.random() < 0.015 else w for w in now]
        texts.append(" ".join(now))
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, texts[0]), (201, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    want = {i: sum(len(a & b) >= 0.8 * len(a | b) for k, b in sets.items() if k != i) for i, a in sets.items()}
    by_component = {r.doc_id: r for r in ngram_join.join(docs, block_rows=16, most_blocks=100).collect()}
    by_bucket = {r.doc_id: r for r in ngram_join.join(docs, block_rows=16, most_blocks=1).collect()}
    assert by_component == by_bucket
    assert {i: r.n_links for i, r in by_bucket.items()} == want and sum(want.values()) > 300


def test_many_rows_without_ids(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit(7).cast("long")).alias("doc_id"), F.concat(F.lit("a b c d e f g "), (F.col("id") % 5000).cast("string")).alias("text"))
    got = ngram_join.join(rows).groupBy("n_copies", "n_text_links").count().collect()
    assert [tuple(r) for r in got] == [(4, 0, 20_000)]
