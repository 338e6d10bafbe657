"""Catalog queries over whole tables: against brute force and whole-table SQL, not the catalog's own SQL."""

import difflib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quern.plans import catalog, oracles


def loaded(sf, name):
    return duckdb.sql(f"SELECT * FROM '{sf}/{name}.parquet'").fetchall()


def test_dense_topk_asks_all_ids_divisible_by_20(spark, sf):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, m = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)
    want = {}
    for i, q in zip(ids, m, strict=True):
        if i % 20 == 0:
            best = sorted(zip(-np.round(m @ q, 9), ids, strict=True))[:10]
            want[i] = [c for _, c in best]
    got = {}
    for r in sorted(catalog.dense_topk(spark, sf).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == want and max(want) > 20


def test_bootstrap_of_the_whole_table(spark, sf):
    """2,000 resamples of all rows, with the operator's draws in plain arithmetic."""
    sf = sf.replace("0.001", "0.01")
    d = np.array([float(e[0]) - float(e[1]) for e, in duckdb.sql(f"SELECT embedding FROM '{sf}/embeddings.parquet' ORDER BY vec_id").fetchall()])
    n, means = len(d), []
    for b in range(2000):
        x = (b * 48271 + np.arange(n, dtype=np.int64) * 69621 + 42) % 2147483647
        x = ((x + 1) * 16807) % 2147483647
        x = (x * 48271) % 2147483647
        means.append(d[np.floor((x * n) / 2147483647.0).astype(int)].mean())
    means.sort()
    r = catalog.bootstrap_ci(spark, sf).first()
    assert r.n == n > 200
    assert (r.mean_diff, r.ci_low, r.ci_high) == pytest.approx((d.mean(), means[50], means[1950]), abs=2e-6)


def whole_titles(name, folder):
    """The catalog's SQL of a linking query with the cut of titles taken out."""
    sql = oracles.ORACLE_SQL[name].replace("substr(title, 1, 24)", "title")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return sorted(map(str, con.execute(sql).fetchall()))


@pytest.mark.parametrize("name", ["link_groups", "canonical_pick", "group_breakdown", "unique_papers"])
def test_titles_link_whole(spark, sf, name):
    sf = sf.replace("0.001", "0.01")
    got = sorted(str(tuple(r)) for r in catalog.QUERIES[name](spark, sf).collect())
    assert got == whole_titles(name, sf)


def test_titles_alike_in_24_characters_stay_apart(spark, tmp_path):
    rows = [(1, "the same four and twenty letters here, A", "s", "en", 9), (2, "the same four and twenty letters here, B", "s", "en", 9), (3, "The same four and twenty letters here A", "t", "en", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.group_id for r in catalog.link_groups(spark, str(tmp_path)).collect()} == {1: "grp0001", 2: "", 3: "grp0001"}


def test_fuzzy_pairs_of_whole_titles(spark, tmp_path):
    """Against all pairs: titles alike only after character 120, or sharing only later words, count; those that differ there don't."""
    head, tail = "common heading words " * 6, " ".join(f"tail{i:04d}" for i in range(40))
    texts = [f"{head}{tail}", f"{head}{tail} more", head + " ".join(f"other{i:04d}" for i in range(40)), f"alpha beta gamma delta one {tail}", f"epsilon zeta theta kappa one {tail}", "short title", None, f"{head}{tail}\nand a second line"]
    spark.createDataFrame([(i, x, "s", "en", len(x or "")) for i, x in enumerate(texts)], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    titles = [(x or "").split("\n")[0] for x in texts]
    plain = [re.sub("[^a-z0-9]+", " ", x.lower()).strip() for x in titles]
    names = [set(re.findall("[a-z0-9]{4,}", x.lower())) for x in titles]
    sizes = Counter(w for x in names for w in x)
    want = {}
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            ratio = difflib.SequenceMatcher(None, plain[a], plain[b]).ratio()
            if len(names[a] & names[b]) >= 2 and any(sizes[w] <= 50 for w in names[a] & names[b]) and ratio >= 0.85:
                want[a, b] = (round(ratio, 9), round(len(names[a] & names[b]) / len(names[a] | names[b]), 9))
    got = {(r.a, r.b): (round(r.title_sim, 9), round(r.author_overlap, 9)) for r in catalog.fuzzy_title_pairs(spark, str(tmp_path)).collect()}
    assert got == want and (0, 1) in want and (0, 2) not in want and (3, 4) in want
