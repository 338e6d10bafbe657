"""Cover trees, cells and large values of the top-k search."""

import numpy as np
import pytest

from quern.llm import topk_search


def walk(node):
    yield node
    for child in node.children:
        yield from walk(child)


def test_cover_tree_is_one():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(700, 8)) * 64)
    root, order = topk_search.cover_tree(x, leaf=10)
    assert sorted(order.tolist()) == list(range(700)) and len(topk_search.leaves(root)) > 30
    for node in walk(root):
        rows = x[order[node.start : node.end]]
        assert (np.sqrt(((rows - node.centre) ** 2).sum(1)) <= node.radius + 1e-9).all()
        assert (x == node.centre).all(1).any()
        if node.children:
            assert (node.children[0].centre == node.centre).all()
            centres = np.array([c.centre for c in node.children])
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + np.eye(len(centres)) * 1e9
            assert apart.min() >= max(c.radius for c in node.children) - 1e-9


def test_both_trees_are_walked():
    rng = np.random.default_rng(2)
    c = np.floor(np.repeat(rng.normal(size=(60, 16)) * 200, 20, 0) + rng.normal(size=(1200, 16)) * 3)
    q = np.floor(np.repeat(c[::20], 8, 0) + rng.normal(size=(480, 16)) * 2)
    known = np.full(len(q), topk_search.NONE)
    best, order, computed = topk_search.dual_search(q, -1 - np.arange(480), known, c, np.arange(1200), np.arange(1200), 5, leaf=16)
    want = -np.sort(-(q @ c.T), axis=1)[:, :5]
    assert (best.scores == want[order]).all() and computed < 0.3 * len(q) * len(c)
    # with the kth score known from elsewhere fewer are looked at, and nothing that counts is lost
    told, order, fewer = topk_search.dual_search(q, -1 - np.arange(480), want[:, -1].astype(np.int64), c, np.arange(1200), np.arange(1200), 5, leaf=16)
    assert (told.scores == want[order]).all() and fewer <= computed


def brute(x, every, k, ids=None):
    ids = list(range(len(x))) if ids is None else ids
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in zip(ids, x, strict=True) if j != i)
            out[i] = [(n, j, -s) for n, (s, j) in enumerate(scores[:k], 1)]
    return out


def got_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_queries_fill_several_leaves_and_blocks(spark):
    rng = np.random.default_rng(3)
    x = np.floor(np.repeat(rng.normal(size=(12, 6)) * 3, 50, 0) * 64 + rng.normal(size=(600, 6)) * 20).astype(int)
    df = spark.createDataFrame([(i, [float(v) / 64 for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute(x.tolist(), 2, 4)
    assert got_of(topk_search.top_k(df, every=2, k=4, block_rows=60, sample_rows=200, leaf=8)) == want
    assert got_of(topk_search.top_k(df, every=2, k=4, block_rows=40, sample_rows=1, leaf=8, queries_together=50)) == want


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(4)
    x = [[int(v) for v in r] for r in rng.integers(-(2**30), 2**30, size=(60, 5))]
    df = spark.createDataFrame([(i, [v / 64 for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute(x, 20, 20)
    assert max(abs(s) for v in want.values() for *_, s in v) > 2**53
    assert got_of(topk_search.top_k(df)) == want


def test_scores_beyond_64_bits_are_refused(spark):
    df = spark.createDataFrame([(i, [1e30, 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="62 bits"):
        topk_search.top_k(df).collect()
    df = spark.createDataFrame([(i, [2.0**40, 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk_search.top_k(df).collect()


def test_cells_are_pruned_before_the_shuffle():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(64, 16))
    centres *= 1000 / np.sqrt((centres**2).sum(1))[:, None]
    x = np.floor(np.repeat(centres, 100, 0) + rng.normal(size=(6400, 16)) * 3)
    nodes = topk_search.leaves(topk_search.cover_tree(x, leaf=150)[0])
    cells = topk_search.Cells(0, np.array([n.centre for n in nodes]), np.arange(6400), x)
    cell, far = cells.nearest(x)
    cells.radii = np.array([far[cell == i].max(initial=0) for i in range(len(nodes))])
    cells.blocks = np.bincount(cell, minlength=len(nodes))
    q = x[::20]
    reached, _ = cells.reached(q, cells.known(q, np.arange(0, 6400, 20), 20))
    assert reached.sum() < 0.1 * reached.size
