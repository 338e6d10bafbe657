"""Exact top-k inner products by dual-tree search over cover trees.

A cover tree is one over all rows, in two storeys. Its upper levels are built from
a bounded sample of the vectors (``sample_rows``); their lowest nodes are the cells.
Every row belongs to the cell of the nearest centre, and a cell's covering radius is
taken over all its rows. The lower levels are built by the task that gets a cell, or
a block of it where it has more than ``block_rows`` rows.

A query carries the worst score that its k best can have: first the kth best among
the sample, then the kth best of its most promising cell, which is searched by
itself. It is sent only to the cells that can reach that score, by the bound

    q.c <= q.cc + |q| r_c

with the centre cc and the covering radius r_c, so cells that can't are pruned before
anything is shuffled. In a task, queries are indexed by a cover tree too, and both
trees are walked together: a pair of nodes is pruned when no candidate below the one
can reach the worst kth score of any query below the other, by the bound

    q.c <= cq.cc + r_q |cc| + r_c |cq| + r_q r_c.

Candidates are shuffled once a round (there are two), and again for each
``queries_together`` queries that reach their cell. Scores are exact: sums of products
of integers, in doubles where all stay below 2**53, else in 64-bit integers; a score
beyond 64 bits is an error.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Vectors in a leaf of a tree, and the most children of a node.
LEAF, CHILDREN = 192, 32
#: The score of nothing: below all scores, and with a negative that is one.
NONE = -(2**63 - 1)


class Node:
    """A node of a cover tree: rows order[start:end] lie within ``radius`` of the point ``centre``."""

    __slots__ = ("centre", "centres", "children", "end", "norm", "norms", "radii", "radius", "start")

    def __init__(self, centre: np.ndarray, radius: float, start: int, end: int) -> None:
        self.centre, self.radius, self.start, self.end = centre, radius, start, end
        self.norm = float(np.sqrt(centre @ centre))
        self.children: list[Node] = []

    def close(self) -> None:
        """Puts the children's centres and radii together, to be bounded at once."""
        self.centres, self.radii = np.array([x.centre for x in self.children]), np.array([x.radius for x in self.children])
        self.norms = np.array([x.norm for x in self.children])


def cover_tree(x: np.ndarray, leaf: int = LEAF, base: float = 1.6, most_children: int = CHILDREN) -> tuple[Node, np.ndarray]:
    """A cover tree of the rows of x, and the order of rows in which each node is a range.

    Every centre is a row. A node's own centre is the first of its children's (nesting);
    the others are taken farthest first, until all rows of the node lie within radius /
    base of one of them, or ``most_children`` are taken. With s the distance that is left
    then, the children's centres are at least s apart (separation), and each row lies
    within s of the nearest, to which it belongs (covering), so s is the children's
    scale. A node of at most ``leaf`` rows, or of equal rows, is a leaf.
    """
    order = np.arange(len(x))
    if not len(x):
        return Node(np.zeros(x.shape[1]), 0.0, 0, 0), order
    first = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    root = Node(x[first], float(np.sqrt(((x - x[first]) ** 2).sum(1).max())), 0, len(x))
    stack = [root]
    while stack:
        node = stack.pop()
        n = node.end - node.start
        if n <= leaf or node.radius == 0:
            continue
        rows = order[node.start : node.end]
        points = x[rows]
        near = ((points - node.centre) ** 2).sum(1)
        owner, centres = np.zeros(n, np.int64), [node.centre]
        least = (node.radius / base) ** 2
        most = min(most_children, max(2, 2 * n // leaf))  # leaves stay large enough to be multiplied at once
        while len(centres) < most and near.max() > (least if len(centres) > 1 else 0):
            p = int(near.argmax())
            far = ((points - points[p]) ** 2).sum(1)
            closer = far < near
            owner[closer], near[closer] = len(centres), far[closer]
            centres.append(points[p])
        if len(centres) == 1:
            continue
        by_owner = np.argsort(owner, kind="stable")
        order[node.start : node.end] = rows[by_owner]
        at = node.start
        for j, size in enumerate(np.bincount(owner, minlength=len(centres)).tolist()):
            if size:
                child = Node(centres[j], float(np.sqrt(near[owner == j].max())), at, at + size)
                node.children.append(child)
                stack.append(child)
                at += size
        node.close()
    return root, order


def leaves(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.children:
            stack += node.children
        else:
            out.append(node)
    return out


def reaches(high, size, worst):
    """Whether a bound reaches a score; it may fall short by rounding, which grows with the product of the lengths (size). Equal scores count, as ties go to the smaller id."""
    return high + (size + np.abs(high)) * 1e-12 + 1e-6 >= worst


class Scores:
    """Inner products of rows of integers, exact."""

    def __init__(self, q: np.ndarray, c: np.ndarray) -> None:
        top = max(np.abs(q).max(initial=0), np.abs(c).max(initial=0))
        if not top < 2.0**62:
            raise OverflowError("a component is beyond 62 bits")
        self.small = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < 2.0**53
        self.q, self.c = q, c
        if not self.small:
            self.whole_q, self.whole_c = q.astype(np.int64), c.astype(np.int64)

    def get(self, a: np.ndarray, b: slice) -> np.ndarray:
        about = self.q[a] @ self.c[b].T
        if self.small:
            return about.astype(np.int64)
        # integers wrap modulo 2**64, so a score that is known to lie within is the true one
        within = np.sqrt((self.q[a] ** 2).sum(1))[:, None] * np.sqrt((self.c[b] ** 2).sum(1)) * 1e-12
        if (np.abs(about) + within >= 2.0**63).any():
            raise OverflowError("a score is beyond 64 bits")
        return self.whole_q[a] @ self.whole_c[b].T


class Best:
    """The k best of each query so far: scores falling, ties by id rising. ``known`` are scores that each query's kth is known to reach."""

    def __init__(self, known: np.ndarray, k: int) -> None:
        self.k, n = k, len(known)
        self.scores = np.full((n, k), NONE, np.int64)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.rows = np.full((n, k), -1)
        self.worst = known.astype(np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Scores of the queries ``at`` (rows) with candidates; only what reaches a query's kth is sorted."""
        better = (scores >= self.worst[at, None]) & (scores > NONE)
        some, cols = better.any(1), np.flatnonzero(better.any(0))
        if not len(cols):
            return
        at, scores, ids, rows = at[some], np.where(better, scores, NONE)[some][:, cols], ids[cols], rows[cols]
        s = np.concatenate([self.scores[at], scores], 1)
        i = np.concatenate([self.ids[at], np.broadcast_to(ids, scores.shape)], 1)
        r = np.concatenate([self.rows[at], np.broadcast_to(rows, scores.shape)], 1)
        pick = np.lexsort((r, i, -s), axis=1)[:, : self.k]
        self.scores[at], self.ids[at], self.rows[at] = (np.take_along_axis(v, pick, 1) for v in (s, i, r))
        self.worst[at] = np.maximum(self.worst[at], self.scores[at, -1])


def dual_search(q: np.ndarray, q_rows: np.ndarray, known: np.ndarray, c: np.ndarray, c_ids: np.ndarray, c_rows: np.ndarray, k: int, leaf: int = LEAF, candidates: tuple[Node, np.ndarray] | None = None) -> tuple[Best, np.ndarray, int]:
    """The k best candidates of each query but its own row; also the order of the queries and the number of scores computed.

    known: scores that each query's kth best is known to reach (NONE if nothing is
    known); candidates below it are left out. candidates: their tree, if it is there.
    """
    (q_root, q_order), (c_root, c_order) = cover_tree(q, leaf), candidates or cover_tree(c, leaf)
    q, q_rows = q[q_order], q_rows[q_order]
    c, c_ids, c_rows = c[c_order], c_ids[c_order], c_rows[c_order]
    lengths = np.sqrt((q * q).sum(1))
    best, exact, computed = Best(known[q_order], k), Scores(q, c), 0

    def bound(a: Node, b: Node) -> float:
        return float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius

    # pairs of nodes; once a leaf of queries is reached, its queries that are left (rows) instead of it
    stack: list[tuple[float, Node | np.ndarray, Node]] = [(bound(q_root, c_root), q_root, c_root)]
    while stack:
        high, a, b = stack.pop()
        if isinstance(a, Node):
            if not reaches(high, (a.norm + a.radius) * (b.norm + b.radius), float(best.worst[a.start : a.end].min())):
                continue
            if not a.children:
                stack.append((high, np.arange(a.start, a.end), b))
            elif not b.children or b.end - b.start <= a.end - a.start:
                stack += sorted(((bound(x, b), x, b) for x in a.children), key=lambda p: p[0])
            else:
                stack += sorted(((bound(a, x), a, x) for x in b.children), key=lambda p: p[0])  # the most promising is taken first
            continue
        # queries in hand bound a node each by its own product with the centre
        a = a[reaches(q[a] @ b.centre + lengths[a] * b.radius, lengths[a] * (b.norm + b.radius), best.worst[a])]
        if not len(a):
            continue
        if not b.children:
            theirs = slice(b.start, b.end)
            scores = exact.get(a, theirs)
            computed += scores.size
            scores[q_rows[a, None] == c_rows[None, theirs]] = NONE
            best.add(a, scores, c_ids[theirs], c_rows[theirs])
            continue
        highs = q[a] @ b.centres.T + lengths[a, None] * b.radii
        open_ = reaches(highs, lengths[a, None] * (b.norms + b.radii), best.worst[a, None])
        top = highs.max(0)
        stack += [(float(top[j]), a[open_[:, j]], b.children[j]) for j in np.argsort(top).tolist() if open_[:, j].any()]
    return best, q_order, computed


@dataclass
class Cells:
    """The cells of the vectors of one length: numbers from ``first`` on, and the sample they were made from."""

    first: int
    centres: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray
    radii: np.ndarray | None = None
    blocks: np.ndarray | None = None

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the cell of each vector, and the distance to its centre."""
        squares = (self.centres * self.centres).sum(1)
        at = np.concatenate([(squares - 2 * v[i : i + 1024] @ self.centres.T).argmin(1) for i in range(0, len(v), 1024)])
        return self.first + at, np.sqrt(((v - self.centres[at]) ** 2).sum(1))

    def known(self, v: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """A score that the kth best of each query reaches: the kth best of the sample, rows of the query's id left out."""
        if len(self.sample) < k:
            return np.full(len(v), NONE)
        scores = v @ self.sample.T
        scores[ids[:, None] == self.sample_ids] = -np.inf
        kth = np.partition(scores, len(self.sample) - k, axis=1)[:, len(self.sample) - k]
        lowered = np.floor(kth - np.where(np.abs(kth) < 2.0**50, 0, np.abs(kth) * 1e-9 + np.sqrt((v * v).sum(1) * (self.sample * self.sample).sum(1).max()) * 1e-12))
        return np.where(lowered > -(2.0**62), np.clip(lowered, -(2.0**62), 2.0**62), float(NONE)).astype(np.int64)

    def reached(self, v: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and cell whether the cell can reach the score; and the most promising cell."""
        lengths = np.sqrt((v * v).sum(1))[:, None]
        highs = v @ self.centres.T + lengths * self.radii
        norms = np.sqrt((self.centres * self.centres).sum(1))
        there = self.blocks > 0
        best = np.where(there, v @ self.centres.T, -np.inf).argmax(1)
        return reaches(highs, lengths * (norms + self.radii), known[:, None].astype(float)) & there, best


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, as doubles that hold integers."""
    return np.floor(x * scale)


def finite(vector: Column) -> Column:
    """Whether a vector is there and has no null or non-finite component."""
    return F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf")))), F.lit(False))


def by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector in the batch its rows, and their vectors."""
    v = batch.column(column)
    sizes, flat = np.asarray(pc.list_value_length(v)), np.asarray(v.flatten(), dtype=np.float64)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield rows, flat[starts[rows][:, None] + np.arange(dim)].reshape(len(rows), dim)


def fit_cells(rows: DataFrame, scale: float, block_rows: int, sample_rows: int, sample_bytes: int = 32 << 20) -> dict[int, Cells]:
    """Cells for each length of vector, from a sample of about ``sample_rows`` rows (fewer where they have more than ``sample_bytes``)."""
    sizes = {r["dim"]: r["n"] for r in rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n, wanted = sum(sizes.values()), min(sample_rows, sample_bytes // (8 * max(1, *sizes, 1)) + 1)
    share = min(1.0, (wanted + 20) / max(1, n))
    h = F.xxhash64("vec_id", "x")
    # equal rows count once, so the bound holds however often a row is repeated
    drawn = rows.where(F.pmod(h, F.lit(1 << 40)) < int(share * (1 << 40))).groupBy(h.alias("h")).agg(F.first("vec_id").alias("vec_id"), F.first("x").alias("x")).toArrow()
    by_dim = {}
    for batch in drawn.combine_chunks().to_batches():
        ids = np.asarray(batch.column("vec_id"))
        for at, x in by_length(batch, "x"):
            by_dim[x.shape[1]] = (ids[at], integers(x, scale))
    out, first = {}, 0
    for dim in sorted(sizes):
        ids, sample = by_dim.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
        order = np.argsort(ids, kind="stable")
        ids, sample = ids[order], sample[order]
        centres = np.zeros((1, dim))
        if len(sample) and np.abs(sample).max(initial=0) < 2.0**62:
            nodes = leaves(cover_tree(sample, leaf=max(4, len(sample) * block_rows // max(1, sizes[dim])))[0])
            centres = np.array([x.centre for x in nodes])
        out[dim] = Cells(first, centres, ids, sample)
        first += len(centres)
    return out


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, scale: float = 64.0, block_rows: int = 8192, sample_rows: int = 4096, queries_together: int = 65_536, leaf: int = LEAF) -> DataFrame:
    """The k highest scores of each query among all other rows: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but
    the query's own (a repeated id is another row). Ties go to the smaller id. Rows with
    a null id, or with a vector that is null or holds null or non-finite components,
    take no part; vectors of different length have no product, so each length is
    searched by itself. Fewer than k candidates give fewer rows; no query, none; an
    empty table an empty one. A scaled component of 2**62 or more that is multiplied,
    or a score beyond 64 bits, raises OverflowError.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & finite(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    cells = fit_cells(rows, scale, block_rows, sample_rows)
    shipped = spark.sparkContext.broadcast(pickle.dumps(cells))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, Cells] = pickle.loads(shipped.value)
        for batch in batches:
            ids = np.asarray(batch.column("vec_id"))
            for at, x in by_length(batch, "x"):
                own, v = cells[x.shape[1]], integers(x, scale)
                cell, far = own.nearest(v)
                asked = ids[at] % every == 0
                known = np.full(len(at), NONE)
                if asked.any():
                    known[asked] = own.known(v[asked], ids[at][asked], k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), vector_array(v), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(asked), pa.array(known)], names=["vec_id", "v", "cell", "far", "asked", "known"])

    # a row's number tells repeated ids and vectors apart; it is fixed as it is written
    placed = written(rows.mapInArrow(place, "vec_id long, v array<double>, cell int, far double, asked boolean, known long").withColumn("row", F.monotonically_increasing_id()), "topk-cells")
    stats = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    for own in cells.values():
        there = [stats.get(own.first + i) for i in range(len(own.centres))]
        own.radii = np.array([r["far"] * (1 + 1e-9) if r else 0.0 for r in there])
        own.blocks = np.array([-(-r["n"] // block_rows) if r else 0 for r in there])
    queries = placed.where("asked").select("vec_id", "row", "v", "known", "cell")
    rank = F.row_number().over(W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "row"))
    best = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k)
    first = written(best(search(placed, queries, cells, k, leaf, queries_together, lambda open_, best: open_ & (np.arange(open_.shape[1]) == best[:, None]))), "topk-first")
    kth = first.where(F.col("rank") == k).select("query_row", F.col("score").alias("kth"))
    better = queries.join(kth, F.col("row") == F.col("query_row"), "left").select("vec_id", "row", "v", F.greatest("known", F.coalesce("kth", F.lit(NONE))).alias("known"), "cell")
    # the most promising cell depends on the query alone, so it is the same one as before
    rest = search(placed, better, cells, k, leaf, queries_together, lambda open_, best: open_ & (np.arange(open_.shape[1]) != best[:, None]))
    return best(first.drop("rank").unionByName(rest)).select("query_id", "rank", "vec_id", "score")


def search(placed: DataFrame, queries: DataFrame, cells: dict[int, Cells], k: int, leaf: int, queries_together: int, chosen: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Each query's k best of the cells that are ``chosen`` of (cells it can reach, its most promising cell): query_id, query_row, vec_id, row, score."""
    spark = placed.sparkSession
    shipped = spark.sparkContext.broadcast(pickle.dumps(cells))
    blocks = {own.first + i: int(n) for own in cells.values() for i, n in enumerate(own.blocks)}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        cells: dict[int, Cells] = pickle.loads(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                known = np.asarray(part.column("known"))
                for rows, v in by_length(part, "v"):
                    own = cells[v.shape[1]]
                    which, cell = np.nonzero(chosen(*own.reached(v, known[rows])))
                    yield part, rows[which], (own.first + cell).astype(np.int32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, cell in dealt(batches):
            there, n = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n)], names=["cell", "n"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, cell in dealt(batches):
            for i in range(0, len(rows), 8192):
                sent = part.take(pa.array(rows[i : i + 8192]))
                yield pa.RecordBatch.from_arrays([sent.column(n) for n in ("vec_id", "row", "v", "known", "cell")] + [pa.array(cell[i : i + 8192])], names=["vec_id", "row", "v", "known", "home", "cell"])

    asked = {r["cell"]: r["n"] for r in queries.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    out = "query_id long, query_row long, vec_id long, row long, score long"
    if not asked:
        return spark.createDataFrame([], out)
    # by cell, folded into one literal
    number = lambda of: F.element_at(F.split(F.lit(",".join(str(of.get(i, 0)) for i in range(len(blocks)))), ",").cast("array<long>"), F.col("cell") + 1)
    parts = {c: -(-n // queries_together) for c, n in asked.items()}
    block = F.pmod(F.xxhash64("row"), F.greatest(F.lit(1), number(blocks))).cast("int")
    candidates = placed.where(number(parts) > 0).select("cell", block.alias("block"), F.explode(F.sequence(F.lit(0), number(parts) - 1)).alias("part"), F.lit(False).alias("asked"), F.lit(0).alias("home"), "vec_id", "row", "v", F.lit(NONE).alias("known"))
    sent = queries.select("vec_id", "row", "v", "known", "cell").mapInArrow(send, "vec_id long, row long, v array<double>, known long, home int, cell int")
    sent = sent.select("cell", F.explode(F.sequence(F.lit(0), number(blocks) - 1)).alias("block"), F.pmod(F.xxhash64("row"), number(parts)).cast("int").alias("part"), F.lit(True).alias("asked"), "home", "vec_id", "row", "v", "known")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, waiting, tree = None, [], [], None

        def flush() -> pa.RecordBatch:
            nonlocal tree, waiting
            asked = pa.Table.from_batches(waiting)
            waiting = []
            if tree is None:
                table = pa.Table.from_batches(held)
                v = vectors_of(table)
                tree = (v, np.asarray(table.column("vec_id")), np.asarray(table.column("row")), cover_tree(v, leaf))
            c, c_ids, c_rows, built = tree
            ids, rows = np.asarray(asked.column("vec_id")), np.asarray(asked.column("row"))
            best, order, _ = dual_search(vectors_of(asked), rows, np.asarray(asked.column("known")), c, c_ids, c_rows, k, leaf, built)
            found = best.rows >= 0
            at = order[np.nonzero(found)[0]]
            return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(rows[at]), pa.array(best.ids[found]), pa.array(best.rows[found]), pa.array(best.scores[found])], names=["query_id", "query_row", "vec_id", "row", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("cell", "block", "part", "asked")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges, edges[1:], strict=False):
                *key, is_asked = keys[:, start].tolist()
                if key != unit:
                    if waiting and held:
                        yield flush()
                    unit, held, waiting, tree = key, [], [], None
                piece = batch.slice(start, end - start)
                if not is_asked:
                    held.append(piece)
                    continue
                waiting.append(piece)
                if held and sum(x.num_rows for x in waiting) >= 4096:
                    yield flush()
        if waiting and held:
            yield flush()

    units = candidates.unionByName(sent).repartition("cell", "block", "part").sortWithinPartitions("cell", "block", "part", "asked", "home", "row")
    return units.mapInArrow(work, out)


def vector_array(v: np.ndarray) -> pa.Array:
    ends = pa.array(np.arange(0, v.size + 1, v.shape[1]) if v.shape[1] else np.zeros(len(v) + 1), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(v).reshape(-1)))


def vectors_of(table: pa.Table) -> np.ndarray:
    return np.asarray(table.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))
