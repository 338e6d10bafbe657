"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of shingles of five words. Texts that fall into one bucket of any
band of their MinHash values are candidates. A pair's MinHash values are
compared some at a time, and it is dropped as soon as the posterior probability
that its likeness reaches the threshold, given the matches so far and an even
prior, falls below the tolerance. What remains is verified on the shingle sets.

The steps, none of which emits the pairs of a group:

1. Each text gets a key (equal word sequences have equal keys) and its MinHash
   values; copies are counted at one representative.
2. Buckets of two or more representatives are compared; a bucket beyond
   ``block_rows`` is cut into blocks, and each pair of blocks is a unit of work. A
   unit returns a spanning forest of the pairs that pass.
3. The components of those forests hold all pairs that pass. The pairs of a component
   that share a bucket are compared once more, in blocks too, now with the shingle
   sets: a unit returns, for each text, its number of verified links and an edge of a
   spanning forest. A component of more than 24 blocks is dealt by bucket instead, so
   that chains of many texts are not compared with all of their component; a pair
   counts in the first band whose bucket it shares.
4. The components of the verified edges are the classes.

Shingle sets are of 64-bit hashes. What is lost: with 24 bands of 4 values a pair of
likeness 0.8 is no candidate with probability 3.2e-6 (0.9: 1e-11), and the posterior
drops it with probability 7.1e-5 (tolerance 1e-5, a look every 16 of 96 values; 0.9:
2.7e-8), both for independent MinHash values, which the linear hashes of this module
come near to. A lost pair costs a link; its texts stay in one class if others join them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import POWERS, discard, field, fresh, map_texts, mix64, written
from .components import components

WORDS = 5
BANDS, ROWS = 24, 4
VALUES = BANDS * ROWS
#: MinHash values compared between two looks at the posterior.
STEP = 16
SPACE = np.isin(np.arange(256), [0, 9, 10, 11, 12, 13, 32])
_rng = np.random.default_rng(20240501)
FACTORS = _rng.integers(0, 1 << 32, VALUES, np.uint32) | np.uint32(1)
OFFSETS = _rng.integers(0, 1 << 32, VALUES, np.uint32)
PLACES = [np.uint64(pow(0xD6E8FEB86659FD93, j, 1 << 64)) for j in range(WORDS + 1)]


def shingles(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Shingle hashes of the texts in order, the number of the text of each, and the texts' keys.

    Words are lower-cased runs of anything but ASCII white space. A text of fewer than
    n words has one shingle of all of them; one without words has none, and no key.
    """
    joined = "\0".join(x.replace("\0", " ") for x in texts).lower() + "\0"
    data = np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)
    up, down = POWERS.upto(len(data) + 1)
    space = SPACE[data]
    inside = ~space
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    codes = data.astype(np.uint64)
    codes += np.uint64(1)
    codes *= up[: len(data)]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes, out=sums[1:])
    words = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    stops = np.flatnonzero(data == 0)
    first = np.searchsorted(starts, np.concatenate([[0], stops[:-1]]) if len(stops) else [])
    last = np.searchsorted(starts, stops)
    count = last - first
    raw = words.tobytes()
    keys = [hashlib.md5(raw[8 * a : 8 * b]).digest() if b > a else None for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + first[owner]
    length = np.minimum(count, n)[owner]
    hashes = np.zeros(len(owner), np.uint64)
    for j in range(n):
        there = length > j
        hashes[there] += words[at[there] + j] * PLACES[j]
    return mix64(hashes + length.astype(np.uint64)), owner, keys


def signatures(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """MinHash values, a row for each of n texts (zeros for one without shingles)."""
    out = np.zeros((n, VALUES), np.uint32)
    if len(hashes):
        there, starts = np.unique(owner, return_index=True)
        high = (hashes >> np.uint64(32)).astype(np.uint32)
        for k in range(VALUES):
            out[there, k] = np.minimum.reduceat(high * FACTORS[k] + OFFSETS[k], starts)
    return out


def buckets(values: np.ndarray) -> np.ndarray:
    """For each text and band a 64-bit hash of the band's number and its values."""
    out = np.zeros((len(values), BANDS), np.uint64)
    for b in range(BANDS):
        mixed = np.full(len(values), b, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            mixed = mix64(mixed * np.uint64(31) + values[:, k])
        out[:, b] = mixed
    return out


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each number n of compared values the matches below which a pair is dropped.

    With an even prior and m of n matches the likeness has the Beta distribution (m + 1,
    n - m + 1), which exceeds t with the probability that a binomial variable of n + 1
    draws with chance t is at most m.
    """
    out = []
    for n in range(VALUES + 1):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance or m > n:
                break
            m += 1
        out.append(m)
    return out


def surviving(values: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of rows of ``values`` that the posterior doesn't drop."""
    matches = np.zeros(len(a), np.int64)
    for k in range(0, VALUES, STEP):
        matches += (values[a, k : k + STEP] == values[b, k : k + STEP]).sum(1)
        keep = matches >= least[min(VALUES, k + STEP)]
        if not keep.all():
            a, b, matches = a[keep], b[keep], matches[keep]
        if not len(a):
            break
    return a, b


def pair_chunks(side: np.ndarray, i: int, j: int, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a unit's rows, some at a time: within a block, or between two."""
    if i == j:
        n = len(side)
        row = 0
        while row < n - 1:
            upto = row + 1
            while upto < n - 1 and (upto - row + 1) * (n - row) <= most:
                upto += 1
            a = np.repeat(np.arange(row, upto), n - 1 - np.arange(row, upto))
            yield a, np.concatenate([np.arange(r + 1, n) for r in range(row, upto)])
            row = upto
    else:
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        step = max(1, most // max(1, len(right)))
        for at in range(0, len(left), step):
            part = left[at : at + step]
            yield np.repeat(part, len(right)), np.tile(right, len(part))


class Forest:
    """Joins rows of a unit; roots are the least rows."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def thin(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges with the same components: by rounds of taking over the least label, so that few remain for the forest."""
    if len(a) <= 4 * n:
        return a, b
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            rows = np.flatnonzero(label != np.arange(n))
            return rows, label[rows]
        label = new


def units(df: DataFrame, group: str, blocks: Column, key: Column) -> DataFrame:
    """Deals the rows of a group into pairs of blocks: a row for each pair (i, j) that needs it, with its own block as side."""
    side = F.pmod(F.xxhash64(key, F.lit(3)), blocks).cast("int")
    dealt = df.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    return dealt.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("other").repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def by_unit(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.Table]:
    """The rows of one unit after the other from batches sorted by unit."""
    waiting: list[pa.RecordBatch] = []
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = list(zip(batch.column(group).to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True))
        start = 0
        for r in range(1, len(names) + 1):
            if r == len(names) or names[r] != names[start]:
                if held is not None and names[start] != held:
                    yield pa.Table.from_batches(waiting)
                    waiting = []
                waiting.append(batch.slice(start, r - start))
                held, start = names[start], r
    if waiting:
        yield pa.Table.from_batches(waiting)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, VALUES)


def row_name(id_: Column, text: Column) -> Column:
    """A digest that rows share only if both id and text are equal."""
    return F.md5(F.concat_ws("|", F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit("-")), F.coalesce(F.md5(text), F.lit("-"))))


def prepare(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, name (a digest of id and text), bytes, key, values (16 bits of each MinHash value) and bands of each row; the last three null where a text has no words."""

    def make():
        def apply(texts):
            hashes, owner, keys = shingles(texts)
            values = signatures(hashes, owner, len(texts))
            short = ((values * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")
            bands = buckets(values).astype("<u8")
            rows = range(len(texts))
            return [pa.array(keys, pa.binary()), pa.array([short[i].tobytes() if keys[i] else None for i in rows], pa.binary()), pa.array([bands[i].tobytes() if keys[i] else None for i in rows], pa.binary())]

        return apply

    named = docs.select(F.col(id_col).alias("id"), row_name(F.col(id_col), F.col(text_col)).alias("name"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("bytes"), F.col(text_col).alias("__t"))
    return map_texts(named, ["id", "name", "bytes"], "__t", [field("key", T.BinaryType()), field("values", T.BinaryType()), field("bands", T.BinaryType())], make)


def shared_buckets(reps: DataFrame, blocks: Column) -> DataFrame:
    """bucket, band, of (a key) and blocks for each text and each of its buckets that another text shares; blocks may use n and bytes of a bucket."""
    in_bands = reps.select("key", "bands", "bytes", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).select("key", "bytes", "band", F.substring("bands", F.col("band") * 8 + 1, F.lit(8)).alias("bucket"))
    # partial counts before the shuffle; most buckets have one row and go no further
    shared = in_bands.groupBy(F.col("bucket").alias("shared")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).where("n > 1").select("shared", blocks.alias("blocks"))
    return in_bands.join(shared, F.col("bucket") == F.col("shared")).select("bucket", "band", F.col("key").alias("of"), "blocks")


def candidate_edges(reps: DataFrame, least: list[int], block_rows: int) -> DataFrame:
    """Edges (u, v) of spanning forests of the pairs that share a bucket and pass."""
    kept = shared_buckets(reps, F.ceil(F.col("n") / F.lit(block_rows)))
    # the MinHash values join late: only for the few rows of shared buckets
    members = kept.join(reps.select("key", "values"), F.col("of") == F.col("key")).select("bucket", "key", "values", "blocks")
    dealt = units(members, "bucket", F.col("blocks"), F.col("key")).select("bucket", "i", "j", "side", "key", "values")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_u: list[bytes] = []
        out_v: list[bytes] = []

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out_u, pa.binary()), pa.array(out_v, pa.binary())], names=["u", "v"])
            out_u.clear()
            out_v.clear()
            return batch

        for unit in by_unit(batches, "bucket"):
            if unit.num_rows < 2:
                continue
            keys, values = unit.column("key").to_pylist(), matrix(unit.column("values"))
            i, j = unit.column("i")[0].as_py(), unit.column("j")[0].as_py()
            forest = Forest(len(keys))
            for a, b in pair_chunks(np.asarray(unit.column("side")), i, j):
                forest.join(*thin(len(keys), *surviving(values, a, b, least)))
            for r in range(len(keys)):
                if (top := forest.root(r)) != r:
                    out_u.append(keys[r])
                    out_v.append(keys[top])
            if len(out_u) > 10_000:
                yield emit()
        if out_u:
            yield emit()

    return dealt.mapInArrow(work, "u binary, v binary")


def matching_bands(bands: np.ndarray, a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Whether the pairs share a bucket; in the bucket of ``band`` whether it is the first that they share."""
    if band < 0:
        found = np.zeros(len(a), bool)
        for k in range(BANDS):
            found |= bands[a, k] == bands[b, k]
        return found
    found = bands[a, band] == bands[b, band]
    for k in range(band):
        found &= bands[a, k] != bands[b, k]
    return found


def verified_links(members: DataFrame, threshold: float, least: list[int]) -> DataFrame:
    """For each text of a unit with links: key, text_links, doc_links and anchor, a text of its verified component."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in by_unit(batches, "unit"):
            n = unit.num_rows
            if n < 2:
                continue
            hashes, owner, _ = shingles([x or "" for x in unit.column("text").to_pylist()])
            ends = np.searchsorted(owner, np.arange(n + 1))
            sets = [np.unique(hashes[ends[r] : ends[r + 1]]) for r in range(n)]
            keys, copies = unit.column("key").to_pylist(), np.asarray(unit.column("copies"))
            values, side = matrix(unit.column("values")), np.asarray(unit.column("side"))
            bands = np.frombuffer(b"".join(unit.column("bands").to_pylist()), "<u8").reshape(-1, BANDS)
            i, j, band = (unit.column(c)[0].as_py() for c in ("i", "j", "band"))
            size = np.array([len(s) for s in sets])
            text_links, doc_links = np.zeros(n, np.int64), np.zeros(n, np.int64)
            forest, common = Forest(n), None
            for a, b in pair_chunks(side, i, j):
                # sizes alone bound the likeness
                fit = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
                a, b = surviving(values, a[fit], b[fit], least)
                fit = matching_bands(bands, a, b, band)
                a, b = a[fit], b[fit]
                if not len(a):
                    continue
                if common is None and len(a) > 20 * n:
                    common = intersections(sets)
                both = common[a, b] if common is not None else np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                true = both >= threshold * (size[a] + size[b] - both) - 1e-9
                a, b = a[true], b[true]
                np.add.at(text_links, a, 1)
                np.add.at(text_links, b, 1)
                np.add.at(doc_links, a, copies[b])
                np.add.at(doc_links, b, copies[a])
                forest.join(*thin(n, a, b))
            linked = np.flatnonzero(text_links).tolist()
            if linked:
                yield pa.RecordBatch.from_arrays([pa.array([keys[r] for r in linked], pa.binary()), pa.array(text_links[linked]), pa.array(doc_links[linked]), pa.array([keys[forest.root(r)] for r in linked], pa.binary())], names=["key", "text_links", "doc_links", "anchor"])

    return members.mapInArrow(work, "key binary, text_links long, doc_links long, anchor binary")


def intersections(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: products of 0/1 matrices over the shingles that two or more hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[place]
    keep = number >= 0
    owner, number = owner[keep], number[keep]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        low, high = np.searchsorted(number, [at, at + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[low:high], number[low:high] - at] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def classified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, tolerance: float = 1e-5, block_rows: int = 512, block_bytes: int = 16 << 20, most_blocks: int = BANDS) -> DataFrame:
    """id, name, class (null without words), class_id, n_links, n_text_links and n_copies of each row, as join() says; a written table."""
    least = least_matches(threshold, tolerance)
    prepared = written(prepare(docs, id_col, text_col), "join-prepared")
    grouped = prepared.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("rep_id"), F.min("name").alias("rep_name"), F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("copies"), F.first("values").alias("values"), F.first("bands").alias("bands"))
    reps = written(grouped, "join-texts")
    labels = components(candidate_edges(reps, least, block_rows), "join-candidates")
    # rows of equal name are equal; they become one before the shuffle, and meet only the one text that bears their name
    texts = docs.select(row_name(F.col(id_col), F.col(text_col)).alias("of_name"), F.col(text_col).alias("text")).groupBy("of_name").agg(F.first("text").alias("text"))
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(block_rows)), F.ceil(F.col("bytes") / F.lit(block_bytes)))
    in_components = reps.join(labels, F.col("key") == F.col("node")).drop("node")
    sized = in_components.groupBy(F.col("label").alias("of_label")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).select("of_label", blocks.alias("blocks"))
    chosen = written(in_components.join(sized, F.col("label") == F.col("of_label")).drop("of_label"), "join-chosen")
    small = chosen.where(F.col("blocks") <= most_blocks).select(F.col("label").alias("unit"), F.lit(-1).alias("band"), F.col("key").alias("of"), "blocks")
    large = shared_buckets(chosen.where(F.col("blocks") > most_blocks), blocks).select(F.col("bucket").alias("unit"), "band", "of", "blocks")
    members = small.unionByName(large).join(chosen.select("key", "rep_name", "copies", "values", "bands"), F.col("of") == F.col("key")).drop("of")
    dealt = units(members.join(texts, F.col("rep_name") == F.col("of_name")).drop("of_name", "rep_name"), "unit", F.col("blocks"), F.col("key"))
    links = written(verified_links(dealt, threshold, least), "join-links")
    linked = components(links.select(F.col("key").alias("u"), F.col("anchor").alias("v")), "join-classes").withColumnRenamed("label", "class")
    counts = links.groupBy(F.col("key").alias("k")).agg(F.sum("text_links").alias("text_links"), F.sum("doc_links").alias("doc_links"))
    whole = reps.select("key", "rep_id", "copies").join(linked, F.col("key") == F.col("node"), "left").join(counts, F.col("key") == F.col("k"), "left").withColumn("class", F.coalesce("class", "key"))
    least_ids = whole.groupBy(F.col("class").alias("c")).agg(F.min("rep_id").alias("class_id"))
    texts_out = whole.join(least_ids, F.col("class") == F.col("c")).select(F.col("key").alias("k2"), "class", "class_id", (F.col("copies") - 1 + F.coalesce("doc_links", F.lit(0))).alias("n_links"), F.coalesce("text_links", F.lit(0)).alias("n_text_links"), F.col("copies").alias("n_copies"))
    found = prepared.select("id", "name", "key").join(texts_out, F.col("key") == F.col("k2"), "left")
    alone = F.col("key").isNull()
    out = written(found.select("id", "name", "class", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies")), "join-classified")
    for table in (prepared, reps, labels, chosen, links, linked):
        discard(table)
    return out


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The class and the links of each row: id, class_id, n_links, n_text_links, n_copies.

    Two rows are linked if their texts' sets of shingles of five words have a Jaccard
    likeness of ``threshold`` or more. class_id is the least id of the rows that links
    connect, n_links the number of rows a row is linked to (copies of its text among
    them), n_text_links that of different texts, n_copies that of rows with its text.
    A null text, and one without words, is linked to nothing: its class is its id.
    Null ids are left aside in class_id (null if a class has no other); repeated rows
    are copies of one another. Exact but for the chances in the module's text.
    """
    return classified(docs, id_col=id_col, text_col=text_col, **options).select(F.col("id").alias(id_col), "class_id", "n_links", "n_text_links", "n_copies")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` of which each class keeps one: that of the least id (null last), then of the least digest.

    A row without words is a class of its own; equal rows are one.
    """
    rows = classified(docs, id_col=id_col, text_col=text_col, **options)
    order = F.struct(F.col("id").isNull().alias("missing"), F.col("id").alias("id"), F.col("name").alias("name"))
    first = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(order).alias("first")).select(F.col("first.name").alias("kept"))
    kept = first.unionByName(rows.where(F.col("class").isNull()).select(F.col("name").alias("kept"))).distinct()
    # equal rows lie together after the join, which has dealt the rows by name
    own, other = fresh(docs, "__name"), fresh(docs, "__kept")
    named = docs.withColumn(own, row_name(F.col(id_col), F.col(text_col)))
    return named.join(kept.withColumnRenamed("kept", other), F.col(own) == F.col(other), "left_semi").dropDuplicates([own]).select(*docs.columns)
