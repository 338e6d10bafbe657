"""Lempel-Ziv phrase fingerprints.

A text is parsed into the phrases of an incremental dictionary: each phrase is
the shortest string from where the last ended that the dictionary doesn't hold
yet, and is added to it. The phrases' hashes form a set, of which the least
``size`` values are the signature. Two signatures are compared by the share of
the least values of their union that both hold, an estimate of the Jaccard
likeness of the phrase sets (and exact where both sets are small), which follows
the likeness that a compressor sees.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import POWERS, discard, field, mix64, slices, written

#: Values in a signature.
SIZE = 128
#: Ranges of neighbouring ids for each shuffle partition, so that partitions come out even.
RANGES = 4


def phrase_hashes(text: str, starts: list[int], ends: list[int]) -> np.ndarray:
    """64-bit hashes of text[start:end], by differences of one running sum."""
    up, down = POWERS.upto(len(text) + 1)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes += np.uint64(1)
    codes *= up[: len(codes)]
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes, out=sums[1:])
    a, b = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    return mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def parse(text: str, seen: set[str], start: int, ends: list[int], stop: int) -> int:
    """Adds the phrases from ``start`` on that end at ``stop`` or before; returns where the next would start.

    The dictionary holds each prefix of its phrases, so the length of the next one is
    searched from that of the last, up or down.
    """
    n, k = len(text), 4
    while start < n:
        piece = text[start : start + k]
        if piece in seen:
            k = len(piece)
            while piece in seen:
                if start + k >= n:
                    return start  # what is left is a known phrase
                k += 1
                piece = text[start : start + k]
        else:
            k = len(piece)
            while k > 1:
                shorter = text[start : start + k - 1]
                if shorter in seen:
                    break
                piece = shorter
                k -= 1
        if start + k > stop:
            return start
        seen.add(piece)
        start += k
        ends.append(start)
    return start


def signature(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The least values, as 32-bit integers in order."""
    values = np.unique((hashes >> np.uint64(32)).astype(np.uint32))
    return values[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Share of the least values of the union that both hold; 1 for two empty texts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:size]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], side="right")) / len(union)


def to_text(values: np.ndarray) -> str:
    return base64.b64encode(values.astype(">u4").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u4").astype(np.uint32)


def fingerprint(text: str, size: int = SIZE) -> np.ndarray:
    ends: list[int] = []
    parse(text, set(), 0, ends, len(text))
    return signature(phrase_hashes(text, [0, *ends[:-1]] if ends else [], ends), size)


def both_fingerprints(text: str, after: str, size: int = SIZE) -> tuple[np.ndarray, str, np.ndarray]:
    """Signature of a text, its edited text, and that one's signature.

    The edited text has the first floor(n / 3) code points of ``after``, or all, in
    place of the last as many of the text. What both begin with is parsed once.
    """
    cut = len(text) - len(text) // 3
    edited = text[:cut] + after[: len(text) // 3]
    seen: set[str] = set()
    ends: list[int] = []
    start = parse(text, seen, 0, ends, cut)
    shared = len(ends)
    other = list(ends)
    parse(edited, seen, start, other, len(edited))
    for a, b in zip([start, *other[shared:]], other[shared:], strict=False):
        seen.discard(edited[a:b])
    parse(text, seen, start, ends, len(text))
    own = signature(phrase_hashes(text, [0, *ends[:-1]] if ends else [], ends), size)
    theirs = signature(phrase_hashes(edited, [0, *other[:-1]] if other else [], other), size)
    return own, edited, theirs


def range_bounds(rows: DataFrame, ranges: int) -> list[tuple[int, int, int]]:
    """The least key (missing, falling, digest) of each of at most ``ranges`` ranges of about equal size, rising.

    Spark's own range partitioning cuts the keys, so the driver holds one key for each range.
    """
    keys = written(rows.select("missing", "falling", "digest"), "lz-keys")
    cut = keys.repartitionByRange(ranges, "missing", "falling", "digest").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("missing", "falling", "digest")).alias("first"))
    found = sorted(tuple(r["first"]) for r in cut.select("first").collect())
    discard(keys)
    return found


def in_range(bounds: list[tuple[int, int, int]]) -> tuple[Column, Column]:
    """Number of the range of a row's key, from 0, and whether the key is the first of its range."""
    parts = [F.split(F.lit(",".join(str(b[i]) for b in bounds)), ",").cast("array<long>") for i in range(3)]  # each folded into one literal
    at = lambda i: F.struct(*[F.element_at(p, i + 1).alias(n) for p, n in zip(parts, ("m", "f", "d"), strict=True)])
    key = F.struct(F.col("missing").alias("m"), F.col("falling").alias("f"), F.col("digest").alias("d"))
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        below = at(middle) <= key
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(below, middle).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(middle - 1).alias("high")))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(bounds) - 1).alias("high")), halve)["low"], at(F.col("range")) == key


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likenesses.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited
    and near_next. The next document is the next one by falling id (integer ids; of
    repeated ids by a hash of the text, null ids last), after the last the first; a
    single document is its own next. A null text is empty; empty texts have the empty
    fingerprint, likeness 1 to one another and 0 to others. An empty table gives none.

    Rows are cut into ranges of id and hash (``ranges``; by default four for each
    shuffle partition, however many rows there are), so one id that many rows bear is
    cut too; only rows equal in id and text stay together. The texts are shuffled
    once, by range; the first of a range also goes to the range before, as the next of
    its last one. A task streams its ranges and holds few texts at a time.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"missing": F.col("id").isNull().cast("long"), "falling": F.coalesce(F.bitwise_not(F.col("id").cast("long")), F.lit(0)), "digest": F.xxhash64("text")})
    bounds = range_bounds(rows, ranges or RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) or [(0, 0, 0)]
    number, is_first = in_range(bounds)
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("halo"))
    halo = F.struct(F.pmod(F.col("range") - 1, F.lit(len(bounds))).alias("range"), F.lit(True).alias("halo"))
    order = ["missing", "falling", "digest"]
    dealt = rows.withColumn("range", number).select("id", "text", *order, F.explode(F.when(is_first, F.array(own, halo)).otherwise(F.array(own))).alias("to")).select("to.range", "to.halo", "id", "text", *order)
    dealt = dealt.repartition("range").sortWithinPartitions("range", "halo", *order, "text").select("halo", "id", "text")
    schema = T.StructType([field(id_col, docs.schema[id_col].dataType), field("n_chars", T.LongType()), field("edited_sha256", T.StringType()), field("fingerprint", T.StringType()), field("edited_fingerprint", T.StringType()), field("near_edited", T.DoubleType()), field("near_next", T.DoubleType())])
    id_arrow = rows.select("id").schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [to_arrow_schema(id_arrow).field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        made: list[list] = []
        waiting: tuple | None = None  # a row whose next is not known yet
        pending: list | None = None  # a row made but for near_next, which needs the next one's fingerprint

        def settle(own: np.ndarray) -> None:
            nonlocal pending
            if pending is not None:
                row, values = pending
                made.append([*row, likeness(values, own, size)])
                pending = None

        def meet(after: str) -> None:
            nonlocal waiting, pending
            id_, text = waiting
            own, edited, theirs = both_fingerprints(text, after, size)
            settle(own)
            pending = ([id_, len(text), hashlib.sha256(edited.encode()).hexdigest(), to_text(own), to_text(theirs), likeness(own, theirs, size)], own)
            waiting = None

        for batch in batches:
            for part in slices(batch, "text"):
                for is_halo, id_, text in zip(*(part.column(c).to_pylist() for c in ("halo", "id", "text")), strict=True):
                    if waiting is not None:
                        meet(text)
                    if not is_halo:
                        waiting = (id_, text)
                    elif pending is not None:
                        settle(fingerprint(text, size))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], kinds[i]) for i in range(len(kinds))], names=schema.names)
                    made.clear()
        if waiting is not None or pending is not None:
            raise RuntimeError("a range came without the document after it")

    return dealt.mapInArrow(work, schema)
