"""What several of the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, shared_dir, written  # noqa: F401  what operators import from here

#: UTF-8 bytes of text that a Python worker turns into Python objects at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text each, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total + n > limit and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(docs: DataFrame, keep: list[str], text: str, fields: list[T.StructField], make: Callable[[], Callable[[list[str]], list]], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row of ``keep`` and ``fields`` for each row of ``docs``.

    ``make()`` runs once a task and returns a function from the texts of a slice (of
    ``slice_bytes`` bytes, or one text; null as the empty text) to a list of columns for ``fields``.
    """
    schema = T.StructType([docs.schema[c] for c in keep] + fields)
    names, own = [f.name for f in schema], fresh(docs, "__text")
    at = keep.index(text) if text in keep else len(keep)  # a text that is kept isn't sent twice

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        collecting = gc.isenabled()
        gc.disable()  # these functions make many objects and no cycles
        try:
            for batch in batches:
                for part in slices(batch, batch.schema.names[at], slice_bytes):
                    texts = [x or "" for x in part.column(at).to_pylist()]
                    made = [x if isinstance(x, pa.Array) else pa.array(x) for x in apply(texts)]
                    yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + made, names=names)
        finally:
            if collecting:
                gc.enable()
            del apply
            give_back()

    return docs.select(*keep, *([] if text in keep else [docs[text].alias(own)])).mapInArrow(work, schema)


def give_back() -> None:
    """Returns what a worker has freed to the system, as workers live on between tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Powers:
    """Powers of an odd factor and of its inverse modulo 2**64; at most ``KEPT`` of each outlive a call."""

    FACTOR = 0x9E3779B97F4A7C15
    KEPT = 1 << 21

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """At least n powers of the factor, and of its inverse."""
        if len(self.up) >= n:
            return self.up, self.down
        factors = (self.FACTOR, pow(self.FACTOR, -1, 1 << 64))
        up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 14), np.uint64(f))])) for f in factors)
        if n <= self.KEPT:
            self.up, self.down = up, down
        return up, down


#: One table of powers for a worker, whatever operators it serves.
POWERS = Powers()


def fresh(df: DataFrame, name: str) -> str:
    """A column name beginning with ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def in_blocks(items: Column) -> Column:
    """An array of one or more items cut into blocks of about the root of its size."""

    def cut(p: Column) -> Column:
        return let(F.ceil(F.sqrt(F.size(p))).cast("int"), lambda b: F.transform(F.sequence(F.lit(0), ((F.size(p) - 1) / b).cast("int")), lambda i: F.slice(p, i * b + 1, b)))

    return let(items, cut)


def folded(items: Column, start: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A fold over an array that gathers what each step adds: a struct of the last ``at`` and ``out``, an array of ``kind``.

    step: (at, item) to the next at and an array of what is added. As an array is copied
    whenever something is added, the fold goes by blocks of about the root of the
    array's size, and what is copied grows with the power 1.5 of it, not its square.
    """
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(state: Column, x: Column) -> Column:
        at, more = step(state["at"], x)
        return F.struct(at.alias("at"), F.concat(state["out"], more).alias("out"))

    def block(state: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(state["at"].alias("at"), none.alias("out")), one)
        return let(inner, lambda s: F.struct(s["at"].alias("at"), F.concat(state["out"], F.array(s["out"])).alias("out")))

    whole = lambda p: let(F.aggregate(in_blocks(p), F.struct(start.alias("at"), nones.alias("out")), block), lambda s: F.struct(s["at"].alias("at"), F.flatten(s["out"]).alias("out")))
    return let(items, lambda p: F.when(F.size(p) > 0, whole(p)).otherwise(F.struct(start.alias("at"), none.alias("out"))))


def bounded_sample(docs: DataFrame, id_col: str, text_col: str, bound: int) -> DataFrame:
    """Column text: the whole texts of at most ``bound`` documents, those of the least hashes of id and text; nulls left out.

    Rows equal in both count once. Only hashes are ranked, and only those below a
    loose bound that about 1.2 times as many documents pass, so neither the number of
    rows nor a repeated one makes a task large. The same rows give the same sample.
    """
    space = 1 << 40
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(space)).alias("h"))
    n = docs.where(F.col(text_col).isNotNull()).count()
    few = rows.where(F.col("h") < int(min(1.0, (1.2 * bound + 20) / max(1, n)) * space))
    last = few.select("h").distinct().orderBy("h").limit(bound).agg(F.max("h")).first()[0]
    return few.where(F.col("h") <= F.lit(-1 if last is None else last)).dropDuplicates(["h"]).select("text")
