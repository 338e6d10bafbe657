"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has, at each of its slots, one bit for each language.
An n-gram is looked up once: the slots of its hashes are ANDed, and the result
is the mask of all languages whose filter holds it. The bits are summed by
language over a text (the popcounts), each sum is corrected for the false
positives expected of that language's filter, and the largest decides.

N-grams are of bytes of the lower-cased UTF-8 text, everything but letters and
bytes above ASCII being one separator.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field as made

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, fresh, map_texts, mix64, slices

UNKNOWN = "und"


def letters_only() -> np.ndarray:
    """Each byte as it counts: a separator unless a letter of ASCII or above ASCII."""
    out = np.full(256, 32, np.uint8)
    out[97:123] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    out[0] = 0
    return out


LETTERS = letters_only()


def grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams (n bytes in an integer) of the texts, and the number of the text of each."""
    joined = " " + " \0 ".join(x.replace("\0", " ") for x in texts).lower() + " "
    data = LETTERS[np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)]
    space = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    data = data[keep]
    if len(data) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = data == 0
    owner = np.cumsum(ends)
    size = len(data) - n + 1
    packed, crosses = np.zeros(size, np.uint64), np.zeros(size, bool)
    for i in range(n):
        packed = packed << np.uint64(8) | data[i : i + size]
        crosses |= ends[i : i + size]
    return packed[~crosses], owner[:size][~crosses]


@dataclass
class Filters:
    """The bit-sliced filters of the languages, and what a text's popcounts are corrected by."""

    languages: list[str]
    n: int = 4
    hashes: int = 3
    slots: list[np.ndarray] = made(default_factory=list)  # one array for each 64 languages
    false_rate: np.ndarray = made(default_factory=lambda: np.zeros(0))

    @classmethod
    def build(cls, languages: list[str], members: list[np.ndarray], n: int, hashes: int, bits_each: int) -> Filters:
        """members: the n-grams of each language; bits_each: slots for each distinct n-gram."""
        distinct = len(np.unique(np.concatenate(members))) if members else 0
        size = 1 << max(10, (bits_each * max(1, distinct) - 1).bit_length())
        out = cls(languages, n, hashes)
        for at in range(0, len(languages), 64):
            part = members[at : at + 64]
            kind = next(k for k, most in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(part) <= most)
            slots = np.zeros(size, kind)
            for bit, keys in enumerate(part):
                for place in out.places(keys, size):
                    slots[place] |= kind(1 << bit)
            out.slots.append(slots)
        fills = [float((slots >> slots.dtype.type(bit) & slots.dtype.type(1)).mean()) for w, slots in enumerate(out.slots) for bit in range(min(64, len(languages) - 64 * w))]
        out.false_rate = np.array(fills) ** hashes
        return out

    def places(self, keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
        mixed = mix64(keys)
        step = (mixed >> np.uint64(32)) | np.uint64(1)
        for j in range(self.hashes):
            yield ((mixed + np.uint64(j) * step) & np.uint64(size - 1)).astype(np.int64)

    def masks(self, keys: np.ndarray) -> list[np.ndarray]:
        """For each n-gram the mask of the languages that hold it, in words of 64 languages."""
        out = []
        for slots in self.slots:
            mask = None
            for place in self.places(keys, len(slots)):
                mask = slots[place] if mask is None else mask & slots[place]
            out.append(mask)
        return out

    def shares(self, texts: list[str]) -> np.ndarray:
        """For each text and language the corrected share of the text's n-grams that the language holds."""
        keys, owner = grams(texts, self.n)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        out = np.zeros((len(texts), len(self.languages)))
        there = np.flatnonzero(total)
        if len(there):
            starts = np.searchsorted(owner, there)
            for word, mask in enumerate(self.masks(keys)):
                one = mask.dtype.type(1)
                for bit in range(min(64, len(self.languages) - 64 * word)):
                    out[there, 64 * word + bit] = np.add.reduceat((mask >> mask.dtype.type(bit) & one).astype(np.int64), starts)
            by_chance = self.false_rate
            out = np.clip((out - total[:, None] * by_chance) / (1 - np.minimum(by_chance, 0.99)), 0, None)
            out[there] = np.minimum(out[there] / total[there, None], 1.0)
        return out


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text, mod 3, is 1; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 3000, n: int = 4, hashes: int = 3, bits_each: int = 12, least_ratio: float = 0.25) -> Filters:
    """Filters learned from text and lang of rows that aren't held out and have both.

    per_language bounds the labelled sample: the documents of a language with the
    least hash of id and text, whole texts, equal rows once. A language holds each
    n-gram of its sample that has at least least_ratio of its relative frequency in the
    language where that is highest. The driver gets the distinct n-grams of the sample.
    """
    h = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 40))
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), h.alias("h"))
    counts = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Filters([])
    # first a share somewhat above the bound, then the bound itself from those few hashes
    loose = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, int(min(1.0, 1.2 * per_language / v + 20 / v) * (1 << 40)))])
    few = rows.where(F.col("h") < loose[F.col("lang")])
    bound = few.select("lang", "h").distinct().withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("r") <= per_language).groupBy("lang").agg(F.max("h").alias("h"))
    exact = F.create_map(*[F.lit(x) for r in bound.collect() for x in (r["lang"], r["h"])])
    sample = few.where(F.col("h") <= exact[F.col("lang")]).dropDuplicates(["lang", "h"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, langs = part.column("text").to_pylist(), part.column("lang").to_pylist()
                for lang in set(langs):
                    keys, found = np.unique(grams([x for x, y in zip(texts, langs, strict=True) if y == lang], n)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(found)], names=["lang", "gram", "n"])

    gathered = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = gathered.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("total"))
    share = gathered.join(F.broadcast(total), F.col("lang") == F.col("of")).withColumn("p", F.col("n") / F.col("total"))  # a row for each language
    best = share.withColumn("most", F.max("p").over(W.partitionBy("gram")))
    got = best.where(F.col("p") >= F.lit(least_ratio) * F.col("most")).select("lang", "gram").toArrow()
    names, keys = np.asarray(got.column("lang").to_pylist(), dtype=object), np.asarray(got.column("gram")).astype(np.uint64)
    languages = sorted(counts, key=lambda x: (-counts[x], x))
    return Filters.build(languages, [keys[names == x] for x in languages], n, hashes, bits_each)


def predict(docs: DataFrame, filters: Filters, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score and coverage to ``keep`` (by default all other columns).

    lang_pred is the language of the largest corrected share, on a tie the one with
    more labelled documents; ``und`` with score 0 where the text is null or has no
    letter, or nothing was learned. score is that share by the sum of all, coverage
    the share itself. No shuffle; whole texts, one slice of a batch at a time.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "coverage")]
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(filters))

    def make():
        filters: Filters = pickle.loads(shipped.value)

        def apply(texts):
            lettered = np.asarray(pc.match_substring_regex(pa.array(texts, pa.string()), r"\p{L}"), dtype=bool)
            if not filters.languages:
                zero = np.zeros(len(texts))
                return [[UNKNOWN] * len(texts), zero, zero]
            shares = filters.shares(texts)
            at = shares.argmax(1)
            top, total = shares[np.arange(len(texts)), at], shares.sum(1)
            score = np.where(lettered & (total > 0), top / np.where(total > 0, total, 1), 0.0)
            return [[filters.languages[i] if ok else UNKNOWN for i, ok in zip(at.tolist(), lettered.tolist(), strict=True)], score, np.where(lettered, top, 0.0)]

        return apply

    return map_texts(docs, keep, text_col, [field("lang_pred", T.StringType()), field("score", T.DoubleType()), field("coverage", T.DoubleType())], make)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """id, held_out, lang_pred, score and coverage of each row: learned from the rows not held out, predicted for all.

    A null id is not held out and not learned from. A null text, an empty one and one
    without a letter are ``und`` with score 0; of languages with equal corrected shares
    the one with more labelled documents is taken, then the first by name. Repeated rows
    give equal rows and are learned from once; very long texts are read whole. Where no row has
    both text and lang every row is ``und``; an empty table gives an empty one. Other
    columns may have any name, and are never inputs of a prediction.
    """
    filters = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    own = fresh(docs.select(id_col).withColumn("held_out", F.lit(True)), "__asked")
    asked = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias(own))
    return predict(asked, filters, text_col=own, keep=[id_col, "held_out"])
