"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target in words. Complete epochs of the source come first:
every document is taken floor(target / source size) times. The rest of the
target is filled by a weighted sample without replacement: every document draws
the exponential key -ln(u) / w, w its quality weight and u fixed by its id, its text
and the seed, and the documents of the least keys are taken until their sizes,
summed in that order, come nearest to what is left.

Keys are summed in two levels. A key is mapped to [0, 1) so that the documents
of a source spread evenly over slices of about ``slice_rows``; slice totals are
summed over the slices, and only then keys within a slice. So a source with any
share of the rows is spread over many tasks, and no row is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, written

#: Words are what is no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def size_in_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_digest(id_: Column, text: Column) -> Column:
    """What a row's key is drawn from: rows share it only if id and text are equal."""
    return F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), F.coalesce(F.md5(text), F.lit("null")))


def uniform(row: Column, nth: Column, seed: int) -> Column:
    """A number in (0, 1), fixed by the row, its number among equal rows and the seed: 48 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), row, nth.cast("string")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, *, source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most_epochs: float = 2.0) -> DataFrame:
    """source, source_size, target for each source of ``sizes`` (a row for each source, with source_size).

    Sources by code point, null last, weigh as ``weights`` says, repeating. They share
    ``share`` times all sizes by weight; no target exceeds ``most_epochs`` times its
    source's size, and what is above is shared again by weight until none is. That
    is target = min(cap, level * weight) with one level for all, found by summing
    the sources in the order of cap / weight: those before the level are capped.
    """
    by_name = W.orderBy(F.col(source_col).asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(float(most_epochs)))
    full = W.orderBy((F.col("__cap") / F.col("__w")), F.col(source_col).asc_nulls_last())
    whole = W.partitionBy()
    ranked = (
        ranked.withColumn("__total", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("__caps", F.sum("__cap").over(full.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("__rest_w", F.sum("__w").over(full.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("__level", (F.col("__total") - F.coalesce("__caps", F.lit(0.0))) / F.col("__rest_w"))
    )
    # the level that counts is that of the first source which stays below its cap
    level = F.min(F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct(F.col("__cap") / F.col("__w"), F.col("__level")))).over(whole)["__level"]
    return ranked.withColumn("__at", level).select(source_col, "source_size", F.least(F.col("__cap"), F.coalesce(F.col("__at") * F.col("__w"), F.col("__cap"))).alias("target"))


def mix(docs: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most_epochs: float = 2.0, good: float = 2.0, plain: float = 1.0, bad: float = 0.5, seed: int = 17, slice_rows: int = 4096, carry: tuple[str, ...] = ()) -> DataFrame:
    """The mix: id, size, source_size, target, taken and copies for each row of ``docs``, and its columns ``carry``.

    taken is in words, repeats counted: copies times size, copies at most
    ``most_epochs`` rounded up. labels (id, quality 0 or 1) sets quality weights:
    ``good`` for 1, ``bad`` for 0, ``plain`` without a label; of repeated labels the
    highest counts. A null text has size 0 and is taken as often as others; a null
    source is a source of its own; rows of null or repeated ids are rows of their own,
    and each draws a key of its own, by its text and, where that is equal too, by its
    number among the equal rows. A source of size 0 has target 0 and nothing is taken.
    An empty table gives an empty one.
    """
    # sizes are used three times below; the texts are read once. Equal rows are counted and told apart by a number
    sized = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), size_in_words(F.col(text_col)).alias("size"), row_digest(F.col(id_col), F.col(text_col)).alias("__row"), *[F.col(c).alias(f"__carry_{c}") for c in carry])
    counted = sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("__equal"))
    rows = written(counted.withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__equal")))).drop("__equal"), "mix-sizes")
    if labels is None:
        weighted = rows.withColumn("__q", F.lit(plain))
    else:
        quality = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__label_id")).agg(F.max("quality").alias("__quality"))
        weighted = rows.join(quality, F.col("__id") == F.col("__label_id"), "left").withColumn("__q", F.when(F.col("__quality") == 1, F.lit(good)).when(F.col("__quality") == 0, F.lit(bad)).otherwise(F.lit(plain)))
    # a key's place in [0, 1): even for the documents of the least weight, denser by good / bad at most for others
    key = -F.log(uniform(F.col("__row"), F.col("__nth"), seed)) / F.col("__q")
    keyed = weighted.withColumn("__key", key)
    by_source = rows.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__n"))
    goals = targets(by_source, weights=weights, share=share, most_epochs=most_epochs)
    goals = goals.join(by_source.select(F.col("source").alias("__s"), "__n"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    goals = (
        goals.withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("__left", F.greatest(F.lit(0.0), F.col("target") - F.col("__epochs") * F.col("source_size")))
        .withColumn("__slices", F.greatest(F.lit(1), F.ceil(F.col("__n") / F.lit(slice_rows))).cast("long"))
    )
    # sources are few beside the rows: the side is broadcast where Spark sees that it is small, else the join splits a large source
    placed = keyed.join(goals, F.col("__source").eqNullSafe(F.col("source"))).withColumn("__slice", F.least(F.col("__slices") - 1, F.floor((F.lit(1.0) - F.exp(-F.col("__key") * F.lit(float(min(good, plain, bad))))) * F.col("__slices"))).cast("long"))
    totals = placed.groupBy("__source", "__slice").agg(F.sum("size").alias("__sum"))
    before = F.sum("__sum").over(W.partitionBy("__source").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1))
    starts = totals.select(F.col("__source").alias("__s2"), F.col("__slice").alias("__slice2"), F.coalesce(before, F.lit(0)).alias("__before"))
    joined = placed.join(starts, F.col("__source").eqNullSafe(F.col("__s2")) & (F.col("__slice") == F.col("__slice2")))
    within = F.sum("size").over(W.partitionBy("__source", "__slice").orderBy("__key", "__id", "__row", "__nth").rowsBetween(W.unboundedPreceding, W.currentRow))
    # nearest to what is left: a document counts if at least half of it is below
    half = F.col("__before") + within - F.col("size") / F.lit(2.0)
    copies = F.col("__epochs") + F.when((F.col("__left") > 0) & (half < F.col("__left")), F.lit(1)).otherwise(F.lit(0))
    copies = F.when(F.col("source_size") > 0, F.least(copies, F.lit(int(-(-most_epochs // 1))))).otherwise(F.lit(0)).cast("long")
    out = joined.withColumn("copies", copies).select(F.col("__id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *[F.col(f"__carry_{c}").alias(c) for c in carry])
    out = written(out, "mix")
    discard(rows)
    return out
