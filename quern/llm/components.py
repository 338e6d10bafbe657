"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of each node of ``edges`` (u, v); label is the least node of its component.

    Each round hangs the neighbours of a node onto the least of them, so paths shrink
    by halves and the rounds grow as the logarithm of the longest. A node's
    neighbours are never gathered: their least is a grouped minimum, joined back. The
    minima are written first, so that both sides of that join are plain shuffles and
    adaptive execution can split the edges of a node with very many neighbours.
    Rounds are cut by written tables in the shared folder, of which the last stays
    (discard() removes it). Loops and edges with a null end are left out.
    """
    now = written(edges.select("u", "v").where("u <> v").distinct(), name)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")), f"{name}-least")
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        joined = down.join(low, F.col("u") == F.col("n"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
        before, now = now, written(small, name)
        discard(before)
        discard(least)
        found = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))).alias("s")).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
