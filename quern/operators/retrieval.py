"""Chunking, lexical and vector ranking, rank fusion, and diversified top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..storage import written

# ---------------------------------------------------------------- chunks


def chunk_words(sections: DataFrame, *, keys: list[str], text_col: str, target: int = 350, overlap: int = 50) -> DataFrame:
    """keys, chunk_index (from 0 in each section) and text: windows of ``target`` words that share ``overlap``; blank text gives none.

    The starts are a closed form of the number of words, so a text is split once and
    its windows are slices; there is no loop and no shuffle.
    """
    step = target - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the target")
    split = sections.select(*keys, t.split_words(F.col(text_col)).alias("__w")).where(F.size("__w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("__w") - target) / F.lit(step))).cast("int")
    windows = split.select(*keys, "__w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return windows.select(*keys, F.col("chunk_index").cast("int").alias("chunk_index"), F.array_join(F.slice("__w", F.col("chunk_index") * step + 1, F.lit(target)), " ").alias("text"))


def cap_tokens(chunks: DataFrame, *, keys: list[str], count: Callable[[str], int], most: int = 450, text_col: str = "text") -> DataFrame:
    """Halves chunks by words until ``count`` gives each at most ``most`` tokens, or it is one word; indices run on in each key.

    No words are lost. The tokenizer is any function; it runs in Arrow batches.
    """

    def halves(text: str) -> list[str]:
        out, stack = [], [text.split()]
        while stack:
            w = stack.pop()
            if len(w) <= 1 or count(" ".join(w)) <= most:
                out.append(" ".join(w))
            else:
                stack += [w[len(w) // 2 :], w[: len(w) // 2]]
        return out

    @F.pandas_udf("array<string>")
    def split(x: pd.Series) -> pd.Series:
        return x.map(lambda s: halves(s or ""))

    pieces = chunks.select(*keys, "chunk_index", F.posexplode(split(F.col(text_col))).alias("__piece", "text"))
    index = F.row_number().over(W.partitionBy(*keys).orderBy("chunk_index", "__piece")) - 1
    return pieces.withColumn("chunk_index", index.cast("int")).drop("__piece")


# ---------------------------------------------------------------- lexical index


class LexicalIndex:
    """BM25 tables: postings (term, chunk_id, tf), lengths (chunk_id, dl), terms (term, df, idf), and one row of totals."""

    def __init__(self, postings: DataFrame, lengths: DataFrame, terms: DataFrame, totals: DataFrame) -> None:
        self.postings, self.lengths, self.terms, self.totals = postings, lengths, terms, totals

    def save(self, path: str) -> None:
        self.postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("lengths", "terms", "totals"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> LexicalIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "terms", "totals")))


def lexical_index(chunks: DataFrame, *, id_col: str = "chunk_id", text_col: str = "text", epsilon: float = 0.25) -> LexicalIndex:
    """idf is ln(N - df + 0.5) - ln(df + 0.5); a negative one becomes epsilon times the mean over the vocabulary.

    Texts are split into terms once, into a written table that all parts of the index are made from.
    """
    tokens = written(chunks.select(F.col(id_col).alias("chunk_id"), t.terms(F.col(text_col)).alias("__t")), "lexical-tokens")
    lengths = tokens.select("chunk_id", F.size("__t").cast("long").alias("dl"))
    postings = tokens.select("chunk_id", F.explode("__t").alias("term")).groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(totals.select("n")))  # one row
    raw = df.select("term", "df", (F.log(F.col("n") - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5))).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.lit(epsilon) * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return LexicalIndex(postings, lengths, terms, totals.crossJoin(mean))


def top_ranked(scored: DataFrame, k: int, *, query: str = "query_id", item: str = "chunk_id", decimals: int | None = None) -> DataFrame:
    """rank from 1 by falling score, then item; Spark keeps k rows of each query before the shuffle."""
    by = F.round("score", decimals) if decimals is not None else F.col("score")
    rank = F.row_number().over(W.partitionBy(query).orderBy(by.desc(), F.col(item)))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def lexical_search(index: LexicalIndex, queries: DataFrame, k: int, *, k1: float = 1.5, b: float = 0.75, fill_zero: bool = False, decimals: int | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank of all queries (query_id, text) in one plan; a repeated query term counts as often.

    fill_zero: queries with fewer than k matches get chunks of score 0, by id.
    """
    asked = queries.select("query_id", F.explode(t.terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    # a query's terms meet the statistics first, so that postings of other terms are dropped before anything is shuffled
    weighted = asked.join(index.terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    met = index.postings.join(weighted, "term").join(index.lengths, "chunk_id").crossJoin(F.broadcast(index.totals.select("avgdl")))
    part = F.col("w") * (F.col("tf") * F.lit(k1 + 1)) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")))
    scored = met.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    if fill_zero:
        # any k + (matches) chunks suffice to fill up to k: the k least ids, and those are k rows a query
        least = index.lengths.orderBy("chunk_id").limit(k).select("chunk_id")
        zero = queries.select("query_id").crossJoin(F.broadcast(least)).join(scored.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        scored = scored.unionByName(zero.withColumn("score", F.lit(0.0)))
    return top_ranked(scored, k, decimals=decimals)


# ---------------------------------------------------------------- vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hash_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a sentence encoder: signed hashed terms, normalised.

    A term's hash is the first 32 bits of its MD5: its place is the remainder by
    ``dim``, its sign bit 16.
    """
    import hashlib
    import re
    from functools import lru_cache

    @lru_cache(1 << 16)
    def hashed(w: str) -> int:
        return int(hashlib.md5(w.encode()).hexdigest()[:8], 16)

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, x in enumerate(texts):
            h = np.fromiter(map(hashed, re.findall("[a-z0-9]+", (x or "").lower())), np.int64)
            np.add.at(out[i], h % dim, np.where(h >> 16 & 1, 1.0, -1.0))
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return encode


def embed(rows: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], *, text_col: str = "text", out: str = "embedding", batch: int = 64, kind: str = "array<float>") -> DataFrame:
    """Adds the vectors of an encoder, which is made once a task and fed ``batch`` texts at a time."""
    return rows.withColumn(out, F.pandas_udf(_iterated(encoder, batch), kind)(F.col(text_col)))


def _iterated(encoder, batch: int):
    def run(series):
        encode = encoder()
        for x in series:
            texts = x.fillna("").tolist()
            yield pd.Series([v for at in range(0, len(texts), batch) for v in encode(texts[at : at + batch]).tolist()], dtype=object)

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "chunk_id", vector_col: str = "embedding", block_rows: int = 4096, decimals: int = 9) -> DataFrame:
    """query_id, chunk_id, score (inner product in doubles), rank: exact, for a stated set of queries (query_id, embedding).

    Queries and vectors are dealt into blocks of about ``block_rows``, and each pair of
    blocks is a unit of work: one product of two matrices, of which the k best of each
    query go on. Scores are ranked as rounded to ``decimals``, ties by id. Null vectors take no part.
    """
    id_type, query_type = vectors.schema[id_col].dataType, queries.schema["query_id"].dataType
    v = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("chunk_id"), F.col(vector_col).cast("array<double>").alias("v"))
    q = queries.where(F.col(vector_col).isNotNull()).select("query_id", F.col(vector_col).cast("array<double>").alias("v"))
    blocks = lambda df, name: df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(block_rows))).cast("int").alias(name))  # noqa: E731  one row
    side = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    sizes = F.broadcast(blocks(v, "nc").crossJoin(blocks(q, "nq")))
    dealt_v = v.crossJoin(sizes).select(side("chunk_id", "nc").alias("cb"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), F.lit(None).cast(query_type).alias("query_id"), "chunk_id", "v")
    dealt_q = q.crossJoin(sizes).select(F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("cb"), side("query_id", "nq").alias("qb"), "query_id", F.lit(None).cast(id_type).alias("chunk_id"), "v")

    def work(t: pa.Table) -> pa.Table:
        asked = np.asarray(pc.is_valid(t.column("query_id")))
        x = np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
        ids, names = t.column("chunk_id").filter(pa.array(~asked)), t.column("query_id").filter(pa.array(asked))
        order = pc.sort_indices(ids)  # equal scores then lie by id
        matrix = x[~asked][np.asarray(order)].T
        rows, cols, scores = [], [], []
        for at in range(0, len(names) if matrix.shape[1] else 0, 256):
            s = x[asked][at : at + 256] @ matrix
            pick = np.argsort(-np.round(s, decimals), axis=1, kind="stable")[:, :k]
            rows.append(np.repeat(np.arange(at, at + len(s)), pick.shape[1]))
            cols.append(pick.ravel())
            scores.append(np.take_along_axis(s, pick, 1).ravel())
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table({"query_id": names.take(pa.array(join(rows, np.int64))), "chunk_id": ids.take(order.take(pa.array(join(cols, np.int64)))), "score": join(scores, np.float64)})

    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("chunk_id", id_type), T.StructField("score", T.DoubleType())])
    return top_ranked(dealt_v.unionByName(dealt_q).groupBy("cb", "qb").applyInArrow(work, schema), k, decimals=decimals)


# ---------------------------------------------------------------- fusion


def fuse(lists: list[DataFrame], k: int, *, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: score is the sum of 1 / (constant + rank) over the lists (query_id, chunk_id, rank).

    A union and one grouped sum, so no outer joins. Ties go to the better rank in the
    first list, then the next, then the id.
    """
    both = None
    for i, x in enumerate(lists):
        part = x.select("query_id", "chunk_id", F.lit(i).alias("list"), "rank")
        both = part if both is None else both.unionByName(part)
    ranks = [F.min(F.when(F.col("list") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(lists))]
    summed = both.groupBy("query_id", "chunk_id").agg(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("score"), *ranks)
    order = [F.round("score", 12).desc(), *[F.col(f"r{i}").asc_nulls_last() for i in range(len(lists))], F.col("chunk_id")]
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return summed.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def fetch_depth(k: int) -> int:
    """How many of each list fusion takes for k results."""
    return max(4 * k, 50)


# ---------------------------------------------------------------- diversification


def collapse(ranked: DataFrame, *, group: str = "group_id", least: float = 0.9, keep_canonical: bool = True) -> DataFrame:
    """One row for each cluster of near copies of a query's ranking (query_id, rank, chunk_id, group, is_canonical, shingles).

    In rank order a row joins the first cluster of its group whose leader's shingles
    are alike enough, else it leads a new one. The survivor is the canonical copy if
    there is one, else the leader; it takes the leader's rank. Each row depends on the
    clusters before it, so this is a fold in Python, a query at a time: a ranking is
    the overfetched top of a search, bounded by its depth.
    """
    columns = [ranked.schema[c] for c in ("query_id", "rank", "chunk_id", group)]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        clusters: list[list] = []  # group, leader's shingles, rank, survivor, whether it is canonical
        for rank, chunk, own, canon, shingles in rows.sort_values(["rank", "chunk_id"], kind="stable")[["rank", "chunk_id", group, "is_canonical", "shingles"]].itertuples(index=False):
            held = set(shingles)
            for c in clusters:
                if c[0] == own and held and c[1] and len(held & c[1]) >= least * len(held | c[1]):
                    if keep_canonical and canon and not c[4]:
                        c[3], c[4] = chunk, True
                    break
            else:
                clusters.append([own, held, rank, chunk, bool(canon)])
        return pd.DataFrame([(rows["query_id"].iloc[0], c[2], c[3], c[0]) for c in clusters], columns=["query_id", "rank", "chunk_id", group])

    return ranked.select("query_id", "rank", "chunk_id", group, "is_canonical", "shingles").groupBy("query_id").applyInPandas(fold, T.StructType(columns))


def cap_groups(ranked: DataFrame, k: int, *, cap: int = 2, group: str = "group_id", demoted: str | None = None) -> DataFrame:
    """At most ``cap`` rows of a group, in rank order, demoted rows (surveys) after all others, k in all; position from 1."""
    late = F.col(demoted) if demoted else F.lit(False)
    in_group = F.row_number().over(W.partitionBy("query_id", group).orderBy("rank", "chunk_id"))
    position = F.row_number().over(W.partitionBy("query_id").orderBy("__late", "rank", "chunk_id"))
    kept = ranked.withColumn("__late", late).withColumn("__n", in_group).where(F.col("__n") <= cap)
    return kept.withColumn("position", position).where(F.col("position") <= k).drop("__late", "__n")


def first_k(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("rank") <= k).withColumn("position", F.col("rank"))


def diversify(ranked: DataFrame, k: int, mode: str = "new", **options) -> DataFrame:
    """The top k of a ranking by mode: none, cap1_naive (one row a group) or new (near copies collapsed, then two a group)."""
    group, demoted = options.get("group", "group_id"), options.get("demoted")
    if mode == "none":
        return first_k(ranked, k)
    if mode == "cap1_naive":
        return cap_groups(ranked, k, cap=1, group=group, demoted=demoted)
    if mode == "new":
        kept = collapse(ranked, group=group)
        if demoted:
            kept = kept.join(ranked.select("query_id", F.col("rank").alias("__r"), demoted), (F.col("rank") == F.col("__r")) & (kept["query_id"] == ranked["query_id"])).select(kept["*"], demoted)
        return cap_groups(kept, k, cap=options.get("cap", 2), group=group, demoted=demoted)
    raise ValueError(f"unknown mode {mode!r}")
