"""Linking records: merging by key, linking by title, canonical copies, fuzzy joins in blocks."""

from __future__ import annotations

import difflib
import math
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..sources import records
from ..storage import discard, written

# Which source's copy is preferred.
SOURCE_PRIORITY = {"acl_anthology": 0, "arxiv": 1, "semantic_scholar": 2}


def merge_first_wins(rows: DataFrame, key: str, order: str, columns: list[str], tags: str | None = None) -> DataFrame:
    """One row for each key: of each column the first value that is not blank, by ``order``; distinct ``tags`` joined in order.

    A grouped aggregate of least (order, value) structs, so partial results are formed before the shuffle.
    """
    firsts = [F.min(F.when(t.blank_to_null(F.col(c)).isNotNull(), F.struct(F.col(order), F.col(c).alias("v")))).getField("v").alias(c) for c in columns]
    tagged = [F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(F.col(order), F.col(tags).alias("v")))), lambda s: s["v"]), "; ").alias(tags)] if tags else []
    out = rows.groupBy(key).agg(F.min(order).alias(order), *firsts, *tagged)
    if tags:
        out = out.withColumn(tags, F.array_join(F.array_distinct(F.split(tags, "; ")), "; "))
    return out


def link_groups(rows: DataFrame, title: Column, order: str) -> DataFrame:
    """Adds group_id (grp0001 ... by first appearance, '' if alone): rows whose titles are equal in letters and digits.

    Titles without any stay alone. Rows stay separate; groups are numbered by ranges of their first rows.
    """
    keyed = rows.withColumn("__key", t.title_key(title))
    groups = keyed.where("__key <> ''").groupBy("__key").agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first")).where("__n > 1")
    numbered = records.numbered(groups, ["__first", "__key"], "__number").select(F.col("__key").alias("__k"), F.format_string("grp%04d", "__number").alias("group_id"))
    return keyed.join(numbered, F.col("__key") == F.col("__k"), "left").withColumn("group_id", F.coalesce("group_id", F.lit(""))).drop("__key", "__k")


def priority(source: Column, ranks: dict[str, int] = SOURCE_PRIORITY, other: int = 9) -> Column:
    out = F.lit(other)
    for name, rank in ranks.items():
        out = F.when(source == name, F.lit(rank)).otherwise(out)
    return out


def canonical(rows: DataFrame, group: str, key: Column, source_rank: Column, version: Column, order: Column) -> DataFrame:
    """Adds canonical_id: the key of the group's row with the least (source rank, -version, order); a row without group is its own."""
    best = rows.where(F.col(group) != "").groupBy(F.col(group).alias("__g")).agg(F.min_by(key, F.struct(source_rank.alias("a"), (-version).alias("b"), order.alias("c"))).alias("__canonical"))
    return rows.join(best, F.col(group) == F.col("__g"), "left").withColumn("canonical_id", F.coalesce("__canonical", key)).drop("__g", "__canonical")


def group_breakdown(rows: DataFrame, group: str, source: str, work: str) -> DataFrame:
    """Counts of groups by what joins them: versions of one work, several sources, both, neither; groups of one are degenerate."""
    per_work = rows.where(F.col(group) != "").groupBy(group, source, work).agg(F.count(F.lit(1)).alias("n"))
    per_group = per_work.groupBy(group).agg(F.sum("n").alias("rows"), F.count_distinct(source).alias("sources"), F.max(F.when(F.col(work) != "", F.col("n")).otherwise(F.lit(0))).alias("most"))
    cross, versions = F.col("sources") > 1, F.col("most") > 1
    kind = F.when(F.col("rows") < 2, "degenerate").when(cross & versions, "both").when(versions, "version_only").when(cross, "cross_source").otherwise("other")
    return per_group.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("rows").alias("n_rows"))


def title_likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Ratcliff-Obershelp likeness, which depends on the order of its arguments; null where it is below ``least``.

    The common characters bound it from above, so most pairs that are not alike cost
    no comparison of strings.
    """

    @F.pandas_udf(T.DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        out, matcher, before = [], difflib.SequenceMatcher(None, "", ""), None
        for one, two in zip(x, y, strict=True):
            if two != before:  # the second is what the matcher prepares
                matcher.set_seq2(two or "")
                before = two
            matcher.set_seq1(one or "")
            found = matcher.ratio() if matcher.quick_ratio() >= least else 0.0
            out.append(found if found >= least else None)
        return pd.Series(out, dtype="float64")

    return ratio(a, b)


def blocked_pairs(rows: DataFrame, id_col: str, blocks: Column, max_block: int | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ids that share a block of at most ``max_block`` rows (None: of any size).

    The size limit is the feature's own: larger blocks say nothing of likeness. Sizes are
    counted with partial sums and joined back, so no block is gathered in one task.
    """
    exploded = rows.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(blocks)).alias("block"))
    sizes = exploded.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    if max_block:
        sizes = sizes.where(F.col("n") <= max_block)
    kept = exploded.join(sizes.select("block"), "block")
    left, right = kept.select("block", F.col("id").alias("a")), kept.select("block", F.col("id").alias("b"))
    return left.join(right, "block").where("a < b").select("a", "b").distinct()


def candidate_pairs(rows: DataFrame, *, id_col: str, title_col: str, authors_col: str, least: float, max_block: int | None, extra: dict[str, str] | None = None) -> DataFrame:
    """Pairs a < b in blocks of a shared surname whose titles' lengths allow a likeness of ``least``: a, b, their titles and surnames, and the ``extra`` columns (name: expression) of both.

    The bound 2 min / (sum of lengths) is a native filter before any title is joined.
    """
    keyed = rows.select(F.col(id_col).alias("id"), t.title_words(F.col(title_col)).alias("title"), t.surnames(F.col(authors_col)).alias("names"), *[F.expr(e).alias(c) for c, e in (extra or {}).items()])
    pairs = blocked_pairs(keyed, "id", F.col("names"), max_block)
    small = keyed.select("id", F.length("title").alias("length"))
    side = lambda rows, x: rows.select(*[F.col(c).alias(f"{c}_{x}") for c in rows.columns])
    both = lambda pairs, rows: pairs.join(side(rows, "a"), F.col("a") == F.col("id_a")).join(side(rows, "b"), F.col("b") == F.col("id_b"))
    la, lb = F.col("length_a"), F.col("length_b")
    close = both(pairs, small).where(F.lit(2.0) * F.least(la, lb) >= F.lit(least) * (la + lb)).select("a", "b")
    return both(close, keyed).drop("id_a", "id_b")


def fuzzy_title_pairs(rows: DataFrame, *, id_col: str, title_col: str, authors_col: str, year_col: str | None = None, least: float = 0.85, strong_authors: int = 2, weak_authors: int = 1, vector_col: str | None = None, least_cosine: float = 0.8, max_block: int | None = 50, max_years: int = 2) -> DataFrame:
    """Pairs of rows that are likely the same work: near titles and years, and ``strong_authors`` shared surnames.

    With a column of normalised vectors of the abstracts, ``weak_authors`` and a cosine of
    ``least_cosine`` do as well. A year that is no number is near to any. Volumes of
    proceedings are left out.
    """
    kept = rows.where(~F.startswith(F.lower(t.or_blank(F.col(title_col))), F.lit("proceedings of")))
    extra = {"year": f"cast({year_col} as string)" if year_col else "''"} | ({"vector": vector_col} if vector_col else {})
    near = candidate_pairs(kept, id_col=id_col, title_col=title_col, authors_col=authors_col, least=least, max_block=max_block, extra=extra)
    gap = F.coalesce(F.abs(F.expr("try_cast(year_a as int)") - F.expr("try_cast(year_b as int)")), F.lit(0))
    near = near.withColumn("year_gap", gap).where(F.col("year_gap") <= max_years).withColumn("shared_authors", F.size(F.array_intersect("names_a", "names_b")))
    near = near.where(F.col("shared_authors") >= (weak_authors if vector_col else strong_authors))
    near = near.withColumn("title_sim", title_likeness(F.col("title_a"), F.col("title_b"), least)).where(F.col("title_sim").isNotNull())
    if vector_col:
        weak = F.col("shared_authors") < strong_authors
        near = near.withColumn("abstract_cosine", F.when(weak, cosine(F.col("vector_a"), F.col("vector_b")))).where(~weak | (F.col("abstract_cosine") >= least_cosine))
    else:
        near = near.withColumn("abstract_cosine", F.lit(None).cast("double"))
    return near.select("a", "b", "title_sim", t.jaccard(F.col("names_a"), F.col("names_b")).alias("author_overlap"), "shared_authors", "year_gap", "abstract_cosine")


def cosine(a: Column, b: Column) -> Column:
    """Inner product of two normalised vectors; 0 where one is missing."""
    return F.coalesce(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def near_misses(rows: DataFrame, *, id_col: str, title_col: str, authors_col: str, group_col: str, low: float = 0.4, high: float = 0.85, least_overlap: float = 0.2, max_block: int | None = 50) -> DataFrame:
    """Pairs that are not of one group and nearly alike: title likeness from ``low`` to ``high`` and surname Jaccard of ``least_overlap`` or more, the most alike first."""
    near = candidate_pairs(rows, id_col=id_col, title_col=title_col, authors_col=authors_col, least=low, max_block=max_block, extra={"group": f"coalesce({group_col}, '')"})
    near = near.where((F.col("group_a") == "") | (F.col("group_a") != F.col("group_b"))).withColumn("author_overlap", t.jaccard(F.col("names_a"), F.col("names_b"))).where(F.col("author_overlap") >= least_overlap)
    scored = near.withColumn("title_sim", title_likeness(F.col("title_a"), F.col("title_b"), low)).where(F.col("title_sim") <= high)
    return scored.select("a", "b", "title_sim", "author_overlap").orderBy(F.desc("title_sim"), "a", "b")


def audit_groups(rows: DataFrame, *, id_col: str, group_col: str, title_col: str, authors_col: str, vector_col: str) -> DataFrame:
    """The pairs within each group with three likenesses: group, a, b, title_sim, author_overlap, abstract_cosine (three places), by group.

    Rows of a group that are equal in all that is compared stand for one another: they
    are one member, under the least id, with n_a and n_b rows, since they are alike by
    definition; so copies of a record add no pairs.
    """
    said = rows.where(t.or_blank(F.col(group_col)) != "").groupBy(F.col(group_col).alias("group"), t.or_blank(F.col(title_col)).alias("title"), t.or_blank(F.col(authors_col)).alias("authors"), F.col(vector_col).alias("vector")).agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("n"))
    member = said.select("group", "id", "n", t.title_words(F.col("title")).alias("title"), t.surnames(F.col("authors")).alias("names"), "vector")
    side = lambda x: member.select(F.col("group").alias(f"group_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "title", "names", "vector")])
    met = side("a").join(side("b"), (F.col("group_a") == F.col("group_b")) & (F.col("id_a") < F.col("id_b")))
    likeness = title_likeness(F.col("title_a"), F.col("title_b"))
    return met.select(F.col("group_a").alias("group"), F.col("id_a").alias("a"), F.col("id_b").alias("b"), "n_a", "n_b", F.bround(likeness, 3).alias("title_sim"), F.bround(t.jaccard(F.col("names_a"), F.col("names_b")), 3).alias("author_overlap"), F.bround(cosine(F.col("vector_a"), F.col("vector_b")), 3).alias("abstract_cosine")).orderBy("group", "a", "b")


def audit_members(rows: DataFrame, *, id_col: str, group_col: str, title_col: str, authors_col: str, vector_col: str, least_cosine: float = 0.7, block_rows: int = 4096) -> DataFrame:
    """What audit_groups() finds, pair by pair, with a row for each row of a group, which says what its pairs come to; by group and id.

    group, id; like, the least id of the rows of the group that are equal in all that is
    compared (its class), and n, their number; same_author_overlap and
    same_abstract_cosine, of two rows of the class (their title_sim is 1; null where n is
    1); n_pairs, how many other classes the group has; of the pairs with these n_doubtful
    (abstract_cosine below ``least_cosine`` or no shared author), least and mean of
    title_sim, author_overlap and abstract_cosine (null without pairs), and farthest, the
    class of the least abstract_cosine (of equal ones the least id); pairs, each pair with
    a later class: other, title_sim, author_overlap, abstract_cosine. So each pair of
    classes is listed once, in the row of its first id; a copy's pairs are those of the
    row of its like (null).

    The likenesses are those of audit_groups(), three places each, and means are of these.
    A group is cut into 16 blocks of rows, more where these would pass ``block_rows``,
    fewer where they would have under a quarter of that. A block is a unit of work that
    meets all classes of its group: products of matrices, titles and authors once for each
    two different ones. Units lie in order and pass their rows on as they are made, so
    pairs are neither shuffled nor sorted nor held; a task holds the classes of one group.
    Ids are unique; a vector that is null or has components that are null or not finite
    has a cosine of 0 with any.
    """
    usable = F.forall(F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vector = F.when(usable, F.col("vector").cast("array<double>")).otherwise(F.array().cast("array<double>"))
    held = written(rows.where(t.or_blank(F.col(group_col)) != "").select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), t.or_blank(F.col(title_col)).alias("title"), t.or_blank(F.col(authors_col)).alias("authors"), F.col(vector_col).alias("vector")), "audit-rows")
    placed = written(records.numbered(held, ["group", "id"], "place"), "audit-places")
    discard(held)
    said = ["group", "title", "authors", "vector"]
    classes = placed.groupBy(*[F.col(c).alias(f"__{c}") for c in said]).agg(F.min("id").alias("like"), F.min("place").alias("like_place"), F.count(F.lit(1)).alias("n"))
    names = F.array_join(t.surnames(F.col("authors")), ";")
    member = placed.join(classes, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in said]).select("place", "group", "id", "like", "like_place", "n", t.title_words(F.col("title")).alias("title"), names.alias("names"), vector.alias("vector"))
    own = [F.when(F.col("n") > 1, x) for x in (F.when(F.col("names") == "", 0.0).otherwise(1.0), F.bround(cosine(F.col("vector"), F.col("vector")), 3))]
    member = written(member.withColumns(dict(zip(("same_author_overlap", "same_abstract_cosine"), own, strict=True))), "audit-members")
    discard(placed)
    sizes = member.groupBy(F.col("group").alias("__g")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("m"))
    # enough units for many tasks, and few blocks that each class is sent to
    size = F.least(F.lit(block_rows), F.greatest(F.lit(-(-block_rows // 4)), F.ceil(F.col("m") / 16)))
    block, blocks = F.floor((F.col("place") - F.col("first")) / size), F.ceil(F.col("m") / size)
    to = F.when(F.col("place") == F.col("like_place"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(block))
    sent = member.join(sizes, F.col("group") == F.col("__g")).withColumns({"block": block, "size": size, "to": to}).withColumn("to", F.explode("to"))
    sent = sent.select((F.col("first") + F.col("to") * F.col("size")).alias("unit"), (F.col("to") == F.col("block")).alias("own"), *member.columns)
    units = sent.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit").sortWithinPartitions("unit", "place")
    kinds = ["title_sim", "author_overlap", "abstract_cosine"]
    kept = ["group", "id", "like", "n", "same_author_overlap", "same_abstract_cosine"]
    counts = ["n_pairs", "n_doubtful", *[f"{what}_{c}" for c in kinds for what in ("sum", "least")]]
    id_type = member.schema["id"].dataType
    pair = T.StructType([T.StructField("other", id_type), *[T.StructField(c, T.DoubleType()) for c in kinds]])
    schema = T.StructType([*[T.StructField(c, member.schema[c].dataType) for c in kept], *[T.StructField(c, T.LongType()) for c in counts], T.StructField("farthest", id_type), T.StructField("pairs", T.ArrayType(pair))])
    found = units.mapInArrow(_compared(math.ceil(round(least_cosine * 1000, 6)), kept, counts), schema)
    met = F.col("n_pairs") > 0
    told = [x for c in kinds for x in (F.when(met, F.col(f"least_{c}") / 1000).alias(f"least_{c}"), F.when(met, F.round(F.col(f"sum_{c}") / (F.col("n_pairs") * 1000), 6)).alias(f"mean_{c}"))]
    return found.select("group", "id", "like", "n", "same_author_overlap", "same_abstract_cosine", "n_pairs", "n_doubtful", *told, F.when(met, F.col("farthest")).alias("farthest"), "pairs")


def _thousandths(x: float) -> int:
    """As bround(x, 3): halves of the decimal form go to even."""
    return int(Decimal(repr(float(x))).scaleb(3).quantize(Decimal(1), ROUND_HALF_EVEN))


def _compared(limit: int, kept: list[str], counts: list[str], cells: int = 1 << 18):
    """The units of audit_members(), which come in order: their own rows with counts, sums and least values over the pairs of their classes, likenesses in thousandths, and the pairs.

    About ``cells`` pairs are compared and passed on at a time.
    """

    def coded(column):
        d = column.combine_chunks().dictionary_encode()
        return np.asarray(d.indices), d.dictionary.to_pylist()

    def table_of(x, y, x_at, y_at, score):
        """Scores of every two values of which the first comes before the second somewhere, and where each x and y is in the table."""
        (xs, x_in), (ys, y_in) = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
        first, last, out = np.full(len(xs), np.inf), np.full(len(ys), -1), np.zeros((len(xs), len(ys)), np.int32)
        np.minimum.at(first, x_in, x_at)
        np.maximum.at(last, y_in, y_at)
        for b in range(len(ys)):
            for a in np.flatnonzero(first < last[b]):
                out[a, b] = score(xs[a], ys[b])
        return out, x_in, y_in

    def vectors(column):
        lengths = np.diff(np.asarray(column.offsets))
        out = np.zeros((len(lengths), max(1, lengths.max(initial=0))))
        out[np.arange(out.shape[1]) < lengths[:, None]] = np.asarray(column.flatten())
        return out, lengths

    def cosines(x, y):
        out = x @ y.T
        out *= 1000
        near = np.abs(out - np.floor(out) - 0.5) < 1e-6
        np.rint(out, out)
        i, j = np.nonzero(near)
        if len(i):  # a half: as the sum in order has it
            s = np.zeros(len(i))
            for k in range(x.shape[1]):
                s += x[i, k] * y[j, k]
            values, at = np.unique(s, return_inverse=True)
            out[i, j] = np.array([_thousandths(v) for v in values])[at]
        return out.astype(np.int32)

    def work(batches):
        rest = None
        for batch in batches:
            rest = pa.concat_tables([*([rest] if rest else []), pa.Table.from_batches([batch])])
            unit = np.asarray(rest.column("unit"))
            whole = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0  # the last may go on
            if whole:
                yield from gathered(rest.slice(0, whole).combine_chunks())
                rest = rest.slice(whole)
        if rest:
            yield from gathered(rest.combine_chunks())

    def gathered(table: pa.Table):
        base, ids, parts, n = table.select(kept), table.column("id").combine_chunks(), [], 0

        def batch():
            at, told, far, length, other, *scores = (np.concatenate(x, -1) for x in zip(*parts, strict=True))
            pairs = pa.StructArray.from_arrays([ids.take(pa.array(other)), *[pa.array(x / 1000) for x in scores]], ["other", "title_sim", "author_overlap", "abstract_cosine"])
            starts = np.append(0, np.cumsum(np.maximum(length, 0))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(starts), pairs, mask=pa.array(length < 0))
            columns = [*base.take(pa.array(at)).columns, *map(pa.array, told), ids.take(pa.array(far)), lists]
            return pa.table(columns, [*kept, *counts, "farthest", "pairs"]).to_batches()

        for part in compared(table):
            parts.append(part)
            n += len(part[0]) + len(part[4])
            if n >= cells:
                yield from batch()
                parts, n = [], 0
        if parts:
            yield from batch()

    def compared(table: pa.Table):
        """Of one unit after the other: rows, their counts, sums and least values, the farthest, how many pairs are listed (-1: none, being a copy), and of these the other row and three scores."""
        place, like, own, unit = (np.asarray(table.column(c)) for c in ("place", "like_place", "own", "unit"))
        titles, said = coded(table.column("title"))
        names, lists = coded(table.column("names"))
        sets = [set(x.split(";")) - {""} for x in lists]
        vecs, lengths = vectors(table.column("vector").combine_chunks())
        mixed = bool((lengths != lengths[0]).any())
        matcher, prepared = difflib.SequenceMatcher(None, "", ""), None

        def title(a, b):
            nonlocal prepared
            if prepared != b:
                matcher.set_seq2(said[b])
                prepared = b
            matcher.set_seq1(said[a])
            return _thousandths(matcher.ratio())

        def overlap(a, b):
            x, y = sets[a], sets[b]
            return _thousandths(len(x & y) / len(x | y)) if x and y else 0

        cuts = np.flatnonzero(np.diff(unit, prepend=-1)).tolist()
        for start, end in zip(cuts, [*cuts[1:], len(unit)], strict=True):
            mine = start + np.flatnonzero(own[start:end])
            met = start + np.flatnonzero(place[start:end] == like[start:end])  # a row of each class of the group
            classes, first = np.unique(like[mine], return_index=True)
            one, at, size = mine[first], place[met], len(met)
            itself, which, listed = np.searchsorted(at, classes), np.searchsorted(classes, like[mine]), place[one] == classes
            sooner, title_one, title_met = table_of(titles[one], titles[met], classes, at, title)
            later = table_of(titles[met], titles[one], at, classes, title)[0].T
            overlaps, names_one, names_met = table_of(names[one], names[met], np.zeros(len(one)), np.ones(size), overlap)
            told, far, done, step = np.zeros((len(counts), len(one)), np.int64), np.zeros(len(one), np.int64), 0, max(1, cells // size)
            told[0] = size - 1
            for low in range(0, len(one), step):
                part, high = slice(low, low + step), min(len(one), low + step)
                me, row = itself[part], np.arange(high - low)
                after = np.arange(size) > me[:, None]
                cosine = cosines(vecs[one[part]], vecs[met])
                if mixed:
                    cosine[lengths[one[part]][:, None] != lengths[met]] = 0
                scores = np.where(after, sooner[title_one[part]][:, title_met], later[title_one[part]][:, title_met]), overlaps[names_one[part]][:, names_met], cosine
                bad = (cosine < limit) | (scores[1] == 0)
                bad[row, me] = False
                told[1, part] = bad.sum(1)
                for k, x in enumerate(scores):
                    x[row, me] = 0
                    told[2 + 2 * k, part] = x.sum(1)
                    x[row, me] = 1 << 30
                    told[3 + 2 * k, part] = x.min(1)
                far[part] = met[cosine.argmin(1)]
                after &= listed[part][:, None]
                # the rows before the next class, whose own classes are all done
                upto = len(mine) if high == len(one) else int(np.searchsorted(place[mine], classes[high]))
                rows, of = mine[done:upto], which[done:upto]
                done = upto
                yield rows, told[:, of], far[of], np.where(place[rows] == like[rows], size - 1 - itself[of], -1), met[np.nonzero(after)[1]], *[x[after] for x in scores]

    return work


def apply_merges(pairs: list[tuple], groups: dict) -> dict:
    """Group numbers after taking over the pairs in order, as merge_steps()."""
    return merge_steps(pairs, groups)[0]


def merge_steps(pairs: list[tuple], groups: dict, manual: list[tuple] = ()) -> tuple[dict, list[tuple]]:
    """Group numbers after taking over the pairs in order, then the manual ones; and the pairs that were applied (a, b, group).

    One grouped takes in the other, two ungrouped start a group, two grouped are left; a
    manual pair of which a side is unknown too. The result depends on the order: each
    pair may change what the next finds. It is a review list (pairs of likely the same
    work that no exact title links), so it is plain Python over its few rows.
    """
    out, applied = dict(groups), []
    top = max([int(g[3:]) for g in out.values() if g], default=0)
    for a, b in [*pairs, *(p for p in manual if p[0] in out and p[1] in out)]:
        ga, gb = out.get(a, ""), out.get(b, "")
        if ga and gb:
            continue
        if not ga and not gb:
            top += 1
            ga = f"grp{top:04d}"
        out[a] = out[b] = ga or gb
        applied.append((a, b, out[a]))
    return out, applied


def resume(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not done yet."""
    return wanted.join(done.select(F.col(key).alias("__done")).distinct(), F.col(key) == F.col("__done"), "left_anti")


def same_shingle_pairs(rows: DataFrame, *, id_col: str, text_col: str, least: float, n: int = 3) -> DataFrame:
    """Pairs a < b of different texts whose shingle sets have a Jaccard likeness of ``least`` or more: a, b, n_a, n_b, similarity.

    Rows of equal text are one, under their least id; n_a and n_b are their numbers, so
    copies add no pairs. Shingles are 64-bit hashes. Prefix filter: with shingles in one
    global order (rarest first), two sets so alike share one of their first size -
    ceil(least * size) + 1. Only those are joined, then pairs are verified on the whole sets.
    """
    texts = rows.groupBy(F.col(text_col).alias("text")).agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("n"))
    sets = written(texts.select("id", "n", F.transform(t.shingles(F.col("text"), n), lambda x: F.xxhash64(x)).alias("s")), "shingle-sets")
    exploded = sets.select("id", F.size("s").alias("size"), F.explode("s").alias("shingle"))
    counts = exploded.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # a shingle of one text joins nothing, but has its place in the order, before all others
    ranked = exploded.join(counts, "shingle", "left").withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.coalesce("df", F.lit(1)), "shingle")))
    prefix = ranked.where((F.col("r") <= F.col("size") - F.ceil(F.col("size") * F.lit(least) - F.lit(1e-9)) + 1) & F.col("df").isNotNull())
    left, right = prefix.select("shingle", F.col("id").alias("a"), F.col("size").alias("na")), prefix.select("shingle", F.col("id").alias("b"), F.col("size").alias("nb"))
    met = left.join(right, "shingle").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - F.lit(1e-9))).select("a", "b").distinct()
    side = lambda x: sets.select(F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("s").alias(f"s_{x}"))
    full = met.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    return full.select("a", "b", "n_a", "n_b", t.jaccard(F.col("s_a"), F.col("s_b")).alias("similarity")).where(F.col("similarity") >= least)
