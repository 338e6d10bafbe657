"""Secret scans: patterns, and character Markov models.

Two first-order Markov models over the characters of a token, one of random
strings and one of ordinary identifiers, are trained from labelled samples. A
token's log-likelihood ratio is the sum, over its pairs of adjacent characters,
of the difference of the two models' log-probabilities; above a threshold the
token is reported beside what the patterns find. All of it is SQL expressions:
a text is scanned where it was read, without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, folded, fresh, in_blocks, let

# The base patterns, and the least length of what counts (of group 2 for assign).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: The kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "markov")

#: A token to be judged: a whole run of these characters, long enough to hold a key.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: A token that the models are trained on may be shorter.
SAMPLE_TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"

#: The type of a span.
SPAN = "struct<start:int,order:int,stop:int>"

#: What takes the place of a secret in a redacted text.
MARK = "[secret]"


@dataclass(frozen=True)
class Models:
    """ratios: for each pair of characters, row by row, the log-likelihood ratio of random to ordinary."""

    ratios: tuple[float, ...]

    def column(self) -> Column:
        return F.split(F.lit(",".join(f"{x:.6f}" for x in self.ratios)), ",").cast("array<double>")  # folded into one literal


def codes(token: Column) -> Column:
    """Place of each character in the alphabet, from 0; -1 for others."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def train(samples: DataFrame, *, text_col: str = "text", random_col: str = "random", smoothing: float = 0.5) -> Models:
    """Models from labelled tokens; pairs are counted by Spark, and at most 2 * 66 * 66 counts come to the driver.

    Null texts and labels are left out. Without samples of a label its model is even.
    """
    pairs = samples.where(F.col(text_col).isNotNull() & F.col(random_col).isNotNull()).select(F.col(random_col).cast("boolean").alias("random"), codes(F.col(text_col)).alias("c"))
    steps = pairs.where(F.size("c") > 1).select("random", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))).alias("p"))
    counts = {(r["random"], r["a"], r["b"]): r["n"] for r in steps.select("random", "p.a", "p.b").where("a >= 0 and b >= 0").groupBy("random", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    k = len(ALPHABET)
    out = []
    for a in range(k):
        rows = {label: [counts.get((label, a, b), 0) + smoothing for b in range(k)] for label in (True, False)}
        sums = {label: sum(x) for label, x in rows.items()}
        out += [math.log(rows[True][b] / sums[True]) - math.log(rows[False][b] / sums[False]) for b in range(k)]
    return Models(tuple(out))


def random_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled random tokens as keys are made: base64, hex, upper and lower case with digits, from digests of numbers."""
    raw = F.unhex(F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 512))
    text64 = F.translate(F.base64(raw), "=", "")
    made = [text64, F.lower(F.hex(raw)), F.upper(F.regexp_replace(text64, "[+/]", "")), F.translate(text64, "+/", "-_"), F.lower(F.regexp_replace(text64, "[+/]", "")), F.regexp_replace(text64, "[+/]", "")]
    kind = F.pmod(F.col("id"), F.lit(len(made)))
    text = F.coalesce(*[F.when(kind == i, x) for i, x in enumerate(made)])
    return spark.range(n).select(F.substring(text, 1, 64).alias("text"), F.lit(True).alias("random"))


def ordinary_samples(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 2000) -> DataFrame:
    """Labelled ordinary tokens: those of a bounded sample of documents, outside what the patterns find.

    sample_docs bounds the sample, whole texts; see bounded_sample(), which is the same for the same rows.
    """
    plain = F.regexp_replace(F.regexp_replace(F.col("text"), ASSIGN, " "), f"{ACCESS}|[0-9a-f]{{{LEAST_HEX},}}", " ")
    return bounded_sample(docs, id_col, text_col, sample_docs).select(F.explode(F.regexp_extract_all(plain, F.lit(SAMPLE_TOKEN), F.lit(0))).alias("text"), F.lit(False).alias("random"))


def default_models(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 2000) -> Models:
    """Models of generated random strings and of the ordinary tokens of a bounded sample of ``docs``.

    The same rows give the same models, in whatever order they lie; null texts and ids
    are allowed, repeated rows count once, and an empty table leaves the ordinary model even.
    """
    return train(random_samples(docs.sparkSession).unionByName(ordinary_samples(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, sample_docs=sample_docs)))


def located(text: Column, pattern: str, kind: int, kept) -> Column:
    """Spans (start, order, stop; code points, stop exclusive) of the pattern's leftmost matches of which ``kept(match, group 2)`` holds.

    What lies between the matches is what split() leaves, so starts are running sums of lengths.
    """
    groups = pattern == ASSIGN
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if groups else matches
    pieces = F.arrays_zip(F.slice(F.split(text, pattern), F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"), values.alias("value"))

    def step(at: Column, piece: Column) -> tuple[Column, Column]:
        start = at + F.length(piece["gap"])
        stop = start + F.length(piece["match"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("order"), stop.alias("stop"))
        return stop, F.when(kept(piece["match"], piece["value"]), F.array(span)).otherwise(none)

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(pattern), folded(pieces, F.lit(0), SPAN, step)["out"]).otherwise(none)


def ratio(token: Column, models: Models) -> Column:
    """Log-likelihood ratio of random to ordinary of a token."""
    k = len(ALPHABET)
    table = models.column()
    c = codes(token)
    pairs = F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.when((a >= 0) & (b >= 0), F.element_at(table, a * k + b + 1)).otherwise(F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def scan(docs: DataFrame, models: Models, *, text_col: str = "text", least_ratio: float = 14.0, keep: list[str] | None = None) -> DataFrame:
    """Adds base_spans and all_spans, arrays of (start, order, stop) by start, then kind.

    order is the kind's place in KINDS. A token of the models is added where its ratio
    is ``least_ratio`` or more and it overlaps no base span. Null and empty texts have
    no spans; texts of any length are scanned whole, in time about proportional to
    length and matches. Each row gives a row, repeated rows equal ones, an empty table
    none. keep: the columns to return beside them (by default all; base_spans and
    all_spans are replaced if they are there, other names may be any).
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("base_spans", "all_spans")]
    own, judged = fresh(docs, "__text"), fresh(docs, "__tokens")
    text = F.coalesce(F.col(own), F.lit(""))
    base = F.array_sort(
        F.concat(
            located(text, ASSIGN, 0, lambda m, v: F.length(v) >= LEAST_ASSIGN),
            # as the run is taken greedily from its first place, the least length may stand in the pattern
            located(text, f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}", 1, lambda m, v: F.lit(True)),
            located(text, f"[0-9a-f]{{{LEAST_HEX},}}", 2, lambda m, v: F.lit(True)),
        )
    )
    tokens = located(text, TOKEN, 3, lambda m, v: ratio(m, models) >= least_ratio)
    found = docs.select(*keep, F.col(text_col).alias(own)).withColumn("base_spans", base).withColumn(judged, tokens)
    free = F.when((F.size("base_spans") > 0) & (F.size(judged) > 0), without_overlap(F.col(judged), F.col("base_spans"))).otherwise(F.col(judged))
    return found.select(*keep, "base_spans", F.array_sort(F.concat("base_spans", free)).alias("all_spans"))


def without_overlap(tokens: Column, spans: Column) -> Column:
    """The tokens that overlap none of the spans, which are sorted by start; whole blocks of spans are passed over by where they begin and end."""
    meets = lambda t, b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])
    ranges = F.transform(in_blocks(spans), lambda b: F.struct(F.element_at(b, 1)["start"].alias("start"), F.array_max(F.transform(b, lambda s: s["stop"])).alias("stop"), b.alias("spans")))
    return let(ranges, lambda r: F.filter(tokens, lambda t: ~F.exists(r, lambda b: meets(t, b) & F.exists(b["spans"], lambda s: meets(t, s)))))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["order"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["order"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column, mark: str = MARK) -> Column:
    """The text with ``mark`` in place of each stretch that spans cover; overlapping spans are one stretch."""

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        part = F.substring(text, at + 1, s["start"] - at)
        return F.greatest(at, s["stop"]), F.when((s["start"] >= at), F.array(part)).otherwise(F.array().cast("array<string>"))

    whole = lambda f: F.concat(F.array_join(f["out"], mark), F.lit(mark), F.substring(text, f["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, let(folded(spans, F.lit(0), "string", step), whole)).otherwise(text)
