"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as SQL engines agree on it; pass ``(?U)\\s+`` for all of Unicode.
SPACE = "[ \\t\\n\\r]+"


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def or_blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def collapse_space(x: Column, space: str = SPACE) -> Column:
    return F.trim(F.regexp_replace(or_blank(x), space, " "))


def split_words(x: Column, space: str = SPACE) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(or_blank(x), space), lambda w: w != "")


def strip_braces(x: Column) -> Column:
    return F.regexp_replace(x, "[{}]", "")


def title_key(x: Column) -> Column:
    """Lower-case letters and digits only: what links titles, and compares spans with passages."""
    return F.regexp_replace(F.lower(or_blank(x)), "[^a-z0-9]+", "")


def title_words(x: Column) -> Column:
    """Lower-case words of letters and digits with single spaces, other characters left out: what title likeness is measured on."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(or_blank(x)), "[^a-z0-9 ]", ""), " +", " "))


def significant_words(x: Column) -> Column:
    """Distinct words of four or more letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(or_blank(x)), F.lit("[a-z0-9]{4,}"), F.lit(0)))


def terms(x: Column) -> Column:
    """Tokens of the lexical index, in order."""
    return F.regexp_extract_all(F.lower(or_blank(x)), F.lit("[a-z0-9]+"), F.lit(0))


def surnames(authors: Column) -> Column:
    """Lower-case longest part (the first of equal ones) of each name in a list joined by semicolons."""
    names = F.filter(F.transform(F.split(or_blank(authors), ";"), lambda n: F.trim(n)), lambda n: n != "")
    parts = F.transform(names, lambda n: F.filter(F.split(n, "[,\\s]+"), lambda p: p != ""))
    longest = F.transform(
        F.filter(parts, lambda p: F.size(p) > 0),
        lambda p: F.lower(F.aggregate(p, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))),
    )
    return F.array_distinct(longest)


def shingles(x: Column, n: int = 3) -> Column:
    """Distinct runs of n lower-case words; fewer words give one run of all, none gives none.

    The words are shifted against themselves: slicing them anew for each run would
    split the text as often as it has words.
    """
    w = split_words(F.lower(or_blank(x)))
    runs = F.greatest(F.lit(0), F.size(w) - (n - 1))
    shifted = F.arrays_zip(*[F.slice(w, F.lit(j + 1), runs).alias(f"w{j}") for j in range(n)])
    joined = F.transform(shifted, lambda z: F.concat_ws(" ", *[z[f"w{j}"] for j in range(n)]))
    return F.when(F.size(w) >= n, F.array_distinct(joined)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both.cast("double") / (F.size(a) + F.size(b) - both).cast("double"))


def count_contained(x: Column, words: list[str]) -> Column:
    """How many of the terms occur in the text, each once."""
    if not words:
        return F.lit(0)
    total = None
    for w in words:
        one = F.when(F.contains(x, F.lit(w)), F.lit(1)).otherwise(F.lit(0))
        total = one if total is None else total + one
    return total


def contained(x: Column, words: list[str]) -> Column:
    """The terms that occur in the text, in the order of the list."""
    return F.filter(F.array(*[F.lit(w) for w in words]).cast("array<string>"), lambda w: F.contains(x, w))


def section_label(x: Column) -> Column:
    """A section's title for display: no leading number, lower-case letters, digits and spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(or_blank(x)), "^[0-9.]+[ \\t]*", ""), "[^a-z0-9 ]", ""))


def file_key(*parts: Column) -> Column:
    """A name that any file system takes."""
    return F.regexp_replace(F.concat_ws("__", *parts), "[^A-Za-z0-9_.-]", "_")


#: Fixed value: citations as [3], also in full-width brackets and with a line range after a dagger.
CITATION = "[\\[【](\\d+)(?:†[^\\]】]*)?[\\]】]"


def cited_numbers(answer: Column) -> Column:
    """Distinct source numbers that an answer cites, rising."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(or_blank(answer), F.lit(CITATION), F.lit(1)), lambda n: n.cast("int"))))


def title_case(x: Column) -> Column:
    """Each run of letters begins with a capital, also after a hyphen, a digit or an apostrophe; its other letters are small."""
    runs = F.regexp_extract_all(or_blank(x), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def title_case_heading(x: Column) -> Column:
    """A heading without its leading number, in title case."""
    return title_case(F.trim(F.regexp_replace(or_blank(x), "^[0-9.]+\\s*", "")))


def first_line(x: Column) -> Column:
    return F.substring_index(or_blank(x), "\n", 1)


def after_first_line(x: Column) -> Column:
    head = F.length(first_line(x))
    return F.substring(or_blank(x), head + F.lit(2), F.length(or_blank(x)))
