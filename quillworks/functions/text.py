"""Text as Columns.

White space is the ECMAScript set, which is wider than Java's; word boundaries are ASCII.  Offsets count code points.
Every function is built from Spark's own expressions, so it stays in generated code and needs no exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, to stand inside a character class.
WIDE = r"\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS_SET = r"\t\n\x0B\f\r " + WIDE
#: White space but the line break, to stand inside a character class.
GAP_SET = r"\t\x0B\f\r " + WIDE
WS, NOT_WS = f"[{WS_SET}]", f"[^{WS_SET}]"
WORD_START, WORD_END = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])", r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"
BOUNDARY = f"(?:{WORD_START}|{WORD_END})"
#: Stands before each match while offsets are taken; it has no business in prose.
MARK = "\x01"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: an optimizer that merges projections would copy it into every use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+$", "")


def trim_start(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(NOT_WS)


def words(text: Column) -> Column:
    """Maximal runs without white space."""
    return F.regexp_extract_all(text, F.lit(f"{NOT_WS}+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NOT_WS}+"))


def occurrences(text: Column, literal: str) -> Column:
    """Of a literal, not overlapping."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def newlines(text: Column) -> Column:
    return occurrences(text, "\n")


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def pieces(text: Column, pattern: str | Column) -> Column:
    """The text cut in front of every match; the first piece is what precedes all matches."""
    clean = F.translate(text, MARK, " ")
    return F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(MARK + "$0")), MARK)


def running(values: Column) -> Column:
    """Sums of an integer array up to and with each element, without the last: where each next piece begins."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(
        values, start,
        lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["all"], acc["at"] + x).alias("all")),
        lambda acc: F.slice(acc["all"], 1, F.greatest(F.size(acc["all"]) - 1, F.lit(0))),
    )


def match_offsets(text: Column, pattern: str | Column) -> Column:
    """Zero-based offset of every match, empty matches too."""
    return running(F.transform(pieces(text, pattern), F.length))


def match_lines(text: Column, pattern: str) -> Column:
    """How many line breaks precede each match."""
    return running(F.transform(pieces(text, pattern), newlines))


def lines_of(text: Column, offsets: Column) -> Column:
    """How many line breaks precede each offset."""
    return F.transform(offsets, lambda at: newlines(F.substring(text, F.lit(1), at)))


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def sentence_bounds(text: Column) -> Column:
    """[start, end) of each sentence with the white space behind it; what is left at the end is one more."""
    cut = f"(?<=[.!?]){WS}+"
    ends = F.transform(
        F.arrays_zip(match_offsets(text, cut).alias("at"), F.regexp_extract_all(text, F.lit(cut), F.lit(0)).alias("gap")),
        lambda z: z["at"] + F.length(z["gap"]),
    )
    return let(ends, lambda e: let(
        F.array_distinct(F.concat(e, F.when(F.length(text) > 0, F.array(F.length(text))).otherwise(F.array().cast("array<int>")))),
        lambda all_: F.transform(all_, lambda x, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(all_, i - 1)).alias("start"), x.alias("end"))),
    ))


def excerpt(text: Column, limit: int = 120) -> Column:
    """One line for a report: white space collapsed, long dashes written out, cut with an ellipsis."""
    flat = trim(F.regexp_replace(text, f"{WS}+", " "))
    flat = F.replace(F.replace(flat, F.lit("–"), F.lit("\\u2013")), F.lit("—"), F.lit("\\u2014"))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)
