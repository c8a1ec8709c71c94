"""Drafts to paragraphs.

Drafts without fences are cut in Spark's own expressions; only those with a fence, or with a paragraph over the cap,
go through a line-by-line fold in Arrow batches, as quotes and list items decide where a fence counts.  Both ways are
narrow: paragraphs stay where their draft was read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CHUNKS = "file string, line int, text string, kind string, part struct<index: int, of: int>, seq int"
KINDS = ("prose", "heading", "list", "block_quote", "table", "front_matter", "html_comment", "link_definition")
LIST_PROSE_WORDS = 12
STATE_CAP = 24_000


# --- kinds ---------------------------------------------------------------


def _any_line(pattern: str) -> str:
    return f"(?dm)^(?:{pattern})"


def _not_all_lines(pattern: str) -> str:
    """Matches if some non-blank line does not match."""
    return f"(?dm)^(?!{pattern})(?=[^\\n]*{T.NOT_WS})"


TABLE_LINE = rf" {{0,3}}\|?[{T.WS_SET}:|-]*-[{T.WS_SET}:|-]*\|[{T.WS_SET}:|-]*$".replace(r"\n", "")
LINK_LINE = rf" {{0,3}}\[[^\]]+\]:{T.WS}*{T.NOT_WS}+"
HEADING_LINE = rf" {{0,3}}#{{1,6}}(?:{T.WS}|$)"
RULE_LINE = rf"(?:---|\+\+\+)[{T.GAP_SET}]*$"
FIRST = rf"(?d)\A(?:[{T.GAP_SET}]*\n)*"


def kind_of(text: Column, line: Column) -> Column:
    """What kind of block a paragraph is; the order of the tests is the contract."""
    closes = F.regexp_count(text, F.lit(_any_line(RULE_LINE))) > 1
    filled = F.regexp_count(text, F.lit(f"(?dm)^(?=[^\\n]*{T.NOT_WS})"))
    return (
        F.when((line == 1) & text.rlike(FIRST + RULE_LINE.replace("$", "(?:\\n|$)")) & (filled > 2) & closes, "front_matter")
        .when(text.rlike(rf"\A{T.WS}*<!--"), "html_comment")
        .when(text.rlike(_any_line(TABLE_LINE)) & text.contains("|"), "table")
        .when(text.rlike(T.NOT_WS) & ~text.rlike(_not_all_lines(LINK_LINE)), "link_definition")
        .when(text.rlike(T.NOT_WS) & ~text.rlike(_not_all_lines(HEADING_LINE)), "heading")
        .when(text.rlike(FIRST + r" {0,3}>"), "block_quote")
        .when(text.rlike(FIRST + r" *(?:[-*+]|\d{1,9}[.)]) +"), "list")
        .otherwise("prose")
    )


def prose_like(text: Column, kind: Column) -> Column:
    """Whether a paragraph is worth a judgment: prose and quotes, and lists long enough to hold sentences."""
    bare = F.regexp_replace(text, r"(?dm)^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+", "")
    return kind.isin("prose", "block_quote") | ((kind == "list") & (T.word_count(bare) >= LIST_PROSE_WORDS))


def opens_block(part: Column) -> Column:
    return part.isNull() | (part["index"] == 1)


def closes_block(part: Column) -> Column:
    return part.isNull() | (part["index"] == part["of"])


# --- cutting without fences ----------------------------------------------


def chunk_plain(drafts: DataFrame) -> DataFrame:
    """Paragraphs of drafts that hold no fence: maximal runs of non-blank lines."""
    # The generator keeps the optimizer from copying the split into every use of it.
    lines = drafts.select("file", F.explode(F.array(F.split(T.normalise_newlines(F.coalesce("text", F.lit(""))), "\n"))).alias("l"))
    full = lines.select("file", "l", F.explode(F.array(F.transform("l", lambda x: ~T.is_blank(x)))).alias("f"))

    def edges(step: int) -> Column:
        at = F.sequence(F.lit(0), F.size("f") - 1)
        return F.filter(at, lambda i: F.get("f", i) & ~F.coalesce(F.get("f", i + step), F.lit(False)))

    spans = full.select("file", "l", F.posexplode(F.arrays_zip(edges(-1).alias("a"), edges(1).alias("b"))).alias("seq", "z"))
    text = F.array_join(F.slice("l", F.col("z.a") + 1, F.col("z.b") - F.col("z.a") + 1), "\n")
    out = spans.select("file", (F.col("z.a") + 1).alias("line"), text.alias("text"), "seq")
    return out.select("file", "line", "text", kind_of(F.col("text"), F.col("line")).alias("kind"), F.lit(None).cast("struct<index: int, of: int>").alias("part"), "seq")


# --- cutting with fences -------------------------------------------------

#: The white space, and what marks a quote, a list item and a fence.
WS_PY = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
QUOTES, ITEM, DRAWN = r"(?: {0,3}+> ?+)", r" *(?:[-*+]|[0-9]{1,9}[.)]) +", r" {0,3}(?P<drawn>`{3,}(?=[^`]*\Z)|~{3,})"
SHAPE = re.compile(rf"(?P<quotes>{QUOTES}*+)(?P<item>{ITEM})?(?P<rest>.*)", re.DOTALL)
OPENS = re.compile(DRAWN, re.DOTALL)


@lru_cache(maxsize=256)
def closer(depth: int, column: int, drawn: str) -> re.Pattern:
    """Lines that close a fence: at its depth of quotes, not left of its column, drawn with its mark, at least as long."""
    return re.compile(rf"{QUOTES}{{{depth}}}[{WS_PY}]{{{column}}} {{0,3}}{re.escape(drawn[0])}{{{len(drawn)},}}[ \t]*")


def fenced(lines: list[str]) -> Iterator[tuple[int, int]]:
    """[start, end) of each fenced run of lines, its marks included; one that nothing closes takes the rest.

    Only what decides whether a fence counts is carried along: how deep the quotes are, and the column at which the
    content of an open list item stands.
    """
    depth = column = at = 0
    while at < len(lines):
        shape = SHAPE.fullmatch(lines[at])
        item, rest, outer = shape["item"], shape["rest"], depth
        depth = shape["quotes"].count(">")
        if item:  # a fence on the line of the mark itself is text
            column, rest = len(item), ""
        else:
            filled = rest.lstrip(WS_PY)
            if depth != outer or (filled and len(rest) - len(filled) < column):
                column = 0
            rest = rest[column:] if filled else ""
        at += 1
        if drawn := OPENS.match(rest):
            begin, ends = at - 1, closer(depth, column, drawn["drawn"])
            at = next((i for i in range(at, len(lines)) if ends.fullmatch(lines[i])), len(lines)) + 1
            yield begin, min(at, len(lines))


def paragraphs(text: str) -> Iterator[tuple[int, str]]:
    """(first line, text) of the paragraphs of a draft: runs of lines that are neither blank nor fenced."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    prose = [bool(line.strip(WS_PY)) for line in lines]
    for a, b in fenced(lines):
        prose[a:b] = [False] * (b - a)
    for is_prose, run in groupby(range(len(lines)), prose.__getitem__):
        if is_prose:
            at = list(run)
            yield at[0] + 1, "\n".join(lines[at[0] : at[-1] + 1])


SENTENCE = re.compile(f"[.!?]+(?=[{WS_PY}]|\\Z)[{WS_PY}]*")


def bounds(text: str) -> list[tuple[int, int]]:
    ends = [m.end() for m in SENTENCE.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return list(zip([0, *ends], ends))


def split_long(line: int, text: str, cap: int | None) -> list[tuple[int, str]]:
    """Whole sentences packed up to the cap; a sentence over it is cut on it.  (line, text) of each piece."""
    if not cap or len(text) <= cap:
        return [(line, text)]
    groups: list[list[int]] = []
    for a, b in bounds(text):
        if groups and len(text[groups[-1][0] : b].rstrip(WS_PY)) <= cap:
            groups[-1][1] = b
        else:
            groups.append([a, b])
    cuts = [(i, min(i + cap, b)) for a, b in groups for i in range(a, b, cap)]
    found = [(line + text.count("\n", 0, a), piece) for a, b in cuts if (piece := text[a:b].rstrip(WS_PY))]
    return found or [(line, text)]


def chunk_folded(drafts: DataFrame, max_chars: int | None = None) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for file, text in zip(*(c.to_pylist() for c in batch.columns)):
                seq = 0
                for line, block in paragraphs(text or ""):
                    cut = split_long(line, block, max_chars)
                    for i, (at, piece) in enumerate(cut, 1):
                        rows.append((file, at, piece, line, block, {"index": i, "of": len(cut)} if len(cut) > 1 else None, seq))
                        seq += 1
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    import pyarrow as pa

    schema = pa.schema([
        ("file", pa.string()), ("line", pa.int32()), ("text", pa.string()), ("first", pa.int32()), ("block", pa.string()),
        ("part", pa.struct([("index", pa.int32()), ("of", pa.int32())])), ("seq", pa.int32()),
    ])
    out = drafts.select(F.col("file").cast("string"), F.col("text").cast("string")).mapInArrow(run, "file string, line int, text string, first int, block string, part struct<index: int, of: int>, seq int")
    # A piece is of the kind of the block that it was cut from.
    return out.select("file", "line", "text", kind_of(F.col("block"), F.col("first")).alias("kind"), "part", "seq")


def chunk_drafts(drafts: DataFrame, max_chars: int | None = None) -> DataFrame:
    """file, line, text, kind, part, seq of every paragraph of drafts (file, text).  Null texts have none."""
    hard = F.col("text").rlike("`{3}|~{3}")
    if max_chars:
        hard = hard | (F.length("text") > max_chars)
    hard = F.coalesce(hard, F.lit(False))
    rows = drafts.select("file", "text")
    return chunk_plain(rows.where(~hard)).unionByName(chunk_folded(rows.where(hard), max_chars))


# --- code spans and places -----------------------------------------------

RUN = re.compile("`+")


def mask_code_py(text: str) -> str:
    """Code spans as blanks of the same length, line breaks kept; a run without a partner stays."""
    runs = [m.span() for m in RUN.finditer(text)]
    out, at, i = [], 0, 0
    while i < len(runs):
        a, b = runs[i]
        j = next((j for j in range(i + 1, len(runs)) if runs[j][1] - runs[j][0] == b - a), None)
        if j is None:
            i += 1
            continue
        out += [text[at:a], re.sub(r"[^\n]", " ", text[a : runs[j][1]])]
        at, i = runs[j][1], j + 1
    return "".join([*out, text[at:]])


def with_prose(chunks: DataFrame) -> DataFrame:
    """Adds prose: the text with its code spans blanked.  Python sees only paragraphs that hold a backtick."""
    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(mask_code_py)

    ticks = F.col("text").contains("`")
    return chunks.where(~ticks).withColumn("prose", F.col("text")).unionByName(chunks.where(ticks).withColumn("prose", mask("text")))


def place_chunks(chunks: DataFrame, drafts: DataFrame) -> DataFrame:
    """Adds start: the offset in the normalised draft of the line that each whole paragraph starts on."""
    d = drafts.select("file", T.normalise_newlines(F.col("text")).alias("_draft"))
    before = F.slice(F.split("_draft", "\n"), F.lit(1), F.col("line") - 1)
    start = F.aggregate(before, F.lit(0), lambda n, x: n + F.length(x) + 1)
    return chunks.join(d, "file").withColumn("start", start).drop("_draft")
