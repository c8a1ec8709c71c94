"""Countable rules, compiled into one projection over paragraphs.

A rule becomes a Column: the array of line breaks that precede each of its matches.  All rules of a ruleset stand in
one array that is exploded once, so a paragraph is read once and moved nowhere, however many rules there are.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.ruleset import Rule, Ruleset, pattern_for_java
from .chunk import with_prose

PATTERN_CAP = 8_000
#: Words that the vocabulary rule lists, and their literal senses that it spares: fixed values.
SLOP_WORDS = ("delve", "tapestry", "landscape", "unlock", "testament", "navigate", "realm", "myriad", "intricate", "pivotal", "seamless", "showcase")
SLOP_SPARED = (
    "landscape architect", "landscape architecture", "landscape gardener", "landscape orientation", "landscape mode",
    "navigate to", "navigate by", "navigate the menu", "navigation bar", "navigation pane",
    "unlock the door", "unlock the screen", "unlock your phone",
)
#: Endings of inflected words: fixed values.
ENDINGS, AFTER_E, FOR_E, FOR_Y = "s|es|ed|ing|ly|ment|ments|ion|ions", "s|d|ly|ment|ments", "es|ed|ing|ion|ions", "ies|ied"
LONG_DASH = r"(?<!\d)–(?!\d)|—"
NO_LINES = "array<int>"


def _literal(text: str) -> str:
    return T.WS + "+" if not text.strip() else "".join(T.WS + "+" if p.isspace() else re.sub(r"([^A-Za-z0-9_])", r"\\\1", p) for p in re.findall(r"\s+|\S+", text))


def inflected(word: str) -> str:
    """A pattern for a word and its ordinary English inflections."""
    word = word.strip()
    stem, cut = _literal(word), _literal(word[:-1]) if len(word) > 1 else ""
    if word.endswith("e") and cut:
        return f"{stem}(?:{AFTER_E})?|{cut}(?:{FOR_E})"
    return f"{stem}(?:{ENDINGS})?" + (f"|{cut}(?:{FOR_Y})" if word.endswith("y") and cut else "")


def word_list_pattern(words: Sequence[str]) -> str:
    """Longest first, so that a phrase wins over its first word."""
    fold = "(?iu)" if any(not w.isascii() for w in words) else "(?i)"
    plain = all(re.fullmatch(r"[A-Za-z0-9_](?:.*[A-Za-z0-9_])?", w.strip(), re.DOTALL) for w in words)
    # Next to a word character a boundary is one look at the other side.
    before, after = ("(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])") if plain else (T.BOUNDARY, T.BOUNDARY)
    return f"{fold}{before}(?:{'|'.join(inflected(w) for w in sorted(words, key=len, reverse=True))}){after}"


def spared_pattern(phrase: str) -> str:
    """A phrase with each of its words inflected; it may stand inside longer words."""
    return "(?i)" + f"{T.WS}+".join(f"(?:{inflected(w.lower())})" if re.fullmatch("[A-Za-z]+", w) else _literal(w) for w in phrase.split())


# --- the checks: arrays of offsets or of line counts -----------------------


def dash_lines(text: Column) -> Column:
    return F.when(text.rlike("[–—]"), T.match_lines(text, LONG_DASH)).otherwise(F.array().cast(NO_LINES))


MASKS = (rf"(?i)[a-z][a-z0-9+.-]*://{T.NOT_WS}+", r"(?<![A-Za-z0-9_])\d{1,2}:\d{2}(?::\d{2})?(?![A-Za-z0-9_])", r"(?s)<!--.*?-->")


def without_links(text: Column) -> Column:
    """Without addresses, clock times and comments.  Only colons are counted in it, so lengths may change, but line breaks stay."""
    out = text
    for mask in MASKS[:2]:
        out = F.regexp_replace(out, mask, " ")
    # Line breaks of a comment stay: the comment is cut at its breaks and joined again.
    opened = F.split(out, "<!--")

    def close(piece: Column, i: Column) -> Column:
        end = F.instr(piece, "-->")
        inside = F.substring(piece, F.lit(1), end - 1)
        rest = F.substring(piece, end + 3, F.length(piece))
        blanked = F.concat(F.regexp_replace(inside, r"[^\n]", ""), rest)
        return F.when(i == 0, piece).when(end > 0, blanked).otherwise(F.concat(F.lit("<!--"), piece))

    return F.when(out.contains("<!--"), F.array_join(F.transform(opened, close), " ")).otherwise(out)


def colon_lines(text: Column, least: float = 3) -> Column:
    def count(prose: Column) -> Column:
        first = F.array(T.newlines(F.substring_index(prose, ":", 1)))
        return F.when(T.occurrences(prose, ":") >= F.lit(least), F.when(prose.contains(":"), first)).otherwise(F.array().cast(NO_LINES))

    none = F.array().cast(NO_LINES)
    return F.when(T.occurrences(text, ":") >= F.lit(least), F.coalesce(T.let(without_links(text), count), none)).otherwise(none)


def sentence_lengths(text: Column) -> Column:
    """Words of each sentence that has any."""
    return F.filter(F.transform(F.split(text, rf"(?<=[.!?]){T.WS}+"), T.word_count), lambda n: n > 0)


def rhythm(text: Column) -> Column:
    """Struct of n, words and cv (population deviation over mean) of the sentence lengths, in one fold."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("n"), zero.alias("s"), zero.alias("q"))
    step = lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x.cast("long") * x).alias("q"))
    cv = lambda a: F.when(a["s"] > 0, F.sqrt((a["n"] * a["q"] - a["s"] * a["s"]).cast("double")) / a["s"])
    return F.aggregate(sentence_lengths(text), start, step, lambda a: F.struct(a["n"].alias("n"), a["s"].alias("words"), cv(a).alias("cv")))


def rhythm_lines(text: Column, floor: float = 0.25, sentences: float = 4, words: float = 60) -> Column:
    none = F.array().cast(NO_LINES)
    even = T.let(rhythm(text), lambda r: (r["n"] >= sentences) & (r["words"] >= words) & (r["cv"] < floor))
    return F.when(F.coalesce(even, F.lit(False)), F.array(F.lit(0))).otherwise(none)


def word_offsets(text: Column, words: Sequence[str], spared: Sequence[str] = ()) -> Column:
    none = F.array().cast(NO_LINES)
    if not words:
        return none
    pattern = word_list_pattern(words)
    found = T.match_offsets(text, pattern)
    if spared := [s for s in spared if s.strip()]:
        # One expression over the phrases, not one for each: a plan is built faster, and few texts get here.
        def spans(p: Column) -> Column:
            at = F.arrays_zip(T.match_offsets(text, p).alias("a"), F.regexp_extract_all(text, p, F.lit(0)).alias("t"))
            return F.transform(at, lambda z: F.struct(z["a"].alias("a"), (z["a"] + F.length(z["t"])).alias("b")))

        all_ = F.flatten(F.transform(F.lit([spared_pattern(x) for x in spared]), spans))
        found = T.let(all_, lambda s: F.filter(T.match_offsets(text, pattern), lambda m: ~F.exists(s, lambda z: (m >= z["a"]) & (m < z["b"]))))
    # A search for the bare stems is far cheaper than the pattern, and most paragraphs hold none.
    stems = sorted({(w.split() or [""])[0].lower() for w in words})
    stems = [x[:-1] if x[-1:] in ("e", "y") and len(x) > 1 else x for x in stems]
    hit = text.rlike(pattern)
    if all(x.isascii() and x for x in stems):
        any_stem = lambda low: reduce(lambda p, q: p | q, [F.contains(low, F.lit(x)) for x in stems])
        hit = T.let(F.lower(text), any_stem) & hit
    return F.when(hit, found).otherwise(none)


def rule_lines(rule: Rule, text: Column) -> Column:
    """Line breaks before each match of a rule in a text, without a look at the kind of block."""
    if rule.pattern is not None:
        return T.match_lines(F.substring(text, 1, PATTERN_CAP), pattern_for_java(rule.pattern, rule.flags))
    if rule.builtin == "dash_present":
        return dash_lines(text)
    if rule.builtin in ("colon_count", "colon_heavy"):
        return colon_lines(text, 3 if rule.min is None else rule.min)
    if rule.builtin == "sentence_rhythm":
        given = {k: v for k, v in (("floor", rule.floor), ("sentences", rule.min_sentences), ("words", rule.min_words)) if v is not None}
        return rhythm_lines(text, **given)
    slop = rule.builtin == "slop_vocab"
    words = rule.words if rule.words is not None else SLOP_WORDS if slop else ()
    spared = rule.spared if rule.spared is not None else SLOP_SPARED if slop else ()
    return T.lines_of(text, word_offsets(text, words, spared))


def trips(rules: Sequence[Rule], text: Column) -> Column:
    """Ids of the countable rules that a text trips, whatever kind of block it is and code spans included."""
    ids = [F.when(F.size(rule_lines(r, text)) > 0, F.lit(r.id)) for r in rules if r.countable]
    return F.array_compact(F.array(*ids)) if ids else F.array().cast("array<string>")


def countable_flags(chunks: DataFrame, ruleset: Ruleset) -> DataFrame:
    """file, line, rule, kind, probability, message: one row for each line of a paragraph and rule that matches there."""
    rules = [r for r in ruleset.rules if r.countable]
    schema = "file string, line int, rule string, kind string, probability double, message string"
    if not rules:
        return chunks.sparkSession.createDataFrame([], schema)
    none = F.array().cast(NO_LINES)
    hits = [
        F.struct(F.lit(r.id).alias("rule"), F.lit(r.message).alias("message"), F.array_distinct(F.when(F.col("kind").isin(*r.kinds), rule_lines(r, F.col("prose"))).otherwise(none)).alias("at"))
        for r in rules
    ]
    rows = with_prose(chunks).select("file", "line", F.explode(F.array(*hits)).alias("h")).where(F.size("h.at") > 0)
    rows = rows.select("file", "line", "h.rule", "h.message", F.explode("h.at").alias("down"))
    return rows.select("file", (F.col("line") + F.col("down")).alias("line"), "rule", F.lit("regex").alias("kind"), F.lit(1.0).alias("probability"), "message")


def pattern_notes(chunks: DataFrame, ruleset: Ruleset) -> DataFrame:
    """file, line, rule of the paragraphs that a user's pattern read only in part."""
    own = [F.when(F.col("kind").isin(*r.kinds), F.lit(r.id)) for r in ruleset.rules if r.pattern is not None]
    ids = F.array_compact(F.array(*own)) if own else F.array().cast("array<string>")
    return chunks.where(F.length("text") > PATTERN_CAP).select("file", "line", F.explode(ids).alias("rule"))
