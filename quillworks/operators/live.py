"""A draft while it is written: spans to underline, reactions, prefixes to record, and re-scoring of what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.ruleset import Rule, Ruleset
from . import countable as R

#: Built-ins whose mark covers the whole paragraph; the other name of the colon rule is not among them.
WHOLE = ("colon_count", "sentence_rhythm")
WORD_CHARS = r"\p{L}\p{N}'’\-"
ORDER = ("approve", "twitch", "wrinkle", "recoil")


def reaction(kind: Column, p: Column, bar: Column) -> Column:
    hard = bar + (1 - bar) / 2
    return F.when(kind == "regex", "wrinkle").when(p + 1e-9 >= hard, "recoil").when(p >= bar, "twitch").otherwise("approve")


def round_reaction(reactions: Column) -> Column:
    """The strongest of a round; approve if there is none."""
    places = F.transform(reactions, lambda r: F.array_position(F.lit(list(ORDER)), r).cast("int"))
    return F.coalesce(F.get(F.lit(list(ORDER)), F.array_max(places) - 1), F.lit("approve"))


def sentence_prefixes(text: Column) -> Column:
    """Every prefix that ends with a sentence, and the whole text if more follows; white space at the end is cut."""
    whole = T.normalise_newlines(text)
    cut = F.transform(T.sentence_bounds(whole), lambda b: T.trim_end(F.substring(whole, F.lit(1), b["end"])))
    return F.filter(F.array_distinct(cut), lambda x: x != "")


def prefix_lengths(text: Column) -> Column:
    """The length of each of sentence_prefixes, from the places of the gaps: no prefix is built."""
    gap = f"(?<=[.!?]){T.WS}+"

    def ends(whole: Column) -> Column:
        gaps = F.transform(F.regexp_extract_all(whole, F.lit(gap), F.lit(0)), F.length)
        parts = F.arrays_zip(F.transform(F.split(whole, gap), F.length).alias("part"), gaps.alias("gap"))
        nexts = T.running(F.transform(parts, lambda z: z["part"] + F.coalesce(z["gap"], F.lit(0))))
        # What stands before a gap ends with a terminator, so there is nothing to trim.
        cut = F.transform(F.arrays_zip(nexts.alias("next"), gaps.alias("gap")), lambda z: z["next"] - z["gap"])
        return F.filter(F.array_distinct(F.concat(cut, F.array(F.length(T.trim_end(whole))))), lambda n: n > 0)

    return T.let(T.normalise_newlines(text), ends)


def around(text: Column, at: Column) -> Column:
    """[start, end) of the word from an offset on, or of a mark with the word on either side."""
    rest, before = F.substring(text, at + 1, F.length(text)), F.substring(text, F.lit(1), at)
    word = F.length(F.regexp_extract(rest, f"^[{WORD_CHARS}]*", 0))
    gap = f"[{T.GAP_SET}]*"
    left = F.length(F.regexp_extract(before, f"[{WORD_CHARS}]*{gap}$(?!\\n)", 0))
    right = F.length(F.regexp_extract(F.substring(rest, F.lit(2), F.length(text)), f"^{gap}[{WORD_CHARS}]*", 0))
    return F.when(word > 0, F.struct(at.alias("start"), (at + word).alias("end"))).otherwise(F.struct((at - left).alias("start"), (at + 1 + right).alias("end")))


def rule_offsets(rule: Rule, text: Column) -> Column:
    if rule.pattern is not None:
        return T.match_offsets(F.substring(text, 1, R.PATTERN_CAP), R.pattern_for_java(rule.pattern, rule.flags))
    if rule.builtin == "dash_present":
        return T.match_offsets(text, R.LONG_DASH)
    if rule.builtin in ("slop_vocab", "banned_words"):
        slop = rule.builtin == "slop_vocab"
        return R.word_offsets(text, rule.words if rule.words is not None else R.SLOP_WORDS if slop else (), rule.spared if rule.spared is not None else R.SLOP_SPARED if slop else ())
    return F.transform(R.rule_lines(rule, text), lambda down: T.let(F.split(text, "\n"), lambda l: F.aggregate(F.slice(l, F.lit(1), down), F.lit(0), lambda n, x: n + F.length(x) + 1)))


def page_flags(placed: DataFrame, ruleset: Ruleset, bar: float | None = None) -> DataFrame:
    """Countable flags of placed paragraphs (file, line, text, start) with spans: every kind of block, code spans included."""
    bar_ = F.lit(ruleset.bar if bar is None else bar)
    text, hits = F.col("text"), []
    for r in ruleset.rules:
        if not r.countable:
            continue
        if r.builtin in WHOLE:
            down = R.rule_lines(r, text)
            spans = F.transform(down, lambda n: F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), n.alias("down")))
        else:
            spans = F.transform(rule_offsets(r, text), lambda at: T.let(around(text, at), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), T.newlines(F.substring(text, F.lit(1), at)).alias("down"))))
        hits.append(F.struct(F.lit(r.id).alias("rule"), F.lit(r.message).alias("message"), F.lit("paragraph" if r.builtin in WHOLE else "span").alias("scope"), spans.alias("spans")))
    rows = placed.select("file", F.col("line").alias("first"), F.col("start").alias("offset"), F.explode(F.array(*hits)).alias("h")).select("*", F.explode("h.spans").alias("s"))
    # Two matches of one span are one mark: the first.
    best = rows.groupBy("file", "first", "offset", "h.rule", "h.message", "h.scope", "s.start", "s.end").agg(F.min("s.down").alias("down"))
    return best.select(
        "file", "rule", F.lit("regex").alias("kind"), F.lit(1.0).alias("probability"), "message", (F.col("first") + F.col("down")).alias("line"),
        (F.col("offset") + F.col("start")).alias("start"), (F.col("offset") + F.col("end")).alias("end"), "scope", reaction(F.lit("regex"), F.lit(1.0), bar_).alias("reaction"),
    )


def judged_page_flags(placed: DataFrame, answers: DataFrame, messages: DataFrame, bar: float) -> DataFrame:
    """Flags of answered paragraphs (digest, nouls): no band here, as a page shows what a model leans to."""
    rows = placed.withColumn("digest", F.sha2("text", 256)).join(answers, "digest").select("*", F.explode("nouls").alias("rule", "probability"))
    rows = rows.where(F.col("probability") >= bar).join(F.broadcast(messages), "rule")
    return rows.select(
        "file", "rule", F.lit("judgment").alias("kind"), "probability", "message", "line", "start", (F.col("start") + F.length("text")).alias("end"),
        F.lit("paragraph").alias("scope"), reaction(F.lit("judgment"), F.col("probability"), F.lit(bar)).alias("reaction"),
    )


def changed(chunks: DataFrame, memo: DataFrame) -> DataFrame:
    """Distinct paragraph texts that no answer is held for."""
    return chunks.select(F.sha2("text", 256).alias("digest"), "text").dropDuplicates(["digest"]).join(memo.select("digest"), "digest", "left_anti")


def recordable(drafts: DataFrame) -> DataFrame:
    """Distinct prose paragraphs of every sentence prefix of drafts, to be asked about once each, shortest first."""
    from .chunk import chunk_drafts, prose_like

    prefixes = drafts.select("file", F.explode(sentence_prefixes(F.col("text"))).alias("text"))
    rows = chunk_drafts(prefixes).where(prose_like(F.col("text"), F.col("kind")))
    return rows.select("text").distinct().withColumn("chars", F.length("text"))
