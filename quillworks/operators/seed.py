"""Planting known faults in clean paragraphs.

Transforms are Columns.  The choice of paragraphs is a seeded shuffle for each rule: ``mode="exact"`` makes the same
choice as a sequential shuffle of all clean paragraphs and so holds them in one task of a rule; ``mode="hash"`` takes
the first paragraphs by a keyed hash, which any number of machines can do, and is another corpus of the same kind.
"""

from __future__ import annotations

import math
import re
from collections.abc import Collection, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.prng import Draws, draw, key_py
from ..sources.ruleset import Rule, Ruleset
from . import countable as R
from .chunk import WS_PY, bounds

PER_RULE = 3
SITE = ", "
FRAME = "One word keeps coming up here, {}."


class SeedError(ValueError):
    pass


# --- transforms as Columns -------------------------------------------------


def keyed_edit(text: Column, find: Column, replacement: Column) -> Column:
    """One literal edit; null unless find stands exactly once."""
    once = (F.length(text) - F.length(F.replace(text, find, F.lit("")))) == F.length(find)
    return F.when((F.length(find) > 0) & once, F.replace(text, find, replacement))


def comma_edit(text: Column, count: int | Column, mark: str) -> Column:
    """The last ``count`` comma sites written with another mark; null where there are fewer."""
    count = F.lit(count) if isinstance(count, int) else count

    def edit(parts: Column) -> Column:
        sites = F.size(parts) - 1
        head, tail = F.slice(parts, F.lit(1), sites - count + 1), F.slice(parts, sites - count + 2, count)
        return F.when(sites >= count, F.concat(F.array_join(head, SITE), F.lit(mark), F.array_join(tail, mark)))

    return T.let(F.split(text, SITE), edit)


def colons_needed(text: Column, count: int, least: float = 3) -> Column:
    return F.greatest(F.lit(count), F.lit(int(least)) - T.occurrences(text, ":"))


def equalize(text: Column) -> Column:
    """The same words in sentences of nearly one length; null for fewer than 16 words or sentences of under 3."""
    none = F.lit(None).cast("string")

    def flow(words: Column, target: Column) -> Column:
        n = F.size(words)
        k = F.greatest(F.lit(4), F.floor(n / target + 0.5).cast("int"))
        size = F.floor(n / k).cast("int")

        def sentence(i: Column, k: Column, size: Column) -> Column:
            extra = n - size * k
            start = i * size + F.least(i, extra)
            # More left over than sentences cannot be, as size is the floor.
            take = F.when(i == k - 1, n - start).otherwise(size + F.when(i < extra, 1).otherwise(0))
            bare = F.filter(F.transform(F.slice(words, start + 1, take), lambda w: F.regexp_replace(w, r"[.!?]+$", "")), lambda w: w != "")
            return F.when(F.size(bare) > 0, F.concat(T.capitalise(F.array_join(bare, " ")), F.lit(".")))

        def whole(s: Column) -> Column:
            out = F.transform(F.sequence(F.lit(0), s["k"] - 1), lambda i: sentence(i, s["k"], s["size"]))
            return F.when(s["size"] >= 3, F.array_join(F.array_compact(out), " "))

        return F.when(n >= 16, T.let(F.struct(k.alias("k"), size.alias("size")), whole)).otherwise(none)

    def mean_length(a: Column) -> Column:
        mean = F.when(a["n"] > 0, a["words"] / a["n"]).otherwise(12.0)
        return F.least(F.lit(24), F.greatest(F.lit(8), F.floor(mean + 0.5).cast("int")))

    target = T.let(R.rhythm(text), mean_length)
    return T.let(F.struct(T.words(text).alias("w"), target.alias("t")), lambda s: flow(s["w"], s["t"]))


def splice(text: Column, sentence: Column, position: str, r: Column) -> Column:
    """A sentence at the start, at the end, or inside: never at the first boundary nor the last; r is a draw in [0, 1)."""

    def put(b: Column) -> Column:
        n = F.size(b)
        inside = F.when(n <= 2, F.greatest(F.lit(0), n - 1)).otherwise(1 + F.floor(r * (n - 2)).cast("int"))
        after = {"start": F.lit(0), "end": n}.get(position, inside)
        at = F.when(after <= 0, F.lit(0)).when(after >= n, F.length(text)).otherwise(F.get(b, after - 1)["end"])
        head, tail = T.trim_end(F.substring(text, F.lit(1), at)), T.trim_start(F.substring(text, at + 1, F.length(text)))
        return F.array_join(F.filter(F.array(head, sentence, tail), lambda x: x != ""), " ")

    return T.let(T.sentence_bounds(text), put)


def word_sentence(rule_words: Sequence[str], key: Column, ordinal: Column) -> Column:
    at = F.pmod(F.floor(draw(key, ordinal) * len(rule_words)), F.lit(len(rule_words))).cast("int")
    return F.format_string(FRAME.replace("{}", "%s"), F.get(F.lit(list(rule_words)), at))


# --- the same on the driver or in a group ----------------------------------


def splice_py(text: str, sentence: str, position: str, draws: Draws) -> tuple[str, int]:
    ends = [b for _, b in bounds(text)] or [len(text)]
    n = len(ends)
    after = {"start": 0, "end": n}.get(position)
    if after is None:
        after = max(0, n - 1) if n <= 2 else 1 + int(draws.next() * (n - 2))
    at = 0 if after == 0 else len(text) if after >= n else ends[after - 1]
    parts = (text[:at].rstrip(WS_PY), sentence, text[at:].lstrip(WS_PY))
    return " ".join(p for p in parts if p), after


def unique_key(text: str, site: int, length: int, steps: int = 6) -> tuple[int, str]:
    """(start, text) of the shortest run of whole words around a site that stands once in the text."""
    a, b = site, site + length
    for _ in range(steps + 1):
        if text.count(text[a:b]) == 1:
            return a, text[a:b]
        a = text.rfind(" ", 0, max(0, a - 1)) + 1 if a > 0 else 0
        end = text.find(" ", b + 1)
        b = len(text) if end < 0 else end
    raise SeedError("no run of words around the site stands once")


def comma_edit_py(text: str, count: int, mark: str) -> str:
    parts = text.split(SITE)
    if len(parts) - 1 < count:
        raise SeedError(f"the paragraph has {len(parts) - 1} comma sites and the seed needs {count}")
    cut = len(parts) - count
    return SITE.join(parts[:cut]) + mark + mark.join(parts[cut:])


def words_py(text: str) -> list[str]:
    return [w for w in re.split(f"[{WS_PY}]+", text) if w]


def equalize_py(text: str) -> str:
    words = words_py(text)
    if len(words) < 16:
        raise SeedError(f"the paragraph has {len(words)} words, too few to flow again")
    lengths = [n for s in re.split(f"(?<=[.!?])[{WS_PY}]+", text) if (n := len(words_py(s)))]
    mean = sum(lengths) / len(lengths) if lengths else 12
    k = max(4, math.floor(len(words) / min(24, max(8, math.floor(mean + 0.5))) + 0.5))
    size, extra = divmod(len(words), k)
    if size < 3:
        raise SeedError("the paragraph is too short for four even sentences")
    out, at = [], 0
    for i in range(k):
        take = size + (i < extra)
        bare = [w for x in words[at : at + take] if (w := re.sub(r"[.!?]+$", "", x))]
        at += take
        if bare:
            s = " ".join(bare)
            out.append(s[0].upper() + s[1:] + ".")
    return " ".join(out)


@dataclass(frozen=True)
class Bank:
    """Faults of a rule as (text, host words), and near misses as (text, why)."""

    faults: dict[str, list[tuple[str, list[str]]]]
    negatives: dict[str, list[tuple[str, str]]]

    def ordered(self, rule: str, host: str) -> list[str]:
        """Those about what the paragraph is about first, then those about nothing in particular, then the rest."""
        text = host.lower()
        rank = lambda hosts: 0 if hosts and any(h.lower() in text for h in hosts) else 1 if not hosts else 2
        return [t for t, _ in sorted(self.faults.get(rule, []), key=lambda f: rank(f[1]))]


def fault_order(text: Column, hosts: Column) -> Column:
    """0 for a fault with a host word in the text, 1 for one without host words, 2 for the rest."""
    fits = F.exists(hosts, lambda h: F.contains(F.lower(text), F.lower(h)))
    return F.when(fits, 0).when(F.size(hosts) == 0, 1).otherwise(2)


def plant(rule: Rule, text: str, draws: Draws, faults: Sequence[str]) -> tuple[str, str]:
    """(new text, spliced sentence or empty), or SeedError."""
    seed = rule.seed
    if seed is None:
        raise SeedError("no seed recipe")
    if seed.splice:
        among = list(faults) or list(seed.splice)
        at = draws.below(len(among))
        sentence = among[at].strip() if at is not None else ""
        if not sentence:
            raise SeedError("the splice list is empty")
        if sentence in text:
            raise SeedError("the spliced sentence is already in the paragraph")
        return splice_py(text, sentence, seed.position, draws)[0], sentence
    count = max(1, math.floor(seed.count + 0.5))
    if seed.transform == "insert_em_dash":
        return comma_edit_py(text, count, " — "), ""
    if seed.transform == "add_colons":
        least = 3 if rule.min is None else rule.min
        return comma_edit_py(text, max(count, int(least) - text.count(":")), ": "), ""
    if seed.transform == "equalize_sentences":
        return equalize_py(text), ""
    words = rule.words if rule.words is not None else R.SLOP_WORDS if seed.transform == "insert_slop_word" else ()
    if not words:
        raise SeedError("the rule has no words, so no defect of this kind can be made")
    sentence = " ".join(FRAME.format(words[draws.below(len(words))]) for _ in range(count))
    return splice_py(text, sentence, "any", draws)[0], sentence


CANDIDATE = "ord int, rule string, made int, base_id string, base_file string, sentence string, text string, transform string, reason string"


def split_clean(bases: DataFrame, ruleset: Ruleset) -> DataFrame:
    """bases (id, file, line, text) with clean and reason: which countable rules a text trips before any planting."""
    rows = bases.withColumn("_t", R.trips(ruleset.rules, F.col("text")))
    reason = F.when(F.size("_t") > 0, F.concat(F.lit("already trips "), F.array_join("_t", ", ")))
    return rows.withColumn("clean", F.size("_t") == 0).withColumn("reason", reason).drop("_t")


def firsts(rows: DataFrame, heads: list[tuple[int, str, int]], most: int, mode: str = "exact") -> DataFrame:
    """ord, key, id, file, nth, total: the first rows (id, file) in the order of each head (ord, rule, key).

    exact: of the sequential shuffle of all rows, sorted by id; total - 1 draws are taken by it.  hash: by keyed hash;
    total is null.  Only ids and files meet.
    """
    heads_ = rows.sparkSession.createDataFrame([(i, k) for i, _, k in heads], "ord int, key long")
    all_ = rows.select("id", "file").crossJoin(F.broadcast(heads_))
    if mode == "hash":
        # Ranks are cut in each task before they meet.
        w = Window.partitionBy("ord").orderBy(F.xxhash64("key", "id"), "id")
        ranked = all_.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
        return ranked.select("ord", "key", "id", "file", "nth", F.lit(None).cast("int").alias("total"))

    def run(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        order = Draws(int(pdf["key"].iloc[0])).shuffled(list(range(len(pdf))))
        return pdf.iloc[order[:most]].assign(nth=range(1, min(most, len(pdf)) + 1), total=len(pdf))[["ord", "key", "id", "file", "nth", "total"]]

    return all_.groupBy("ord").applyInPandas(run, "ord int, key long, id string, file string, nth int, total int")


def drawn(key: int, total: int | None) -> Draws:
    """The draws of a key as the shuffle of so many rows leaves them."""
    draws = Draws(key)
    draws.n = max(0, (total or 0) - 1)
    return draws


def candidates(bases: DataFrame, clean: DataFrame, ruleset: Ruleset, seed: int, most: int, mode: str, bank: Bank | None, ords: Collection[int] | None = None, refused: Mapping[int, Collection[int]] | None = None) -> DataFrame:
    """Planted texts of the first paragraphs each rule (all, or those of the given places) would try, in that order; refusals carry a reason and no text.

    Texts come from the bases by (id, file), which name one paragraph: its rules are not run a second time.  refused
    names the places of a rule whose planted fault was not accepted and so may be planted again.
    """
    refused = dict(refused or {})
    by_id = {i: r for i, r in enumerate(ruleset.rules) if r.seed and (ords is None or i in ords)}
    heads = [(i, r.id, key_py(f"{seed}:{r.id}")) for i, r in by_id.items()]
    first = firsts(clean, heads, most, mode)
    rows = bases.select("id", "file", "text").join(F.broadcast(first) if most <= 10_000 else first, ["id", "file"])

    def run(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        at = int(pdf["ord"].iloc[0])
        total = pdf["total"].iloc[0]
        rule, draws, used, out = by_id[at], drawn(int(pdf["key"].iloc[0]), None if pd.isna(total) else int(total)), set(), []
        for row in pdf.sort_values("nth").to_dict("records"):
            faults = bank.ordered(rule.id, row["text"]) if bank else []
            fresh = [f for f in faults if f not in used] or faults
            common = (at, rule.id, len(out), row["id"], row["file"])
            name = rule.seed.transform or "splice"
            try:
                text, sentence = plant(rule, row["text"], draws, fresh)
            except SeedError as e:
                out.append((*common, None, None, name, str(e)))
                continue
            if len(out) not in refused.get(at, ()):
                used.add(sentence)
            out.append((*common, sentence or None, text, name, None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in CANDIDATE.split(", ")])

    return rows.groupBy("ord").applyInPandas(run, CANDIDATE)


def accepted(made: DataFrame, ruleset: Ruleset) -> DataFrame:
    """Candidates with the reason of those that trip a second countable rule, or not their own."""
    tripped = made.withColumn("_t", R.trips(ruleset.rules, F.coalesce("text", F.lit(""))))
    own_countable = F.col("rule").isin([r.id for r in ruleset.rules if r.countable])
    second = F.filter("_t", lambda x: x != F.col("rule"))
    why = (
        F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.size(second) > 0, F.concat(F.lit("also tripped "), F.array_join(second, ", ")))
        .when(own_countable & ~F.array_contains("_t", F.col("rule")), "did not trip its rule")
    )
    return tripped.withColumn("reason", why).drop("_t")


def settled(bases: DataFrame, clean: DataFrame, ruleset: Ruleset, seed: int, per_rule: int, most: int, mode: str, bank: Bank | None, ords: Collection[int] | None) -> DataFrame:
    """Candidates with reasons, where only accepted faults of the bank count as used.

    Which fault comes next depends on what was accepted before, so each pass settles the first refusal that is not
    known yet, of every rule; without a bank, and mostly with one, there is a single pass.
    """
    known: dict[int, set[int]] = {}
    while True:
        made = accepted(candidates(bases, clean, ruleset, seed, most, mode, bank, ords, known), ruleset).persist()
        if not bank:
            return made
        before = F.count_if(F.col("reason").isNull()).over(Window.partitionBy("ord").orderBy("made"))
        open_ = made.withColumn("_fine", before).where(F.col("reason").isNotNull() & F.col("text").isNotNull() & (F.col("_fine") < per_rule)).select("ord", "made").collect()
        fresh = {}
        for i, place in sorted(map(tuple, open_)):
            if place not in known.get(i, ()):
                fresh.setdefault(i, place)
        if not fresh:
            return made
        made.unpersist()
        for i, place in fresh.items():
            known.setdefault(i, set()).add(place)


def seed_corpus(bases: DataFrame, ruleset: Ruleset, seed: int = 1, per_rule: int = PER_RULE, mode: str = "exact", bank: Bank | None = None, tries: int = 8) -> tuple[DataFrame, DataFrame]:
    """(seeded, refused): per_rule planted copies of clean paragraphs for each rule that carries a recipe.

    A copy stays only if it trips no second countable rule, and its own rule if that is countable.  A rule goes on,
    by rounds, until it has its copies or has tried every clean paragraph; the first round plants per_rule * tries.
    Ids S01, S02, ... run over all rules in order.
    """
    clean = split_clean(bases, ruleset).where("clean").select("id", "file", "text")
    judged, most, short = None, per_rule * tries, None
    while judged is None or short:
        made = settled(bases, clean, ruleset, seed, per_rule, most, mode, bank, short)
        counts = made.groupBy("ord").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").isNull()).alias("fine")).collect()
        short = [r.ord for r in counts if r.fine < per_rule and r.n >= most]
        done = made.where(~F.col("ord").isin(short)) if short else made
        judged = done if judged is None else judged.unionByName(done)
        most *= 8
    judged = judged.withColumn("nth", F.count_if(F.col("reason").isNull()).over(Window.partitionBy("ord").orderBy("made")))
    fine = judged.where(F.col("reason").isNull() & (F.col("nth") <= per_rule))
    # per_rule rows a rule at most.
    number = F.row_number().over(Window.partitionBy().orderBy("ord", "nth"))
    seeded = fine.withColumn("n", number).select(
        F.concat(F.lit("S"), F.lpad(F.col("n").cast("string"), F.greatest(F.lit(2), F.length(F.col("n").cast("string"))), F.lit("0"))).alias("id"),
        "base_id", "base_file", "rule", "transform", "sentence", T.word_count(F.col("text")).alias("words"), "text",
    )
    # What was tried behind the last copy was not needed.
    return seeded, judged.where(F.col("reason").isNotNull() & (F.col("nth") < per_rule)).select("rule", "base_id", "reason")


def near_misses(spark: SparkSession, hosts: Sequence[tuple[str, str, str]] | DataFrame, ruleset: Ruleset, bank: Bank, seed: int = 1) -> DataFrame:
    """N01, N02, ...: texts that look like a fault and are none, in hosts (id, file, text).

    A near miss goes to the host whose place in its rule's own shuffle is the number of near misses planted so far, for
    any rule; one that its host holds already is left out and takes no place.
    """
    queue = [(i, r.id, *near) for i, r in enumerate(ruleset.rules) for near in bank.negatives.get(r.id, ())]
    keys = {i: key_py(f"{seed}:{rule}:negative") for i, rule, _, _ in queue}
    if isinstance(hosts, DataFrame):
        heads = [(i, ruleset.rules[i].id, key) for i, key in keys.items()]
        # No place beyond the number of near misses is ever asked for.
        first = hosts.select("id", "file", "text").join(F.broadcast(firsts(hosts, heads, len(queue))), ["id", "file"])
        rows = first.select("ord", "nth", "total", "id", "file", "text").collect()
        places = {(r.ord, r.nth - 1): (r.id, r.file, r.text) for r in rows}
        totals = {r.ord: r.total for r in rows}
        draws = {i: drawn(key, totals.get(i)) for i, key in keys.items()}
    else:
        draws = {i: Draws(key) for i, key in keys.items()}
        places = {(i, nth): h for i in keys for nth, h in enumerate(draws[i].shuffled(list(hosts)))}
        totals = dict.fromkeys(keys, len(hosts)) if hosts else {}

    def planted() -> Iterator[tuple]:
        n = 0
        for i, rule, text, why in queue if totals else ():
            id_, file, body = places[i, n % totals[i]]
            if text not in body:
                n += 1
                yield f"N{n:02d}", id_, file, rule, why, splice_py(body, text, "any", draws[i])[0]

    return spark.createDataFrame(list(planted()), "id string, base_id string, base_file string, rule string, why string, text string")
