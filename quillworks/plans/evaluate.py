"""The evaluation: clean paragraphs and planted faults through three arms, scored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import judge, score, seed
from ..operators.chunk import kind_of, prose_like
from ..operators.countable import countable_flags
from ..sources.ruleset import Rule, Ruleset

ARMS = (("A", 0), ("B", 1), ("C", 2))
CALLS = {"latency_ms": "double", "input_tokens": "bigint", "output_tokens": "bigint", "cost_usd": "double", "requests": "bigint", "retries": "bigint", "unanswered": "bigint", "usage_reported": "boolean"}


def facts(spark: SparkSession, ruleset: Ruleset, clean_is_filtered: bool = True) -> DataFrame:
    """What is known of each rule before any measurement: countable faults are found by construction, and a countable
    rule cannot fire on paragraphs that were kept because none fires."""

    def inert(r: Rule) -> str | None:
        if r.builtin == "banned_words" and not r.words:
            return "its word list is empty"
        return "clean paragraphs are those it does not fire on" if r.countable and clean_is_filtered else None

    rows = [(r.id, i, r.countable, not r.countable, r.countable and r.seed is not None, inert(r)) for i, r in enumerate(ruleset.rules)]
    return spark.createDataFrame(rows, "rule string, ord int, is_countable boolean, is_judgment boolean, guaranteed boolean, inert_on_clean string")


def documents(clean: DataFrame, negatives: DataFrame | None, seeded: DataFrame) -> DataFrame:
    """id, kind, truth, text: near misses count as clean."""
    none = F.lit(None).cast("string")
    out = clean.select("id", F.lit("clean").alias("kind"), none.alias("truth"), "text")
    if negatives is not None:
        out = out.unionByName(negatives.select("id", F.lit("clean").alias("kind"), none.alias("truth"), "text"))
    return out.unionByName(seeded.select("id", F.lit("seeded").alias("kind"), F.col("rule").alias("truth"), "text"))


def calls_of_nothing(docs: DataFrame, arm: str) -> DataFrame:
    zeros = [F.lit(True if t == "boolean" else 0).cast(t).alias(n) for n, t in CALLS.items()]
    return docs.select(F.lit(arm).alias("arm"), "id", "kind", "truth", *zeros)


def arm_a(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Nothing is asked: every cell answers 0."""
    return docs.select(F.lit("A").alias("arm"), F.col("id").alias("doc")).crossJoin(F.broadcast(rules.select("rule"))).withColumn("probability", F.lit(0.0)).withColumn("answered", F.lit(True))


def as_chunks(docs: DataFrame) -> DataFrame:
    part = F.lit(None).cast("struct<index: int, of: int>")
    return docs.select(F.col("id").alias("file"), F.lit(1).alias("line"), "text", kind_of(F.col("text"), F.lit(1)).alias("kind"), part.alias("part"), F.lit(0).alias("seq"))


def arm_b(docs: DataFrame, ruleset: Ruleset, rules: DataFrame) -> DataFrame:
    """Countable rules answer 1 or 0; judgment rules are not answered."""
    hits = countable_flags(as_chunks(docs), ruleset).select(F.col("file").alias("doc"), "rule").distinct().withColumn("hit", F.lit(1.0))
    every = docs.select(F.col("id").alias("doc")).crossJoin(F.broadcast(rules.select("rule", "is_countable")))
    rows = every.join(hits, ["doc", "rule"], "left")
    return rows.select(F.lit("B").alias("arm"), "doc", "rule", F.coalesce("hit", F.lit(0.0)).alias("probability"), F.col("is_countable").alias("answered"))


def arm_c(docs: DataFrame, ruleset: Ruleset, rules: DataFrame, the_judge: judge.Judge, parallel: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, calls): the countable cells of B, and the judge's probabilities as they came, undecided ones too."""
    chunks = as_chunks(docs)
    asked = judge.with_questions(chunks.where(prose_like(F.col("text"), F.col("kind"))), [r for r in ruleset.rules if not r.countable])
    outcomes = judge.run_judge(asked.select(F.col("file").alias("key"), "text", "questions"), the_judge, parallel).checkpoint()
    answers = outcomes.where("outcome = 'answered'").select(F.col("key").alias("doc"), F.explode("nouls").alias("rule", "p"))
    rows = arm_b(docs, ruleset, rules).join(answers, ["doc", "rule"], "left").join(F.broadcast(rules.select("rule", "is_judgment")), "rule")
    judged = F.col("is_judgment") & F.col("p").isNotNull()
    cells = rows.select(F.lit("C").alias("arm"), "doc", "rule", F.when(judged, F.col("p")).otherwise(F.col("probability")).alias("probability"), F.when(F.col("is_judgment"), judged).otherwise(F.col("answered")).alias("answered"))
    n_judgment = sum(not r.countable for r in ruleset.rules)
    o = outcomes.select(F.col("key").alias("id"), "outcome", "latency_ms", "input_tokens", "output_tokens", "attempts", "usage_reported", F.size("nouls").alias("n"))
    missing = F.when(F.col("outcome") == "answered", n_judgment - F.col("n")).otherwise(F.lit(n_judgment))
    calls = docs.join(o, "id", "left").select(
        F.lit("C").alias("arm"), "id", "kind", "truth", F.coalesce("latency_ms", F.lit(0)).cast("double").alias("latency_ms"), F.coalesce("input_tokens", F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce("output_tokens", F.lit(0)).cast("long").alias("output_tokens"), F.coalesce(judge.cost_usd(F.col("input_tokens")), F.lit(0.0)).alias("cost_usd"),
        # One request a document is counted even where none was sent.
        F.lit(1).cast("long").alias("requests"), F.greatest(F.lit(0), F.coalesce("attempts", F.lit(1)) - 1).cast("long").alias("retries"),
        F.coalesce(missing, F.lit(n_judgment)).cast("long").alias("unanswered"), F.coalesce("usage_reported", F.lit(True)).alias("usage_reported"),
    )
    return cells, calls


@dataclass
class Evaluation:
    docs: DataFrame
    cells: DataFrame
    calls: DataFrame
    rules: DataFrame
    seeded: DataFrame
    refused: DataFrame

    def grid(self) -> DataFrame:
        return score.grid(self.calls, self.cells, self.rules)

    def tables(self, bar: float = score.GALLERY) -> dict[str, DataFrame]:
        g, bars = self.grid(), score.thresholds_with(bar)
        return {
            "per_rule": score.per_rule(g, bars), "overall": score.overall(g, self.rules, bars), "classes": score.by_class(g, self.rules, bars), "calibration": score.calibration(g),
            "unanswered": score.unanswered_cells(g), "misses": score.misses(g), "false_positives": score.false_positives(g), "summary": score.summary(self.calls),
        }


def evaluate(bases: DataFrame, ruleset: Ruleset, the_judge: judge.Judge | None = None, seed_value: int = 1, per_rule: int = 3, mode: str = "exact", bank: seed.Bank | None = None) -> Evaluation:
    """bases (id, file, line, text).  Every rule is measured, whatever its tags."""
    spark = bases.sparkSession
    clean = seed.split_clean(bases, ruleset).where("clean").select("id", "file", "text")
    seeded, refused = seed.seed_corpus(bases, ruleset, seed_value, per_rule, mode, bank)
    seeded = seeded.checkpoint()  # a few rows a rule; later uses must see the same
    negatives = None
    if bank:
        negatives = seed.near_misses(spark, clean, ruleset, bank, seed_value)
    docs = documents(clean, negatives, seeded)
    rules = facts(spark, ruleset)
    cells = arm_a(docs, rules).unionByName(arm_b(docs, ruleset, rules))
    calls = calls_of_nothing(docs, "A").unionByName(calls_of_nothing(docs, "B"))
    if the_judge:
        c_cells, c_calls = arm_c(docs, ruleset, rules, the_judge)
        cells, calls = cells.unionByName(c_cells), calls.unionByName(c_calls)
    return Evaluation(docs, cells, calls, rules, seeded, refused)
