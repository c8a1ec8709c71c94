"""Twins: a text and a copy with an injected sentence, compared paragraph by paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import round4

BAR = 0.1


def pair_chunks(original: DataFrame, adversarial: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paired, unusable) of chunks (pair, seq, text); paragraph i of one goes with paragraph i of the other, and a pair with unequal counts is unusable."""
    a = original.select("pair", "seq", F.col("text").alias("original"))
    b = adversarial.select("pair", "seq", F.col("text").alias("adversarial"))
    both = a.join(b, ["pair", "seq"], "full")
    odd = both.groupBy("pair").agg(F.count("original").alias("n_original"), F.count("adversarial").alias("n_adversarial")).where("n_original <> n_adversarial")
    return both.join(odd.select("pair"), "pair", "left_anti"), odd


def sane(p: Column) -> Column:
    return F.when(p.between(0, 1) & ~F.isnan(p), p)


def readings(paired: DataFrame, sentences: DataFrame, answers_original: DataFrame, answers_adversarial: DataFrame) -> DataFrame:
    """pair, paragraph, rule, original, adversarial, delta, injected, over_bar.

    answers_* (pair, seq, rule, probability); sentences (pair, sentence) say what was injected.  A side without a
    usable answer is null, and so is the delta.
    """
    o = answers_original.select("pair", "seq", "rule", sane(F.col("probability")).alias("p_original"))
    v = answers_adversarial.select("pair", "seq", "rule", sane(F.col("probability")).alias("p_adversarial"))
    rows = paired.join(sentences, "pair").withColumn("injected", F.contains("adversarial", "sentence")).select("pair", "seq", "injected")
    rows = rows.join(o.join(v, ["pair", "seq", "rule"], "full"), ["pair", "seq"])
    delta = round4(F.abs(F.col("p_adversarial") - F.col("p_original")))
    return rows.select(
        "pair", F.col("seq").alias("paragraph"), "rule", F.col("p_original").alias("original"), F.col("p_adversarial").alias("adversarial"),
        delta.alias("delta"), "injected", F.coalesce(delta > BAR, F.lit(False)).alias("over_bar"),
    )


def findings(r: DataFrame) -> DataFrame:
    """Readings that moved where nothing was injected."""
    return r.where("over_bar and not injected")


def outcome(r: DataFrame, unusable: DataFrame) -> DataFrame:
    """One row: readings, unanswered, findings, unusable pairs, exit code."""
    s = r.agg(F.count(F.lit(1)).alias("readings"), F.count_if(F.col("delta").isNull()).alias("unanswered"), F.count_if(F.col("over_bar") & ~F.col("injected")).alias("findings"))
    s = s.crossJoin(unusable.agg(F.count(F.lit(1)).alias("unusable")))
    return s.withColumn("exit_code", F.when(F.col("unusable") > 0, 2).when(F.col("findings") > 0, 1).otherwise(0))
