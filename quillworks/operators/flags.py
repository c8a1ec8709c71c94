"""What becomes of findings: thresholds, merging, verdicts and output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAND = (0.4, 0.6)
FLAG = ("file", "line", "rule", "kind", "probability", "message")
KEY = ("file", "line", "rule")


def undecided(p: Column) -> Column:
    """The model answered without deciding."""
    return p.between(*BAND)


def readings_of(answers: DataFrame, messages: DataFrame) -> DataFrame:
    """answers (file, line, nouls map) to one row an answered rule: file, line, rule, probability, message, no_judgment."""
    rows = answers.select("file", "line", F.explode("nouls").alias("rule", "probability"))
    return rows.join(F.broadcast(messages), "rule").withColumn("no_judgment", undecided(F.col("probability"))).select("file", "line", "rule", "probability", "message", "no_judgment")


def flags_from(readings: DataFrame, bar: float) -> DataFrame:
    """Decided readings at the bar or over it."""
    rows = readings.where(~F.col("no_judgment") & (F.col("probability") >= bar))
    return rows.select("file", "line", "rule", F.lit("judgment").alias("kind"), "probability", "message")


def merge_flags(*groups: DataFrame) -> DataFrame:
    """The union, one flag for each file, line and rule: that of the earliest group, ties by the larger probability."""
    rows = None
    for i, g in enumerate(groups):
        part = g.select(*FLAG).withColumn("_group", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    best = F.min_by(F.struct(*[c for c in FLAG if c not in KEY]), F.struct("_group", -F.col("probability"), "message"))
    return rows.groupBy(*KEY).agg(best.alias("f")).select(*KEY, "f.*")


def sorted_flags(flags: DataFrame) -> DataFrame:
    return flags.orderBy(*KEY)


def lines_out(flags: DataFrame) -> DataFrame:
    return flags.select(*KEY, F.format_string("%s:%d %s %.2f %s", "file", "line", "rule", "probability", "message").alias("text"))


def json_out(flags: DataFrame) -> DataFrame:
    return flags.select(*KEY, F.to_json(F.struct(*FLAG)).alias("json"))


def tally(chunks: DataFrame, answers: DataFrame, rules_asked: DataFrame) -> DataFrame:
    """One row: asked = answered + no_judgment + unanswered, over paragraphs that are sent or should have been.

    chunks: file, line, is_prose.  rules_asked: file, line, rule of every question.  answers: readings.
    """
    asked = rules_asked.join(answers.select(*KEY, "no_judgment"), list(KEY), "left")
    one = asked.agg(
        F.count(F.lit(1)).alias("asked"), F.count_if(~F.col("no_judgment")).alias("answered"),
        F.count_if(F.col("no_judgment")).alias("no_judgment"), F.count_if(F.col("no_judgment").isNull()).alias("unanswered"),
    )
    return one.crossJoin(F.broadcast(chunks.agg(F.count_if(~F.col("is_prose")).alias("structure"))))


def verdict(asked: Column, answered: Column, no_judgment: Column, ran: Column, stopped: Column) -> Column:
    return (
        F.when(~ran, "not run").when((asked > 0) & (answered + no_judgment == 0), "answered nothing")
        .when(stopped | (answered + no_judgment < asked), "degraded").otherwise("answered")
    )


def exit_code(flags: Column, asked: Column, answered: Column, consent: Column) -> Column:
    """3 no consent, 2 asked and nothing answered, 1 flags, 0 none."""
    return F.when(~consent, 3).when((asked > 0) & (answered == 0), 2).when(flags > 0, 1).otherwise(0)


def degradation(skipped: DataFrame) -> DataFrame:
    """skipped (file, line, reason) to reason, count and its first place."""
    first = F.min(F.struct("file", "line"))
    return skipped.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), first.alias("f")).select("reason", "n", F.col("f.file").alias("file"), F.col("f.line").alias("line"))


def skip_lines(skipped: DataFrame) -> DataFrame:
    """skipped (file, line, outcome, reason) to n and text: a line a reason, and one a stop for all it left unsent."""
    rows = skipped.groupBy((F.col("outcome") == "not sent").alias("unsent"), "reason").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "line")).alias("f"))
    text = (
        F.when(F.col("unsent"), F.format_string("asking stopped (%s), %d paragraphs were left unsent", "reason", "n"))
        .when(F.col("n") == 1, F.format_string("no judgment of %s:%d, %s", "f.file", "f.line", "reason"))
        .otherwise(F.format_string("no judgment of %d paragraphs, %s (the first is %s:%d)", "n", "reason", "f.file", "f.line"))
    )
    return rows.select("n", "unsent", text.alias("text"))


def usage(outcomes: DataFrame, hits: DataFrame | None = None, usd_per_million: float | None = None) -> DataFrame:
    """One row of what the outcomes of a judge cost, with its line of text; hits are the answers the cache held."""
    one = outcomes.agg(
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("requests"), F.coalesce(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(0)).alias("retries"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("latency_ms"),
    )
    cached = F.lit(0).cast("long").alias("cached")
    one = one.select("*", cached) if hits is None else one.crossJoin(F.broadcast(hits.agg(F.count(F.lit(1)).alias("cached"))))
    price = F.lit(usd_per_million).cast("double")
    one = one.withColumn("usd", F.col("input_tokens") * price / 1e6)
    cost = F.when(price.isNull(), "no price known").otherwise(F.format_string("$%.6f at $%.3f a million", "usd", price))
    line = F.format_string("%d requests (%d repeated), %d input tokens, %s, %d ms, %d from the cache", "requests", "retries", "input_tokens", cost, "latency_ms", "cached")
    return one.withColumn("text", line)


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
