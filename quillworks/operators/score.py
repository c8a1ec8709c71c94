"""Scores over (document, rule) cells.

docs: arm, id, kind ('clean' or 'seeded'), truth, and call columns; cells: arm, doc, rule, probability, answered; rules:
rule, ord, is_countable, is_judgment, guaranteed, inert_on_clean.  A cell that is missing reads 0 and counts as not
answered; of two for the same key the later (by seq) wins.  Everything is sums by rule, class or arm: one expansion of
the grid, partial sums before each shuffle, rules broadcast as the small dimension that they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import median, p95, ratio, round4, wilson

THRESHOLDS = (0.5, 0.7, 0.9)
GALLERY = 0.7
POST_PARAGRAPHS = 8


def thresholds_with(bar: float) -> list[float]:
    return sorted({*THRESHOLDS, bar})


def thresholds_column(bar: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(F.lit(list(THRESHOLDS)), F.array(bar))))


def last_cells(cells: DataFrame) -> DataFrame:
    """One cell for each arm, document and rule: that with the largest seq."""
    best = F.max_by(F.struct("probability", "answered"), "seq")
    return cells.groupBy("arm", "doc", "rule").agg(best.alias("c")).select("arm", "doc", "rule", "c.*")


def grid(docs: DataFrame, cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Every document under every rule, with its reading; own marks the cell of a planted fault."""
    ids = F.broadcast(rules.select("rule", "ord"))
    every = docs.select("arm", F.col("id").alias("doc"), "kind", "truth").crossJoin(ids)
    full = every.join(cells.select("arm", "doc", "rule", "probability", "answered"), ["arm", "doc", "rule"], "left")
    return full.select(
        "arm", "doc", "rule", "ord", "kind", "truth", F.coalesce("probability", F.lit(0.0)).alias("probability"),
        F.coalesce("answered", F.lit(False)).alias("answered"), (F.coalesce(F.col("truth") == F.col("rule"), F.lit(False)) & (F.col("kind") == "seeded")).alias("own"),
    )


def at_thresholds(df: DataFrame, bars: Sequence[float]) -> DataFrame:
    return df.withColumn("threshold", F.explode(F.lit([float(b) for b in bars]))).withColumn("over", F.col("probability") >= F.col("threshold"))


def _clean() -> Column:
    return F.col("kind") == "clean"


def per_rule(g: DataFrame, bars: Sequence[float] = THRESHOLDS) -> DataFrame:
    s = at_thresholds(g, bars).groupBy("arm", "rule", "threshold").agg(
        F.count_if(F.col("own") & F.col("over")).alias("hits"), F.count_if("own").alias("n_positive"),
        F.count_if(_clean() & F.col("over")).alias("fps"), F.count_if(_clean()).alias("n_clean"),
    )
    return s.select(
        "arm", "rule", "threshold", "n_positive", "n_clean", "hits", ratio(F.col("hits"), F.col("n_positive")).alias("recall"),
        wilson(F.col("hits"), F.col("n_positive"))["low"].alias("low"), wilson(F.col("hits"), F.col("n_positive"))["high"].alias("high"),
        "fps", ratio(F.col("fps"), F.col("n_clean")).alias("fp_rate_clean"),
    )


def fireable(g: DataFrame, rules: DataFrame) -> DataFrame:
    """arm, fireable: rules that were answered at least once and that could fire on a clean text."""
    answered = g.where("answered").select("arm", "rule").distinct().join(F.broadcast(rules.where("inert_on_clean is null").select("rule")), "rule", "left_semi")
    return answered.groupBy("arm").agg(F.count(F.lit(1)).alias("fireable"))


def overall(g: DataFrame, rules: DataFrame, bars: Sequence[float] = THRESHOLDS) -> DataFrame:
    """First by document, which knows whether any rule fired on it, then by arm."""
    by_doc = at_thresholds(g, bars).groupBy("arm", "threshold", "doc", "kind").agg(
        F.count_if("over").alias("over"), F.count_if(F.col("own") & F.col("over")).alias("hit"), F.count_if("own").alias("own"),
        F.count_if(F.col("over") & ~F.col("own")).alias("off"), F.count(F.lit(1)).alias("cells"),
    )
    clean, seeded = F.col("kind") == "clean", F.col("kind") == "seeded"
    total = lambda when, x: F.coalesce(F.sum(F.when(when, F.col(x))), F.lit(0))
    s = by_doc.groupBy("arm", "threshold").agg(
        total(seeded, "hit").alias("hits"), F.count_if(seeded).alias("positives"), total(clean, "over").alias("fp_cells"), F.count_if(clean & (F.col("over") > 0)).alias("fp_docs"),
        F.count_if(clean).alias("n_clean"), total(clean, "cells").alias("clean_cells"), total(seeded, "off").alias("off_rule_flags"),
        F.coalesce(F.sum(F.when(seeded, F.greatest(F.lit(0), F.col("cells") - 1))), F.lit(0)).alias("seeded_off_cells"),
    )
    s = s.join(F.broadcast(fireable(g, rules)), "arm", "left").withColumn("fireable_cells", F.col("n_clean") * F.coalesce("fireable", F.lit(0)))
    c = F.col
    return s.select(
        "arm", "threshold", "hits", "positives", ratio(c("hits"), c("positives")).alias("recall"), "fp_docs", "n_clean", ratio(c("fp_docs"), c("n_clean")).alias("fp_doc_rate"),
        wilson(c("fp_docs"), c("n_clean"))["low"].alias("fp_doc_low"), wilson(c("fp_docs"), c("n_clean"))["high"].alias("fp_doc_high"),
        "fp_cells", "clean_cells", ratio(c("fp_cells"), c("clean_cells")).alias("fp_cell_rate"), "fireable_cells", ratio(c("fp_cells"), c("fireable_cells")).alias("fp_fireable_rate"),
        "off_rule_flags", ratio(c("off_rule_flags"), c("seeded_off_cells")).alias("off_rule_rate"),
        ratio(c("fp_cells") + c("off_rule_flags"), c("clean_cells") + c("seeded_off_cells")).alias("fp_negative_rate"),
    )


def by_class(g: DataFrame, rules: DataFrame, bars: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Recall of countable and of judgment rules; by construction if there are positives and every rule of the class guarantees its own."""
    kinds = rules.select("rule", F.when(F.col("is_countable"), "countable").otherwise("judgment").alias("class"), "guaranteed")
    facts = kinds.groupBy("class").agg(F.count(F.lit(1)).alias("rules"), F.min("guaranteed").alias("all_guaranteed"))
    own = at_thresholds(g.where("own"), bars).join(F.broadcast(kinds.select("rule", "class")), "rule")
    s = own.groupBy("arm", "class", "threshold").agg(F.count_if("over").alias("hits"), F.count(F.lit(1)).alias("positives"))
    arms = g.select("arm").distinct().crossJoin(F.broadcast(facts)).withColumn("threshold", F.explode(F.lit([float(b) for b in bars])))
    s = arms.join(s, ["arm", "class", "threshold"], "left").na.fill(0, ["hits", "positives"])
    w = wilson(F.col("hits"), F.col("positives"))
    return s.select(
        "arm", "class", "threshold", "rules", "hits", "positives", ratio(F.col("hits"), F.col("positives")).alias("recall"), w["low"].alias("low"), w["high"].alias("high"),
        ((F.col("positives") > 0) & F.col("all_guaranteed")).alias("by_construction"),
    )


def multi_grain(g: DataFrame, rules: DataFrame, bar: float = GALLERY) -> DataFrame:
    """Hits and false alarms by rule, by class and over all, from the same cells in one pass."""
    kinds = rules.select("rule", F.when(F.col("is_countable"), "countable").otherwise("judgment").alias("class"))
    rows = g.join(F.broadcast(kinds), "rule").withColumn("over", F.col("probability") >= bar)
    rows.createOrReplaceTempView("quillworks_cells")
    return g.sparkSession.sql("""
        SELECT arm, CASE grouping_id() WHEN 0 THEN 'rule' WHEN 1 THEN 'class' ELSE 'all' END AS grain, class, rule,
               count_if(own AND over) AS hits, count_if(own) AS positives, count_if(kind = 'clean' AND over) AS fps, count_if(kind = 'clean') AS clean_cells
        FROM quillworks_cells GROUP BY GROUPING SETS ((arm, class, rule), (arm, class), (arm))""")


def calibration(g: DataFrame) -> DataFrame:
    """Ten buckets of answered cells for each arm, empty ones too."""
    bucket = F.least(F.floor(F.col("probability") * 10), F.lit(9)).cast("int")
    s = g.where("answered").groupBy("arm", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("defective"))
    every = g.select("arm").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(9))))
    s = every.join(s, ["arm", "bucket"], "left").na.fill(0, ["n", "defective"])
    return s.withColumn("fraction_defective", ratio(F.col("defective"), F.col("n")))


def unanswered_cells(g: DataFrame) -> DataFrame:
    return g.groupBy("arm").agg(F.count_if(~F.col("answered")).alias("unanswered"))


def misses(g: DataFrame, bar: float = GALLERY) -> DataFrame:
    return g.where(F.col("own") & (F.col("probability") < bar)).select("arm", "doc", "rule", "probability")


def false_positives(g: DataFrame, bar: float = GALLERY) -> DataFrame:
    return g.where(_clean() & (F.col("probability") >= bar)).select("arm", "doc", "rule", "probability")


def gallery(rows: DataFrame, ascending: bool) -> DataFrame:
    p = F.col("probability")
    return rows.orderBy("arm", p.asc() if ascending else p.desc(), "doc", "rule")


def summary(docs: DataFrame) -> DataFrame:
    """Totals of calls by arm; money is null if any request that was sent reports no usage."""
    n = F.count(F.lit(1))
    blind = F.count_if((F.col("requests") > 0) & ~F.col("usage_reported"))
    usd = F.when(blind == 0, F.sum("cost_usd"))
    return docs.groupBy("arm").agg(
        n.alias("documents"), F.sum("requests").alias("requests"), F.sum("retries").alias("retries"), F.sum("unanswered").alias("unanswered"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), round4(F.avg("latency_ms")).alias("mean_ms"),
        round4(median(F.col("latency_ms"))).alias("median_ms"), p95(F.col("latency_ms")).alias("p95_ms"), F.floor(usd * 1e8 + 0.5).cast("long").alias("usd_e8"),
        F.floor(usd / n * 1e10 + 0.5).cast("long").alias("usd_per_100_e8"),
    )


def post_odds(scores: DataFrame, arm_order: DataFrame) -> DataFrame:
    """The arm that flags most clean texts, and the chance of a false flag in a post of eight paragraphs; the first arm wins ties."""
    rate = F.col("fp_docs") / F.col("n_clean")
    rows = scores.where("n_clean > 0 and fp_docs > 0").join(F.broadcast(arm_order), "arm").withColumn("rate", rate)
    worst = rows.groupBy("threshold").agg(F.max_by(F.struct("arm", "rate"), F.struct("rate", -F.col("ord"))).alias("w"))
    return worst.select("threshold", F.col("w.arm").alias("arm"), round4(F.col("w.rate")).alias("rate"), round4(1 - F.pow(1 - F.col("w.rate"), POST_PARAGRAPHS)).alias("odds"))


def near_miss_hits(negatives: DataFrame, fps: DataFrame) -> DataFrame:
    """negatives (id, ...) with the "arm: rule" of each false alarm on them."""
    hits = fps.groupBy("doc").agg(F.array_sort(F.collect_set(F.concat_ws(": ", "arm", "rule"))).alias("flagged_by"))
    return negatives.join(hits, negatives["id"] == hits["doc"], "left").drop("doc").withColumn("flagged_by", F.coalesce("flagged_by", F.array().cast("array<string>")))
