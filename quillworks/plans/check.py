"""The check: drafts to flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cache, flags, judge
from ..operators.chunk import STATE_CAP, chunk_drafts, prose_like
from ..operators.countable import countable_flags, pattern_notes
from ..sources.ruleset import Ruleset, default_ruleset, select


@dataclass
class Checked:
    flags: DataFrame
    chunks: DataFrame
    notes: DataFrame
    readings: DataFrame | None = None
    outcomes: DataFrame | None = None
    dropped: list[tuple[str, str]] | None = None
    skipped: DataFrame | None = None
    hits: DataFrame | None = None


def messages(spark, ruleset: Ruleset) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame([(r.id, r.message) for r in ruleset.rules if not r.countable], "rule string, message string")


def questions(chunks: DataFrame, ruleset: Ruleset, model: str) -> DataFrame:
    """Paragraphs worth a judgment, with what they are asked and the key of the answer."""
    rows = chunks.where(prose_like(F.col("text"), F.col("kind")))
    rows = judge.with_questions(rows, [r for r in ruleset.rules if not r.countable]).where(F.size("asked") > 0)
    return rows.withColumn("key", cache.cache_key(F.lit(model), F.col("questions"), F.col("text"))).withColumn("wording", cache.wording(F.col("questions"))).withColumnRenamed("asked", "rules")


def check(
    drafts: DataFrame, ruleset: Ruleset | None = None, only: list[str] | None = None, skip: list[str] | None = None, the_judge: judge.Judge | None = None,
    cache_path: str | None = None, bar: float | None = None, now_ms: int = 0, parallel: int | None = None, seconds: float | None = None, work_dir: str | None = None,
) -> Checked:
    """Flags of drafts (file, text).  Without a judge this is a dry run: the plan holds no node that could send anything.

    Equal questions are asked once.  Outcomes are written to work_dir (or the checkpoint folder) before they are read,
    so no later use of them asks again.
    """
    ruleset, dropped = select(ruleset or default_ruleset(), only, skip)
    chunks = chunk_drafts(drafts, STATE_CAP)
    counted = countable_flags(chunks, ruleset)
    out = Checked(flags.merge_flags(counted), chunks, pattern_notes(chunks, ruleset), dropped=dropped)
    if the_judge is None or all(r.countable for r in ruleset.rules):
        return out
    spark = drafts.sparkSession
    asked = questions(chunks, ruleset, the_judge.model)
    distinct = asked.select("key", "wording", "rules", "text", "questions").dropDuplicates(["key"])
    hits, fresh = None, distinct
    if cache_path:
        hits, fresh = cache.look_up(distinct, cache.open_cache(spark, cache_path), now_ms, the_judge.model)
    answers = judge.run_judge(fresh, the_judge, parallel, seconds)
    if work_dir:
        answers.write.mode("overwrite").parquet(work_dir)
        answers = spark.read.schema(judge.ANSWERS).parquet(work_dir)
    else:
        answers = answers.checkpoint()
    found = answers.where("outcome = 'answered'").select("key", "model", judge.usable(F.col("nouls")).alias("nouls"))
    if cache_path:
        cache.store(found.join(fresh.select("key", "wording", "rules"), "key"), cache_path, now_ms)
        found = found.unionByName(hits.select("key", "model", "nouls"))
    read = flags.readings_of(asked.select("file", "line", "key").join(found.select("key", "nouls"), "key").select("file", "line", "nouls"), messages(spark, ruleset))
    out.readings, out.outcomes, out.hits = read, answers, hits
    unjudged = answers.where("outcome <> 'answered'").select("key", "outcome", F.col("message").alias("reason"))
    out.skipped = asked.select("file", "line", "key").join(unjudged, "key").select("file", "line", "outcome", "reason")
    out.flags = flags.merge_flags(counted, flags.flags_from(read, ruleset.bar if bar is None else bar))
    return out
