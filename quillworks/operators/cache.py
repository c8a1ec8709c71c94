"""The answer cache: content-addressed, versioned, and old after a fortnight.

A table (key, v, at, model, wording, nouls, shard), written append-only and partitioned by the first two hex digits
of the key; the latest row of a key counts.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .flags import undecided

VERSION = 2
MAX_AGE_MS = 14 * 86_400_000
SCHEMA = "key string, v int, at long, model string, wording string, nouls map<string, double>, shard string"


def cache_key(model: Column, questions: Column, text: Column) -> Column:
    """Digest of version, model, questions and text, with separators that none of them holds."""
    zero = F.char(F.lit(0))
    return F.sha2(F.concat(F.lit(f"v{VERSION}"), zero, model, zero, questions, zero, text), 256)


def wording(questions: Column) -> Column:
    return F.sha2(questions, 256)


def covers(nouls: Column, rules: Column) -> Column:
    return F.size(F.array_except(rules, F.map_keys(nouls))) == 0


def has_opinion(nouls: Column, rules: Column) -> Column:
    return F.exists(rules, lambda r: F.coalesce(~undecided(F.try_element_at(nouls, r)), F.lit(False)))


def admissible(nouls: Column, rules: Column) -> Column:
    """Whether an answer is worth keeping: it covers what was asked, and decides something."""
    return covers(nouls, rules) & has_opinion(nouls, rules)


def valid(now_ms: Column, served: Column, expect_wording: Column, rules: Column) -> Column:
    """Whether a cached row (v, at, model, wording, nouls) answers a question now.  A null served model fits any."""
    sound = F.forall(F.map_values(F.col("nouls")), lambda p: p.isNotNull() & ~F.isnan(p) & p.between(0, 1))
    fits = (
        (F.col("v") == VERSION) & (F.col("at") >= now_ms - MAX_AGE_MS) & F.col("model").isNotNull() & (served.isNull() | (F.col("model") == served))
        & (F.col("wording") == expect_wording) & F.col("nouls").isNotNull() & sound & admissible(F.col("nouls"), rules)
    )
    return F.coalesce(fits, F.lit(False))


def latest(cache: DataFrame) -> DataFrame:
    rest = [c for c in ("v", "at", "model", "wording", "nouls") if c in cache.columns]
    return cache.groupBy("key").agg(F.max_by(F.struct(*rest), "at").alias("c")).select("key", "c.*")


def look_up(asked: DataFrame, cache: DataFrame, now_ms: int, served: str | None = None) -> tuple[DataFrame, DataFrame]:
    """asked (key, wording, rules, ...) into (hits with model and nouls, misses)."""
    c = latest(cache).withColumnRenamed("wording", "_wording")
    rows = asked.join(c, "key", "left").withColumnRenamed("wording", "_expect").withColumnRenamed("_wording", "wording")
    ok = valid(F.lit(now_ms), F.lit(served).cast("string"), F.col("_expect"), F.col("rules"))
    rows = rows.withColumn("_ok", ok).withColumnRenamed("wording", "_w").withColumnRenamed("_expect", "wording")
    own = asked.columns
    return rows.where("_ok").select(*own, "model", "nouls"), rows.where("not _ok").select(*own)


def store(answers: DataFrame, path: str, now_ms: int) -> None:
    """Append answers (key, model, wording, nouls, rules) that are worth keeping."""
    rows = answers.where(admissible(F.col("nouls"), F.col("rules")))
    rows = rows.select("key", F.lit(VERSION).alias("v"), F.lit(now_ms).cast("long").alias("at"), "model", "wording", "nouls", F.substring("key", 1, 2).alias("shard"))
    rows.write.mode("append").partitionBy("shard").parquet(path)


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The table at a path; an empty one where nothing was stored yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def prune(cache: DataFrame, now_ms: int) -> DataFrame:
    return cache.where(F.col("at") >= now_ms - MAX_AGE_MS)


def location(env: dict[str, str], home: str) -> str | None:
    """Where the cache lives; None if it is off.  A relative setting counts from home."""
    given = env.get("QUILLWORKS_CACHE", "").strip()
    if given.lower() == "off":
        return None
    base = given or os.path.join(env.get("XDG_CACHE_HOME", "").strip() or os.path.join(home, ".cache"), "quillworks")
    return base if os.path.isabs(base) else os.path.join(home, base)
