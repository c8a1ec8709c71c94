"""Mixing sources to target weights, in DataFrame functions only.

Every row gets a hash-random key.  Within its source the key's range is cut into buckets of about ``bucket_rows``
rows, so a source of any size spreads over many tasks.  Prefix sums of token counts run in three levels: rows in a
bucket, buckets in a block, blocks in a source.  A source takes its budget's whole epochs of every row, and in the
last epoch the rows before the cut, the row at the cut in part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def words(text: Column) -> Column:
    """Number of maximal runs of other characters than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds target to (source, source_size, n_rows): one row a source, sources by code point, null last.

    Shares of the whole by repeating weights.  With sources in order of size / weight, those below some place are at
    their cap of max_epochs times their size and the others share the rest by weight; the place is the first whose
    share is within its cap.
    """
    total = F.sum("source_size").over(Window.partitionBy())
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.lit([float(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("*", w.alias("_w"), total.alias("_all"))
    s = s.withColumn("_cap", max_epochs * F.col("source_size").cast("double"))
    by = Window.partitionBy().orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.select(
        "*", ((F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)).alias("_level"),
    )
    # Feasible places form a suffix, and its first has the largest level: what a unit of weight gets.
    s = s.withColumn("_level", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level")))
    common = F.max("_level").over(Window.partitionBy())
    target = F.coalesce(F.least(F.col("_cap"), common * F.col("_w")), F.col("_cap"))
    return s.select("source", "source_size", "n_rows", target.alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = 0, bucket_rows: int = 64, block: int = 256, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row, and the columns to carry.

    Null and empty texts have size 0 and take nothing; very long texts count whole; a null source is a source of its
    own, ordered last.  Reruns agree: the key is a digest of seed, doc_id and text, so rows of one or no doc_id spread
    like others, and equal keys are ordered by doc_id and size; rows that are equal in these are interchangeable, but
    for what is carried, which orders them last.  An empty table gives an empty table.  Other columns are not read, so
    they may have any name; a carried one named as a column of the result comes back as carried_<name>.
    """
    source, id_ = F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id")
    more = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    keyed = docs.select(id_, source, words(F.col("text")).alias("size"), key.alias("_key"), *more)
    # Sizes and keys only: the texts are read once, and once more where columns are carried.
    d = materialise(keyed.select("doc_id", "source", "size", "_key"), "mix")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    plan = materialise(targets(sizes, weights, max_epochs), "mix-plan")
    p = plan.select(F.col("source").alias("_s"), "source_size", "target", "n_rows")
    # The first 12 hex digits as a fraction of the key's range; buckets are equal ranges of it.
    at = F.conv(F.substring("_key", 1, 12), 16, 10).cast("double") / F.lit(float(16**12))

    def bucketed(rows: DataFrame) -> DataFrame:
        rows = rows.join(p, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        return rows.withColumn("_b", F.floor(at * F.ceil(F.col("n_rows") / bucket_rows)))

    d = bucketed(d)
    sums = d.groupBy("source", "_b").agg(F.sum("size").alias("_sum")).withColumn("_k", F.floor(F.col("_b") / block))
    blocks = sums.groupBy("source", "_k").agg(F.sum("_sum").alias("_ksum"))
    up_to = (Window.unboundedPreceding, -1)
    blocks = blocks.select("source", "_k", F.coalesce(F.sum("_ksum").over(Window.partitionBy("source").orderBy("_k").rowsBetween(*up_to)), F.lit(0)).alias("_kbase"))
    sums = sums.select("source", "_k", "_b", F.coalesce(F.sum("_sum").over(Window.partitionBy("source", "_k").orderBy("_b").rowsBetween(*up_to)), F.lit(0)).alias("_base"))
    b = blocks.select(F.col("source").alias("_s"), F.col("_k").alias("_kk"), "_kbase")
    sums = sums.join(b, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_k") == F.col("_kk")))
    sums = sums.select(F.col("source").alias("_s"), F.col("_b").alias("_bb"), (F.col("_base") + F.col("_kbase")).alias("_base"))
    if carry:
        d = bucketed(keyed)
    d = d.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_bb"))).drop("_s", "_bb")
    order = [F.col(f"_c{i}") for i, c in enumerate(carry) if docs.schema[c].dataType.simpleString() in ("string", "bigint", "int", "double", "boolean")]
    row = Window.partitionBy("source", "_b").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size", *order).rowsBetween(*up_to)
    d = d.withColumn("_before", F.col("_base") + F.coalesce(F.sum("size").over(row), F.lit(0)))
    budget = F.floor(F.least(F.col("target"), max_epochs * F.col("source_size")) + F.lit(1e-9)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - F.col("_before")))
    own = ("doc_id", "source", "size", "source_size", "target", "taken")
    back = [F.col(f"_c{i}").alias(f"carried_{c}" if c in own else c) for i, c in enumerate(carry)]
    return d.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"), *back)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, coalesce(least(cap, max(CASE WHEN level * w <= cap THEN level END) OVER () * w), cap) AS target FROM l),
p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CAST(floor(least(t.target, 3.0::DOUBLE * t.source_size) + 1e-9::DOUBLE) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""
