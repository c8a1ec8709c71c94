"""Exact duplicates by content sort, in DataFrame functions only.

The normalised text is ordered by (first characters, 64-bit hash, whole text).  A range exchange on the bounded part
of that key samples its splitters, each partition is sorted externally, and neighbours are compared in full by the
window's group test, so that a hash collision joins nothing.

A text that very many rows share would fill one partition.  A count by digest (combined before its shuffle) names the
texts with over ``hot_rows`` rows; there are at most rows / hot_rows of them, which ``max_hot`` bounds, so their list
is broadcast.  Only their rows get a salt in the sort key; each salted run keeps its best row, and an aggregation
(again combined before its shuffle, by the whole text) joins the runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, tasks

PREFIX = 32


def exact_dedup(docs: DataFrame, keep: str = "max", carry: Sequence[str] = (), hot_rows: int = 64, max_hot: int = 100_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the columns to carry of every row.

    Null texts count as empty and are copies of each other.  keep is "max" or "min": which doc_id stays.  A null
    doc_id stays only in a group that has no other.  Of repeated rows with the same doc_id and text one is kept.  Very
    long texts are compared whole.  An empty table gives an empty table; columns that are not carried are not read, so
    they may have any name, and a carried one named as a column of the result comes back as carried_<name>.
    """
    own = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    names = [c for c in carry if c != "doc_id"]
    more = {c: f"_c{i}" for i, c in enumerate(names) if c != "text"}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(x) for c, x in more.items()])
    rows = rows.withColumn("_t", ascii_lower(F.col("text")))
    rows = rows.withColumn("_sha", F.sha2(F.col("_t"), 256))
    n = docs.count()
    limit = max(hot_rows, -(-n // max_hot))
    hot = rows.groupBy("_sha").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    rows = rows.join(F.broadcast(hot), "_sha", "left")
    runs = F.ceil(F.col("_n") / limit).cast("long")
    rows = rows.select(
        "doc_id", "text", *more.values(), "_sha", F.col("_n").isNotNull().alias("_hot"),
        F.substring("_t", 1, PREFIX).alias("_p"), F.xxhash64("_t").alias("_h"),
        # By place in the scan, so that rows of one or no doc_id are spread as well.
        F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), runs), F.lit(0)).alias("_salt"),
    )
    spread = rows.repartitionByRange(tasks(docs.sparkSession), "_p", "_h", "_salt")
    # The exchange carries the text once; it is normalised again behind it.
    spread = spread.withColumn("_t", ascii_lower(F.col("text")))
    kept_columns = [more.get(c, c) for c in names]
    run = Window.partitionBy("_p", "_h", "_salt", "_t")
    best = F.col("doc_id").desc_nulls_last() if keep == "max" else F.col("doc_id").asc_nulls_last()
    pick = F.max if keep == "max" else F.min
    spread = spread.select(
        "doc_id", *kept_columns, "_sha", "_hot", "_salt", "_t",
        pick("doc_id").over(run).alias("_keep"), F.count(F.lit(1)).over(run).alias("_size"),
        F.row_number().over(run.orderBy(best)).alias("_nth"),
    )
    # The runs of a hot text meet here: one row of each run, combined by the whole text before the shuffle; the best
    # row stays in one run only.
    null_last = F.col("_keep").isNotNull() if keep == "max" else F.col("_keep").isNull()
    whole = (
        spread.where("_hot and _nth = 1").groupBy("_t", "_sha")
        .agg(pick(F.struct(null_last.alias("n"), F.col("_keep").alias("keep"), F.col("_salt").alias("salt"))).alias("_best"), F.sum("_size").alias("_hot_size"))
        .select("_sha", F.col("_best.keep").alias("_hot_keep"), F.col("_best.salt").alias("_hot_salt"), "_hot_size")
    )
    out = spread.drop("_t").join(F.broadcast(whole), "_sha", "left")
    keep_id = F.when(F.col("_hot"), F.col("_hot_keep")).otherwise(F.col("_keep"))
    return out.select(
        "doc_id", keep_id.alias("keep_id"),
        F.when(F.col("_hot"), F.col("_hot_size")).otherwise(F.col("_size")).alias("group_size"),
        ((F.col("_nth") == 1) & F.col("doc_id").eqNullSafe(keep_id) & (~F.col("_hot") | (F.col("_salt") == F.col("_hot_salt")))).alias("kept"),
        F.col("_sha").alias("text_sha256"), *[F.col(more.get(c, c)).alias(f"carried_{c}" if c in own else c) for c in names],
    )


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
