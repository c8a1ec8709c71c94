"""The check over drafts as they arrive.  An extension: nothing here has event times or windows.

Paragraphs and countable flags are stateless, so they are a plain streaming projection.  The latest flags of a draft
that is written again and again come from foreachBatch: a batch's drafts replace what was known of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunk import chunk_drafts
from ..operators.countable import countable_flags
from ..sources.drafts import decode
from ..sources.ruleset import Ruleset


def stream_drafts(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """file, text of files that appear in a folder."""
    raw = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", True)
    raw = raw.schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return decode(raw.select("path", "content"))[0]


def stream_flags(drafts: DataFrame, ruleset: Ruleset) -> DataFrame:
    return countable_flags(chunk_drafts(drafts), ruleset)


def keep_latest(drafts: DataFrame, ruleset: Ruleset, table_path: str, checkpoint: str, once: bool = True):  # noqa: ANN201
    """Starts a query that keeps, under table_path, one folder of flags for each batch; latest() reads the newest of each draft."""

    def write(batch: DataFrame, number: int) -> None:
        # Read once: both the names and the flags come from it.
        batch = batch.persist()
        try:
            files = batch.select("file").distinct()
            found = files.join(stream_flags(batch, ruleset), "file", "left").withColumn("batch", F.lit(number))
            found.write.mode("overwrite").parquet(f"{table_path}/batch={number}")
        finally:
            batch.unpersist()

    writer = drafts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, table_path: str) -> DataFrame:
    """Flags of each draft from the last batch that held it; a batch that is written twice counts once."""
    rows = spark.read.option("basePath", table_path).parquet(f"{table_path}/batch=*")
    last = rows.groupBy("file").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["file", "batch"]).where("rule is not null").drop("batch")
