"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition used by mixing and near-duplicates: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where one machine runs all, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not f"{spark.sparkContext.master}[".startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="quillworks-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors, and is computed once."""
    return Folders(df.sparkSession).materialise(df, name)


class Folders:
    """Tables of a run in the shared folder, deleted when their last reader is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def materialise(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that materialise() returned; what is computed from them must be written by now."""
        for path in [p for p, df in self.paths.items() if any(df is t for t in tables)]:
            del self.paths[path]
            jvm = self.spark._jvm
            jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm.org.apache.hadoop.fs.Path(path), True)

    def free(self) -> None:
        """Let Spark delete the shuffle files of steps that are written; else they stay until the driver's heap is full."""
        self.spark._jvm.System.gc()

    def drop_all(self, *but: DataFrame) -> None:
        self.drop(*[df for df in self.paths.values() if not any(df is b for b in but)])


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
