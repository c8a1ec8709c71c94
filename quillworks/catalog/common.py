"""Drafts made of the driver's tables, on both sides of a comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def drafts(spark: SparkSession, d: str) -> DataFrame:
    """Documents with every line a paragraph."""
    return documents(spark, d).select(F.concat(F.lit("doc-"), "doc_id").alias("file"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


#: The same paragraphs: file, line, text, seq.
PARAGRAPHS = r"""
lines AS (
  SELECT 'doc-' || doc_id AS file, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10))) AS text,
         generate_subscripts(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10)), 1) AS n
  FROM documents),
marked AS (SELECT *, NOT regexp_matches(text, '[^\s]') AS blank FROM lines),
grouped AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY n) AS g FROM marked),
paragraphs AS (
  SELECT file, CAST(min(n) AS INTEGER) AS line, string_agg(text, chr(10) ORDER BY n) AS text,
         CAST(row_number() OVER (PARTITION BY file ORDER BY min(n)) - 1 AS INTEGER) AS seq
  FROM grouped WHERE NOT blank GROUP BY file, g)"""


#: Words of a text as the oracle counts them.
def duck_words(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '[^\s]+'))"


def round4_sql(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5::DOUBLE) / 10000"
