"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents; other columns of docs go, whatever their names.  In
every stage a null text counts as empty, texts of any length are read whole, repeated rows are rows of their own, and
an empty table gives an empty table; the operators' docstrings say the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.llm import exact_dedup, mixing, near_dedup, packing, queries, toxicity
from quillworks.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Up to so many ids (16 MB) are broadcast, more are joined with a shuffle.
BROADCAST_IDS = 2_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go.  The model learns from the training folds of the labels.

    Repeated rows score alike, so they stay or go together.  Empty texts get the score of no words and stay; without
    labels of both classes the score is the share of ones.
    """
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, list(COLUMNS)).where("predicted = 0").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that with the smallest doc_id, a null one last; of rows that tie, one.

    Empty texts are copies of each other.
    """
    return exact_dedup.exact_dedup(docs, keep="min", carry=COLUMNS).where("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id: five-word shingles, similarity 0.8
    or more.

    Rows of one doc_id are one document and stay or go together.  Rows without a doc_id or without words stay.
    """
    gone = materialise(near_dedup.near_dedup(docs).where("not kept").select("doc_id").distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's budget takes it; of the one at the cut the first words, joined by spaces.

    A null source is one of its own.  Each row has a share of its own, also where rows repeat or share a doc_id or have
    none.  Texts without words have size 0: they are in no budget and stay once if their source takes a whole epoch.
    """
    rows = mixing.mix(docs, carry=COLUMNS)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.least(F.lit(1), F.floor((F.col("target") + 1e-9) / F.greatest("source_size", F.lit(1)))))
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    rows = rows.select(*[F.col(f"carried_{c}" if c in ("doc_id", "source") else c).alias(c) for c in COLUMNS], whole.cast("int").alias("_whole"), rest.cast("int").alias("_rest"))
    n = F.col("_whole") + (F.col("_rest") > 0).cast("int")
    rows = rows.where(n > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), n)))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("_copy") > F.col("_whole"), F.array_join(F.slice(words, F.lit(1), F.col("_rest")), " ")).otherwise(F.col("text"))
    return rows.withColumn("text", text).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, each a sequence of its own; an empty text is the end id alone."""
    return packing.pack(docs, queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Embeddings of character n-grams, sketches and byte pair encoding are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
