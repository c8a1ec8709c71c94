"""Draft files as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".md", ".markdown", ".txt")
SKIPPED_FOLDERS = ("node_modules",)


class SourceError(ValueError):
    pass


def walk(folder: str) -> list[str]:
    """Draft files below a folder: no hidden entries, no links, no packages of others."""
    out = []
    for top, folders, names in os.walk(folder):
        folders[:] = sorted(f for f in folders if not f.startswith(".") and f not in SKIPPED_FOLDERS and not os.path.islink(os.path.join(top, f)))
        out += [p for n in names if not n.startswith(".") and n.lower().endswith(SUFFIXES) and not os.path.islink(p := os.path.join(top, n))]
    return sorted(out)


def collect_files(paths: Sequence[str]) -> tuple[list[str], list[str]]:
    """(sorted distinct files, links that were not read).  Files given by name may have any suffix."""
    files: set[str] = set()
    links: list[str] = []
    for p in paths:
        if os.path.islink(p):
            links.append(p)
        elif os.path.isdir(p):
            files.update(walk(p))
        elif os.path.isfile(p):
            files.add(p)
        else:
            raise SourceError(f"{p}: no such file")
    if not files:
        raise SourceError("no drafts to read")
    return sorted(files), sorted(set(links))


def display_path(path: str, root: str) -> str:
    inside = os.path.relpath(path, root)
    return path if inside.startswith("..") else inside


def decode(raw: DataFrame, root: str = "") -> tuple[DataFrame, DataFrame]:
    """(drafts, rejects) of rows (path, content): a NUL byte or invalid UTF-8 makes a reject with a reason."""
    path = F.regexp_replace("path", r"^file:/*", "/")
    if root:
        path = F.regexp_replace(path, f"^{_quoted(root.rstrip('/') + '/')}", "")
    rows = raw.select(path.alias("file"), "content")
    nul = F.decode("content", "ISO-8859-1").contains("\0")
    reason = F.when(nul, "holds a NUL byte").when(~F.is_valid_utf8(F.col("content").cast("string")), "is not UTF-8")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select("file", F.col("content").cast("string").alias("text")), rows.where("reason is not null").select("file", "reason")


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def read_drafts(spark: SparkSession, paths: Sequence[str], root: str = "") -> tuple[DataFrame, DataFrame]:
    files, _ = collect_files(paths)
    return decode(spark.read.format("binaryFile").load(files).select("path", "content"), root)


def read_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A folder in any store that Spark reads: listing and reading are Spark's, which follows links of a local folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.col("path")
    wanted = F.lower(path).rlike(r"\.(md|markdown|txt)$") & ~path.rlike(r"/\.") & ~path.rlike("/node_modules/")
    return decode(raw.where(wanted).select("path", "content"))
