"""Texts from outside: diff files, file contents as services send them, and the order in which contents are looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def diff_files(spark: SparkSession, path: str) -> DataFrame:
    """pr_id (the file's name without its suffix), raw_diff: whole files, blank ones left out; bytes that are no UTF-8 become replacement characters. A missing path is an error.

    The driver lists every file, so this is for thousands of them; see `unpacked` for more."""
    return _named_diffs(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def pack(files: DataFrame, path: str) -> None:
    """Write files (path: string, content: bytes) whole, many to a pack, so that the packs grow in number with the bytes and not with the files."""
    files.select("path", "content").write.parquet(path)


def unpacked(spark: SparkSession, path: str) -> DataFrame:
    """What `diff_files` gives for the same files, from packs of them."""
    return _named_diffs(spark.read.schema("path string, content binary").parquet(path))


def _named_diffs(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return as_diffs(files.select(name.alias("pr_id"), "content"))


def as_diffs(files: DataFrame) -> DataFrame:
    """pr_id, raw_diff from pr_id, content (bytes)."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select("pr_id", text.alias("raw_diff")).filter(F.trim(F.regexp_replace("raw_diff", r"\s", "")) != "")


def decoded(encoded: Column) -> Column:
    """Base64 with line feeds as text; null for null and for what is no base64, replacement characters for bytes that are no UTF-8."""
    data = F.try_to_binary(F.regexp_replace(encoded, r"\s", ""), F.lit("base64"))
    return F.make_valid_utf8(data.cast("string"))


def file_contents(answers: DataFrame) -> DataFrame:
    """pr_id, path, text: answers (pr_id, path, kind, status, content in base64). Folders, failures and unreadable contents give a null text."""
    good = (F.col("kind") == "file") & (F.col("status") == 200)
    return answers.select("pr_id", "path", F.when(good, decoded(F.col("content"))).alias("text"))


def looked_up(wanted: DataFrame, disk: DataFrame, cache: DataFrame) -> DataFrame:
    """pr_id, path, text: from disk, else from the cache, else null. One row for each (pr_id, path) in each table."""
    own = lambda rows, name: rows.select("pr_id", "path", F.col("text").alias(name))
    rows = wanted.join(own(disk, "on_disk"), ["pr_id", "path"], "left").join(own(cache, "cached"), ["pr_id", "path"], "left")
    return rows.select("pr_id", "path", F.coalesce("on_disk", "cached").alias("text"))
