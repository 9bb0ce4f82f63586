"""Markdown files as (path, content) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def document_source(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.md`` under a folder, or one file, without hidden files.

    ``path`` is relative to the folder, for a single file to the folder it is in.
    """
    reader = spark.read
    if path.endswith(".md"):
        root = path.rsplit("/", 1)[0]
    else:
        root = path.rstrip("/")
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
    files = reader.text(path, wholetext=True).select(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")).alias("uri"), "value")
    relative = F.regexp_extract("uri", r"\Q" + root + r"\E/(.*)$", 1)
    return files.select(relative.alias("path"), F.col("value").alias("content")).where(
        ~F.element_at(F.split("path", "/"), -1).startswith(".")
    )
