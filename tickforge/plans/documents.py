"""The given text tables read as notes and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickforge.operators import text
from tickforge.plans.market import table


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of every document; those with an even id have front matter."""
    documents = table(spark, sf_dir, "documents")
    head = F.concat(
        F.lit('---\ntitle: "Note '),
        F.col("doc_id").cast("string"),
        F.lit('"\ntags: ['),
        F.col("lang"),
        F.lit(', "'),
        F.col("source"),
        F.lit('"]\n---\n'),
    )
    return documents.select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(head, F.col("text"))).otherwise(F.col("text")).alias("content"),
    )


def note_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunk_documents(text.frontmatter(notes(spark, sf_dir), "docs"))


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("source_uri"), "page_id", "html")
    return text.chunk_documents(pages, text="html")


def turn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("chat:"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("source_uri"),
        F.col("role").alias("title"),
        "text",
    )
    return text.chunk_documents(turns, text="text")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a call record: type as tool, value as duration."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("tool_name"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("caller"),
        F.col("props").alias("parameters"),
        F.when(F.col("value") > 100, "error").otherwise("ok").alias("result_status"),
        F.round(F.col("value"), 0).cast("long").alias("duration_ms"),
        F.col("value").alias("latency_ms"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )
