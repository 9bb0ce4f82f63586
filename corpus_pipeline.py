"""From raw documents to packed training sequences: the operators of tickforge.llm in stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns
the columns of documents; the last returns the packed sequences. Between stages the rows are
written as Parquet and read back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickforge.llm import chunks, decontaminate, packing, quality, simhash
from tickforge.llm.common import stored, table

TOKENIZER = "word_bpe_49k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier and their site's posterior take for good and not toxic."""
    classifier = quality.fit(docs, table(spark, sf_dir, "labels"))
    found = quality.judged(docs, classifier, F.col("source"), F.col("lang"))
    return found.filter(F.col("wanted") >= quality.THRESHOLD).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that an earlier one has."""
    cut = chunks.drop_repeated_chunks(docs).select("row.*")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links: that with the smallest id."""
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 ids with the documents they hold and their boundary records."""
    found = packing.sequences(packing.windows(docs, public_tokenizers.path(TOKENIZER)))
    return found.withColumn("doc_ids", F.transform("pieces", lambda p: p["doc_id"]))


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

ORACLE_SQL = None
"""SQL has neither the fitted classifier nor the tokenizer; the tests use brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    *filters, (_, last) = STAGES
    for name, stage in filters:
        docs = stored(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
