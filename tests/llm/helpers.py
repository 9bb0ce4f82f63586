"""Small inputs that the tests of the package share."""

import random

from pyspark.sql import types as T

# Names that the operators use inside; a table may have columns of the same names.
CLASHING = ["id", "fp", "hash", "n", "s", "chunk", "lines", "shard", "size", "root", "part", "row", "file", "item", "place", "unit", "quality", "toxic", "_key", "_host", "_path", "_evidence", "_wanted", "_h", "_n", "_lines", "_removed_lines", "_repeats", "evidence", "host", "path", "wanted"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(name, T.IntegerType()) for name in CLASHING]
)


def documents(spark, rows):
    """(doc_id, text[, lang, source]) with extra columns; what is left out is null."""
    full = [tuple([*row, *[None] * (4 - len(row)), *range(len(CLASHING))]) for row in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def long_text(seed=1, n=200_000):
    return " ".join(words(seed, n))
