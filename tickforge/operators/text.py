"""Documents: front matter, chunks and the chunk index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickforge.contracts import CHUNK_OVERLAP, CHUNK_WORDS
from tickforge.functions.ranking import first_rows

# The front matter form, and what separates words.
FRONT_MATTER = r"(?s)\A---\n(.*?)\n---\n(.*)\z"
RARE_SPACE = r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

INDEX_KEYS = ["source_uri", "chunk_index"]


def _entry(name: str) -> Column:
    """Value of the last ``name:`` line of the block, NULL when there is none."""
    lines = F.filter(F.split("block", "\n"), lambda line: line.startswith(f"{name}:"))
    return F.trim(F.substring(F.element_at(F.when(F.size(lines) > 0, lines), -1), len(name) + 2, 2_000_000_000))


def frontmatter(documents: DataFrame, source_type: str) -> DataFrame:
    """Title, tags and body of (path, content) rows; the file stem is the default title."""
    matched = F.col("content").rlike(FRONT_MATTER)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(.)\.[^.]*$", "$1")
    tags = F.split(F.regexp_replace(_entry("tags"), r"^[\[\]]+|[\[\]]+$", ""), ",")
    cleaned = F.filter(tags, lambda tag: F.trim(tag) != "")
    unquoted = F.transform(cleaned, lambda tag: F.regexp_replace(F.trim(tag), '^"+|"+$', ""))
    return (
        documents.withColumn("block", F.when(matched, F.regexp_extract("content", FRONT_MATTER, 1)))
        .withColumn("body", F.when(matched, F.regexp_extract("content", FRONT_MATTER, 2)).otherwise(F.col("content")))
        .select(
            F.concat(F.lit(f"{source_type}:"), F.col("path")).alias("source_uri"),
            F.coalesce(F.regexp_replace(_entry("title"), '^"+|"+$', ""), stem).alias("title"),
            F.coalesce(unquoted, F.array().cast("array<string>")).alias("tags"),
            F.lit(source_type).alias("source_type"),
            "body",
        )
    )


def _words(at_most: int) -> str:
    """Pattern for a run of up to so many words with the space after them."""
    return rf"(?:\S++\s*+){{1,{at_most}}}+"


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def chunk_documents(
    documents: DataFrame, text: str = "body", max_words: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Overlapping word chunks; the last one is the first that reaches the end.

    The text is cut once into blocks of ``max_words - overlap`` words, and a chunk is a
    block plus the head of what follows it. That is linear in the length of a text,
    where slicing one array of all its words per chunk is quadratic.
    """
    step = max(1, max_words - overlap)
    extra = max_words - step
    following = -(-extra // step)
    blocks = F.col("_blocks")
    last_words = F.size(F.regexp_extract_all(F.element_at(blocks, -1), F.lit(r"\S+"), F.lit(0)))
    total = (F.size(blocks) - 1) * step + last_words
    last = F.greatest(F.lit(0), F.ceil((total - max_words) / step).cast("int"))

    def chunk(i: Column) -> Column:
        block = F.get(blocks, i)
        if extra <= 0:
            return _spaced(block)
        rest = F.array_join(F.slice(blocks, i + 2, F.lit(following)), " ")
        return _spaced(F.concat(block, F.lit(" "), F.regexp_extract(rest, "^" + _words(extra), 0)))

    rest = [name for name in documents.columns if name != text]
    plain = F.regexp_replace(F.col(text), RARE_SPACE, " ")
    cut = F.explode(F.array(F.regexp_extract_all(plain, F.lit(_words(step)), F.lit(0)))).alias("_blocks")
    return (
        documents.select(*rest, cut)
        .where(F.size(blocks) > 0)
        .select(*rest, F.posexplode(F.transform(F.sequence(F.lit(0), last), chunk)).alias("chunk_index", "content"))
    )


def chunk_upsert(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """The index with new chunks in place of those with the same URI and number."""
    rows = index.withColumn("_new", F.lit(0)).unionByName(chunks.withColumn("_new", F.lit(1)))
    return first_rows(rows, INDEX_KEYS, [F.desc("_new"), F.desc("indexed_at"), F.desc("content")]).drop("_new")
