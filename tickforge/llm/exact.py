"""Exact duplicates in two passes: a Bloom filter says which rows may be repeated, only those shuffle.

Texts are equal if they are the same without white space; a SHA-256 digest of what is left
stands for the text. The filter has one 64-bit word per row, and each digest has two bits in one
of them. The first pass counts how often each bit is asked for and keeps those asked for twice or
more. In the second a row whose two bits are not both among these is the only one of its kind
and passes straight through; the others, the repeated ones and about one in a thousand more, are
grouped by their digests.

All counts and minima merge in the map tasks, so a text that a third of all rows share is one row
per task. The filter is broadcast up to BROADCAST_WORDS words of two longs each; beyond that it is
joined by word. Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickforge.llm.common import small_side, stored

SPACE = r"[\x20\x09-\x0D]+"
BROADCAST_WORDS = 2_000_000
RUN = 10_000
"""Most rows that one generator call writes for a repeated row."""


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def digested(docs: DataFrame, id: str, text: str, *columns: Column) -> DataFrame:
    """(id, length, digest) and `columns`: what decides about a row. A null text is empty."""
    return docs.select(
        F.col(id).cast("long").alias("id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("length"),
        F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"),
        *columns,
    )


def _bits(rows: DataFrame, words: int) -> DataFrame:
    """rows with the word of the filter that their digest falls into, and its two bits there."""
    hashed = F.xxhash64("digest")
    return rows.withColumns({"word": F.pmod(F.shiftright(hashed, 12), F.lit(words)), "bits": F.array_distinct(F.array(hashed.bitwiseAND(F.lit(63)), F.shiftright(hashed, 6).bitwiseAND(F.lit(63))))})


def repeated_bits(rows: DataFrame) -> tuple[DataFrame, int]:
    """(word, seen): the bits of each word that two rows or more ask for; and the number of words."""
    words = max(1, rows.count())
    asked = _bits(rows, words).select("word", F.explode("bits").alias("bit")).groupBy("word", "bit").agg(F.count(F.lit(1)).alias("n"))
    twice = asked.filter("n > 1").groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("seen"))
    return stored(twice, "bloom"), words


def _probed(rows: DataFrame, seen: DataFrame, words: int) -> DataFrame:
    """rows with `maybe`: whether another row may have the same digest."""
    joined = _bits(rows, words).join(small_side(seen, BROADCAST_WORDS), "word", "left")
    maybe = F.forall("bits", lambda b: F.getbit(F.coalesce("seen", F.lit(0)), b) == 1)
    return joined.withColumn("maybe", maybe).drop("word", "bits", "seen")


def _rank() -> Column:
    """Least for the row of a group that stays: the longest, then the smallest id, null ids last."""
    return F.struct((-F.col("length")).alias("shorter"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))


def _groups(copies: DataFrame) -> DataFrame:
    """(digest, first, size, alike): the row that stays, the rows of the group, those that tie with it in everything."""
    first = F.min(F.struct(_rank().alias("rank"), "n")).alias("first")
    found = copies.groupBy("digest").agg(first, F.sum("n").alias("size"))
    return found.select("digest", F.col("first.rank").alias("first"), "size", F.col("first.n").alias("alike"))


def _candidates(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(rows that are alone, candidates with the number of rows alike, filter, its words)."""
    rows = stored(digested(docs, id, text), "digests")
    seen, words = repeated_bits(rows)
    probed = _probed(rows, seen, words)
    copies = probed.filter("maybe").groupBy("digest", "id", "length").agg(F.count(F.lit(1)).alias("n"))
    return probed.filter("not maybe"), stored(copies, "candidates"), seen, words


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, keep_id, size, kept, digest): one row per row of `docs`, dropped ones too.

    Of a group of equal texts the row with the most characters stays, then the smallest id; null
    ids come last. Null texts are empty, and so are those of white space alone. Of rows that tie in
    all of this exactly one is kept. An empty table gives no row; other columns are not looked at.
    """
    alone, copies, _, _ = _candidates(docs, id, text)
    groups = stored(_groups(copies), "groups")
    joined = copies.join(small_side(groups), "digest")
    runs = joined.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))))
    each = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)))
    kept = _rank().eqNullSafe(F.col("first")) & (F.col("copy") == 0)
    grouped = each.select("id", F.col("first.id").alias("keep_id"), "size", kept.alias("kept"), "digest")
    single = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"), "digest")
    return single.unionByName(grouped)


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; see exact_duplicates.

    Rows that are alone pass through where they are read; of the others, those that stay are
    found by a join on their digests.
    """
    _, copies, seen, words = _candidates(docs, id, text)
    groups = stored(_groups(copies), "groups")
    probed = _probed(digested(docs, id, text, F.struct("*").alias("row")), seen, words)
    joined = probed.filter("maybe").join(small_side(groups), "digest").filter(_rank().eqNullSafe(F.col("first")))
    single = probed.filter("not maybe").select("row.*")
    tied = joined.filter("alike > 1").dropDuplicates(["digest"])
    return single.unionByName(joined.filter("alike = 1").select("row.*")).unionByName(tied.select("row.*"))
