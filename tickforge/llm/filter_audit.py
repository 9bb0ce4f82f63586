"""Which of several filters removes what, in every order in which they may be applied.

What a document fails is a mask of bits, one per filter. All that the audit says follows from the
number of documents of each part with each mask, so documents are counted once, per part and mask,
in the map tasks; the orders are laid out over those few counts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from tickforge.llm.common import small_side, stored
from tickforge.llm.transducer import text_counts

MIN_WORDS = 200
FILTERS = {
    "A": f"words < {MIN_WORDS}",
    "B": "100 * distinct_words < 50 * words",
    "C": "100 * capitals > 2 * code_points",
    "D": "symbols > 0",
    "E": "id > first_id",
}
"""When a document fails: by its counts, or (E) since a smaller id has the same text."""


def failures(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask): what each row of `docs` fails, the first filter in bit 0.

    Null texts are empty, a null part is the empty string. Rows with the smallest id of their text
    do not fail E, however many they are, nor do null ids, which are neither smaller nor larger.
    """
    counted = stored(text_counts(docs, id, text, part), "text-counts")
    same = counted.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    known = counted.join(small_side(stored(same, "same-texts")), "digest", "left")
    bits = [F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(FILTERS.values())]
    return known.select("id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), sum(bits[1:], bits[0]).alias("mask"))


def labelled(failed: DataFrame, labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """failed with `good` and `toxic`, 0 without a label; a document labelled twice has both rows' marks."""
    marks = [F.max(F.when(F.col(c) == 1, F.lit(1)).otherwise(F.lit(0))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    once = labels.groupBy(F.col(id).cast("long").alias("id")).agg(*marks)
    return failed.join(once, "id", "left").fillna(0, ["good", "toxic"])


def audit(marked: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from rows of (part, mask, good, toxic).

    An order is a string of the filters' letters, applied from left to right. Every part has all
    orders and steps, with zeros where nothing goes; without rows there is no part.
    """
    counts = marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    letters = "".join(FILTERS)
    before = [(i, m) for i in range(len(letters)) for m in range(1 << len(letters)) if not m >> i & 1]
    cases = F.explode(F.array(*(F.struct(F.lit(i).alias("filter"), F.lit(m).alias("before")) for i, m in before)))
    laid = stored(counts, "mask-counts").withColumn("case", cases).select("*", "case.filter", "case.before")

    fails = F.expr("(mask >> filter) & 1") == 1
    gone = F.expr("mask & before") != 0
    orders = factorial(len(letters))

    def total(when: Column, what: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, what)), F.lit(0)).cast("long")

    found = laid.groupBy("part", "filter", "before").agg(
        total(~fails & ~gone, F.col("n")).alias("kept"),
        total(fails & ~gone, F.col("n")).alias("removed"),
        total(fails & gone, F.col("n")).alias("redundant"),
        total(fails & (F.bit_count("mask") == 1), F.col("n")).alias("unique_fails"),
        total(fails & ~gone, F.col("good")).alias("good_lost"),
        total(fails & ~gone, F.col("toxic")).alias("toxic_lost"),
        # Of all orders, each of the filters that a document fails is the first of them equally often.
        total(fails, F.expr(f"n * ({orders} div bit_count(mask))")).alias("shapley"),
    )
    steps = [
        ("".join(order), k + 1, letters.index(x), sum(1 << letters.index(y) for y in order[:k]))
        for order in permutations(letters)
        for k, x in enumerate(order)
    ]
    rows = marked.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, before int")
    return found.join(F.broadcast(rows), ["filter", "before"]).drop("filter", "before")
