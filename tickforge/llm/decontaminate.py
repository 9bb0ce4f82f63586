"""Benchmark decontamination by spaced-seed hashing, in DataFrame expressions alone.

Each of the fixed MASKS looks at some of SPAN = 8 successive tokens and ignores the others.
The hashes of the benchmark under all masks are joined with those of the documents, so a
passage is found even if the tokens that some mask ignores have been replaced. A hit fixes
how an item lies on a document; the tokens of both are then compared one by one along that
line, and the run around the hit counts as a leak if it covers at least MIN_SHARE of the item,
or MIN_WORDS tokens of it, with no more than MAX_CHANGED of the tokens changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickforge.llm.common import small_side, stored

MASKS = ("11011011", "11101101", "10110111", "01111110")
SPAN = 8
MIN_WORDS = 13
MIN_SHARE = 0.6
MAX_CHANGED = 0.2
SEED_ROWS = 500_000
"""Most seeds of a benchmark that may be broadcast (24 bytes each)."""


def tokens(text: Column) -> Column:
    """Hashes of the runs of letters and digits of a text, in lower case."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def mask_hash(array: str, place: str, masks: tuple[str, ...] = MASKS) -> Column:
    """An array with the hash under each mask of the tokens from `place` on."""
    picked = [", ".join(f"{array}[{place} + {i}]" for i, bit in enumerate(mask) if bit == "1") for mask in masks]
    return F.array(*(F.expr(f"xxhash64({k}, {p})") for k, p in enumerate(picked)))


def seeds(df: DataFrame, array: str, place: str, *columns: str) -> DataFrame:
    """A row for each place and mask: `columns`, `place`, `seed`. Texts under SPAN tokens have none."""
    placed = df.filter(F.size(array) >= SPAN).select("*", F.explode(F.expr(f"sequence(0, size({array}) - {SPAN})")).alias(place))
    return placed.select(*columns, place, F.explode(mask_hash(array, place)).alias("seed"))


def leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", seed_rows: int = SEED_ROWS) -> DataFrame:
    """(id, item, first, last, words, same, item_words): stretches of documents that repeat an item.

    `first` and `last` are token numbers from 0, `same` the tokens that are equal there. A
    document row is told apart by its id and text; rows that repeat both give the same leaks
    once. Null or short texts, and items under SPAN tokens, have none.
    """
    items = stored(
        benchmark.select(F.col(item).alias("item"), tokens(F.col(item_text)).alias("item_tokens")).filter(F.size("item_tokens") >= SPAN),
        "items",
    )
    known = stored(seeds(items, "item_tokens", "item_place", "item").dropDuplicates(["item", "item_place", "seed"]), "item-seeds")
    longest = items.agg(F.max(F.size("item_tokens")).alias("n")).first().n or 0
    words = docs.select(F.struct(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("own")).alias("row"), tokens(F.col(text)).alias("doc_tokens"))
    shift = (F.col("place") - F.col("item_place")).alias("shift")
    begin = F.greatest(F.col("shift"), F.lit(0)).alias("begin")
    near = F.expr(f"slice(doc_tokens, greatest(shift, 0) + 1, {longest})").alias("near")
    bounded = len(known.limit(seed_rows + 1).groupBy().count().filter(F.col("count") <= seed_rows).take(1)) > 0
    if bounded:  # each hit takes its stretch along; repeats of one line meet before the shuffle
        hits = seeds(words, "doc_tokens", "place", "row", "doc_tokens").join(F.broadcast(known), "seed")
        lines = hits.select("row", "item", shift, "doc_tokens").select("row", "item", "shift", begin, near).distinct()
    else:  # hits alone are shuffled, and the texts that have any
        hits = seeds(words, "doc_tokens", "place", "row").join(known, "seed")
        narrow = hits.select("row", "item", shift).distinct()
        lines = words.join(narrow, "row").select("row", "item", "shift", begin, near).distinct()
    lines = lines.select("row.id", "item", "shift", "begin", "near")
    compared = lines.join(small_side(items), "item").select(
        "id", "item", "begin", F.size("item_tokens").alias("item_words"),
        F.expr(
            "zip_with(slice(item_tokens, greatest(-shift, 0) + 1, size(near)), "
            "slice(near, 1, size(item_tokens) - greatest(-shift, 0)), (x, y) -> int(x <=> y))"
        ).alias("same"),
    )
    return _runs(compared)


def _enough(words: Column) -> Column:
    return (words >= SPAN) & ((words >= MIN_WORDS) | (words >= F.ceil(F.col("item_words") * MIN_SHARE)))


def _runs(compared: DataFrame) -> DataFrame:
    """The leak on each line, if there is one.

    That is the best run, with the highest sum of 1 per equal and -4 per changed token, if it is
    long enough; with these weights a run stops paying as MAX_CHANGED of it is changed. Else it is
    the longest stretch from one equal token to another with at most MAX_CHANGED of it changed:
    changes side by side split the best run, and each half of it may be too short.
    """
    loss = round((1 - MAX_CHANGED) / MAX_CHANGED)
    fold = f"""
        aggregate(same,
          struct(0 AS at, 0 AS score, 0 AS begin, 0 AS same, 0 AS best, 0 AS first, -1 AS last, 0 AS hits),
          (a, s) -> struct(
            a.at + 1 AS at,
            IF(a.score + IF(s = 1, 1, -{loss}) > 0, a.score + IF(s = 1, 1, -{loss}), 0) AS score,
            IF(a.score + IF(s = 1, 1, -{loss}) > 0, a.begin, a.at + 1) AS begin,
            IF(a.score + IF(s = 1, 1, -{loss}) > 0, a.same + s, 0) AS same,
            greatest(a.best, a.score + IF(s = 1, 1, -{loss})) AS best,
            IF(a.score + IF(s = 1, 1, -{loss}) > a.best, a.begin, a.first) AS first,
            IF(a.score + IF(s = 1, 1, -{loss}) > a.best, a.at, a.last) AS last,
            IF(a.score + IF(s = 1, 1, -{loss}) > a.best, a.same + s, a.hits) AS hits))
    """
    columns = ["id", "item", "begin", "item_words"]
    run = compared.select(*columns, "same", F.expr(fold).alias("r"))
    best = run.filter(_enough(F.col("r.last") - F.col("r.first") + 1)).select(*columns, "r.first", "r.last", F.col("r.hits").alias("same"))
    # no stretch is long enough without this many equal tokens, so most chance hits end here
    least = F.ceil(F.least(F.lit(MIN_WORDS), F.greatest(F.lit(SPAN), F.ceil(F.col("item_words") * MIN_SHARE))) * (1 - MAX_CHANGED))
    short = run.filter(~_enough(F.col("r.last") - F.col("r.first") + 1)).filter(F.expr("aggregate(same, 0, (n, s) -> n + s)") >= least)
    both = best.unionByName(_longest(short.select(*columns, "same"), loss))
    found = both.select(
        "id", "item",
        (F.col("begin") + F.col("first")).alias("first"), (F.col("begin") + F.col("last")).alias("last"),
        (F.col("last") - F.col("first") + 1).alias("words"), "same", "item_words",
    )
    return found.filter(_enough(F.col("words"))).distinct()


def _longest(compared: DataFrame, loss: int) -> DataFrame:
    """The longest stretch of each line with no more than MAX_CHANGED changed.

    With `loss` per changed and -1 per equal token that is the pair of places furthest apart
    between which the sum does not rise. The sums are sorted from the highest down; one fold keeps
    the earliest place so far, from which a stretch to the current one is allowed.
    """
    sums = f"""
        aggregate(same, array(0), (a, s) -> concat(a, array(element_at(a, -1) + IF(s = 1, -1, {loss}))))
    """
    sorted_places = "array_sort(transform(sums, (x, i) -> struct(-x AS down, i AS place)))"
    # same[place] opens a stretch, same[place - 1] ends one; both have to be equal tokens
    fold = f"""
        aggregate({sorted_places}, struct(size(same) AS low, 0 AS first, -1 AS last),
          (a, p) -> struct(
            IF(p.place < size(same) AND get(same, p.place) = 1, least(a.low, p.place), a.low) AS low,
            IF(get(same, p.place - 1) = 1 AND p.place - a.low > a.last - a.first + 1, a.low, a.first) AS first,
            IF(get(same, p.place - 1) = 1 AND p.place - a.low > a.last - a.first + 1, p.place - 1, a.last) AS last))
    """
    columns = ["id", "item", "begin", "item_words"]
    placed = compared.select(*columns, "same", F.expr(sums).alias("sums"))
    found = placed.select(*columns, "same", F.expr(fold).alias("r"))
    hits = "aggregate(slice(same, r.first + 1, r.last - r.first + 1), 0, (n, s) -> n + s)"
    return found.select(*columns, "r.first", "r.last", F.expr(hits).alias("same"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """(id, items, words): documents with leaks, the items in order, and the most words of one."""
    found = leaks(docs, benchmark, **columns)
    return found.groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("words").cast("long").alias("words"))


def clean(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the rows whose id has a leak; rows with a null id are told by that null."""
    found = small_side(stored(contaminated(docs, benchmark, id=id, text=text).select(F.col("id").alias("_key")), "leaks"))
    return docs.join(found, docs[id].eqNullSafe(found["_key"]), "left_anti")
