"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming distance.

A fingerprint has one bit per majority of the hashes of a text's word shingles. Two
fingerprints with at most MAX_DISTANCE = 2 different bits agree on at least two of four
16-bit blocks, so the six choices of two blocks are the join keys: every close pair shares
a key, and a join on it followed by the Hamming distance finds all of them.

The work is on distinct fingerprints, so copies cost one row each whatever their number. A
key that more than PAIR_LIMIT distinct fingerprints share is not paired up: there each
member lists itself and its 64 neighbours at distance 1. Two fingerprints differ in at most
two bits exactly if those lists meet, and whoever meets at one value is joined to the
smallest there: 65 rows per member, no pairs, the same components.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tickforge.llm.common import connected_components, small_side, stored

SEED = 42
SHINGLE_WORDS = 3
MAX_DISTANCE = 2
BLOCKS = 4
PAIR_LIMIT = 64
SLICE_BYTES = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_slices(text: bytes, size: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, about `size` bytes of it at a time."""
    start = 0
    while start < len(text):
        cut = _SPACE.search(text, start + size)
        end = cut.start() if cut else len(text)
        yield text[start:end].split()
        start = end


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text as an unsigned number; 0 without words."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for words in word_slices((text or b"").lower()):
        words = tail + words
        if len(words) >= shingle_words:
            ones += _bit_counts(map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))))
            total += len(words) - shingle_words + 1
        tail = words[len(words) - shingle_words + 1 :] if len(words) >= shingle_words else words
    if not total and tail:
        ones, total = _bit_counts([b" ".join(tail)]), 1
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def _bit_counts(shingles) -> np.ndarray:
    """How many hashes have each bit set, highest bit first."""
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8)
    return np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long. Null texts count as empty."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py()) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(compute, "id long, fp long")


def fingerprint_text(fp: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def close_links(classes: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(a, b): links between the distinct fingerprints `fp` that make their components.

    Keys with up to `pair_limit` members give every pair within MAX_DISTANCE; larger ones
    give a tree over the members that are linked through them.
    """
    width = 64 // BLOCKS
    blocks = [((1 << width) - 1) << (width * i) for i in range(BLOCKS)]
    masks = [blocks[i] | blocks[j] for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]
    keys = F.array(*(F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)))
    keyed = classes.select("fp", F.inline(keys))
    sizes = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = stored(keyed.join(sizes, ["choice", "key"]), "simhash-blocks")

    small = shared.filter(F.col("members") <= pair_limit)
    pairs = (
        small.alias("x")
        .join(small.alias("y"), ["choice", "key"])
        .filter("x.fp < y.fp")
        .filter(F.bit_count(F.expr("x.fp ^ y.fp")) <= MAX_DISTANCE)
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    crowded = shared.filter(F.col("members") > pair_limit).select("fp").distinct()
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))
    meetings = crowded.select("fp", F.explode(near).alias("near"))
    lowest = meetings.groupBy("near").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a < b").select("near", "a")
    trees = meetings.join(lowest, "near").filter("fp > a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(trees).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(id, fp, component, kept_fp): every row with its component.

    `component` is the smallest id that links reach, nulls aside, and (component, kept_fp)
    the row that stands for it; with null ids alone it is null. Rows without words have
    fingerprint 0 and are linked like any other. Repeated rows come out as often as they
    went in; an empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, id, text), "simhash")
    classes = stored(rows.groupBy("fp").agg(F.min("id").alias("id")), "simhash-classes")
    roots = connected_components(close_links(classes.select("fp"), pair_limit)).withColumnsRenamed({"node": "fp"})
    placed = classes.join(roots, "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("first")
    best = placed.groupBy("root").agg(first)
    chosen = placed.join(best, "root").select("fp", F.col("first.id").alias("component"), F.col("first.fp").alias("kept_fp"))
    return rows.join(chosen, "fp").select("id", "fp", "component", "kept_fp")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the one that stands for it.

    Rows that share an id, or have none, are taken as one document: they stay if one of them
    stands for its component, and of those with equal texts one stays.
    """
    stands = F.col("id").eqNullSafe(F.col("component")) & (F.col("fp") == F.col("kept_fp"))
    found = near_duplicates(docs, id, text).groupBy("id").agg(F.bool_or(stands).alias("stays"), F.count(F.lit(1)).alias("n"))
    marks = stored(found.filter("not stays or n > 1").withColumnRenamed("id", "_key"), "near-duplicates")
    gone, again = small_side(marks.filter("not stays").select("_key")), small_side(marks.filter("stays").select("_key"))
    left = docs.join(gone, docs[id].eqNullSafe(gone["_key"]), "left_anti")
    single = left.join(again, left[id].eqNullSafe(again["_key"]), "left_anti")
    return single.unionByName(left.join(again, left[id].eqNullSafe(again["_key"]), "left_semi").dropDuplicates([id, text]))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value
