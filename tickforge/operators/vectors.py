"""Hashed embeddings and similarity search.

A vector is kept sparse: an array of (idx, weight) for the slots that are not zero.
It is built inside the row, so a table of chunks is embedded without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tickforge.contracts import (
    EMBEDDING_SIZE,
    EVIDENCE_MESSAGE,
    FRESHNESS_QUERY,
    INCIDENT_LIMIT,
    INCIDENT_QUERY,
    NO_EVIDENCE_MESSAGE,
    SEARCH_LIMIT,
    SUMMARY_CHARS,
    TIMELINE_CHARS,
    TIMELINE_ENTRIES,
    TOKEN_PATTERN,
)
from tickforge.functions.columns import col
from tickforge.functions.ranking import first_rows


EMBEDDING_TYPE = "array<struct<idx:int,weight:double>>"
CHUNK_KEY = ["source_uri", "chunk_index"]
BROADCAST_SLOTS = 200_000
"""Most slots of all queries together that may be broadcast (about 40 bytes each)."""
SLICE_BYTES = 1 << 20
"""Text that is cut into tokens at a time."""


def tokens(text: str | Column) -> Column:
    return F.transform(F.regexp_extract_all(col(text), F.lit(TOKEN_PATTERN), F.lit(0)), F.lower)


@lru_cache(1 << 17)
def _hashed(token: str) -> int:
    """The first four bytes of a token's digest as a number; its lowest bit is that of the fifth, which says the sign."""
    digest = hashlib.sha256(token.lower().encode()).digest()
    return int.from_bytes(digest[:4], "big") << 1 | digest[4] & 1


def _embedded(texts: pa.Array, size: int) -> pa.Array:
    find = re.compile(TOKEN_PATTERN).findall
    found = [find(text) if text else [] for text in texts.to_pylist()]
    rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
    met = pa.array([token for f in found for token in f], pa.string()).dictionary_encode()
    hashes = np.array([_hashed(token) for token in met.dictionary.to_pylist()], "int64")
    slots, signs = (hashes >> 1) % size, 1.0 - 2.0 * (hashes & 1)
    which = met.indices.to_numpy()
    cell, at = np.unique(rows * size + slots[which], return_inverse=True)
    net = np.bincount(at, signs[which], len(cell)) if len(cell) else np.zeros(0)
    cell, net = cell[net != 0], net[net != 0]
    row, idx = cell // size, cell % size
    norm = np.sqrt(np.bincount(row, net * net, len(texts)))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))])
    entries = pa.StructArray.from_arrays([pa.array(idx.astype("int32")), pa.array(net / norm[row])], names=["idx", "weight"])
    return pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), entries)


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> list[pa.Array]:
    """The texts in order, about ``most`` bytes at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64")
    part = (np.cumsum(sizes) - sizes) // most
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(starts, starts[1:])]


def _embedder(size: int):
    """Arrow function over a batch of texts: one sparse unit vector per text.

    Tokens take many times the bytes of their text, so a batch is worked through in slices.
    """

    @F.arrow_udf(EMBEDDING_TYPE)
    def embed(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_embedded(part, size) for part in text_slices(texts)])

    return embed


def with_embedding(chunks: DataFrame, text: str = "content", size: int = EMBEDDING_SIZE) -> DataFrame:
    """Add the sparse vector of a text column.

    Built-in functions can do this too, but their higher-order functions run
    interpreted and were many times slower than one Arrow batch at a time.
    """
    return chunks.withColumn("embedding", _embedder(size)(col(text)))


def dense(embedding: str | Column = "embedding", size: int = EMBEDDING_SIZE) -> Column:
    """The vector with all its zeros."""
    weights = F.map_from_entries(col(embedding))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(weights, i), F.lit(0.0)))


def dot(left: str | Column, right: str | Column) -> Column:
    """Product of two dense vectors, 0 when either is empty or their lengths differ."""
    left, right = col(left), col(right)
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda acc, value: acc + value)
    return F.when((F.size(left) == F.size(right)) & (F.size(left) > 0), total).otherwise(F.lit(0.0))


def few(df: DataFrame, limit: int = BROADCAST_SLOTS, of: DataFrame | None = None) -> DataFrame:
    """With a broadcast hint if there are at most so many rows, or so many of a frame that bounds them and costs less to count."""
    small = (df if of is None else of).limit(limit + 1).groupBy().count().where(F.col("count") <= limit).take(1)
    return F.broadcast(df) if small else df


def vector_topk(
    chunks: DataFrame, queries: DataFrame, limit: int = SEARCH_LIMIT, min_score: float | None = 0.0
) -> DataFrame:
    """Best chunks for each query (query_id, query).

    Chunks and queries meet on the slots they share: sums per query and chunk are made in
    the task that reads the chunk, only keys and scores are ranked, and the content is
    fetched for the winners. ``min_score=None`` keeps sums of zero and below too; chunks
    that share no slot with a query are never found.
    """
    asked = with_embedding(queries, "query").select("query_id", F.inline("embedding").alias("idx", "asked"))
    asked = few(asked)
    slots = chunks.select(*CHUNK_KEY, F.inline("embedding").alias("idx", "weight"))
    scored = slots.join(asked, "idx").groupBy("query_id", *CHUNK_KEY).agg(F.round(F.sum(F.col("weight") * F.col("asked")), 6).alias("score"))
    if min_score is not None:
        scored = scored.where(F.col("score") > min_score)
    best = first_rows(scored, ["query_id"], [F.col("score").desc(), *map(F.col, CHUNK_KEY)], limit, "result_rank")
    return few(best, BROADCAST_SLOTS // limit, of=queries).join(chunks.drop("embedding"), CHUNK_KEY)


def freshness_queries(symbols: DataFrame) -> DataFrame:
    """(query_id, query) for each symbol."""
    return symbols.select(F.col("symbol").alias("query_id"), F.format_string(FRESHNESS_QUERY, F.upper("symbol")).alias("query"))


def incident_summary(chunks: DataFrame, incident_ids: list[str]) -> DataFrame:
    """Summary and timeline from the best evidence; one row per incident.

    Works on at most six result rows per incident.
    """
    asked = chunks.sparkSession.createDataFrame([(name,) for name in incident_ids], "query_id string")
    found = vector_topk(chunks, asked.withColumn("query", F.format_string(INCIDENT_QUERY, "query_id")), INCIDENT_LIMIT)
    ranked = found.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("result_rank", "title", "content", "source_uri", "chunk_index"))).alias("results")
    )
    first = F.col("results")[0]
    timeline = F.transform(F.slice("results", 1, TIMELINE_ENTRIES), lambda r: F.substring(r["content"], 1, TIMELINE_CHARS))
    return asked.join(ranked, "query_id", "left").select(
        F.col("query_id").alias("incident_id"),
        F.when(
            first.isNotNull(), F.format_string(EVIDENCE_MESSAGE, first["title"], F.substring(first["content"], 1, SUMMARY_CHARS))
        )
        .otherwise(NO_EVIDENCE_MESSAGE)
        .alias("summary"),
        F.coalesce(timeline, F.array().cast("array<string>")).alias("timeline"),
        F.coalesce(F.transform("results", lambda r: r["source_uri"]), F.array().cast("array<string>")).alias("sources"),
    )
