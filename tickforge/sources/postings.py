"""A stored inverted index over hashed embeddings, searched without reading all of it.

``chunks`` holds the rows, ``postings`` one row per chunk and slot in order of slot and weight, and
``blocks`` the number, the largest and the smallest weight of each block: the postings of a slot whose
weights are alike. A query of m slots with a known lower bound on its last result can only find a
new chunk through a posting that adds an m-th of that bound or more, so blocks below it are skipped
and no result is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickforge.contracts import SEARCH_LIMIT
from tickforge.functions.ranking import first_rows
from tickforge.operators.vectors import BROADCAST_SLOTS, CHUNK_KEY, few, with_embedding

BINS = 64
"""Blocks of a slot per unit of weight."""
ROUNDING = 1e-6


class PostingIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def save(cls, chunks: DataFrame, path: str) -> PostingIndex:
        """Store chunks that have an embedding; each is embedded and written once."""
        index = cls(chunks.sparkSession, path)
        chunks.write.mode("overwrite").parquet(f"{index.path}/chunks")
        slots = index.chunks().select(*CHUNK_KEY, F.inline("embedding").alias("idx", "weight"))
        placed = slots.withColumn("bin", F.floor(F.col("weight") * BINS).cast("int"))
        placed.repartitionByRange("idx", "bin").sortWithinPartitions("idx", "bin").write.mode("overwrite").parquet(f"{index.path}/postings")
        block = [F.max("weight").alias("largest"), F.min("weight").alias("smallest"), F.count(F.lit(1)).alias("n")]
        index.postings().groupBy("idx", "bin").agg(*block).write.mode("overwrite").parquet(f"{index.path}/blocks")
        return index

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def needed(self, asked: DataFrame, limit: int, min_score: float) -> DataFrame:
        """(query_id, idx, bin): the blocks that a search for ``asked`` (query_id, idx, asked) has to read for candidates."""
        bounds = self.blocks().join(few(asked), "idx").withColumn("best", F.greatest(F.col("asked") * F.col("largest"), F.col("asked") * F.col("smallest")))
        known = self._scores(asked, few(self._promising(bounds, asked, limit), BROADCAST_SLOTS // (4 * limit), of=asked))
        last = first_rows(known.where(F.col("score") > min_score), ["query_id"], [F.desc("score")], limit, "rank")
        least = last.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == limit, F.min("score")).alias("least"))
        widths = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"))
        shares = widths.join(least, "query_id", "left").select(
            "query_id", ((F.coalesce("least", F.lit(min_score)) - ROUNDING) / F.col("m")).alias("share")
        )
        return bounds.join(few(shares, of=asked), "query_id").where((F.col("best") >= F.col("share")) & (F.col("best") > 0)).select("query_id", "idx", "bin")

    def _promising(self, bounds: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
        """(query_id, chunk key): ``limit`` chunks per query from the blocks with the largest bounds, whose scores give the lower bound."""
        first = first_rows(bounds, ["query_id"], [F.desc("best"), "idx", "bin"], limit, "block_rank").select("query_id", "idx", "bin", "asked")
        found = self._read(asked).join(few(first, BROADCAST_SLOTS // limit, of=asked), ["idx", "bin"])
        return first_rows(found, ["query_id"], [F.desc(F.col("weight") * F.col("asked")), *CHUNK_KEY], 4 * limit).select("query_id", *CHUNK_KEY).distinct()

    def _read(self, asked: DataFrame) -> DataFrame:
        """The postings of the asked slots; a slot is one of a few hundred numbers, so the list goes to the scan."""
        slots = [r.idx for r in asked.select("idx").distinct().collect()]
        return self.postings().where(F.col("idx").isin(slots))

    def _scores(self, asked: DataFrame, candidates: DataFrame | None) -> DataFrame:
        """(query_id, chunk key, score) of candidates, or of all chunks that share a slot with a query."""
        met = self._read(asked).join(few(asked), "idx")
        if candidates is not None:
            met = met.join(candidates, ["query_id", *CHUNK_KEY], "left_semi")
        return met.groupBy("query_id", *CHUNK_KEY).agg(F.round(F.sum(F.col("weight") * F.col("asked")), 6).alias("score"))

    def search(self, queries: DataFrame, limit: int = SEARCH_LIMIT, min_score: float = 0.0) -> DataFrame:
        """Best chunks for each query (query_id, query), the same as vectors.vector_topk finds by reading all."""
        asked = with_embedding(queries, "query").select("query_id", F.inline("embedding").alias("idx", "asked"))
        asked = self.spark.createDataFrame(asked.toPandas(), asked.schema) if _is_small(asked) else asked.persist()
        needed = self.needed(asked, limit, min_score).persist()
        sizes = needed.join(self.blocks(), ["idx", "bin"]).agg(F.sum("n").alias("n")).first().n or 0
        total = self.blocks().join(few(asked), "idx").agg(F.sum("n").alias("n")).first().n or 0
        candidates = None
        if sizes < total / 2:  # else fetching the candidates' other slots costs more than it saves
            candidates = few(self._read(asked).join(few(needed), ["idx", "bin"]).select("query_id", *CHUNK_KEY).distinct().persist())
        scored = self._scores(asked, candidates).where(F.col("score") > min_score)
        best = first_rows(scored, ["query_id"], [F.col("score").desc(), *map(F.col, CHUNK_KEY)], limit, "result_rank")
        return few(best, BROADCAST_SLOTS // limit, of=asked).join(self.chunks().drop("embedding"), CHUNK_KEY)


def _is_small(asked: DataFrame, limit: int = 20_000) -> bool:
    return asked.limit(limit + 1).count() <= limit
