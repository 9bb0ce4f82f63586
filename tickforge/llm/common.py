"""What the operators of this package share: shared storage, components, prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tickforge.session import scratch_path

BROADCAST_ROWS = 200_000
"""Most rows of a frame that may be broadcast; beyond it joins shuffle."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = scratch_path(spark, name)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows of df, written to the shared folder and read back: lineage ends here.

    Lost executors cost only the tasks that they were running, and nothing above is
    evaluated twice. The folder goes with the application.
    """
    return stored_at(df, fresh_path(df.sparkSession, name), codec)


def stored_at(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows, else as it is.

    For rows of any length `weight` says how many each counts, and null counts as one.
    """
    if weight is not None:
        small = (df.agg(F.sum(F.coalesce(weight, F.lit(1)))).first()[0] or 0) <= limit
    else:
        small = bool(df.limit(limit + 1).select(F.lit(1).alias("one")).groupBy().count().filter(F.col("count") <= limit).take(1))
    return F.broadcast(df) if small else df


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of `edges` (a, b) with the smallest node that it reaches.

    Alternating large-star and small-star steps: every round hangs the larger neighbours
    of a node, then the node itself, under the smallest one near it, so that chains halve
    and any graph ends as stars. Each round's edges are written to the shared folder. Loops
    and rows with a null are ignored; no edge gives no row.
    """
    spark = edges.sparkSession
    current_path = fresh_path(spark, "links")
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    current, mark = stored_at(links, current_path), None
    while (found := _fingerprint(current)) != mark:
        mark, last_path, current_path = found, current_path, fresh_path(spark, "links")
        current = stored_at(_small_star(_large_star(current)), current_path)
        drop_path(spark, last_path)
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node go under its smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go under the smallest of them."""
    lowest = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()


def offsets_before(totals: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before): the sum of `value` over all smaller keys.

    `totals` has one row per key, that is per partition or block of the data, so the one
    window over all of it stays small whatever the data.
    """
    earlier = W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(key, F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias("before"))
