"""Ordered scans over keys of any size.

A window partitioned by key puts a key's whole history into one task. That is the
cheapest plan while the largest key fits a task, and no plan at all once one symbol
holds a large part of the data. The helpers here look at the largest key first:

* it fits: one window over the key, one shuffle;
* it does not: rows are range-partitioned on (key, order), which cuts any key, any
  second and any run of copies into even tiles. Each tile is scanned on its own, one
  total per tile is carried forward, and the carry is joined back.

Both ways give the same rows. ``order`` must be a total order within a key, so it
always ends in topic, partition and offset or another unique column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tickforge.session import scratch_path

ROWS_PER_TASK = 5_000_000
TILE_BYTES = 128 << 20
"""About what a tile may take in a shuffle, so that wide rows are cut into more tiles."""
COMPRESSED = 4
"""Bytes of a shuffle per byte of a stored Parquet file, roughly."""
TILE = "_tile"
KEY = "_key"
RANK = "_rank"
BLOCK = "_block"


@dataclass(frozen=True)
class Running:
    """A running aggregate: sum, max, min, first or last non-null value.

    ``before`` leaves the current row out.
    """

    kind: str
    column: Column
    before: bool = False


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.tickforge.rowsPerTask", str(ROWS_PER_TASK)))


def is_hot(df: DataFrame, keys: list[str], limit: int | None = None) -> bool:
    """Whether some key holds more rows than one task should sort.

    Reads the key columns only; counts are combined before the shuffle.
    """
    limit = limit or rows_per_task(df.sparkSession)
    largest = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()["n"]
    return (largest or 0) > limit


def range_tiles(df: DataFrame, keys: list[str], order: list[str], limit: int | None = None) -> DataFrame:
    """Add an even, ordered tile number.

    The rows are stored first, so that counting them and sampling cut points does not
    evaluate what is above again, and once more with their tiles: every later reader must
    see the same ones. A tile holds at most ``limit`` rows and, by the width of the schema and
    the size of the stored rows, about TILE_BYTES.
    """
    limit = limit or rows_per_task(df.sparkSession)
    rows = _stored(df)
    n, width = rows.count(), rows._jdf.schema().defaultSize()
    size = max(n * width, COMPRESSED * int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(2, -(-n // limit), -(-size // TILE_BYTES))
    return _stored(rows.repartitionByRange(parts, *keys, *order).withColumn(TILE, F.spark_partition_id()))


def _stored(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "scan")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _over(run: Running, window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, -1 if run.before else 0)
    return _window_function(run.kind, run.column).over(frame)


def _window_function(kind: str, column: Column) -> Column:
    if kind == "sum":
        return F.sum(column)
    if kind == "max":
        return F.max(column)
    if kind == "min":
        return F.min(column)
    if kind == "first":
        return F.first(column, ignorenulls=True)
    if kind == "last":
        return F.last(column, ignorenulls=True)
    raise ValueError(f"unknown running aggregate {kind!r}")


def _tile_total(run: Running, order: list[str]) -> Column:
    position = F.when(run.column.isNotNull(), F.struct(*order))
    if run.kind == "first":
        return F.min_by(run.column, position)
    if run.kind == "last":
        return F.max_by(run.column, position)
    return _window_function(run.kind, run.column)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    if kind == "first":
        return F.coalesce(carried, local)
    return F.coalesce(local, carried)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    runs: dict[str, Running],
    hot: bool | None = None,
) -> DataFrame:
    """Add running aggregates per key in the given order."""
    if hot is None:
        hot = is_hot(df, keys)
    if not hot:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[_over(run, window).alias(name) for name, run in runs.items()])

    # A struct of keys joins NULL with NULL, as the window would group them.
    key = F.struct(*keys) if keys else F.lit(0)
    tiled = range_tiles(df, keys, order).withColumn(KEY, key)
    within = Window.partitionBy(KEY, TILE).orderBy(*order)
    across = Window.partitionBy(KEY).orderBy(TILE).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        tiled.groupBy(KEY, TILE)
        .agg(*[_tile_total(run, order).alias(name) for name, run in runs.items()])
        .select(
            KEY,
            TILE,
            *[_window_function(run.kind, F.col(name)).over(across).alias(f"_carry_{name}") for name, run in runs.items()],
        )
    )
    local = tiled.select("*", *[_over(run, within).alias(f"_local_{name}") for name, run in runs.items()])
    types = {name: local.schema[f"_local_{name}"].dataType for name in runs}
    return local.join(carried, [KEY, TILE], "left").select(
        *df.columns,
        *[
            _combine(run.kind, F.col(f"_carry_{name}").cast(types[name]), F.col(f"_local_{name}")).alias(name)
            for name, run in runs.items()
        ],
    )


def trailing(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    rows: int,
    aggregates: dict[str, Column],
    hot: bool | None = None,
    rank: Column | None = None,
) -> DataFrame:
    """Add aggregates over the current row and the ``rows - 1`` before it.

    For a hot key, rows are numbered and cut into equal blocks; the last rows of a
    block are also sent to the next one, so each frame is complete in its block.
    ``rank`` is the row's number within its key from 0, when that is known already.
    """
    if hot is None:
        hot = is_hot(df, keys)
    if not hot:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0)
        return df.select("*", *[agg.over(frame).alias(name) for name, agg in aggregates.items()])

    size = max(rows_per_task(df.sparkSession), rows)
    if rank is None:
        ranked = running(df, keys, order, {RANK: Running("sum", F.lit(1).cast("long"))}, hot=True)
        rank = F.col(RANK) - 1
    else:
        ranked = df
    ranked = ranked.withColumn(RANK, rank)
    own = F.floor(F.col(RANK) / F.lit(size)).cast("long")
    near_end = F.col(RANK) % F.lit(size) >= F.lit(size - (rows - 1))
    blocks = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    placed = ranked.withColumn(BLOCK, F.explode(blocks))
    frame = Window.partitionBy(*keys, BLOCK).orderBy(RANK).rowsBetween(-(rows - 1), 0)
    return (
        placed.select("*", *[agg.over(frame).alias(name) for name, agg in aggregates.items()])
        .where(F.col(BLOCK) == own)
        .select(*df.columns, *aggregates)
    )
