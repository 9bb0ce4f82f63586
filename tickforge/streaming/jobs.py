"""Streaming queries without state of their own, or with built-in aggregation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tickforge.contracts import ALERT_SCHEMA, BRONZE_TOPICS, TABLE_CONTRACTS
from tickforge.functions.columns import notional, version, weighted_price
from tickforge.operators import bronze, live, silver
from tickforge.operators.feed import quality_alert_rows

# Bars are held open, and changed by however late a trade, unless a watermark is asked for.
WATERMARK = None


def run_available(stream: DataFrame, path: str, checkpoint: str, output: str = "append", partition_by: tuple[str, ...] = ()) -> StreamingQuery:
    """Process what is there now into a Parquet folder and stop."""
    writer = stream.writeStream.format("parquet").outputMode(output).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).start(path)


def bronze_ingest(
    messages: DataFrame, path: str, checkpoint: str, job_run_id: str = "manual", processed_at: Column | None = None
) -> StreamingQuery:
    """Append new messages of the bronze topics to the bronze table."""
    rows = bronze.bronze_rows(messages.where(F.col("topic").isin(*BRONZE_TOPICS)), job_run_id, processed_at)
    columns = TABLE_CONTRACTS["bronze_market_events"].partition_columns
    return run_available(rows, path, checkpoint, partition_by=columns)


def bronze_rejects(messages: DataFrame) -> DataFrame:
    """What bronze_ingest leaves out: unreadable messages, and those of other topics."""
    own = F.col("topic").isin(*BRONZE_TOPICS)
    others = messages.where(~own | F.col("topic").isNull()).select(
        F.col("topic").alias("source_topic"),
        F.col("partition").cast("long").alias("source_partition"),
        F.col("offset").cast("long").alias("source_offset"),
        F.col("value").cast("string").alias("raw_event"),
        F.lit("unknown_topic").alias("reason"),
    )
    return bronze.bronze_rejects(messages.where(own)).unionByName(others)


def ingest_bronze(
    messages: DataFrame, path: str, rejects_path: str, checkpoint: str, job_run_id: str = "manual", processed_at: Column | None = None
) -> tuple[StreamingQuery, StreamingQuery]:
    """Every new message goes to the bronze table or to the rejects."""
    return (
        bronze_ingest(messages, path, f"{checkpoint}/rows", job_run_id, processed_at),
        run_available(bronze_rejects(messages), rejects_path, f"{checkpoint}/rejects"),
    )


class DroppedRows(StreamingQueryListener):
    """How many rows each query with a watermark has dropped as too late, over its whole run.

    A query's own list of reports keeps the last hundred only. Add it with
    ``spark.streams.addListener`` before the queries start.
    """

    def __init__(self):
        self.by_query: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        states = event.progress.stateOperators
        self.by_query[str(event.progress.id)] += sum(state.numRowsDroppedByWatermark for state in states)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def top_of_book_stream(messages: DataFrame, processed_time: Column | None = None) -> DataFrame:
    return live.top_of_book(silver.quote_rows(bronze.bronze_rows(messages)), processed_time)


def spread_alert_stream(messages: DataFrame) -> DataFrame:
    return live.spread_alerts(silver.quote_rows(bronze.bronze_rows(messages)))


def alert_stream(messages: DataFrame) -> DataFrame:
    """Alerts of the feed and of the quotes in one stream."""
    rows = bronze.bronze_rows(messages)
    sent = bronze.payload(rows, "quality_alert", ALERT_SCHEMA).select("symbol", "exchange", "event_time", "payload.*")
    return quality_alert_rows(sent).unionByName(live.spread_alerts(silver.quote_rows(rows)))


def bar_stream(messages: DataFrame, watermark: str | None = WATERMARK, interval: str = "1 second") -> DataFrame:
    """Bars per symbol and exchange. A late trade updates its own bar, however late it is.

    The state holds one row per bar. A watermark bounds it, and drops trades that are later;
    ``DroppedRows`` counts them, and ``stateful.closing_bar_stream`` keeps them.

    Append mode, which needs a watermark, gives each bar once it is closed, update mode after
    every change.
    """
    position = F.struct("event_time", "sequence_number", "source_offset", "source_topic", "source_partition")
    trades = silver.trade_rows(bronze.bronze_rows(messages))
    trades = trades.withWatermark("event_time", watermark) if watermark else trades
    return (
        trades.groupBy(F.window("event_time", interval).alias("w"), "symbol", "exchange")
        .agg(
            F.min_by("price", position).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", position).alias("close"),
            F.sum("size").alias("volume"),
            F.sum(notional("price", "size")).alias("notional"),
            F.max("sequence_number").alias("sequence_number"),
        )
        .select(
            version().alias("schema_version"),
            F.lit("bar_1s").alias("event_type"),
            "symbol",
            "exchange",
            F.col("w.start").alias("event_time"),
            "sequence_number",
            "open",
            "high",
            "low",
            "close",
            "volume",
            weighted_price(F.col("notional"), F.col("volume"), F.col("close")).alias("vwap"),
        )
    )


def each_batch(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, output: str = "append", **trigger
) -> StreamingQuery:
    """Run ``write`` per micro-batch; a repeated batch comes with the same number."""
    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(output)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
