"""Micro-batch sinks: topics, and the feed handler's outputs. They may see a batch twice after
a failure and write the same thing again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickforge.contracts import ALERTS_TOPIC, QUOTES_TOPIC, RAW_TOPIC, TRADES_TOPIC
from tickforge.functions.columns import iso_utc
from tickforge.operators import feed
from tickforge.sources.topics import as_messages, write_topic


class TopicSink:
    """Micro-batches of messages to one topic, on Kafka or as JSON files.

    On files each batch has its own folder, so repeating it replaces it; on Kafka a
    repeated batch is sent again.
    """

    def __init__(self, topic: str, sink: str = "json", **options: str):
        self.topic, self.sink, self.options = topic, sink, options

    def write(self, messages: DataFrame, batch: int) -> None:
        if self.sink == "kafka":
            write_topic(messages, self.topic, "kafka", **self.options)
            return
        stamped = messages.withColumn("timestamp", iso_utc("timestamp"))
        stamped.write.mode("overwrite").json(f"{self.options['path'].rstrip('/')}/{self.topic}/batch-{batch}")


class SplitTables:
    """Rows of one stream to a table per value of ``kind``; a repeated batch replaces its own folders."""

    def __init__(self, path: str, kinds: tuple[str, ...]):
        self.path, self.kinds = path.rstrip("/"), kinds

    def write(self, rows: DataFrame, batch: int) -> None:
        kept = rows.persist()
        try:
            for kind in self.kinds:
                kept.where(kept["kind"] == kind).write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={batch}")
        finally:
            kept.unpersist()

    def read(self, spark: SparkSession, kind: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{kind}").drop("batch")


class FeedOutputs:
    """Valid events to the raw and the typed topics, rejected ones to the alerts."""

    def __init__(self, sink: str = "json", **options: str):
        self.sink, self.options = sink, options

    def write(self, messages: DataFrame, batch: int) -> None:
        checked = feed.feed_checked(messages).persist()
        try:
            trades = self._sourced(feed.canonical_trades(checked))
            quotes = self._sourced(feed.canonical_quotes(checked))
            self._put(as_messages(trades, TRADES_TOPIC, feed.TRADE_COLUMNS), TRADES_TOPIC, batch)
            self._put(as_messages(quotes, QUOTES_TOPIC, feed.QUOTE_COLUMNS), QUOTES_TOPIC, batch)
            raw = as_messages(trades, RAW_TOPIC, feed.TRADE_COLUMNS).unionByName(as_messages(quotes, RAW_TOPIC, feed.QUOTE_COLUMNS))
            self._put(raw, RAW_TOPIC, batch)
            alerts = self._sourced(feed.validation_alerts(checked))
            self._put(as_messages(alerts, ALERTS_TOPIC, feed.ALERT_COLUMNS), ALERTS_TOPIC, batch)
        finally:
            checked.unpersist()

    @staticmethod
    def _sourced(rows: DataFrame) -> DataFrame:
        return rows.withColumnsRenamed({"topic": "source_topic", "partition": "source_partition", "offset": "source_offset"})

    def _put(self, messages: DataFrame, topic: str, batch: int) -> None:
        TopicSink(topic, self.sink, **self.options).write(messages, batch)
