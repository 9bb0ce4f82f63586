"""Hot state: the newest event per kind and symbol, and the newest alerts per symbol.

Messages of the state topics fold into it in any cut: what a batch adds is merged by the same
rules as two states are, so batches, a repeated batch and a rebuild from the topics end alike.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tickforge.contracts import (
    ALERT_SCHEMA,
    ALERT_TTL_SECONDS,
    ALERTS_STORED,
    ALERTS_TOPIC,
    BARS_TOPIC,
    METRICS_TOPIC,
    QUOTES_TOPIC,
    STALE_MS,
    STATE_TTL_SECONDS,
    TOP_OF_BOOK_TOPIC,
)
from tickforge.functions.columns import iso_utc, lag_ms, parse_utc, version
from tickforge.functions.ranking import first_rows
from tickforge.sources.folders import Snapshots

# Which topic feeds which kind of state.
STATE_TOPICS = {
    QUOTES_TOPIC: "latest_quote",
    TOP_OF_BOOK_TOPIC: "top_of_book",
    BARS_TOPIC: "bar_1s",
    METRICS_TOPIC: "metrics",
}
REBUILD_TOPICS = (TOP_OF_BOOK_TOPIC, BARS_TOPIC, METRICS_TOPIC, ALERTS_TOPIC)
KINDS = {**STATE_TOPICS, ALERTS_TOPIC: "alerts"}
POSITION = "source_topic string, source_partition long, source_offset long"
STATE_SCHEMA = f"""state_kind string, symbol string, payload string, event_time timestamp, sequence_number long,
                   ingest_time timestamp, {POSITION}, expires_at timestamp"""
ALERTS_SCHEMA = f"""symbol string, exchange string, alert_type string, observed_sequence long, event_time timestamp,
                    severity string, message string, sequence_number long, payload string"""
ORDER = ["event_time", "sequence_number", "ingest_time", "source_topic", "source_partition", "source_offset"]
ENVELOPE = "symbol string, exchange string, event_time string, ingest_time string, processed_time string, sequence_number bigint"


def state_rows(messages: DataFrame, as_of: Column | None = None, rebuilt: bool = False) -> DataFrame:
    """Messages of the state topics as entries; freshness is that of a quote at ``as_of``.

    A state rebuilt from the derived topics has no quotes: there the book gives freshness, with
    no lag and the status ``rebuilt``.
    """
    kind = F.coalesce(*[F.when(F.col("topic") == topic, kind) for topic, kind in STATE_TOPICS.items()])
    fresh_from = STATE_TOPICS[TOP_OF_BOOK_TOPIC if rebuilt else QUOTES_TOPIC]
    kinds = F.when(kind == fresh_from, F.array(kind, F.lit("freshness"))).otherwise(F.array(kind))
    now = F.current_timestamp() if as_of is None else as_of
    rows = (
        messages.where(F.col("topic").isin(*(REBUILD_TOPICS[:3] if rebuilt else STATE_TOPICS)))
        .withColumn("e", F.explode(F.array(F.from_json("value", ENVELOPE))))
        .select(
            F.explode(kinds).alias("state_kind"),
            F.upper("e.symbol").alias("symbol"),
            F.col("e.exchange").alias("exchange"),
            F.col("value").alias("payload"),
            parse_utc("e.event_time").alias("event_time"),
            F.col("e.sequence_number").alias("sequence_number"),
            parse_utc("e.ingest_time").alias("ingest_time"),
            F.col("topic").alias("source_topic"),
            F.col("partition").alias("source_partition"),
            F.col("offset").alias("source_offset"),
            F.col("e.processed_time").alias("processed_time"),
        )
        .withColumn("expires_at", F.expr(f"ingest_time + INTERVAL {STATE_TTL_SECONDS} SECONDS"))
        .withColumn("lag", F.lit(0).cast("long") if rebuilt else lag_ms("event_time", now))
    )
    status = F.lit("rebuilt") if rebuilt else F.when(F.col("lag") > STALE_MS, "stale").otherwise("fresh")
    fresh = F.to_json(
        F.struct(
            iso_utc("event_time").alias("event_time"),
            F.col("exchange"),
            F.col("lag").alias("freshness_lag_ms"),
            iso_utc("ingest_time").alias("last_ingest_time"),
            (F.col("processed_time") if rebuilt else iso_utc(now)).alias("last_processed_time"),
            version().alias("schema_version"),
            status.alias("status"),
            F.col("symbol"),
        )
    )
    payload = F.when(F.col("state_kind") == "freshness", fresh).otherwise(F.col("payload"))
    return rows.withColumn("payload", payload).drop("exchange", "lag", "processed_time")


def alert_entries(messages: DataFrame) -> DataFrame:
    """Messages of the alert topic as entries of the lists."""
    fields = ENVELOPE + ", " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ALERT_SCHEMA)
    alerts = messages.where(F.col("topic") == ALERTS_TOPIC).withColumn("e", F.explode(F.array(F.from_json("value", fields))))
    return alerts.select(
        F.upper("e.symbol").alias("symbol"), "e.exchange", "e.alert_type", "e.observed_sequence", parse_utc("e.event_time").alias("event_time"),
        "e.severity", "e.message", "e.sequence_number", F.col("value").alias("payload"),
    )


def latest_entries(rows: DataFrame) -> DataFrame:
    """The newest entry per kind and symbol."""
    row = F.max_by(F.struct(*rows.columns), F.struct(*ORDER)).alias("row")
    return rows.groupBy("state_kind", "symbol").agg(row).select("row.*")


def alert_lists(entries: DataFrame, keep: int = ALERTS_STORED) -> DataFrame:
    """The newest ``keep`` alerts of each symbol, ``alert_rank`` from 1.

    An alert that came twice is one entry. A list ends an hour after its last alert, so those
    before a pause of an hour are gone when the next one comes. Lists of lists are the list of
    all: what has been left out once is never among the newest again.
    """
    keys = ["symbol", "exchange", "alert_type", "observed_sequence", "event_time"]
    rest = ["severity", "message", "sequence_number", "payload"]
    once = entries.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("rest")).select(*keys, "rest.*")
    newest_first = [F.desc("event_time"), F.desc("sequence_number"), *map(F.col, ("alert_type", "exchange", "observed_sequence", "message"))]
    ranked = first_rows(once, ["symbol"], newest_first, keep, "alert_rank")
    place = Window.partitionBy("symbol").orderBy("alert_rank")
    pause = F.unix_micros(F.lag("event_time").over(place)) - F.unix_micros("event_time") >= ALERT_TTL_SECONDS * 1_000_000
    return ranked.withColumn("_pause", pause).withColumn("_gone", F.max(F.coalesce("_pause", F.lit(False))).over(place)).where("NOT _gone").drop("_pause", "_gone")


def alert_state(lists: DataFrame) -> DataFrame:
    """The lists as entries of the state: a JSON array per symbol, newest first."""
    ordered = F.array_sort(F.collect_list(F.struct("alert_rank", "payload", "event_time", "sequence_number")))
    return lists.groupBy("symbol").agg(ordered.alias("a")).select(
        F.lit(KINDS[ALERTS_TOPIC]).alias("state_kind"),
        "symbol",
        F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["payload"]), ","), F.lit("]")).alias("payload"),
        F.col("a")[0]["event_time"].alias("event_time"),
        F.col("a")[0]["sequence_number"].alias("sequence_number"),
        F.col("a")[0]["event_time"].alias("ingest_time"),
        F.lit(ALERTS_TOPIC).alias("source_topic"),
        F.lit(None).cast("long").alias("source_partition"),
        F.lit(None).cast("long").alias("source_offset"),
        F.expr(f"a[0].event_time + INTERVAL {ALERT_TTL_SECONDS} SECONDS").alias("expires_at"),
    )


def rebuilt_state(messages: DataFrame, symbol: str | None = None) -> DataFrame:
    """The state that messages of the derived topics add up to, of all symbols or of one."""
    state, alerts = state_rows(messages, rebuilt=True), alert_entries(messages)
    if symbol is not None:
        state, alerts = (rows.where(F.col("symbol") == symbol.upper()) for rows in (state, alerts))
    return latest_entries(state).unionByName(alert_state(alert_lists(alerts)))


def rebuild_counts(messages: DataFrame, symbol: str | None = None) -> DataFrame:
    """(state_kind, event_count): the dry run, what a rebuild of the same messages would read. Nothing is written."""
    wanted = messages.where(F.col("topic").isin(*REBUILD_TOPICS))
    if symbol is not None:
        wanted = wanted.where(F.upper(F.get_json_object("value", "$.symbol")) == symbol.upper())
    kind = F.coalesce(*[F.when(F.col("topic") == topic, kind) for topic, kind in KINDS.items()])
    return wanted.groupBy(kind.alias("state_kind")).agg(F.count(F.lit(1)).alias("event_count"))


class HotState(Snapshots):
    """The state after each micro-batch; see Snapshots. The time of a version is that of the newest message in it.

    A batch is read three times: for the entries, the alerts and the time. It is kept meanwhile, unless it comes from
    stored columns (``stored``), of which each reading takes what it needs.
    """

    def __init__(self, spark: SparkSession, path: str, as_of: Column | None = None, keep: int | None = 2, stored: bool = False):
        super().__init__(spark, path, keep)
        self.as_of, self.stored = as_of, stored

    def _entries(self, version: int | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], STATE_SCHEMA)
        return self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.folder(version)}/state")

    def _alerts(self, version: int | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], ALERTS_SCHEMA)
        return self.spark.read.schema(ALERTS_SCHEMA).parquet(f"{self.folder(version)}/alerts")

    def read(self, as_of: dt.datetime | None = None) -> DataFrame:
        """The current entries with the alert lists; with a time, those that were there then and had not expired.

        The time decides on the version: the newest one that holds no message ingested after it.
        """
        if as_of is not None and as_of.tzinfo is None:
            as_of = as_of.replace(tzinfo=dt.timezone.utc)
        version = self.current(None if as_of is None else round(as_of.timestamp() * 1_000_000))
        state = self._entries(version).unionByName(alert_state(self._alerts(version).withColumn("alert_rank", self._rank())))
        return state if as_of is None else state.where(F.col("expires_at") > F.lit(as_of))

    @staticmethod
    def _rank() -> Column:
        newest_first = [F.desc("event_time"), F.desc("sequence_number"), "alert_type", "exchange", "observed_sequence", "message"]
        return F.row_number().over(Window.partitionBy("symbol").orderBy(*newest_first))

    def upsert(self, messages: DataFrame, batch: int) -> None:
        known, sent = self.before(batch), messages if self.stored else messages.persist()
        try:
            folder = self.folder(batch)
            state = latest_entries(self._entries(known).unionByName(state_rows(sent, self.as_of)))
            state.write.mode("overwrite").parquet(f"{folder}/state")
            alerts = alert_lists(self._alerts(known).unionByName(alert_entries(sent)))
            alerts.drop("alert_rank").write.mode("overwrite").parquet(f"{folder}/alerts")
            newest = sent.agg(F.max(F.unix_micros("timestamp")).alias("us")).first().us
        finally:
            if not self.stored:
                sent.unpersist()
        self.finish(batch, max(newest or 0, self.finished().get(known, 0)))
