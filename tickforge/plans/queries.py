"""The registered queries: each operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickforge import contracts
from tickforge.functions.scans import is_hot, rows_per_task
from tickforge.operators import bronze as bronze_ops, checks, feed, gold, live, reports, silver, staleness, text, vectors, vendor
from tickforge.plans import documents, market
from tickforge.session import scratch_path
from tickforge.sources import postings, topics

DAY = "2024-01-01"
SEARCHES = {"runbook": "the stale symbol runbook", "lineage": "la lineage de bronze and silver", "replay": "REPLAY dry run of the day"}
HOLD_TICKS = 120
INCIDENTS = ["INC-001", "the-and-of"]


def at(text_time: str) -> Column:
    return F.lit(text_time).cast("timestamp")


def start() -> Column:
    return at(f"{DAY} 00:00:00")


def middle() -> Column:
    return at(f"{DAY} 00:01:30")


def end() -> Column:
    return at(f"{DAY} 00:03:05")


def presented(df: DataFrame) -> DataFrame:
    """Times without zone, dates and lists as text, doubles to six places."""
    shown = []
    for field in df.schema:
        column, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
        if kind == "timestamp":
            column = column.cast("timestamp_ntz")
        elif kind == "date":
            column = column.cast("string")
        elif kind == "double":
            column = F.round(column, 6)
        elif kind.startswith("decimal"):
            column = F.round(column.cast("double"), 6)
        elif kind in ("array<string>", "array<bigint>"):
            column = F.array_join(column.cast("array<string>"), ",")
        shown.append(column.alias(field.name))
    return df.select(*shown)


class Market:
    """The frames that queries share, built on demand from one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, squeeze: int = market.DENSE):
        self.spark, self.sf_dir, self.squeeze = spark, sf_dir, squeeze

    @cached_property
    def hot(self) -> bool:
        return _hot(self.spark, self.sf_dir)

    def settled(self) -> Market:
        """The same market from stored tables: bronze and the rows parsed from it, each written once.

        For queries that read them many times, as the jobs of a lakehouse do.
        """
        place = scratch_path(self.spark, "settled")
        stored = Market(self.spark, self.sf_dir, self.squeeze)
        stored.hot = self.hot
        stored.bronze = written(self.bronze, f"{place}/bronze")
        stored.trade_rows = written(stored.trade_rows, f"{place}/trades")
        stored.quote_rows = written(stored.quote_rows, f"{place}/quotes")
        return stored

    @property
    def hot_seconds(self) -> bool | None:
        """A second of a symbol is small when the symbol is; else it is looked at."""
        return None if self.hot else False

    @cached_property
    def messages(self) -> DataFrame:
        return market.typed_messages(self.spark, self.sf_dir, self.hot, self.squeeze)

    @cached_property
    def bronze(self) -> DataFrame:
        return market.bronze(self.spark, self.sf_dir, self.hot, self.squeeze)

    @cached_property
    def feed(self) -> DataFrame:
        return market.feed_messages(self.spark, self.sf_dir, self.hot)

    @cached_property
    def trade_rows(self) -> DataFrame:
        return silver.trade_rows(self.bronze)

    @cached_property
    def quote_rows(self) -> DataFrame:
        return silver.quote_rows(self.bronze)

    @cached_property
    def trades(self) -> DataFrame:
        return silver.latest_trades(self.trade_rows)

    @cached_property
    def quotes(self) -> DataFrame:
        return silver.latest_quotes(self.quote_rows)

    @cached_property
    def gaps(self) -> DataFrame:
        return silver.sequence_gaps(self.bronze, hot=self.hot)

    @cached_property
    def bars(self) -> DataFrame:
        return gold.bars(self.trades)

    @cached_property
    def spreads(self) -> DataFrame:
        return gold.spread_features(self.quotes)

    @cached_property
    def annotations(self) -> DataFrame:
        return gold.quality_annotations(self.bronze, self.gaps)

    @cached_property
    def features(self) -> DataFrame:
        return gold.research_features(self.bars, self.spreads)

    @cached_property
    def tracked(self) -> DataFrame:
        return feed.quality_alert_rows(silver.sequence_track(self.bronze, hot=self.hot))

    @cached_property
    def feed_alerts(self) -> DataFrame:
        rows = bronze_ops.payload(self.bronze, "quality_alert", contracts.ALERT_SCHEMA)
        return feed.quality_alert_rows(rows.select("symbol", "exchange", "event_time", "payload.*"))

    @cached_property
    def alerts(self) -> DataFrame:
        """Alerts of the feed, the sequence check and the quotes."""
        return self.feed_alerts.unionByName(self.tracked).unionByName(live.spread_alerts(self.quote_rows))

    @cached_property
    def state(self) -> DataFrame:
        """Newest state per kind; the kinds made from quotes share one newest quote."""
        quotes, trades = live.newest(self.quote_rows, ["symbol"]), self.trade_rows
        return live.latest_state(
            {
                "latest_quote": quotes.select(*live.EVENT, "bid_price", "bid_size", "ask_price", "ask_size", *live.SOURCE),
                "top_of_book": live.top_of_book(quotes, market.processed_at()),
                "bar_1s": live.newest_bar(trades),
                "metrics": live.newest_metrics(trades),
                "freshness": live.freshness(quotes, end()),
            }
        )

    @cached_property
    def differences(self) -> DataFrame:
        keys = ["symbol", "exchange", "window_start"]
        fields = ["open", "high", "low", "close", "volume", "vwap"]
        return reports.live_vs_replay(live.live_bars(self.trade_rows), self.bars, keys, fields)

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        bars = self.bars
        return {
            "bronze_market_events": self.bronze,
            "silver_trades": self.trades,
            "silver_quotes": self.quotes,
            "silver_sequence_gaps": self.gaps,
            "gold_bars_1s": bars,
            "gold_spread_features": self.spreads,
            "gold_volatility_features": gold.volatility_features(bars),
            "gold_quality_annotations": self.annotations,
        }

    @cached_property
    def records(self) -> DataFrame:
        return market.vendor_records(self.spark, self.sf_dir)


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows stored once, for what reads them several times."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hot(spark: SparkSession, sf_dir: str) -> bool:
    """Whether a symbol on an exchange can be too large for one task.

    Asked of the raw table as it is now; an event becomes at most two messages, so twice
    its count bounds every later frame.
    """
    events = market.table(spark, sf_dir, "events").selectExpr("user_id % 24 AS k")
    return is_hot(events, ["k"], rows_per_task(spark) // 2)


def _chunk_view(chunks: DataFrame) -> DataFrame:
    return chunks.select("source_uri", "chunk_index", F.md5("content").alias("content_md5"))


def _evidence(m: Market) -> DataFrame:
    """The index that searches read: the notes cut and embedded, written once."""
    return written(vectors.with_embedding(documents.note_chunks(m.spark, m.sf_dir)), scratch_path(m.spark, "evidence"))


def _searches(m: Market) -> DataFrame:
    return m.spark.createDataFrame(list(SEARCHES.items()), "query_id string, query string")


def _found(results: DataFrame) -> DataFrame:
    return results.select(
        "query_id", "result_rank", "source_uri", "chunk_index", "title", "source_type", "score", F.md5("content").alias("content_md5")
    )


def _freshness_check(m: Market) -> DataFrame:
    """For every symbol: how fresh it is, its snapshot, and what the notes have on that."""
    m = m.settled()
    fresh = written(live.newest(live.freshness(m.quote_rows, end()), ["symbol"]), scratch_path(m.spark, "fresh"))
    found = vectors.vector_topk(_evidence(m), vectors.freshness_queries(fresh.select("symbol")))
    return reports.freshness_check(fresh, found, _shown(live.symbol_snapshot(m.state, m.alerts, fresh.select("symbol"), end())))


def _latest_state(m: Market) -> DataFrame:
    m = m.settled()
    paths = {"latest_quote": "bid_price", "top_of_book": "mid_price", "bar_1s": "vwap", "metrics": "volatility_bps", "freshness": "freshness_lag_ms"}
    value = F.coalesce(*[F.when(F.col("state_kind") == k, F.get_json_object("payload", f"$.{p}")) for k, p in paths.items()])
    return m.state.select(
        "state_kind", "symbol", F.get_json_object("payload", "$.exchange").alias("exchange"), "event_time", "sequence_number",
        "expires_at", F.round(value.cast("double"), 6).alias("shown"),
    )


def _snapshot(m: Market) -> DataFrame:
    m = m.settled()
    shot = live.symbol_snapshot(m.state, m.alerts, live.active_symbols(m.bronze), end())
    return _shown(shot)


def _shown(shot: DataFrame) -> DataFrame:
    """A field of each kind of state in a snapshot, and its alerts."""
    read = lambda kind, path: F.get_json_object(kind, f"$.{path}").cast("double")
    return shot.select(
        "symbol",
        read("latest_quote", "ask_price").alias("ask_price"),
        read("top_of_book", "spread").alias("spread"),
        read("bar_1s", "close").alias("close"),
        read("metrics", "sample_count").cast("long").alias("sample_count"),
        F.get_json_object("freshness", "$.status").alias("status"),
        F.coalesce(F.size("alerts"), F.lit(0)).alias("alert_count"),
        F.array_join(F.transform("alerts", lambda a: a["alert_type"]), ",").alias("alert_types"),
    )


def _conformance(m: Market) -> DataFrame:
    return checks.table_conformance({**m.tables, "gold_unknown": m.bars})


def _hashed(m: Market) -> DataFrame:
    embedded = vectors.with_embedding(documents.turn_chunks(m.spark, m.sf_dir))
    return embedded.select("source_uri", "chunk_index", F.inline("embedding"))


def _pairs(m: Market) -> DataFrame:
    table = market.table(m.spark, m.sf_dir, "embeddings").select("vec_id", "embedding")
    after = table.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("following"))
    return table.join(after, "vec_id").select("vec_id", vectors.dot("embedding", "following").alias("score"))


def _canonical(m: Market, kind: str) -> DataFrame:
    checked = feed.feed_checked(m.feed)
    return feed.canonical_trades(checked) if kind == "trade" else feed.canonical_quotes(checked)


BATCH: dict[str, Callable[[Market], DataFrame]] = {
    "bronze_rows": lambda m: m.bronze,
    "bronze_rejects": lambda m: bronze_ops.bronze_rejects(market.unchecked_messages(m.spark, m.sf_dir, m.hot)).drop("raw_event"),
    "raw_event_decode": lambda m: bronze_ops.raw_event_decode(m.bronze, contracts.TRADE_SCHEMA).select(
        "event_type", "symbol", "source_topic", "source_partition", "source_offset", "price", "size", "trade_id", "conditions"
    ),
    "event_router": lambda m: _routed(m),
    "lineage_columns": lambda m: m.quotes.select(*contracts.LINEAGE_COLUMNS),
    "canonical_trades": lambda m: _canonical(m, "trade"),
    "canonical_quotes": lambda m: _canonical(m, "quote"),
    "feed_validation": lambda m: feed.feed_validation(m.feed),
    "quality_alert_rows": lambda m: m.feed_alerts,
    "contract_violations": lambda m: _violations(m),
    "top_of_book": lambda m: live.top_of_book(m.quote_rows, market.processed_at()),
    "spread_alerts": lambda m: live.spread_alerts(m.quote_rows),
    "freshness": lambda m: live.freshness(m.quote_rows, end()),
    "vendor_quotes": lambda m: vendor.vendor_quotes(vendor.symbol_resolution(m.records), "GLBX"),
    "vendor_trades": lambda m: vendor.vendor_trades(vendor.symbol_resolution(m.records), "GLBX"),
    "vendor_events": lambda m: vendor.vendor_events(m.records, "GLBX"),
    "symbol_resolution": lambda m: vendor.symbol_resolution(m.records).select("record_id", "instrument_id", "resolved_symbol"),
    "time_range_filter": lambda m: reports.time_range_filter(m.bronze, start(), middle(), ["SYM01", "sym02"], "XNAS").drop("raw_event"),
    "event_date_filter": lambda m: reports.event_date_filter(m.bronze, DAY).drop("raw_event"),
    "silver_trades": lambda m: m.trades,
    "silver_quotes": lambda m: m.quotes,
    "sequence_gaps": lambda m: m.gaps,
    "sequence_track": lambda m: silver.sequence_track(m.bronze, hot=m.hot),
    "bars_1s": lambda m: m.bars,
    "spread_features": lambda m: m.spreads,
    "volatility_features": lambda m: gold.volatility_features(m.bars),
    "quality_annotations": lambda m: m.annotations,
    "quality_summary": lambda m: gold.quality_summary(m.annotations),
    "gold_scan": lambda m: gold.gold_scan(m.bars, "sym05", DAY, DAY),
    "research_features": lambda m: m.features,
    "signal_frame": lambda m: gold.signal_frame(m.features, hot=m.hot),
    "bar_updates": lambda m: live.bar_updates(m.trade_rows, hot=m.hot_seconds),
    "rolling_metrics": lambda m: live.rolling_metrics(m.trade_rows, hot=m.hot),
    "latest_state": _latest_state,
    "active_symbols": lambda m: live.active_symbols(m.quote_rows, m.trade_rows, m.alerts),
    "alert_stream_union": lambda m: m.alerts,
    "recent_alerts": lambda m: live.recent_alerts(m.alerts, as_of=end()),
    "symbol_snapshot": _snapshot,
    "stale_alerts": lambda m: staleness.stale_alerts(m.quote_rows, start(), end()),
    "freshness_breach": lambda m: staleness.freshness_breach(m.quote_rows, start(), at(f"{DAY} 00:31:00"), hold_ticks=HOLD_TICKS),
    "freshness_check": _freshness_check,
    "quality_report": lambda m: reports.quality_report(m.settled().tables, None, market.RUN_ID, market.processed_at()),
    "table_conformance": lambda m: _conformance(m.settled()),
    "replay_dry_run": lambda m: reports.replay_dry_run(m.bronze, DAY),
    "replay_estimate": lambda m: reports.replay_estimate(m.bronze, start(), middle(), ["sym01", "SYM07"]),
    "feed_event_rate": lambda m: reports.feed_event_rate(m.bronze),
    "gap_counts": lambda m: reports.gap_counts(m.gaps),
    "live_vs_replay_bars": lambda m: m.differences,
    "divergence_counts_bars": lambda m: reports.divergence_counts(m.differences),
    "gap_evidence": lambda m: reports.gap_evidence(m.gaps, m.tracked, start(), end()),
    "lineage_trace": lambda m: reports.lineage_trace(m.bars, m.trades, m.bronze),
    "lineage_trace_spreads": lambda m: reports.lineage_trace(m.spreads, m.quotes, m.bronze),
    "tool_call_errors": lambda m: reports.tool_call_errors(documents.audit_log(m.spark, m.sf_dir)),
    "latency_summary": lambda m: reports.latency_summary(documents.audit_log(m.spark, m.sf_dir), ["tool_name"], "latency_ms", "timestamp"),
    "frontmatter": lambda m: text.frontmatter(documents.notes(m.spark, m.sf_dir), "docs").select(
        "source_uri", "title", "tags", "source_type", F.md5("body").alias("body_md5")
    ),
    "chunk_documents": lambda m: _chunk_view(documents.note_chunks(m.spark, m.sf_dir)),
    "chunk_pages": lambda m: _chunk_view(documents.page_chunks(m.spark, m.sf_dir)),
    "hashed_embedding": _hashed,
    "cosine_pairs": _pairs,
    "vector_topk": lambda m: _found(vectors.vector_topk(_evidence(m), _searches(m))),
    "vector_topk_postings": lambda m: _found(
        postings.PostingIndex.save(vectors.with_embedding(documents.note_chunks(m.spark, m.sf_dir)), scratch_path(m.spark, "postings")).search(_searches(m))
    ),
    "incident_summary": lambda m: vectors.incident_summary(_evidence(m), INCIDENTS),
}


# The forms for keys too large for a task, whatever the size of the tables.
BATCH |= {
    "sequence_gaps_tiled": lambda m: silver.sequence_gaps(m.bronze, hot=True),
    "sequence_track_tiled": lambda m: silver.sequence_track(m.bronze, hot=True),
    "rolling_metrics_tiled": lambda m: live.rolling_metrics(m.trade_rows, hot=True),
    "bar_updates_tiled": lambda m: live.bar_updates(m.trade_rows, hot=True),
    "signal_frame_tiled": lambda m: gold.signal_frame(m.features, hot=True),
    "symbol_resolution_tiled": lambda m: vendor.symbol_resolution(m.records, hot=True).select("record_id", "instrument_id", "resolved_symbol"),
}


def _routed(m: Market) -> DataFrame:
    parts = [rows.groupBy("symbol").count().select(F.lit(name).alias("route"), "symbol", F.col("count").alias("event_count")) for name, rows in bronze_ops.event_router(m.bronze).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _dealt(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the tasks, whatever keys they were brought together by."""
    return df.repartition(*df.columns)


def _violations(m: Market) -> DataFrame:
    """Every message against the contract of its own type; some of each type break it.

    Events are numbered once, and rows leave the few tasks of their symbols before they become JSON.
    """
    place = scratch_path(m.spark, "violations")
    events = written(_dealt(market.market_events(m.spark, m.sf_dir, m.hot, m.squeeze)), f"{place}/events")
    bronze = written(market.decoded(market.typed(events)), f"{place}/bronze")
    needed = ["schema_version", *live.EVENT, *live.SOURCE]
    trades = written(silver.trade_rows(bronze).select(*needed, "price", "size"), f"{place}/trades")
    typed = market.unchecked(events)
    sent = {
        "trade": typed.where(F.col("topic") == contracts.TRADES_TOPIC),
        "quote": typed.where(F.col("topic") == contracts.QUOTES_TOPIC),
        "quality_alert": typed.where(F.col("topic") == contracts.ALERTS_TOPIC),
    }
    faulty = F.col("source_offset") % 59 == 0
    derived = {
        "top_of_book": live.top_of_book(silver.quote_rows(bronze), market.processed_at()),
        "bar_1s": _dealt(live.bar_updates(trades, hot=m.hot_seconds)),
        "rolling_metrics": _dealt(live.rolling_metrics(trades, hot=m.hot)),
        "market": trades.withColumn("event_type", F.when(faulty, "rumour").otherwise("trade")).select(
            "schema_version", "event_type", *live.EVENT, F.struct("price", "size").alias("payload"), *live.SOURCE
        ),
    }
    for name, rows in derived.items():
        fields = [c for c in rows.columns if c not in live.SOURCE]
        if name != "market":
            rows = rows.withColumn("sequence_number", F.when(faulty, -1).otherwise(F.col("sequence_number")))
        sent[name] = topics.as_messages(rows, name, fields)
    parts = [
        checks.contract_violations(messages, name).select(F.lit(name).alias("contract"), "partition", "offset", "violations")
        for name, messages in sent.items()
    ]
    return reduce(DataFrame.unionByName, parts)


SEVERAL_DAYS = (
    "event_date_filter",
    "gold_scan",
    "volatility_features",
    "replay_dry_run",
    "gap_counts",
    "divergence_counts_bars",
    "table_overwrite",
    "replay_output",
)
"""Queries over three days instead of three dense minutes."""
HALF_AN_HOUR = ("freshness_breach",)
"""Queries over half an hour, in which symbols can be stale for minutes."""


def query(build: Callable[[Market], DataFrame], squeeze: int = market.DENSE) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return presented(build(Market(spark, sf_dir, squeeze)))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tickforge.plans.stored import STORED

    scale = {**dict.fromkeys(SEVERAL_DAYS, market.WIDE), **dict.fromkeys(HALF_AN_HOUR, market.HALF_HOUR)}
    return {name: query(build, scale.get(name, market.DENSE)) for name, build in {**BATCH, **STORED}.items()}
