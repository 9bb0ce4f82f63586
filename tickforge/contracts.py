"""Event and table contracts, topic names and thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- Fixed values: names, thresholds and enums that results depend on -------------

SCHEMA_VERSION = "1.0"

RAW_FEED_TOPIC = "feed.synthetic.raw.v1"
RAW_TOPIC = "market.raw.v1"
TRADES_TOPIC = "market.trades.v1"
QUOTES_TOPIC = "market.quotes.v1"
TOP_OF_BOOK_TOPIC = "market.state.top_of_book.v1"
BARS_TOPIC = "market.bars.1s.v1"
METRICS_TOPIC = "market.metrics.rolling.v1"
ALERTS_TOPIC = "market.quality.alerts.v1"

BRONZE_TOPICS = (
    RAW_TOPIC,
    TRADES_TOPIC,
    QUOTES_TOPIC,
    TOP_OF_BOOK_TOPIC,
    BARS_TOPIC,
    METRICS_TOPIC,
    ALERTS_TOPIC,
)
GAP_TOPICS = (TRADES_TOPIC, QUOTES_TOPIC)

ALERT_TYPES = (
    "sequence_gap",
    "duplicate_or_reordered_sequence",
    "feed_validation_error",
    "crossed_market",
    "wide_spread",
    "stale_symbol",
)
SEVERITIES = ("info", "warning", "critical")
ENVELOPE_TYPES = ("trade", "quote", "halt", "imbalance", "sequence_gap", "heartbeat")

STALE_MS = 2000
STATE_TTL_SECONDS = 120
ALERT_TTL_SECONDS = 3600
ALERTS_STORED = 25
ALERTS_IN_SNAPSHOT = 10
ROLLING_PRICES = 120
MIN_WIDE_SPREAD = 0.05
WIDE_SPREAD_SHARE = 0.002
SIGNAL_MAX_SPREAD = 0.05
CHUNK_WORDS = 220
CHUNK_OVERLAP = 30
EMBEDDING_SIZE = 384
TOKEN_PATTERN = r"[A-Za-z0-9_.$:/-]+"
SEARCH_LIMIT = 5
INCIDENT_LIMIT = 6
SUMMARY_CHARS = 280
TIMELINE_CHARS = 240
TIMELINE_ENTRIES = 3

SEQUENCE_GAP_MESSAGE = "Expected sequence %d but received %d."
SEQUENCE_LATE_MESSAGE = "Received sequence %d after %d."
ANNOTATION_MESSAGE = "Expected sequence %d but observed %d."
UNSUPPORTED_MESSAGE = "Unsupported event_type %s"
MISSING_MESSAGE = "Missing required fields: [%s]"
CROSSED_MESSAGE = "Ask price is below bid price."
WIDE_MESSAGE = "Spread %s exceeded configured threshold."
STALE_MESSAGE = "%s freshness lag is %d ms."
FRESHNESS_QUERY = "%s stale freshness redis alert runbook"
INCIDENT_QUERY = "%s incident timeline symptoms runbook alerts"
EVIDENCE_MESSAGE = "Most relevant evidence is from %s: %s"
NO_EVIDENCE_MESSAGE = "No indexed evidence found for this incident."

REQUIRED_FEED_FIELDS = {
    "trade": ("event_type", "symbol", "exchange", "event_time", "sequence_number", "price", "size"),
    "quote": (
        "event_type",
        "symbol",
        "exchange",
        "event_time",
        "sequence_number",
        "bid_price",
        "bid_size",
        "ask_price",
        "ask_size",
    ),
}

# --- Message schemas -----------------------------------------------------------------

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

ENVELOPE_SCHEMA = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("exchange", T.StringType()),
        T.StructField("event_time", T.StringType()),
        T.StructField("ingest_time", T.StringType()),
        T.StructField("sequence_number", T.LongType()),
    ]
)

TRADE_SCHEMA = T.StructType(
    [
        T.StructField("price", T.DoubleType()),
        T.StructField("size", T.LongType()),
        T.StructField("trade_id", T.StringType()),
        T.StructField("conditions", T.ArrayType(T.StringType())),
    ]
)

QUOTE_SCHEMA = T.StructType(
    [
        T.StructField("bid_price", T.DoubleType()),
        T.StructField("bid_size", T.LongType()),
        T.StructField("ask_price", T.DoubleType()),
        T.StructField("ask_size", T.LongType()),
    ]
)

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("alert_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("observed_sequence", T.LongType()),
        T.StructField("expected_sequence", T.LongType()),
    ]
)

FEED_SCHEMA = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("exchange", T.StringType()),
        T.StructField("event_time", T.StringType()),
        T.StructField("sequence_number", T.LongType()),
        *TRADE_SCHEMA.fields,
        *QUOTE_SCHEMA.fields,
    ]
)

# --- Event contracts -----------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # string, time, integer, number, object, strings
    required: bool = True
    at_least: float | None = None
    above: float | None = None
    one_of: tuple[str, ...] = ()
    nullable: bool = False


def _event(event_types: tuple[str, ...], *extra: Field) -> tuple[Field, ...]:
    return (
        Field("schema_version", "string", one_of=(SCHEMA_VERSION,)),
        Field("event_type", "string", one_of=event_types),
        Field("symbol", "string"),
        Field("exchange", "string"),
        Field("event_time", "time"),
        Field("ingest_time", "time"),
        Field("sequence_number", "integer", at_least=0),
        *extra,
    )


_QUOTE_FIELDS = (
    Field("bid_price", "number", above=0),
    Field("bid_size", "integer", at_least=0),
    Field("ask_price", "number", above=0),
    Field("ask_size", "integer", at_least=0),
)

EVENT_CONTRACTS: dict[str, tuple[Field, ...]] = {
    "trade": _event(
        ("trade",),
        Field("price", "number", above=0),
        Field("size", "integer", above=0),
        Field("trade_id", "string", required=False),
        Field("conditions", "strings", required=False),
    ),
    "quote": _event(("quote",), *_QUOTE_FIELDS),
    "top_of_book": _event(
        ("top_of_book",),
        Field("processed_time", "time"),
        *_QUOTE_FIELDS,
        Field("spread", "number"),
        Field("mid_price", "number", above=0),
    ),
    "bar_1s": _event(
        ("bar_1s",),
        *(Field(name, "number", above=0) for name in ("open", "high", "low", "close")),
        Field("volume", "integer", at_least=0),
        Field("vwap", "number", above=0),
    ),
    "rolling_metrics": _event(
        ("rolling_metrics",),
        Field("sample_count", "integer", at_least=0),
        Field("rolling_volume", "integer", at_least=0),
        Field("rolling_vwap", "number", above=0),
        Field("volatility_bps", "number", at_least=0),
    ),
    "quality_alert": _event(
        ("quality_alert",),
        Field("alert_type", "string", one_of=ALERT_TYPES),
        Field("severity", "string", one_of=SEVERITIES),
        Field("message", "string"),
        Field("observed_sequence", "integer", required=False, nullable=True),
        Field("expected_sequence", "integer", required=False, nullable=True),
    ),
    "market": _event(ENVELOPE_TYPES, Field("payload", "object", required=False)),
}

# --- Table contracts -----------------------------------------------------------------

SOURCE_COLUMNS = ("source_topic", "source_partition", "source_offset")
RUN_COLUMNS = ("job_run_id", "processed_at")
LINEAGE_COLUMNS = (
    "schema_version",
    "symbol",
    "exchange",
    "event_time",
    "ingest_time",
    "sequence_number",
    "event_date",
    *SOURCE_COLUMNS,
    *RUN_COLUMNS,
)
RANGE_COLUMNS = ("first_sequence", "last_sequence", "first_source_offset", "last_source_offset")


@dataclass(frozen=True)
class TableContract:
    zone: str
    grain: str
    partition_columns: tuple[str, ...]
    required_columns: tuple[str, ...]
    upstream: tuple[str, ...]


# Zone, grain, partition columns, columns and upstream tables of each table.
TABLE_CONTRACTS: dict[str, TableContract] = {
    "bronze_market_events": TableContract(
        "bronze",
        "one canonical event",
        ("event_date", "event_type"),
        ("event_type", *LINEAGE_COLUMNS, "raw_event"),
        (),
    ),
    "silver_trades": TableContract(
        "silver",
        "one deduplicated trade",
        ("event_date",),
        (*LINEAGE_COLUMNS, "trade_id", "price", "size", "conditions"),
        ("bronze_market_events",),
    ),
    "silver_quotes": TableContract(
        "silver",
        "one deduplicated quote",
        ("event_date",),
        (*LINEAGE_COLUMNS, "bid_price", "bid_size", "ask_price", "ask_size", "spread", "mid_price"),
        ("bronze_market_events",),
    ),
    "silver_sequence_gaps": TableContract(
        "silver",
        "one sequence anomaly",
        ("event_date",),
        (
            "schema_version",
            "symbol",
            "exchange",
            "event_time",
            "event_date",
            "alert_type",
            "expected_sequence",
            "observed_sequence",
            *SOURCE_COLUMNS,
            *RUN_COLUMNS,
        ),
        ("bronze_market_events",),
    ),
    "gold_bars_1s": TableContract(
        "gold",
        "symbol, exchange, second",
        ("event_date",),
        (
            "schema_version",
            "symbol",
            "exchange",
            "window_start",
            "event_date",
            "open",
            "high",
            "low",
            "close",
            "volume",
            "vwap",
            "trade_count",
            *RANGE_COLUMNS,
            *RUN_COLUMNS,
        ),
        ("silver_trades",),
    ),
    "gold_spread_features": TableContract(
        "gold",
        "symbol, exchange, second",
        ("event_date",),
        (
            "schema_version",
            "symbol",
            "exchange",
            "window_start",
            "event_date",
            "quote_count",
            "min_spread",
            "max_spread",
            "avg_spread",
            "avg_mid_price",
            *RANGE_COLUMNS,
            *RUN_COLUMNS,
        ),
        ("silver_quotes",),
    ),
    "gold_volatility_features": TableContract(
        "gold",
        "symbol, exchange, day",
        ("event_date",),
        (
            "schema_version",
            "symbol",
            "exchange",
            "event_date",
            "bar_count",
            "return_count",
            "volatility_bps",
            "first_window_start",
            "last_window_start",
            *RUN_COLUMNS,
        ),
        ("gold_bars_1s",),
    ),
    "gold_quality_annotations": TableContract(
        "gold",
        "one quality annotation",
        ("event_date",),
        (
            "schema_version",
            "symbol",
            "exchange",
            "event_time",
            "event_date",
            "annotation_type",
            "severity",
            "message",
            "source_table",
            *SOURCE_COLUMNS,
            *RUN_COLUMNS,
        ),
        ("bronze_market_events", "silver_sequence_gaps"),
    ),
}
