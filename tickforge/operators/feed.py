"""Raw feed: validation, canonical trades and quotes, and feed alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickforge.contracts import FEED_SCHEMA, MISSING_MESSAGE, REQUIRED_FEED_FIELDS, UNSUPPORTED_MESSAGE
from tickforge.functions.columns import parse_utc, version

ALERT_COLUMNS = [
    "schema_version",
    "event_type",
    "symbol",
    "exchange",
    "event_time",
    "ingest_time",
    "sequence_number",
    "alert_type",
    "severity",
    "message",
    "observed_sequence",
    "expected_sequence",
]
COMMON_COLUMNS = ["schema_version", "event_type", "symbol", "exchange", "event_time", "ingest_time", "sequence_number"]
TRADE_COLUMNS = [*COMMON_COLUMNS, "price", "size", "trade_id", "conditions"]
QUOTE_COLUMNS = [*COMMON_COLUMNS, "bid_price", "bid_size", "ask_price", "ask_size"]
FEED_SOURCE = ["topic", "partition", "offset"]


def _quoted(name: Column) -> Column:
    return F.concat(F.lit("'"), name, F.lit("'"))


def _missing(event_type: str) -> Column:
    required = F.array(*[F.lit(name) for name in sorted(REQUIRED_FEED_FIELDS[event_type])])
    return F.array_except(required, F.col("present"))


def _unreadable(event_type: str) -> Column:
    """First field that is there but does not convert."""
    names = [name for name in REQUIRED_FEED_FIELDS[event_type] if name != "event_type"]
    value = {name: F.col(f"raw.{name}") for name in names}
    value["event_time"] = parse_utc("raw.event_time")
    bad = [F.when(value[name].isNull(), F.concat(F.lit("Invalid value for "), F.lit(name))) for name in sorted(names)]
    return F.coalesce(*bad)


def feed_checked(messages: DataFrame) -> DataFrame:
    """Parse each message once and add ``error``: NULL for a usable event."""
    parsed = messages.select(
        *FEED_SOURCE,
        F.col("timestamp").alias("ingest_time"),
        F.explode(
            F.array(
                F.struct(
                    F.from_json("value", FEED_SCHEMA).alias("raw"),
                    F.json_object_keys("value").alias("present"),
                )
            )
        ).alias("parsed"),
    ).select(*FEED_SOURCE, "ingest_time", "parsed.*")
    kind = F.col("raw.event_type")
    supported = kind.isin(*REQUIRED_FEED_FIELDS)
    missing = F.when(kind == "trade", _missing("trade")).otherwise(_missing("quote"))
    unreadable = F.when(kind == "trade", _unreadable("trade")).otherwise(_unreadable("quote"))
    listed = F.array_join(F.transform(missing, _quoted), ", ")
    error = (
        F.when(F.col("present").isNull(), "Malformed JSON")
        .when(kind.isNull(), UNSUPPORTED_MESSAGE % None)
        .when(~supported, F.format_string(UNSUPPORTED_MESSAGE, _quoted(kind)))
        .when(F.size(missing) > 0, F.format_string(MISSING_MESSAGE, listed))
        .otherwise(unreadable)
    )
    return parsed.withColumn("error", error)


def feed_validation(messages: DataFrame) -> DataFrame:
    """A critical alert for each message the feed handler rejects."""
    return validation_alerts(feed_checked(messages))


def validation_alerts(checked: DataFrame) -> DataFrame:
    rejected = checked.where("error IS NOT NULL").select(
        F.coalesce("raw.symbol", F.lit("UNKNOWN")).alias("symbol"),
        F.coalesce("raw.exchange", F.lit("UNKNOWN")).alias("exchange"),
        F.col("ingest_time").alias("event_time"),
        F.lit("feed_validation_error").alias("alert_type"),
        F.lit("critical").alias("severity"),
        F.col("error").alias("message"),
        F.col("raw.sequence_number").alias("observed_sequence"),
        F.lit(None).cast("long").alias("expected_sequence"),
        *FEED_SOURCE,
    )
    return quality_alert_rows(rejected, FEED_SOURCE)


def quality_alert_rows(fields: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Complete alert events from symbol, exchange, time, type, severity and message."""
    return fields.select(
        version().alias("schema_version"),
        F.lit("quality_alert").alias("event_type"),
        F.upper("symbol").alias("symbol"),
        "exchange",
        "event_time",
        F.col("event_time").alias("ingest_time"),
        F.coalesce("observed_sequence", F.lit(0)).cast("long").alias("sequence_number"),
        "alert_type",
        "severity",
        "message",
        F.col("observed_sequence").cast("long").alias("observed_sequence"),
        F.col("expected_sequence").cast("long").alias("expected_sequence"),
        *(keep or []),
    )


def stable_id(*parts: str) -> Column:
    """Identifier that a replay of the same message reproduces."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def _canonical(checked: DataFrame, event_type: str) -> DataFrame:
    return checked.where(F.col("error").isNull() & (F.col("raw.event_type") == event_type)).select(
        version().alias("schema_version"),
        F.lit(event_type).alias("event_type"),
        F.upper("raw.symbol").alias("symbol"),
        "raw.exchange",
        parse_utc("raw.event_time").alias("event_time"),
        "ingest_time",
        "raw.sequence_number",
        F.struct("raw.*").alias("raw"),
        *FEED_SOURCE,
    )


def canonical_trades(checked: DataFrame) -> DataFrame:
    default_id = stable_id("symbol", "exchange", "sequence_number", "raw.event_time", "offset")
    return _canonical(checked, "trade").select(
        *COMMON_COLUMNS,
        "raw.price",
        "raw.size",
        F.coalesce(F.when(F.col("raw.trade_id") != "", F.col("raw.trade_id")), default_id).alias("trade_id"),
        F.coalesce("raw.conditions", F.array().cast("array<string>")).alias("conditions"),
        *FEED_SOURCE,
    )


def canonical_quotes(checked: DataFrame) -> DataFrame:
    fields = [F.col(f"raw.{name}") for name in ("bid_price", "bid_size", "ask_price", "ask_size")]
    return _canonical(checked, "quote").select(*COMMON_COLUMNS, *fields, *FEED_SOURCE)
