"""Small frames of events for the tests."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tickforge.contracts import ALERTS_TOPIC, MESSAGE_SCHEMA, QUOTES_TOPIC, TRADES_TOPIC
from tickforge.operators.bronze import bronze_rows

TOPICS = {"trade": TRADES_TOPIC, "quote": QUOTES_TOPIC, "quality_alert": ALERTS_TOPIC}


def processed():
    return F.lit("2026-05-07 00:00:01").cast("timestamp")


def event(kind, sequence, time, **fields):
    base = {
        "schema_version": "1.0",
        "event_type": kind,
        "symbol": fields.pop("symbol", "AAPL"),
        "exchange": fields.pop("exchange", "XNAS"),
        "event_time": time,
        "ingest_time": fields.pop("ingest_time", time),
        "sequence_number": sequence,
    }
    return {**base, **fields}


def trade(sequence, time, price, size, trade_id=None, **fields):
    return event("trade", sequence, time, price=price, size=size, trade_id=trade_id or f"t{sequence}", **fields)


def quote(sequence, time, bid, ask, **fields):
    return event("quote", sequence, time, bid_price=bid, bid_size=100, ask_price=ask, ask_size=200, **fields)


def alert(sequence, time, alert_type, severity="warning", **fields):
    return event(
        "quality_alert", sequence, time, alert_type=alert_type, severity=severity,
        message="Spread exceeded configured threshold.", observed_sequence=sequence, expected_sequence=None, **fields,
    )


def messages(spark, values, topic=None):
    """Messages with offsets 1, 2, ... in the given order."""
    rows = []
    for offset, value in enumerate(values, 1):
        text = value if isinstance(value, str) else json.dumps(value)
        kind = None if isinstance(value, str) else value.get("event_type")
        stamp = dt.datetime(2026, 5, 7, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=offset)
        rows.append((None, text, topic or TOPICS.get(kind, TRADES_TOPIC), 0, offset, stamp))
    return spark.createDataFrame(rows, MESSAGE_SCHEMA)


def bronze_of(spark, values):
    return bronze_rows(messages(spark, values), "test-run", processed())


def rows_of(df):
    return sorted((tuple(str(v) for v in row) for row in df.select(*sorted(df.columns)).collect()))
