"""The given ``events`` table read as market data.

24 keys (12 symbols on two exchanges), about 180 seconds, or three days with the wide time
scale. Purchases and clicks are
trades, views and signups quotes, errors quality alerts. Some events come twice, some
come late, some sequence numbers are skipped, and the raw feed has faulty messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickforge.contracts import ALERTS_TOPIC, FEED_SCHEMA, MESSAGE_SCHEMA, QUOTES_TOPIC, RAW_FEED_TOPIC, TRADES_TOPIC
from tickforge.functions.columns import ISO_FORMAT
from tickforge.functions.scans import Running, running
from tickforge.operators.bronze import bronze_rows
from tickforge.session import use_utc

RUN_ID = "run-1"
PROCESSED_AT = "2024-02-01 00:00:00"
MESSAGE_COLUMNS = MESSAGE_SCHEMA.fieldNames()
LATE_OFFSET = 1602
DENSE, HALF_HOUR, WIDE = 14400, 1440, 10
"""By how much event times are squeezed: 30 days into 180 seconds, half an hour or 3 days."""


# The columns of the given tables, so that no job infers them.
TABLE_COLUMNS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.schema(TABLE_COLUMNS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def processed_at() -> Column:
    return F.lit(PROCESSED_AT).cast("timestamp")


def market_events(spark: SparkSession, sf_dir: str, hot: bool | None = None, squeeze: int = DENSE) -> DataFrame:
    based = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "concat('SYM', lpad(cast(user_id % 12 AS string), 2, '0')) AS symbol",
        "CASE WHEN (user_id div 12) % 2 = 0 THEN 'XNAS' ELSE 'XNYS' END AS exchange",
        f"timestamp_micros(1704067200000000 + (unix_micros(CAST(ts AS timestamp)) - 1704067200000000) div {squeeze}) AS event_time",
        """CASE WHEN event_type IN ('purchase', 'click') THEN 'trade'
                WHEN event_type IN ('view', 'signup') THEN 'quote' ELSE 'quality_alert' END AS event_type""",
        "value",
        "CAST(get_json_object(props, '$.k') AS bigint) AS k",
        "user_id % 4 AS partition",
    )
    market = F.col("event_type") != "quality_alert"
    skip = market & (F.col("event_id") % 37 == 0)
    counts = {
        "_n": Running("sum", F.when(market, 1).otherwise(0).cast("long")),
        "_skipped": Running("sum", F.when(skip, 1).otherwise(0).cast("long")),
    }
    numbered = running(based, ["symbol", "exchange"], ["event_id"], counts, hot)
    return numbered.withColumn(
        "sequence_number", F.when(market, F.col("_n") + F.col("_skipped")).otherwise(F.lit(0).cast("long"))
    ).drop("_n", "_skipped")


def arrivals(events: DataFrame) -> DataFrame:
    """Each event once or twice, with offset, arrival time and a price step on copies."""
    late = "event_id % 41 = 0"
    copies = f"""
        explode(filter(array(
            named_struct('offset', event_id * 4 + IF({late}, {LATE_OFFSET}, 0),
                         'delay_us', IF({late}, 7005000L, 5000L), 'step', 0D),
            IF(event_id % 53 = 0,
               named_struct('offset', event_id * 4 + 1, 'delay_us', 9000L, 'step', 0.5D), NULL)
        ), c -> c IS NOT NULL)) AS copy"""
    return events.selectExpr("*", copies).selectExpr(
        *events.columns,
        "copy.offset AS offset",
        "timestamp_micros(unix_micros(event_time) + copy.delay_us) AS ingest_time",
        "100 + value + copy.step AS base_price",
    )


# JSON fields of each event; a NULL is left out of the text.
FIELDS = {
    "schema_version": "'1.0'",
    "event_type": "event_type",
    "symbol": "symbol",
    "exchange": "exchange",
    "event_time": f"date_format(event_time, \"{ISO_FORMAT}\")",
    "ingest_time": f"date_format(ingest_time, \"{ISO_FORMAT}\")",
    "sequence_number": "sequence_number",
    "price": "IF(event_type = 'trade', base_price, NULL)",
    "size": "IF(event_type = 'trade', k + 1, NULL)",
    "trade_id": "IF(event_type = 'trade' AND k % 5 <> 0, concat('T', event_id), NULL)",
    "conditions": "IF(event_type = 'trade' AND k % 3 = 0, array('odd', 'lot'), NULL)",
    "bid_price": "IF(event_type = 'quote', base_price, NULL)",
    "bid_size": "IF(event_type = 'quote', k, NULL)",
    "ask_price": "IF(event_type = 'quote', base_price + (k - 5) / 100, NULL)",
    "ask_size": "IF(event_type = 'quote', k + 2, NULL)",
    "alert_type": "IF(event_type = 'quality_alert', element_at(array('stale_symbol', 'wide_spread', 'crossed_market'), int(k % 3 + 1)), NULL)",
    "severity": "IF(event_type = 'quality_alert', IF(k % 3 = 2, 'critical', 'warning'), NULL)",
    "message": "IF(event_type = 'quality_alert', concat('Alert with level ', k, '.'), NULL)",
}
TYPED_TOPIC = f"CASE event_type WHEN 'trade' THEN '{TRADES_TOPIC}' WHEN 'quote' THEN '{QUOTES_TOPIC}' ELSE '{ALERTS_TOPIC}' END"


def _messages(rows: DataFrame, fields: dict[str, str], topic: str) -> DataFrame:
    pairs = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    return rows.selectExpr(
        "symbol AS key",
        f"to_json(named_struct({pairs})) AS value",
        f"{topic} AS topic",
        "partition",
        "offset",
        "ingest_time AS timestamp",
        "event_id",
    )


def typed_messages(spark: SparkSession, sf_dir: str, hot: bool | None = None, squeeze: int = DENSE) -> DataFrame:
    """Canonical messages on the trade, quote and alert topics."""
    return typed(market_events(spark, sf_dir, hot, squeeze))


def typed(events: DataFrame) -> DataFrame:
    return _messages(arrivals(events), FIELDS, TYPED_TOPIC).drop("event_id")


def _broken(messages: DataFrame) -> DataFrame:
    """Cut every 43rd message short, so that it is no JSON."""
    short = "IF(event_id % 43 = 0, substring(value, 1, 25), value) AS value"
    return messages.selectExpr(*[short if name == "value" else name for name in MESSAGE_COLUMNS])


def unchecked_messages(spark: SparkSession, sf_dir: str, hot: bool | None = None) -> DataFrame:
    """Typed messages of which some are cut short and some lack a version."""
    return unchecked(market_events(spark, sf_dir, hot))


def unchecked(events: DataFrame) -> DataFrame:
    fields = {**FIELDS, "schema_version": "IF(event_id % 47 <> 0, '1.0', NULL)"}
    return _broken(_messages(arrivals(events), fields, TYPED_TOPIC))


def feed_messages(spark: SparkSession, sf_dir: str, hot: bool | None = None) -> DataFrame:
    """The raw feed: trades and quotes in lower case, some of them faulty."""
    rows = arrivals(market_events(spark, sf_dir, hot)).where("event_type <> 'quality_alert'")
    fields = {name: FIELDS[name] for name in FEED_SCHEMA.fieldNames()}
    for name in ("price", "bid_price", "ask_size"):
        fields[name] = f"IF(event_id % 31 <> 0, {fields[name]}, NULL)"
    fields["symbol"] = "lower(symbol)"
    fields["event_type"] = "IF(event_id % 29 = 0, 'halt', event_type)"
    return _broken(_messages(rows, fields, f"'{RAW_FEED_TOPIC}'"))


def bronze(spark: SparkSession, sf_dir: str, hot: bool | None = None, squeeze: int = DENSE) -> DataFrame:
    return decoded(typed_messages(spark, sf_dir, hot, squeeze))


def decoded(messages: DataFrame) -> DataFrame:
    return bronze_rows(messages, RUN_ID, processed_at())


def vendor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as vendor records of twelve instruments: errors are symbol mappings,
    purchases bare trades, the rest books, of which clicks also traded."""
    events = table(spark, sf_dir, "events")
    mapping, bare = "event_type = 'error'", "event_type = 'purchase'"
    return events.withColumn("k", F.expr("CAST(get_json_object(props, '$.k') AS bigint)")).selectExpr(
        "event_id AS record_id",
        f"""CASE WHEN {mapping} THEN 'SymbolMappingMsg' WHEN {bare} THEN 'TradeMsg'
                 WHEN event_type = 'signup' THEN 'BBOMsg' ELSE 'MBP1Msg' END AS record_type""",
        "IF(user_id % 50 = 49, NULL, 100 + user_id % 12) AS instrument_id",
        "unix_micros(CAST(ts AS timestamp)) * 1000 + 789 AS ts_event",
        "IF(k % 11 = 0, NULL, event_id + 1) AS sequence",
        f"IF({mapping} OR k % 13 = 0, NULL, value) AS pretty_price",
        f"IF({mapping}, NULL, k + 1) AS size",
        "CASE WHEN event_type IN ('click', 'purchase') THEN 'T' WHEN event_type = 'view' THEN 'A' END AS action",
        "CASE k % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' END AS side",
        f"""IF({mapping} OR {bare}, NULL, array(named_struct(
                'pretty_bid_px', value - 5, 'pretty_ask_px', value + 0.25D, 'bid_sz', k, 'ask_sz', k + 2))) AS levels""",
        "CAST(NULL AS string) AS symbol",
        f"IF({mapping} OR k % 7 <> 0, NULL, concat('RAW', k)) AS raw_symbol",
        f"IF({mapping} AND k % 5 <> 0, concat('IN', k % 4), NULL) AS stype_in_symbol",
        f"IF({mapping}, IF(k % 2 = 0, cast(1000 + k AS string), concat('OUT', k)), NULL) AS stype_out_symbol",
    )
