"""Vendor records: symbol mapping over time, and conversion to raw feed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickforge.functions.columns import is_digits, nanos_to_timestamp
from tickforge.functions.scans import Running, running
from tickforge.operators.feed import stable_id

LEVEL = T.StructType(
    [
        T.StructField("pretty_bid_px", T.DoubleType()),
        T.StructField("pretty_ask_px", T.DoubleType()),
        T.StructField("bid_sz", T.LongType()),
        T.StructField("ask_sz", T.LongType()),
    ]
)

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("instrument_id", T.LongType()),
        T.StructField("ts_event", T.LongType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("pretty_price", T.DoubleType()),
        T.StructField("size", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("levels", T.ArrayType(LEVEL)),
        T.StructField("symbol", T.StringType()),
        T.StructField("raw_symbol", T.StringType()),
        T.StructField("stype_in_symbol", T.StringType()),
        T.StructField("stype_out_symbol", T.StringType()),
    ]
)

# Record types that carry a book, and the type of a bare trade.
BOOK_TYPES = "mbp1|bbo"
TRADE_TYPE = "trademsg"


def _filled(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name))


def is_mapping() -> Column:
    named = F.coalesce(_filled("stype_in_symbol"), _filled("stype_out_symbol")).isNotNull()
    return F.col("instrument_id").isNotNull() & named


def offered_mapping() -> Column:
    """The symbol that a mapping record gives its instrument, NULL for other records."""
    mapped = F.when(
        _filled("stype_in_symbol").isNotNull() & F.coalesce(is_digits("stype_out_symbol"), F.lit(False)),
        F.col("stype_in_symbol"),
    ).otherwise(F.coalesce("stype_out_symbol", F.lit("None")))
    return F.when(is_mapping(), mapped)


def resolved_symbol(mapped: str) -> Column:
    """The mapping in force, else the record's own names, else a name made from the instrument id."""
    fallback = F.when(F.col("instrument_id").isNotNull(), F.concat(F.lit("INSTRUMENT_"), F.col("instrument_id").cast("string")))
    names = [_filled(name) for name in ("symbol", "raw_symbol", "stype_in_symbol", "stype_out_symbol")]
    return F.coalesce(mapped, *names, fallback, F.lit("UNKNOWN"))


def symbol_resolution(records: DataFrame, order: tuple[str, ...] = ("ts_event", "record_id"), hot: bool | None = None) -> DataFrame:
    """Add ``resolved_symbol``: the latest mapping seen before the record, else its own names."""
    offered = records.withColumn("_mapping", offered_mapping())
    latest = {"_mapped": Running("last", F.col("_mapping"))}
    scanned = running(offered, ["instrument_id"], list(order), latest, hot)
    return scanned.withColumn("resolved_symbol", resolved_symbol("_mapped")).drop("_mapping", "_mapped")


def _event(event_type: str, exchange: str) -> list[Column]:
    return [
        F.lit(event_type).alias("event_type"),
        F.col("resolved_symbol").alias("symbol"),
        F.lit(exchange).alias("exchange"),
        nanos_to_timestamp("ts_event").alias("event_time"),
        F.coalesce("sequence", F.lit(0)).cast("long").alias("sequence_number"),
    ]


def vendor_quotes(resolved: DataFrame, exchange: str) -> DataFrame:
    """Quotes from the first level of book records with positive prices."""
    kind = F.lower("record_type")
    top = F.get("levels", F.lit(0))
    return (
        resolved.where(~is_mapping() & kind.rlike(BOOK_TYPES) & F.col("ts_event").isNotNull())
        .withColumn("top", top)
        .where("top.pretty_bid_px > 0 AND top.pretty_ask_px > 0 AND top.bid_sz IS NOT NULL AND top.ask_sz IS NOT NULL")
        .select(
            *_event("quote", exchange),
            F.col("top.pretty_bid_px").alias("bid_price"),
            F.col("top.bid_sz").alias("bid_size"),
            F.col("top.pretty_ask_px").alias("ask_price"),
            F.col("top.ask_sz").alias("ask_size"),
            "record_id",
        )
    )


def vendor_trades(resolved: DataFrame, exchange: str) -> DataFrame:
    """Trades from trade records and from any record whose action is a trade."""
    kind = F.lower("record_type")
    complete = F.col("pretty_price").isNotNull() & F.col("size").isNotNull() & F.col("ts_event").isNotNull()
    traded = kind.contains(TRADE_TYPE) | F.coalesce(F.col("action") == "T", F.lit(False))
    return resolved.where(~is_mapping() & traded & complete).select(
        *_event("trade", exchange),
        F.col("pretty_price").alias("price"),
        "size",
        stable_id("record_id", "instrument_id", "ts_event").alias("trade_id"),
        F.array(
            F.coalesce("side", F.lit("")), F.concat(F.lit("action="), F.coalesce("action", F.lit("")))
        ).alias("conditions"),
        "record_id",
    )


def vendor_events(records: DataFrame, exchange: str, hot: bool | None = None) -> DataFrame:
    """Quotes and trades in one frame; a record that gives both keeps quote first."""
    resolved = symbol_resolution(records, hot=hot)
    quotes = vendor_quotes(resolved, exchange).withColumn("part", F.lit(0))
    trades = vendor_trades(resolved, exchange).withColumn("part", F.lit(1))
    return quotes.unionByName(trades, allowMissingColumns=True)
