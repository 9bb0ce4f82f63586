"""Live state: top of book, bars in progress, rolling metrics, freshness, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickforge.contracts import (
    ALERT_TTL_SECONDS,
    ALERTS_IN_SNAPSHOT,
    ALERTS_STORED,
    CROSSED_MESSAGE,
    MIN_WIDE_SPREAD,
    ROLLING_PRICES,
    STALE_MS,
    STATE_TTL_SECONDS,
    WIDE_MESSAGE,
    WIDE_SPREAD_SHARE,
)
from tickforge.functions.columns import (
    iso_utc,
    lag_ms,
    log_return,
    mid_of,
    notional,
    round6,
    spread_of,
    version,
    weighted_price,
    window_start,
)
from tickforge.functions.ranking import first_rows
from tickforge.functions.scans import Running, is_hot, running, trailing
from tickforge.operators import gold, silver
from tickforge.operators.feed import quality_alert_rows
from tickforge.operators.silver import ARRIVAL

SOURCE = ["source_topic", "source_partition", "source_offset"]
EVENT = ["symbol", "exchange", "event_time", "ingest_time", "sequence_number"]


def top_of_book(quotes: DataFrame, processed_time: Column | None = None) -> DataFrame:
    return quotes.select(
        version().alias("schema_version"),
        F.lit("top_of_book").alias("event_type"),
        *EVENT,
        (F.current_timestamp() if processed_time is None else processed_time).alias("processed_time"),
        "bid_price",
        "bid_size",
        "ask_price",
        "ask_size",
        spread_of("bid_price", "ask_price").alias("spread"),
        mid_of("bid_price", "ask_price").alias("mid_price"),
        *[name for name in SOURCE if name in quotes.columns],
    )


def spread_alerts(quotes: DataFrame) -> DataFrame:
    """Crossed markets, and spreads above the wider of a fixed and a relative bound."""
    spread, mid = spread_of("bid_price", "ask_price"), mid_of("bid_price", "ask_price")
    crossed = F.col("spread") < 0
    wide = F.col("spread") > F.greatest(F.lit(MIN_WIDE_SPREAD), F.col("mid") * WIDE_SPREAD_SHARE)
    fields = (
        quotes.select("symbol", "exchange", F.col("ingest_time").alias("event_time"), "sequence_number", spread.alias("spread"), mid.alias("mid"))
        .where(crossed | wide)
        .select(
            "symbol",
            "exchange",
            "event_time",
            F.when(crossed, "crossed_market").otherwise("wide_spread").alias("alert_type"),
            F.when(crossed, "critical").otherwise("warning").alias("severity"),
            F.when(crossed, CROSSED_MESSAGE)
            .otherwise(F.format_string(WIDE_MESSAGE, F.col("spread").cast("string")))
            .alias("message"),
            F.col("sequence_number").alias("observed_sequence"),
            F.lit(None).cast("long").alias("expected_sequence"),
        )
    )
    return quality_alert_rows(fields)


def freshness(quotes: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Lag of each quote at ``as_of`` and whether that is stale."""
    now = F.current_timestamp() if as_of is None else as_of
    rest = [name for name in ("sequence_number", *SOURCE) if name in quotes.columns]
    return (
        quotes.withColumn("_now", now)
        .withColumn("freshness_lag_ms", lag_ms("event_time", "_now"))
        .select(
            version().alias("schema_version"),
            "symbol",
            "exchange",
            "event_time",
            F.col("ingest_time").alias("last_ingest_time"),
            F.col("_now").alias("last_processed_time"),
            "freshness_lag_ms",
            F.when(F.col("freshness_lag_ms") > STALE_MS, "stale").otherwise("fresh").alias("status"),
            *rest,
        )
    )


def _per_trade(trades: DataFrame) -> DataFrame:
    return trades.select(*EVENT, "price", "size", *SOURCE)


def bar_updates(trades: DataFrame, hot: bool | None = None) -> DataFrame:
    """The bar of its second as it stands after each trade, in arrival order."""
    price, size = F.col("price"), F.col("size")
    runs = {
        "open": Running("first", price),
        "high": Running("max", price),
        "low": Running("min", price),
        "volume": Running("sum", size),
        "notional": Running("sum", notional("price", "size")),
    }
    rows = _per_trade(trades).withColumn("window_start", window_start("event_time"))
    scanned = running(rows, ["symbol", "exchange", "window_start"], list(ARRIVAL), runs, hot)
    return scanned.select(
        version().alias("schema_version"),
        F.lit("bar_1s").alias("event_type"),
        "symbol",
        "exchange",
        F.col("window_start").alias("event_time"),
        "ingest_time",
        "sequence_number",
        "open",
        "high",
        "low",
        F.col("price").alias("close"),
        "volume",
        weighted_price(F.col("notional"), F.col("volume"), price).alias("vwap"),
        *SOURCE,
    )


def live_bars(trades: DataFrame) -> DataFrame:
    """Each second's bar after its last arrival: what the live state ends up with."""
    arrived = F.struct(*ARRIVAL)
    return (
        _per_trade(trades)
        .groupBy("symbol", "exchange", window_start("event_time").alias("window_start"))
        .agg(
            F.min_by("price", arrived).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", arrived).alias("close"),
            F.sum("size").alias("volume"),
            F.sum(notional("price", "size")).alias("notional"),
        )
        .withColumn("vwap", weighted_price(F.col("notional"), F.col("volume"), F.col("close")))
        .drop("notional")
    )


def rolling_metrics(trades: DataFrame, prices: int = ROLLING_PRICES, hot: bool | None = None) -> DataFrame:
    """Per trade: volume and VWAP since the start, volatility of the last prices.

    Volume and VWAP are cumulative; only the sample is bounded. ``prices`` prices give
    ``prices - 1`` returns, and a return with a non-positive side is left out.
    """
    keys = ["symbol", "exchange"]
    rows = _per_trade(trades)
    if hot is None:
        hot = is_hot(rows, keys)
    runs = {
        "seen": Running("sum", F.lit(1).cast("long")),
        "rolling_volume": Running("sum", F.col("size")),
        "notional": Running("sum", notional("price", "size")),
        "previous_price": Running("last", F.col("price"), before=True),
    }
    scanned = running(rows, keys, list(ARRIVAL), runs, hot)
    scanned = scanned.withColumn("log_return", log_return(F.col("previous_price"), F.col("price")))
    deviation = {"deviation": F.stddev_samp("log_return")}
    framed = trailing(scanned, keys, list(ARRIVAL), prices - 1, deviation, hot, rank=F.col("seen") - 1)
    return framed.select(
        version().alias("schema_version"),
        F.lit("rolling_metrics").alias("event_type"),
        *EVENT,
        F.least(F.col("seen"), F.lit(prices).cast("long")).alias("sample_count"),
        "rolling_volume",
        weighted_price(F.col("notional"), F.col("rolling_volume"), F.col("price")).alias("rolling_vwap"),
        F.coalesce(round6(F.col("deviation") * 10000), F.lit(0.0)).alias("volatility_bps"),
        *SOURCE,
    )


def _up_to_newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per symbol the trades that lead up to its newest one: those with its keys that did not arrive after it.

    The newest trades are one row per symbol; the rest is a filter on the way to the next aggregate.
    """
    last = newest(rows, ["symbol"]).select(F.struct(*rows.columns).alias("last"))
    same = [rows[key] == F.col(f"last.{key}") for key in keys]
    return rows.join(last, same).where(F.struct(*ARRIVAL) <= F.struct(*[F.col(f"last.{name}") for name in ARRIVAL]))


def newest_bar(trades: DataFrame) -> DataFrame:
    """The last row of ``bar_updates`` per symbol in event order, without the rows before it."""
    rows = _per_trade(trades).withColumn("event_time", window_start("event_time"))
    arrived = F.when(F.col("price").isNotNull(), F.struct(*ARRIVAL))
    sums = _up_to_newest(rows, ["symbol", "exchange", "event_time"]).groupBy("last").agg(
        F.min_by("price", arrived).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.sum("size").alias("volume"),
        F.sum(notional("price", "size")).alias("notional"),
    )
    return sums.select(
        version().alias("schema_version"),
        F.lit("bar_1s").alias("event_type"),
        *[F.col(f"last.{name}").alias(name) for name in EVENT],
        "open",
        "high",
        "low",
        F.col("last.price").alias("close"),
        "volume",
        weighted_price(F.col("notional"), F.col("volume"), F.col("last.price")).alias("vwap"),
        *[F.col(f"last.{name}").alias(name) for name in SOURCE],
    )


def newest_metrics(trades: DataFrame, prices: int = ROLLING_PRICES) -> DataFrame:
    """The last row of ``rolling_metrics`` per symbol in event order, without the rows before it.

    Sums merge in the map tasks, and of the prices a task sends the last ones per symbol only.
    """
    led = _up_to_newest(_per_trade(trades), ["symbol", "exchange"])
    sums = led.groupBy("last").agg(
        F.count(F.lit(1)).alias("seen"), F.sum("size").alias("rolling_volume"), F.sum(notional("price", "size")).alias("notional")
    )
    recent = first_rows(led.withColumn("symbol", F.col("last.symbol")), ["symbol"], [F.desc(name) for name in ARRIVAL], prices)
    before = F.lag("price").over(Window.partitionBy("symbol").orderBy(*ARRIVAL))
    spread = recent.withColumn("log_return", log_return(before, F.col("price"))).groupBy("symbol").agg(F.stddev_samp("log_return").alias("deviation"))
    both = sums.withColumn("symbol", F.col("last.symbol")).join(spread, "symbol")
    return both.select(
        version().alias("schema_version"),
        F.lit("rolling_metrics").alias("event_type"),
        *[F.col(f"last.{name}").alias(name) for name in EVENT],
        F.least(F.col("seen"), F.lit(prices).cast("long")).alias("sample_count"),
        "rolling_volume",
        weighted_price(F.col("notional"), F.col("rolling_volume"), F.col("last.price")).alias("rolling_vwap"),
        F.coalesce(round6(F.col("deviation") * 10000), F.lit(0.0)).alias("volatility_bps"),
        *[F.col(f"last.{name}").alias(name) for name in SOURCE],
    )


BY_EVENT = ("event_time", "sequence_number", "ingest_time", *SOURCE)


def newest(rows: DataFrame, keys: list[str], order: tuple[str, ...] = BY_EVENT) -> DataFrame:
    """Newest row per key; merges in the map tasks."""
    position = F.struct(*[name for name in order if name in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), position).alias("_row")).select("_row.*")


def latest_state(kinds: dict[str, DataFrame], order: tuple[str, ...] = BY_EVENT) -> DataFrame:
    """Newest event per kind and symbol, with the time at which it expires.

    Each kind is reduced to one row per symbol before it is turned into JSON.
    """
    parts = []
    for kind, rows in kinds.items():
        written = "ingest_time" if "ingest_time" in rows.columns else "last_ingest_time"
        fields = [name for name in rows.columns if name not in SOURCE]
        parts.append(
            newest(rows, ["symbol"], order).select(
                F.lit(kind).alias("state_kind"),
                "symbol",
                _payload(rows, fields).alias("payload"),
                "event_time",
                "sequence_number",
                F.expr(f"{written} + INTERVAL {STATE_TTL_SECONDS} SECONDS").alias("expires_at"),
            )
        )
    state = parts[0]
    for part in parts[1:]:
        state = state.unionByName(part)
    return state


def replayed_state(bronze: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """The newest book, bar and metrics per symbol of a replay of the bronze rows that had arrived by then."""
    rows = bronze.where(F.col("ingest_time") <= as_of)
    return silver_state(silver.silver_trades(rows), silver.silver_quotes(rows), as_of)


def silver_state(trades: DataFrame, quotes: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """The newest book, bar and metrics per symbol of silver rows. The trades are read several times and had better be stored."""
    bars = gold.bars(trades).withColumnsRenamed({"window_start": "event_time", "last_sequence": "sequence_number"})
    return {
        "top_of_book": top_of_book(newest(quotes, ["symbol"]), as_of),
        "bar_1s": newest(bars, ["symbol"], ("event_time", "sequence_number", "last_source_offset")),
        "metrics": newest_metrics(trades),
    }


def _payload(rows: DataFrame, fields: list[str]) -> Column:
    times = {field.name for field in rows.schema if field.dataType.typeName() == "timestamp"}
    ordered = [iso_utc(name).alias(name) if name in times else F.col(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered))


def active_symbols(*frames: DataFrame) -> DataFrame:
    """Distinct symbols of any of the frames."""
    symbols = frames[0].select("symbol").distinct()
    for frame in frames[1:]:
        symbols = symbols.union(frame.select("symbol").distinct())
    return symbols.distinct()


def distinct_alerts(alerts: DataFrame) -> DataFrame:
    """One row per alert that was raised once but delivered twice."""
    keys = ["symbol", "exchange", "alert_type", "observed_sequence", "event_time"]
    return alerts.groupBy(*keys).agg(
        F.max("severity").alias("severity"), F.max("message").alias("message"), F.max("sequence_number").alias("sequence_number")
    )


def recent_alerts(alerts: DataFrame, keep: int = ALERTS_STORED, as_of: Column | None = None) -> DataFrame:
    """Newest alerts per symbol; a symbol's list expires an hour after its last alert."""
    newest_first = [F.desc("event_time"), F.desc("sequence_number"), *map(F.col, ("alert_type", "exchange", "observed_sequence", "message"))]
    now = F.current_timestamp() if as_of is None else as_of
    ranked = first_rows(distinct_alerts(alerts), ["symbol"], newest_first, keep, "alert_rank")
    last = F.max("event_time").over(Window.partitionBy("symbol"))
    alive = F.unix_seconds(now) - F.unix_seconds("_last") < ALERT_TTL_SECONDS
    return ranked.withColumn("_last", last).where(alive).drop("_last")


def symbol_snapshot(state: DataFrame, alerts: DataFrame, symbols: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Unexpired state of each active symbol with its ten newest alerts."""
    now = F.current_timestamp() if as_of is None else as_of
    kinds = ("latest_quote", "top_of_book", "bar_1s", "metrics", "freshness")
    by_symbol = (
        state.where(F.col("expires_at") > now)
        .groupBy("symbol")
        .agg(*[F.max(F.when(F.col("state_kind") == kind, F.col("payload"))).alias(kind) for kind in kinds])
    )
    listed = (
        recent_alerts(alerts, ALERTS_IN_SNAPSHOT, as_of)
        .groupBy("symbol")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("alert_rank", "alert_type", "severity", "message", "observed_sequence", "event_time"))
            ).alias("alerts")
        )
    )
    return symbols.join(by_symbol, "symbol", "left").join(listed, "symbol", "left")
