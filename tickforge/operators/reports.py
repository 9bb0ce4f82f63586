"""Reports, replay summaries, rates, reconciliation and lineage."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickforge.contracts import ALERTS_TOPIC, RAW_TOPIC, TABLE_CONTRACTS
from tickforge.functions.columns import window_start
from tickforge.functions.scans import Running, running


def quality_report(
    tables: dict[str, DataFrame], report_date: dt.date | str | None = None, job_run_id: str = "manual", processed_at: Column | None = None
) -> DataFrame:
    """Row count and date range of each table, for one date or for all."""
    parts = []
    for name, df in tables.items():
        if report_date is not None:
            df = event_date_filter(df, report_date)
        parts.append(
            df.agg(
                F.count(F.lit(1)).alias("row_count"),
                F.min("event_date").alias("min_event_date"),
                F.max("event_date").alias("max_event_date"),
            ).select(
                F.lit(TABLE_CONTRACTS[name].zone).alias("zone"),
                F.lit(name).alias("table_name"),
                F.lit(str(report_date or "all")).alias("report_date"),
                "row_count",
                "min_event_date",
                "max_event_date",
                F.lit(job_run_id).alias("job_run_id"),
                (F.current_timestamp() if processed_at is None else processed_at).alias("processed_at"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def event_date_filter(df: DataFrame, date: dt.date | str) -> DataFrame:
    """Rows of one date; a plain predicate on the partition column."""
    return df.where(F.col("event_date") == F.lit(date).cast("date"))


def time_range_filter(
    df: DataFrame,
    start: Column,
    end: Column,
    symbols: list[str] | None = None,
    exchange: str | None = None,
    time: str = "event_time",
) -> DataFrame:
    """Rows of a closed time range, optionally of some symbols or one exchange."""
    rows = df.where(F.col(time).between(start, end))
    if "event_date" in df.columns:
        rows = rows.where(F.col("event_date").between(F.to_date(start), F.to_date(end)))
    if symbols:
        rows = rows.where(F.col("symbol").isin(*[symbol.upper() for symbol in symbols]))
    if exchange:
        rows = rows.where(F.col("exchange") == exchange)
    return rows


def _replayable(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy("source_topic", "event_type").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("source_offset").alias("first_offset"),
        F.max("source_offset").alias("last_offset"),
        F.min("event_time").alias("first_event_time"),
        F.max("event_time").alias("last_event_time"),
    )


def replay_dry_run(bronze: DataFrame, replay_date: dt.date | str) -> DataFrame:
    """What a replay of one date would read. Nothing is written."""
    return _replayable(event_date_filter(bronze, replay_date)).withColumn("replay_date", F.lit(replay_date).cast("date"))


def replay_estimate(bronze: DataFrame, start: Column, end: Column, symbols: list[str] | None = None) -> DataFrame:
    return _replayable(time_range_filter(bronze, start, end, symbols))


def feed_event_rate(bronze: DataFrame, interval: str = "1 minute") -> DataFrame:
    """Events per type, symbol, exchange and interval, with the rate per second."""
    seconds = F.lit(_seconds(interval))
    return (
        bronze.groupBy("event_type", "symbol", "exchange", window_start("event_time", interval).alias("window_start"))
        .agg(F.count(F.lit(1)).alias("event_count"))
        .withColumn("per_second", F.round(F.col("event_count") / seconds, 6))
    )


def _seconds(interval: str) -> int:
    number, unit = interval.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600}[unit.rstrip("s")]


def gap_counts(gaps: DataFrame, interval: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Anomalies per symbol and exchange in tumbling or sliding windows."""
    window = F.window("event_time", interval, slide or interval)
    return (
        gaps.groupBy("symbol", "exchange", window.alias("w"))
        .agg(F.count(F.lit(1)).alias("gap_count"))
        .select("symbol", "exchange", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "gap_count")
    )


def tool_call_errors(audit: DataFrame, interval: str = "5 minutes", more_than: int = 3) -> DataFrame:
    """Calls per tool and status; ``elevated`` where errors exceed the bound."""
    return (
        audit.groupBy("tool_name", "result_status", window_start("timestamp", interval).alias("window_start"))
        .agg(F.count(F.lit(1)).alias("call_count"))
        .withColumn("elevated", (F.col("result_status") == "error") & (F.col("call_count") > more_than))
    )


def latency_summary(requests: DataFrame, keys: list[str], value: str, time: str, hot: bool | None = None) -> DataFrame:
    """Requests, throughput, mean and the 95th and 99th percentile per key.

    A percentile is the element at round(p/100 * (n-1)), half to even. Equal values
    are added up first; that histogram is all that is ordered and summed further on.
    """
    counted = requests.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(time).alias("_first"),
        F.max(time).alias("_last"),
        F.sum(F.col(value).cast("decimal(27,9)")).alias("_part"),
    )
    upto = running(counted, keys, [value], {"_upto": Running("sum", F.col("_n"))}, hot)
    totals = counted.groupBy(*keys).agg(
        F.sum("_n").alias("request_count"),
        (F.unix_micros(F.max("_last")) - F.unix_micros(F.min("_first"))).alias("_span"),
        F.sum("_part").alias("_sum"),
    )
    rank = {p: F.bround(F.lit(p / 100.0) * (F.col("request_count") - 1), 0).cast("long") for p in (95, 99)}
    picked = (
        upto.join(totals, keys)
        .groupBy(*keys)
        .agg(*[F.min(F.when(F.col("_upto") > at, F.col(value))).alias(f"p{p}") for p, at in rank.items()])
    )
    return totals.join(picked, keys).select(
        *keys,
        "request_count",
        F.round(F.try_divide(F.col("request_count") * F.lit(1e6), F.col("_span")), 6).alias("per_second"),
        F.round(F.col("_sum").cast("double") / F.col("request_count"), 6).alias("mean"),
        "p95",
        "p99",
    )


# --- Reconciliation -------------------------------------------------------------------


def live_vs_replay(live: DataFrame, replay: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per field that differs, or that only one side has."""
    sides = live.select(*keys, F.struct(*fields).alias("live")).join(
        replay.select(*keys, F.struct(*fields).alias("replay")), keys, "full_outer"
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                F.round(F.col(f"live.{name}").cast("double"), 6).alias("live_value"),
                F.round(F.col(f"replay.{name}").cast("double"), 6).alias("replay_value"),
            )
            for name in fields
        ]
    )
    return (
        sides.select(*keys, F.inline(entries)).where(~F.col("live_value").eqNullSafe(F.col("replay_value")))
    )


COMPARED = {
    "top_of_book": ("bid_price", "bid_size", "ask_price", "ask_size", "spread", "mid_price"),
    "bar_1s": ("open", "high", "low", "close", "volume", "vwap"),
    "metrics": ("sample_count", "rolling_volume", "rolling_vwap", "volatility_bps"),
}


def state_differences(state: DataFrame, replay: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """One row per kind, symbol and field in which the stored state and the replayed rows differ.

    A symbol that only one side has differs in all fields. What may be compared is small, a few
    numbers per symbol.
    """
    def field(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), F.round(value.cast("double"), 6).alias("value"))

    def stacked(rows: DataFrame, kind: str, of: Callable[[str], Column], time: Column) -> DataFrame:
        values = [field(name, of(name)) for name in ("sequence_number", *COMPARED[kind])]
        return rows.select(F.lit(kind).alias("state_kind"), "symbol", F.inline(F.array(field("event_time_us", F.unix_micros(time)), *values)))

    sides = []
    for kind in COMPARED:
        stored = state.where(F.col("state_kind") == kind)
        sides.append(
            (
                stacked(stored, kind, lambda name: F.get_json_object("payload", f"$.{name}"), F.col("event_time")),
                stacked(replay[kind], kind, F.col, F.col("event_time")),
            )
        )
    live, replayed = (reduce(DataFrame.unionByName, side) for side in zip(*sides))
    keys = ["state_kind", "symbol", "field"]
    joined = live.withColumnRenamed("value", "live_value").join(replayed.withColumnRenamed("value", "replay_value"), keys, "full_outer")
    return joined.where(~F.col("live_value").eqNullSafe(F.col("replay_value"))).select(as_of.cast("timestamp").alias("as_of"), *keys, "live_value", "replay_value")


def divergence_counts(differences: DataFrame, interval: str = "15 minutes", time: str = "window_start") -> DataFrame:
    return (
        differences.groupBy("symbol", window_start(time, interval).alias("interval_start"))
        .agg(F.count(F.lit(1)).alias("difference_count"))
    )


def gap_evidence(gaps: DataFrame, alerts: DataFrame, start: Column, end: Column, symbols: list[str] | None = None, exchange: str | None = None) -> DataFrame:
    """Each gap of a time range with the topics it touches and the alerts about it.

    Alerts are reduced to one row per sequence number first: a number that came many
    times has many gap rows and many alerts, and their product is not wanted.
    """
    wanted = time_range_filter(gaps, start, end, symbols, exchange)
    keys = ["symbol", "exchange", "observed_sequence", "alert_type"]
    raised = (
        time_range_filter(alerts, start, end, symbols, exchange)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("alert_count"),
            F.min("event_time").alias("first_alert_time"),
            F.max("event_time").alias("last_alert_time"),
        )
    )
    topics = F.array(F.lit(RAW_TOPIC), F.col("source_topic"), F.when(F.col("alert_count") > 0, ALERTS_TOPIC))
    return wanted.join(raised, keys, "left").select(
        *keys,
        "expected_sequence",
        "event_time",
        "source_partition",
        "source_offset",
        F.array_sort(F.array_distinct(F.array_compact(topics))).alias("topics"),
        F.coalesce("alert_count", F.lit(0).cast("long")).alias("alert_count"),
        "first_alert_time",
        "last_alert_time",
    )


def freshness_check(fresh: DataFrame, evidence: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Freshness of the asked symbols beside their snapshot (one row per symbol) and the evidence found for each."""
    found = evidence.select(F.col("query_id").alias("symbol"), "result_rank", "source_uri", "chunk_index", "title", "score")
    asked = fresh.select("symbol", "exchange", "event_time", "freshness_lag_ms", "status")
    return asked.join(snapshot.drop("status"), "symbol", "left").join(found, "symbol", "left")


def lineage_trace(
    gold_rows: DataFrame, silver_rows: DataFrame, bronze: DataFrame, symbol: str | None = None, at: Column | None = None
) -> DataFrame:
    """From windows of a gold table to the silver and the bronze rows behind them.

    Restrictions on symbol and time are applied to all three tables before the joins.
    """
    rows, behind = silver_rows.withColumn("window_start", window_start("event_time")), bronze
    if symbol is not None:
        gold_rows, rows, behind = [df.where(F.col("symbol") == symbol.upper()) for df in (gold_rows, rows, behind)]
    if at is not None:
        gold_rows = gold_rows.where((F.col("window_start") == window_start(at)) & (F.col("event_date") == F.to_date(at)))
        rows = rows.where((F.col("window_start") == window_start(at)) & (F.col("event_date") == F.to_date(at)))
        behind = behind.where((window_start("event_time") == window_start(at)) & (F.col("event_date") == F.to_date(at)))
    # The date is part of the key: both tables are partitioned by it.
    source = ["event_date", "source_topic", "source_partition", "source_offset"]
    keys = ["symbol", "exchange", "window_start"]
    return (
        rows.select(*keys, *source)
        .join(behind.select(*source, "schema_version", "job_run_id"), source)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("bronze_rows"),
            F.array_sort(F.collect_set("source_topic")).alias("source_topics"),
            F.array_sort(F.collect_set("source_partition")).alias("source_partitions"),
            F.min("source_offset").alias("first_offset"),
            F.max("source_offset").alias("last_offset"),
            F.array_sort(F.collect_set("schema_version")).alias("schema_versions"),
            F.array_sort(F.collect_set("job_run_id")).alias("job_runs"),
        )
        .join(gold_rows.select(*keys, "first_sequence", "last_sequence"), keys)
    )
