"""Freshness over time: when a monitor that looks once per tick reports, and how long symbols are stale.

A monitor carries a mark from tick to tick, the lag of its last report. Between two quotes the lag
grows by one tick a tick, so an interval is a function from the mark before to the mark after it. A
mark is never above the largest lag since the last reset and never more than the stale time below
it, so such a function is a table over the few possible distances. Tables combine by look-up:
pieces of a timeline are reduced to one table each, a scan over the pieces gives every piece its
mark, and the reports of all pieces are found side by side, however long a symbol stays stale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickforge.contracts import STALE_MESSAGE, STALE_MS
from tickforge.functions.scans import Running, is_hot, running
from tickforge.operators.feed import quality_alert_rows
from tickforge.operators.silver import ARRIVAL

TICKS_PER_PIECE = 86_400
RECORDS_AT_ONCE = 256


def freshness_intervals(quotes: DataFrame, keys: list[str], start: Column, end: Column, tick_ms: int = 1000) -> DataFrame:
    """Runs of ticks during which one quote is the last one that arrived; ``lag_ms`` is its lag at the first, which may be negative.

    Quotes are reduced to the last one per key and tick before the shuffle, so a key
    has at most one row per tick of the asked range, however many quotes it has.
    """
    tick_us = tick_ms * 1000
    since = F.unix_micros("ingest_time") - F.unix_micros(start)
    first_tick = F.greatest(F.lit(0).cast("long"), F.ceil(since / F.lit(tick_us)).cast("long"))
    last_tick = F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(tick_us)).cast("long")
    rest = [name for name in ("symbol", "exchange", "event_time") if name not in keys]
    seen = (
        quotes.where(F.col("ingest_time") <= end)
        .groupBy(*keys, first_tick.alias("from_tick"))
        .agg(F.max_by(F.struct(*rest), F.struct(*ARRIVAL)).alias("last"))
    )
    following = F.lead("from_tick").over(Window.partitionBy(*keys).orderBy("from_tick"))
    offset_us = F.unix_micros(start) - F.unix_micros("last.event_time")
    return (
        seen.withColumn("to_tick", F.coalesce(following - 1, last_tick))
        .where(F.col("from_tick") <= F.col("to_tick"))
        .select(
            *keys,
            *[F.col(f"last.{name}").alias(name) for name in rest],
            "from_tick",
            "to_tick",
            F.floor((offset_us + F.col("from_tick") * tick_us) / F.lit(1000)).cast("long").alias("lag_ms"),
        )
    )


def _lag_at(tick: Column | str, tick_ms: int) -> Column:
    tick = F.col(tick) if isinstance(tick, str) else tick
    return F.greatest(F.lit(0).cast("long"), F.col("lag_ms") + (tick - F.col("from_tick")) * F.lit(tick_ms))


# --- The monitor ----------------------------------------------------------------------


def _records(quotes: DataFrame, start: Column, end: Column, tick_ms: int, stale_ms: int) -> DataFrame:
    """The intervals in which a symbol's lag is larger than ever since the last fresh tick, and what it was before.

    No other interval can raise an alert. ``resets`` is set where the interval starts fresh.
    """
    intervals = freshness_intervals(quotes, ["symbol"], start, end, tick_ms)
    resets = (F.col("lag_ms") <= stale_ms).cast("long")
    hot = is_hot(quotes, ["symbol"])
    stretches = running(intervals.withColumn("resets", resets), ["symbol"], ["from_tick"], {"stretch": Running("sum", F.col("resets"))}, hot)
    peaked = stretches.withColumn("peak", _lag_at("to_tick", tick_ms))
    known = running(peaked, ["symbol", "stretch"], ["from_tick"], {"largest": Running("max", F.col("peak"), before=True)}, hot)
    records = known.withColumn("largest", F.coalesce("largest", F.lit(0).cast("long")))
    return records.where("resets = 1 OR peak > largest").withColumn("piece", F.floor(F.col("from_tick") / F.lit(TICKS_PER_PIECE)))


class Marks:
    """The functions of intervals, in order, for distances 0 to ``stale_ms`` of the mark below the largest lag."""

    def __init__(self, rows: pd.DataFrame, tick_ms: int, stale_ms: int):
        self.tick_ms, self.stale_ms, self.step = tick_ms, stale_ms, -(-stale_ms // tick_ms)
        column = lambda name: rows[name].to_numpy(np.int64)
        self.begin, self.end, self.lag, self.resets = column("from_tick"), column("to_tick"), column("lag_ms"), column("resets") > 0
        self.largest = np.where(self.resets, 0, column("largest"))
        self.peak = np.maximum(self.largest, column("peak"))

    def first_ticks(self, rows: slice, distance: np.ndarray) -> np.ndarray:
        """The tick of the first alert of each interval, behind its end if there is none."""
        mark = np.maximum(self.largest[rows][:, None] - np.where(self.resets[rows][:, None], 0, distance), 0)
        short = np.maximum(mark + self.stale_ms, self.stale_ms + 1) - self.lag[rows][:, None]
        return self.begin[rows][:, None] + np.maximum(0, -(-short // self.tick_ms))

    def tables(self, rows: slice) -> np.ndarray:
        """One row per interval: the distance after it for each distance before it."""
        distance = np.arange(self.stale_ms + 1)[None, :]
        first = self.first_ticks(rows, distance)
        end, begin = self.end[rows][:, None], self.begin[rows][:, None]
        last = first + (end - first) // self.step * self.step
        reported = self.lag[rows][:, None] + (last - begin) * self.tick_ms
        kept = self.largest[rows][:, None] - np.where(self.resets[rows][:, None], 0, distance)
        after = self.peak[rows][:, None] - np.where(first <= end, reported, kept)
        return np.clip(after, 0, self.stale_ms).astype(np.int32)

    def slices(self) -> Iterator[slice]:
        for at in range(0, len(self.begin), RECORDS_AT_ONCE):
            yield slice(at, min(at + RECORDS_AT_ONCE, len(self.begin)))


def combined(tables: np.ndarray) -> list[np.ndarray]:
    """Levels of a tree of functions: the tables, then each two neighbours as one, up to a single one."""
    levels = [tables]
    while len(tables) > 1:
        if len(tables) % 2:
            tables = np.vstack([tables, np.arange(tables.shape[1], dtype=tables.dtype)[None, :]])
            levels[-1] = tables
        tables = np.take_along_axis(tables[1::2], tables[::2], axis=1)
        levels.append(tables)
    return levels


def distances_before(levels: list[np.ndarray], distance: int) -> np.ndarray:
    """The distance in front of each function of the lowest level, down the tree from that in front of all."""
    before = np.array([distance])
    for level in reversed(levels[:-1]):
        left = before[: len(level) // 2]
        both = np.empty(2 * len(left), np.int64)
        both[::2], both[1::2] = left, level[::2][np.arange(len(left)), left]
        before = both
    return before


def _piece_table(tick_ms: int, stale_ms: int):
    def reduce_piece(piece: pd.DataFrame) -> pd.DataFrame:
        marks = Marks(piece.sort_values("from_tick"), tick_ms, stale_ms)
        table = np.arange(stale_ms + 1, dtype=np.int32)
        for rows in marks.slices():
            table = combined(marks.tables(rows))[-1][0][table]
        return pd.DataFrame({"symbol": piece["symbol"].iloc[:1], "piece": piece["piece"].iloc[:1], "table": [table.tobytes()]})

    return reduce_piece


def _piece_starts(pieces: pd.DataFrame) -> pd.DataFrame:
    """The distance in front of each piece of a symbol, from the tables of the pieces."""
    pieces = pieces.sort_values("piece")
    tables = np.vstack([np.frombuffer(t, np.int32) for t in pieces["table"]])
    before = distances_before(combined(tables), 0)[: len(pieces)]
    return pd.DataFrame({"symbol": pieces["symbol"], "piece": pieces["piece"], "distance": before})


def _first_alerts(tick_ms: int, stale_ms: int):
    def find(records: pd.DataFrame) -> pd.DataFrame:
        records = records.sort_values("from_tick")
        marks, distance, found = Marks(records, tick_ms, stale_ms), int(records["distance"].iloc[0]), []
        for rows in marks.slices():
            levels = combined(marks.tables(rows))
            n = rows.stop - rows.start
            before = distances_before(levels, distance)[:n]
            found.append(marks.first_ticks(rows, before[:, None])[:, 0])
            distance = int(levels[-1][0][distance])
        return records[["symbol", "exchange", "from_tick", "to_tick", "lag_ms"]].assign(alert_tick=np.concatenate(found))

    return find


def stale_alerts(quotes: DataFrame, start: Column, end: Column, tick_ms: int = 1000, stale_ms: int = STALE_MS) -> DataFrame:
    """Alerts of a monitor that looks at every symbol once per tick.

    A symbol is reported when its lag passed ``stale_ms``, and again whenever the lag
    grew by ``stale_ms`` since the last report; a fresh tick resets it.
    """
    records = _records(quotes, start, end, tick_ms, stale_ms)
    tables = records.groupBy("symbol", "piece").applyInPandas(_piece_table(tick_ms, stale_ms), "symbol string, piece long, table binary")
    starts = tables.groupBy("symbol").applyInPandas(_piece_starts, "symbol string, piece long, distance long")
    placed = records.join(starts, ["symbol", "piece"])
    schema = "symbol string, exchange string, from_tick long, to_tick long, lag_ms long, alert_tick long"
    first = placed.groupBy("symbol", "piece").applyInPandas(_first_alerts(tick_ms, stale_ms), schema).where("alert_tick <= to_tick")
    step = F.lit(-(-stale_ms // tick_ms)).cast("long")
    fields = first.withColumn("tick", F.explode(F.sequence("alert_tick", "to_tick", step))).select(
        "symbol",
        "exchange",
        _time(start, "tick", tick_ms).alias("event_time"),
        F.lit("stale_symbol").alias("alert_type"),
        F.lit("warning").alias("severity"),
        F.format_string(STALE_MESSAGE, "symbol", _lag_at("tick", tick_ms)).alias("message"),
        F.lit(None).cast("long").alias("observed_sequence"),
        F.lit(None).cast("long").alias("expected_sequence"),
    )
    return quality_alert_rows(fields)


def _time(start: Column, tick: str, tick_ms: int) -> Column:
    return F.timestamp_micros(F.unix_micros(start) + F.col(tick) * F.lit(tick_ms * 1000))


# --- The rule with a hold -------------------------------------------------------------


def freshness_breach(
    quotes: DataFrame, start: Column, end: Column, hold_ticks: int, tick_ms: int = 1000, stale_ms: int = STALE_MS
) -> DataFrame:
    """Spans in which a symbol's largest lag has been stale for the whole hold time.

    One row per span: since when the symbol is stale, from when to when the rule holds, and the lag
    at the end. The stale parts of the intervals of all its exchanges are merged, so there is at most
    a row per quote, whatever the number of ticks.
    """
    keys = ["symbol", "exchange"]
    stale = freshness_intervals(quotes, keys, start, end, tick_ms)
    wait = F.greatest(F.lit(0), F.ceil((F.lit(stale_ms + 1) - F.col("lag_ms")) / F.lit(tick_ms))).cast("long")
    parts = stale.select(
        "symbol", "exchange", (F.col("from_tick") + wait).alias("stale_tick"), "to_tick", _lag_at("to_tick", tick_ms).alias("last_lag")
    ).where("stale_tick <= to_tick")
    hot = is_hot(quotes, ["symbol"])
    order = ["stale_tick", "to_tick", "exchange"]
    seen = running(parts, ["symbol"], order, {"until": Running("max", F.col("to_tick"), before=True)}, hot)
    starts = F.when(F.col("stale_tick") > F.col("until") + 1, 1).when(F.col("until").isNull(), 1).otherwise(0).cast("long")
    numbered = running(seen.withColumn("starts", starts), ["symbol"], order, {"span": Running("sum", F.col("starts"))}, hot)
    spans = numbered.groupBy("symbol", "span").agg(F.min("stale_tick").alias("since"), F.max(F.struct("to_tick", "last_lag")).alias("last"))
    held = spans.select("symbol", "since", (F.col("since") + hold_ticks).alias("from"), F.col("last.to_tick").alias("until"), "last.last_lag")
    return held.where(F.col("from") <= F.col("until")).select(
        "symbol",
        _time(start, "since", tick_ms).alias("stale_since"),
        _time(start, "from", tick_ms).alias("breach_from"),
        _time(start, "until", tick_ms).alias("breach_until"),
        F.col("last_lag").alias("lag_ms"),
    )
