"""Keyed streaming operators with their own state.

A shuffle does not keep arrival order, so each call sorts the rows of its key by arrival.
What a call holds is one key's rows of one micro-batch; the source's ``per_trigger``
bounds that.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickforge.contracts import GAP_TOPICS, ROLLING_PRICES, STALE_MESSAGE, STALE_MS
from tickforge.operators import bronze, silver, vendor
from tickforge.operators.feed import quality_alert_rows
from tickforge.operators.silver import ARRIVAL

KEYS = ["symbol", "exchange"]


def _in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(parts), ignore_index=True)
    return rows.sort_values(list(ARRIVAL), ignore_index=True)


class HighestSequence(StatefulProcessor):
    """Rows whose sequence is not the highest seen so far plus one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.highest = handle.getValueState("highest", "sequence long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows)
        current = batch["sequence_number"].to_numpy("int64")
        known = self.highest.get()[0] if self.highest.exists() else None
        before = np.maximum.accumulate(np.concatenate([[current[0] if known is None else known], current]))[:-1]
        self.highest.update((int(max(before[-1], current[-1])),))
        odd = current != before + 1
        if known is None:
            odd[0] = False
        out = batch.loc[odd, ["ingest_time", "sequence_number"]].copy()
        out.insert(0, "symbol", key[0])
        out.insert(1, "exchange", key[1])
        out["previous"] = before[odd]
        yield out

    def close(self) -> None:
        pass


def sequence_track_stream(messages: DataFrame, source_topics: tuple[str, ...] | None = GAP_TOPICS) -> DataFrame:
    """Gap, duplicate and reordering alerts as the events arrive."""
    rows = bronze.bronze_rows(messages).where(F.col("event_type").isin("trade", "quote"))
    if source_topics is not None:
        rows = rows.where(F.col("source_topic").isin(*source_topics))
    return quality_alert_rows(silver.sequence_alerts(tracked(rows.select(*KEYS, "sequence_number", *ARRIVAL))))


def tracked(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).transformWithStateInPandas(
        HighestSequence(),
        "symbol string, exchange string, ingest_time timestamp, sequence_number long, previous long",
        "Append",
        "None",
    )


class RollingWindow(StatefulProcessor):
    """The last prices, and volume and notional since the start. Notional is kept in
    whole billionths, so that its sum is exact."""

    def __init__(self, prices: int):
        self.limit = prices

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prices = handle.getValueState("prices", "prices array<double>")
        self.totals = handle.getValueState("totals", "volume long, notional decimal(38,0), seen long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows)
        kept = np.array(self.prices.get()[0], "float64") if self.prices.exists() else np.zeros(0)
        volume, notional, seen = self.totals.get() if self.totals.exists() else (0, 0, 0)
        price = batch["price"].to_numpy("float64")
        size = batch["size"].to_numpy("int64")
        total_volume = volume + np.cumsum(size)
        billionths = np.array([int(value) for value in np.rint(price * size * 1e9)], dtype=object)
        total_notional = int(notional) + np.cumsum(billionths)
        notional_value = np.array([total / 1e9 for total in total_notional], "float64")
        every = np.concatenate([kept, price])
        counts = np.minimum(seen + 1 + np.arange(len(price)), self.limit)
        out = batch[["event_time", "ingest_time", "sequence_number", *ARRIVAL[1:]]].copy()
        out.insert(0, "symbol", key[0])
        out.insert(1, "exchange", key[1])
        out["sample_count"] = counts
        out["rolling_volume"] = total_volume
        with np.errstate(divide="ignore", invalid="ignore"):
            out["rolling_vwap"] = np.where(total_volume != 0, notional_value / total_volume, price)
        out["volatility_bps"] = deviation_bps(every, len(price), self.limit)
        self.prices.update((every[-self.limit :].tolist(),))
        self.totals.update((int(total_volume[-1]), Decimal(total_notional[-1]), int(seen + len(price))))
        yield out

    def close(self) -> None:
        pass


BAR_STATE = """open double, close double, high double, low double, volume long, notional decimal(38,0), trade_count long, sequence_number long,
               first_at array<long>, last_at array<long>"""
PLACE = ["event_us", "sequence_number", "source_offset", "source_partition"]
CLOSED_SCHEMA = """kind string, symbol string, exchange string, event_time timestamp, sequence_number long, open double, high double, low double,
                   close double, volume long, vwap double, trade_count long, source_offset long"""


class ClosingBars(StatefulProcessor):
    """Bars that end with the watermark: then a timer sends the bar and frees its state, and trades
    of it that come later are sent on as they are."""

    def __init__(self, length_ms: int):
        self.length_ms = length_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", "end_ms long", BAR_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(PLACE, ignore_index=True)
        batch["end_ms"] = (batch["event_us"] // (1000 * self.length_ms) + 1) * self.length_ms
        late = batch["end_ms"] <= timerValues.getCurrentWatermarkInMs()
        if late.any():
            yield self._late(key, batch[late])
        batch = batch[~late]
        batch["notional"] = [int(x) for x in np.rint(batch["price"].to_numpy() * batch["size"].to_numpy() * 1e9)]
        for end_ms, part in batch.groupby("end_ms"):
            first, last = part.iloc[0], part.iloc[-1]
            new = (
                float(first["price"]), float(last["price"]), float(part["price"].max()), float(part["price"].min()), int(part["size"].sum()),
                Decimal(sum(part["notional"])), len(part), int(part["sequence_number"].max()), [int(first[c]) for c in PLACE], [int(last[c]) for c in PLACE],
            )
            if self.bars.containsKey((end_ms,)):
                new = merged_bars(tuple(self.bars.getValue((end_ms,))), new)
            else:
                self.handle.registerTimer(int(end_ms))
            self.bars.updateValue((int(end_ms),), new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end_ms = expiredTimerInfo.getExpiryTimeInMs()
        bar = self.bars.getValue((end_ms,))
        self.bars.removeKey((end_ms,))
        opened, close, high, low, volume, notional, trades, sequence = tuple(bar)[:8]
        yield pd.DataFrame(
            {
                "kind": ["bar"], "symbol": [key[0]], "exchange": [key[1]], "event_time": [pd.Timestamp(end_ms - self.length_ms, unit="ms", tz="UTC")],
                "sequence_number": [sequence], "open": [opened], "high": [high], "low": [low], "close": [close], "volume": [volume],
                "vwap": [int(notional) / 1e9 / volume if volume else close], "trade_count": [trades], "source_offset": pd.array([None], "Int64"),
            }
        )

    @staticmethod
    def _late(key, rows: pd.DataFrame) -> pd.DataFrame:
        none = np.full(len(rows), np.nan)
        return pd.DataFrame(
            {
                "kind": "late", "symbol": key[0], "exchange": key[1], "event_time": pd.to_datetime(rows["event_us"].to_numpy(), unit="us", utc=True),
                "sequence_number": rows["sequence_number"].to_numpy(), "open": none, "high": none, "low": none, "close": rows["price"].to_numpy(),
                "volume": rows["size"].to_numpy(), "vwap": none, "trade_count": 1, "source_offset": pd.array(rows["source_offset"].to_numpy(), "Int64"),
            }
        )

    def close(self) -> None:
        pass


def merged_bars(a: tuple, b: tuple) -> tuple:
    """One bar from two of the same window, whichever came first."""
    first, last = (a if list(a[8]) <= list(b[8]) else b), (a if list(a[9]) >= list(b[9]) else b)
    return (first[0], last[1], max(a[2], b[2]), min(a[3], b[3]), a[4] + b[4], a[5] + b[5], a[6] + b[6], max(a[7], b[7]), list(first[8]), list(last[9]))


def closing_bar_stream(messages: DataFrame, watermark: str, length_ms: int = 1000) -> DataFrame:
    """Each bar once, when the watermark has passed its end (``kind`` bar), and every trade that came too late for its bar (late).

    The state holds the bars that are still open and nothing else. The event time goes on as a
    number: Spark drops late rows by the column itself before a processor could see them.
    """
    trades = silver.trade_rows(bronze.bronze_rows(messages)).withWatermark("event_time", watermark)
    rows = trades.select(*KEYS, F.unix_micros("event_time").alias("event_us"), "sequence_number", "price", "size", "source_offset", "source_partition")
    return rows.groupBy(*KEYS).transformWithStateInPandas(ClosingBars(length_ms), CLOSED_SCHEMA, "Append", "EventTime")


def deviation_bps(prices: np.ndarray, last: int, limit: int) -> np.ndarray:
    """For each of the ``last`` prices, the sample deviation of the log returns among
    the ``limit`` prices up to it; returns with a non-positive side are left out."""
    before, now = prices[:-1], prices[1:]
    good = (before > 0) & (now > 0)
    returns = np.full(len(now), np.nan)
    returns[good] = np.log(now[good] / before[good])
    padded = np.concatenate([np.full(limit, np.nan), returns])
    frames = np.lib.stride_tricks.sliding_window_view(padded, limit - 1)[-last:]
    result = np.zeros(last)
    for at in range(0, last, 10_000):
        part = frames[at : at + 10_000]
        used = ~np.isnan(part)
        count = used.sum(axis=1)
        values = np.where(used, part, 0.0)
        mean = values.sum(axis=1) / np.maximum(count, 1)
        spread = np.where(used, part - mean[:, None], 0.0)
        variance = (spread * spread).sum(axis=1) / np.maximum(count - 1, 1)
        result[at : at + 10_000] = np.where(count > 1, np.sqrt(variance) * 10000, 0.0)
    return result


def rolling_metrics_stream(messages: DataFrame, prices: int = ROLLING_PRICES) -> DataFrame:
    trades = silver.trade_rows(bronze.bronze_rows(messages))
    rows = trades.select(*KEYS, "event_time", "sequence_number", "price", "size", *ARRIVAL)
    scanned = rows.groupBy(*KEYS).transformWithStateInPandas(
        RollingWindow(prices),
        """symbol string, exchange string, event_time timestamp, ingest_time timestamp, sequence_number long,
           source_topic string, source_partition long, source_offset long,
           sample_count long, rolling_volume long, rolling_vwap double, volatility_bps double""",
        "Append",
        "None",
    )
    return scanned.select(
        F.lit("1.0").alias("schema_version"),
        F.lit("rolling_metrics").alias("event_type"),
        *KEYS,
        "event_time",
        "ingest_time",
        "sequence_number",
        "sample_count",
        "rolling_volume",
        "rolling_vwap",
        F.round("volatility_bps", 6).alias("volatility_bps"),
        "source_topic",
        "source_partition",
        "source_offset",
    )


class KnownMappings(StatefulProcessor):
    """The mappings of an instrument so far. A record gets the last one before it in its own order,
    also when later ones are known already.

    The records of a batch wait until its mappings are known, as packed texts in Arrow arrays and
    not as objects per field; they go on in the parts they came in.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "ts binary, ids binary, codes binary, symbols array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting, new = deque(), []
        for part in rows:
            offered = part["offered_symbol"].notna()
            ts, ids = (part[name].to_numpy("int64") for name in ("ts_event", "record_id"))
            waiting.append((ts, ids, pa.array(part["record"], pa.string())))
            new.append((ts[offered], ids[offered], part.loc[offered, "offered_symbol"].to_numpy(object)))
        ts, ids, codes, symbols = self._with(new)
        names = np.array([*symbols, None], object)
        while waiting:
            asked, numbers, records = waiting.popleft()
            before = places_before(ts, ids, asked, numbers)
            yield pd.DataFrame({"record": records.to_pandas(), "mapped_symbol": names[np.append(codes, len(symbols))[before]]})

    def _with(self, new: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Time, number and symbol (a place in a list) of all mappings, in order."""
        old = self.known.get() if self.known.exists() else (b"", b"", b"", [])
        symbols = list(old[3])
        place = {symbol: i for i, symbol in enumerate(symbols)}
        found = [np.array([place.setdefault(x, len(place)) for x in offered], "<i4") for _, _, offered in new]
        ts, ids, codes = (
            np.concatenate([np.frombuffer(bytes(raw), kind), *more])
            for raw, kind, more in zip(old, ("<i8", "<i8", "<i4"), ([x[0] for x in new], [x[1] for x in new], found))
        )
        if any(map(len, found)):
            order = np.lexsort([ids, ts])
            ts, ids, codes, symbols = ts[order], ids[order], codes[order], list(place)
            self.known.update((ts.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), codes.astype("<i4").tobytes(), symbols))
        return ts, ids, codes, symbols

    def close(self) -> None:
        pass


def places_before(ts: np.ndarray, ids: np.ndarray, asked_ts: np.ndarray, asked_ids: np.ndarray) -> np.ndarray:
    """The place of the last (ts, id) in order that is not after each asked one, or -1."""
    low, high = np.searchsorted(ts, asked_ts, "left"), np.searchsorted(ts, asked_ts, "right")
    tied = np.flatnonzero(low < high)
    if len(tied):
        pair = np.dtype([("ts", "<i8"), ("id", "<i8")])
        known, asked = np.empty(len(ts), pair), np.empty(len(tied), pair)
        known["ts"], known["id"], asked["ts"], asked["id"] = ts, ids, asked_ts[tied], asked_ids[tied]
        low[tied] = np.searchsorted(known, asked, "right")
    return low - 1


PACKED = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def symbol_resolution_stream(records: DataFrame) -> DataFrame:
    """``resolved_symbol`` of vendor records as they come. The state holds an instrument's mappings, twenty bytes
    for each; records without an instrument need none. A record passes the state as one JSON text."""
    packed = records.where("instrument_id IS NOT NULL").select(
        "instrument_id", "ts_event", "record_id", vendor.offered_mapping().alias("offered_symbol"), F.to_json(F.struct(*records.columns), PACKED).alias("record")
    )
    known = packed.groupBy("instrument_id").transformWithStateInPandas(KnownMappings(), "record string, mapped_symbol string", "Append", "None")
    mapped = known.select(F.inline(F.array(F.from_json("record", records.schema, PACKED))), "mapped_symbol")
    others = records.where("instrument_id IS NULL").withColumn("mapped_symbol", F.lit(None).cast("string"))
    return mapped.unionByName(others).withColumn("resolved_symbol", vendor.resolved_symbol("mapped_symbol")).drop("mapped_symbol")


class StaleMonitor(StatefulProcessor):
    """Looks at a symbol once per tick of processing time and reports growing lag."""

    def __init__(self, tick_ms: int, stale_ms: int):
        self.tick_ms, self.stale_ms = tick_ms, stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "exchange string, event_ms long, mark long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = _in_order(rows).iloc[-1]
        mark = self.last.get()[2] if self.last.exists() else 0
        if not self.last.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.tick_ms)
        self.last.update((newest["exchange"], int(newest["event_time"].value // 1_000_000), mark))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(now + self.tick_ms)
        exchange, event_ms, mark = self.last.get()
        lag = max(0, now - event_ms)
        if lag <= self.stale_ms:
            self.last.update((exchange, event_ms, 0))
            return
        if lag - mark < self.stale_ms:
            return
        self.last.update((exchange, event_ms, lag))
        yield pd.DataFrame({"symbol": [key[0]], "exchange": [exchange], "at": [pd.Timestamp(now, unit="ms")], "lag_ms": [lag]})

    def close(self) -> None:
        pass


class StaleTicks(StatefulProcessor):
    """The same monitor with ticks that come as rows, as of the time they name."""

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "exchange string, event_us long, mark long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch.sort_values(["ingest_time", "is_tick", *ARRIVAL[1:]], ignore_index=True)
        exchange, event_us, mark = self.last.get() if self.last.exists() else (None, None, 0)
        ticks = batch["is_tick"].to_numpy(bool)
        at = batch["ingest_time"].to_numpy("datetime64[us]").astype("int64")
        events = batch["event_time"].to_numpy("datetime64[us]").astype("int64")
        last = np.maximum.accumulate(np.where(ticks, -1, np.arange(len(batch))))  # the newest quote up to each row
        wanted = ticks & ((last >= 0) | (event_us is not None))
        known = np.where(last >= 0, events[np.maximum(last, 0)], event_us if event_us is not None else 0)
        exchanges = np.where(last >= 0, batch["exchange"].to_numpy(object)[np.maximum(last, 0)], exchange)
        rows = np.flatnonzero(wanted)
        lags = np.maximum(0, (at[rows] - known[rows]) // 1000)
        raised, mark = raised_ticks(lags, mark, self.stale_ms)
        if len(batch) and (last[-1] >= 0 or event_us is not None):
            self.last.update((str(exchanges[-1]), int(known[-1]), int(mark)))
        alerts = rows[raised]
        yield pd.DataFrame({"symbol": key[0], "exchange": exchanges[alerts], "at": pd.to_datetime(at[alerts], unit="us"), "lag_ms": lags[raised]})

    def close(self) -> None:
        pass


def raised_ticks(lags: np.ndarray, mark: int, stale_ms: int) -> tuple[np.ndarray, int]:
    """The places in ``lags``, one per tick, at which a monitor with this mark reports, and its mark afterwards.

    Between fresh ticks a report comes where the largest lag so far has passed the mark by the stale
    time, so there is one step per report and none per tick.
    """
    stale = np.concatenate([[False], lags > stale_ms, [False]])
    begins, ends = np.flatnonzero(~stale[:-1] & stale[1:]), np.flatnonzero(stale[:-1] & ~stale[1:])
    found = []
    for begin, end in zip(begins.tolist(), ends.tolist()):
        mark = 0 if begin else mark
        largest = np.maximum.accumulate(lags[begin:end])
        while (at := int(np.searchsorted(largest, mark + stale_ms))) < end - begin:
            found.append(begin + at)
            mark = int(largest[at])
    if len(lags) and lags[-1] <= stale_ms:
        mark = 0
    return np.array(found, np.int64), mark


def stale_tick_stream(messages: DataFrame, clock: DataFrame, stale_ms: int = STALE_MS) -> DataFrame:
    """Alerts at the ticks of ``clock`` (symbol, tick_time), a stream like any other."""
    quotes = silver.quote_rows(bronze.bronze_rows(messages)).select(*KEYS, "event_time", *ARRIVAL, F.lit(False).alias("is_tick"))
    ticks = clock.select(
        "symbol",
        F.lit(None).cast("string").alias("exchange"),
        F.col("tick_time").alias("event_time"),
        F.col("tick_time").alias("ingest_time"),
        F.lit(None).cast("string").alias("source_topic"),
        F.lit(None).cast("long").alias("source_partition"),
        F.lit(None).cast("long").alias("source_offset"),
        F.lit(True).alias("is_tick"),
    )
    return _stale_alerts(quotes.unionByName(ticks), StaleTicks(stale_ms), "None")


def stale_monitor_stream(messages: DataFrame, tick_ms: int = 1000, stale_ms: int = STALE_MS) -> DataFrame:
    quotes = silver.quote_rows(bronze.bronze_rows(messages)).select(*KEYS, "event_time", *ARRIVAL)
    return _stale_alerts(quotes, StaleMonitor(tick_ms, stale_ms), "ProcessingTime")


def _stale_alerts(rows: DataFrame, monitor: StatefulProcessor, time_mode: str) -> DataFrame:
    lagging = rows.groupBy("symbol").transformWithStateInPandas(
        monitor, "symbol string, exchange string, at timestamp, lag_ms long", "Append", time_mode
    )
    return quality_alert_rows(
        lagging.select(
            "symbol",
            "exchange",
            F.col("at").alias("event_time"),
            F.lit("stale_symbol").alias("alert_type"),
            F.lit("warning").alias("severity"),
            F.format_string(STALE_MESSAGE, "symbol", "lag_ms").alias("message"),
            F.lit(None).cast("long").alias("observed_sequence"),
            F.lit(None).cast("long").alias("expected_sequence"),
        )
    )
