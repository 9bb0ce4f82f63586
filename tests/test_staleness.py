"""The monitor and the rule with a hold against loops over ticks."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import bronze_of, quote
from tickforge.operators import silver, staleness
from tickforge.streaming import stateful

START = dt.datetime(2026, 5, 7)


def sent_quotes(seed, behind, n=60, exchanges=("XNAS",), growth=0.0):
    """Quotes that arrive after silences, for events some time before; (arrival, event, exchange)."""
    rng, at, found = random.Random(seed), 0.0, []
    for k in range(n):
        at += rng.choice([0.2, 0.9, 3.5, 7.1])
        found.append((START + dt.timedelta(seconds=at), START + dt.timedelta(seconds=at - rng.choice(behind) - growth * k), rng.choice(exchanges)))
    return found, int(at) + 12


def frame(spark, arrivals):
    iso = lambda t: t.isoformat(timespec="microseconds") + "Z"
    sent = [quote(n, iso(happened), 1.0, 1.0, ingest_time=iso(arrive), exchange=e) for n, (arrive, happened, e) in enumerate(arrivals)]
    return silver.quote_rows(bronze_of(spark, sent))


def at(seconds):
    return F.lit((START + dt.timedelta(seconds=seconds)).isoformat(sep=" ")).cast("timestamp")


def lags(arrivals, ticks):
    """{tick: lag of the quote that arrived last}."""
    out = {}
    for tick in range(ticks + 1):
        now = START + dt.timedelta(seconds=tick)
        seen = [happened for arrive, happened, _ in arrivals if arrive <= now]
        if seen:
            out[tick] = max(0, int((now - seen[-1]) / dt.timedelta(milliseconds=1)))
    return out


def looped(lag_at, stale_ms=2000):
    """What the monitor reports, tick by tick."""
    found, mark = [], 0
    for tick, lag in lag_at.items():
        if lag <= stale_ms:
            mark = 0
        elif lag - mark >= stale_ms:
            found.append((tick, lag))
            mark = lag
    return found


CASES = {
    "silences and late quotes": [0.0, 0.4, 1.9, 2.6, 6.3],
    "never fresh": [2.3, 5.1, 9.8, 14.05, 30.2],
    "in the future": [-3.0, 0.5, 4.4],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("piece", [7, 86_400])
def test_monitor_equals_the_tick_loop(spark, monkeypatch, case, piece):
    monkeypatch.setattr(staleness, "TICKS_PER_PIECE", piece)
    arrivals, ticks = sent_quotes(3, CASES[case], growth=1.3 if case == "never fresh" else 0)
    expected = looped(lags(arrivals, ticks))
    found = staleness.stale_alerts(frame(spark, arrivals), at(0), at(ticks))
    rows = [(int(r.s), r.message) for r in found.select((F.unix_micros("event_time") / 1e6 - START.replace(tzinfo=dt.timezone.utc).timestamp()).alias("s"), "message").orderBy("s").collect()]
    assert rows == [(tick, f"AAPL freshness lag is {lag} ms.") for tick, lag in expected] and len(expected) > 10


@pytest.mark.parametrize("stale_ms,tick_ms", [(2000, 1000), (2500, 1000), (700, 200), (2000, 3000)])
def test_tables_of_marks(stale_ms, tick_ms):
    """Functions by look-up, combined in a tree, against the loop: every mark in front of every interval."""
    rng = np.random.default_rng(stale_ms)
    rows, tick, largest, expected, mark = [], 0, 0, [], 0
    for _ in range(700):
        length, lag = int(rng.integers(1, 12)), int(rng.integers(-500, 40_000 if rng.random() < 0.03 else 9000))
        resets, peak = lag <= stale_ms, max(0, lag + (length - 1) * tick_ms)
        if resets:
            largest = 0
        if resets or peak > largest:
            rows.append((tick, tick + length - 1, lag, int(resets), largest, peak))
            expected.append((largest, mark))
        first = None
        for t in range(length):
            now = max(0, lag + t * tick_ms)
            if now <= stale_ms:
                mark = 0
            elif now - mark >= stale_ms:
                mark, first = now, tick + t if first is None else first
        if resets or peak > largest:
            expected[-1] += (first,)
        else:
            assert first is None
        largest, tick = max(largest, peak), tick + length
    marks = staleness.Marks(pd.DataFrame(rows, columns=["from_tick", "to_tick", "lag_ms", "resets", "largest", "peak"]), tick_ms, stale_ms)
    distance = 0
    for part in marks.slices():
        levels = staleness.combined(marks.tables(part))
        before = staleness.distances_before(levels, distance)[: part.stop - part.start]
        first = marks.first_ticks(part, before[:, None])[:, 0]
        for i, (d, t) in enumerate(zip(before, first), part.start):
            known, mark, alert = expected[i]
            assert marks.resets[i] or known - d == mark
            assert (t if t <= marks.end[i] else None) == alert
        distance = levels[-1][0][distance]


def test_a_long_stale_symbol_is_cut_into_many_tasks(spark, monkeypatch):
    """One old quote and a million ticks: as many pieces as intervals that matter, and the sums are right."""
    monkeypatch.setattr(staleness, "TICKS_PER_PIECE", 1000)
    arrivals = [(START + dt.timedelta(seconds=100 * n), START - dt.timedelta(seconds=10 + 3 * n), "XNAS") for n in range(300)]
    quotes = frame(spark, arrivals)
    records = staleness._records(quotes, at(0), at(40_000), 1000, 2000)
    pieces = {r.piece: r["count"] for r in records.groupBy("piece").count().collect()}
    assert len(pieces) == 30 and max(pieces.values()) == 10
    assert staleness.stale_alerts(quotes, at(0), at(40_000)).count() == len(looped(_fast_lags(arrivals, 40_000)))


def _fast_lags(arrivals, ticks):
    out, place = {}, -1
    for tick in range(ticks + 1):
        while place + 1 < len(arrivals) and arrivals[place + 1][0] <= START + dt.timedelta(seconds=tick):
            place += 1
        out[tick] = int((START + dt.timedelta(seconds=tick) - arrivals[place][1]) / dt.timedelta(milliseconds=1))
    return out


@pytest.mark.parametrize("hold", [3, 6])
def test_spans_of_the_rule_equal_the_tick_loop(spark, small_tasks, hold):
    arrivals, ticks = sent_quotes(5, [0.0, 0.4, 2.6], 90, ("XNAS", "XNYS"))
    by_market = [lags([a for a in arrivals if a[2] == e], ticks) for e in ("XNAS", "XNYS")]
    largest = {t: max(m[t] for m in by_market if t in m) for t in range(ticks + 1) if any(t in m for m in by_market)}
    expected, since = [], None
    for tick in range(ticks + 2):
        stale = largest.get(tick, 0) > 2000
        if stale and since is None:
            since = tick
        if not stale and since is not None:
            if tick - 1 - since >= hold:
                expected.append((since, since + hold, tick - 1, largest[tick - 1]))
            since = None
    found = staleness.freshness_breach(frame(spark, arrivals), at(0), at(ticks), hold)
    zero = F.lit(START.isoformat(sep=" ")).cast("timestamp").cast("long")
    seconds = [(F.col(c).cast("long") - zero).alias(c) for c in ("stale_since", "breach_from", "breach_until")]
    assert sorted(tuple(r) for r in found.select(*seconds, "lag_ms").collect()) == expected and len(expected) > 2


def test_reports_without_a_step_per_tick():
    """In several calls with the mark carried on, against the loop over ticks."""
    rng = np.random.default_rng(8)
    for _ in range(200):
        jumps = rng.choice([1000, 1000, 1000, -3000, -9000, 4000], int(rng.integers(1, 120)))
        values = np.maximum(0, np.cumsum(jumps) + int(rng.integers(0, 9000)))
        expected = [t for t, _ in looped(dict(enumerate(values.tolist())))]
        found, mark, begin = [], 0, 0
        for part in np.array_split(values, 3):
            raised, mark = stateful.raised_ticks(part, mark, 2000)
            found += (raised + begin).tolist()
            begin += len(part)
        assert found == expected
