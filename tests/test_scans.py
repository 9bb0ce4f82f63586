"""The two ways through an ordered scan give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows_of
from tickforge.functions.scans import Running, is_hot, running, trailing
from tickforge.operators import gold, live, reports, silver, vendor
from tickforge.plans import documents, market
from tickforge.plans.queries import Market


@pytest.fixture(scope="module")
def numbers(spark):
    """One key with half of the rows, a NULL key, many equal order values, NULL values."""
    rng = random.Random(7)
    rows = [
        (rng.choice(["hot", "hot", "hot", None, "k1", "k2"]), rng.randint(0, 30), i, None if rng.random() < 0.2 else rng.randint(-9, 9))
        for i in range(900)
    ]
    return spark.createDataFrame(rows, "k string, t int, id int, v long").persist()


def runs():
    return {
        f"{kind}_{'before' if before else 'upto'}": Running(kind, F.col("v"), before)
        for kind in ("sum", "max", "min", "first", "last")
        for before in (False, True)
    }


def test_largest_key_decides(numbers, small_tasks):
    assert is_hot(numbers, ["k"])
    assert not is_hot(numbers, ["k"], 10_000)
    assert not is_hot(numbers.limit(0), ["k"])


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_in_tiles_equals_one_window(numbers, small_tasks, keys):
    plain = running(numbers, keys, ["t", "id"], runs(), hot=False)
    tiled = running(numbers, keys, ["t", "id"], runs(), hot=True)
    assert rows_of(plain) == rows_of(tiled)


@pytest.mark.parametrize("rows", [1, 5, 39, 119])
def test_trailing_in_blocks_equals_one_window(numbers, small_tasks, rows):
    aggregates = {"total": F.sum("v"), "n": F.count("v")}
    plain = trailing(numbers, ["k"], ["t", "id"], rows, aggregates, hot=False)
    blocks = trailing(numbers, ["k"], ["t", "id"], rows, aggregates, hot=True)
    assert rows_of(plain) == rows_of(blocks)


OPERATORS = {
    "sequence_gaps": lambda m, hot: silver.sequence_gaps(m.bronze, hot=hot),
    "sequence_track": lambda m, hot: silver.sequence_track(m.bronze, hot=hot),
    "bar_updates": lambda m, hot: live.bar_updates(m.trade_rows, hot=hot),
    "rolling_metrics": lambda m, hot: live.rolling_metrics(m.trade_rows, prices=20, hot=hot),
    "signal_frame": lambda m, hot: gold.signal_frame(m.features, hot=hot),
    "symbol_resolution": lambda m, hot: vendor.symbol_resolution(m.records, hot=hot),
    "latency_summary": lambda m, hot: reports.latency_summary(
        documents.audit_log(m.spark, m.sf_dir), ["tool_name"], "latency_ms", "timestamp", hot=hot
    ),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_agree_both_ways(spark, sf_dir, small_tasks, name):
    m = Market(spark, sf_dir)
    m.hot = False
    assert rows_of(OPERATORS[name](m, False)) == rows_of(OPERATORS[name](m, True))


def test_projection_agrees_both_ways(spark, sf_dir, small_tasks):
    plain = market.market_events(spark, sf_dir, hot=False)
    assert rows_of(plain) == rows_of(market.market_events(spark, sf_dir, hot=True))
