"""Cases with known results, and the edges around them."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tests.helpers import alert, bronze_of, event, messages, processed, quote, rows_of, trade
from tickforge.contracts import RAW_TOPIC, TRADE_SCHEMA
from tickforge.operators import bronze, checks, feed, gold, live, reports, silver, vendor

T = "2026-05-07T00:00:00"


def test_lineage_chain(spark):
    rows = bronze_of(
        spark,
        [quote(1, f"{T}.100Z", 100.0, 100.04, symbol="aapl"), trade(2, f"{T}.200Z", 100.0, 10), trade(3, f"{T}.300Z", 102.0, 30)],
    )
    trades, quotes = silver.silver_trades(rows), silver.silver_quotes(rows)
    bars = gold.bars(trades)
    bar, spread, volatility = bars.first(), gold.spread_features(quotes).first(), gold.volatility_features(bars).first()
    assert quotes.first()["spread"] == 0.04 and quotes.first()["symbol"] == "AAPL"
    assert trades.agg(F.min("source_offset")).first()[0] == 2
    assert (bar["open"], bar["high"], bar["volume"], bar["vwap"]) == (100.0, 102.0, 40, 101.5)
    assert bar["first_source_offset"] == 2
    assert spread["avg_spread"] == 0.04
    assert (volatility["bar_count"], volatility["volatility_bps"]) == (1, 0.0)


def test_duplicates_gaps_and_annotations(spark):
    first = trade(1, f"{T}Z", 100.0, 10)
    rows = bronze_of(spark, [first, {**first, "price": 100.5}, trade(4, "2026-05-07T00:00:01Z", 101.0, 5), alert(4, f"{T}Z", "wide_spread")])
    trades = silver.silver_trades(rows).orderBy("sequence_number").collect()
    gaps = silver.sequence_gaps(rows)
    assert [row["price"] for row in trades] == [100.5, 101.0]
    gap = gaps.where("alert_type = 'sequence_gap'").first()
    assert (gap["expected_sequence"], gap["observed_sequence"]) == (2, 4)
    annotations = gold.quality_annotations(rows, gaps)
    found = {row["annotation_type"]: row["message"] for row in annotations.collect()}
    assert set(found) == {"duplicate_or_reordered_sequence", "sequence_gap", "wide_spread"}
    assert found["sequence_gap"] == "Expected sequence 2 but observed 4."


def test_three_trades_live(spark):
    rows = bronze_of(spark, [trade(2, f"{T}.100Z", 100.0, 10), trade(3, f"{T}.200Z", 102.0, 30), trade(4, f"{T}.300Z", 101.0, 20)])
    trades = silver.trade_rows(rows)
    bar = live.bar_updates(trades).orderBy(F.desc("sequence_number")).first()
    metrics = live.rolling_metrics(trades).orderBy(F.desc("sequence_number")).first()
    assert (bar["open"], bar["high"], bar["low"], bar["close"], bar["volume"]) == (100.0, 102.0, 100.0, 101.0, 60)
    assert math.isclose(bar["vwap"], 101.33333333333333)
    assert (metrics["sample_count"], metrics["rolling_volume"]) == (3, 60)
    assert math.isclose(metrics["rolling_vwap"], 101.33333333333333)
    returns = [math.log(102 / 100), math.log(101 / 102)]
    mean = sum(returns) / 2
    expected = math.sqrt(sum((r - mean) ** 2 for r in returns)) * 10000
    assert math.isclose(metrics["volatility_bps"], round(expected, 6))


def test_top_of_book_and_alerts(spark):
    rows = silver.quote_rows(bronze_of(spark, [quote(1, f"{T}Z", 100.0, 100.04), quote(2, f"{T}Z", 101.0, 100.5), quote(3, f"{T}Z", 10.0, 10.2)]))
    books = {row["sequence_number"]: row for row in live.top_of_book(rows, processed()).collect()}
    alerts = {row["observed_sequence"]: row for row in live.spread_alerts(rows).collect()}
    assert (books[1]["spread"], books[1]["mid_price"]) == (0.04, 100.02)
    assert books[2]["spread"] == -0.5
    assert set(alerts) == {2, 3}
    assert (alerts[2]["alert_type"], alerts[2]["severity"]) == ("crossed_market", "critical")
    assert alerts[3]["message"] == "Spread 0.2 exceeded configured threshold."


def test_tracker_works_in_arrival_order(spark):
    sent = [
        trade(1, f"{T}Z", 1.0, 1, ingest_time=f"{T}.001Z"),
        trade(3, f"{T}Z", 1.0, 1, ingest_time=f"{T}.002Z"),
        trade(2, f"{T}Z", 1.0, 1, ingest_time=f"{T}.003Z"),
        trade(4, f"{T}Z", 1.0, 1, ingest_time=f"{T}.004Z"),
    ]
    found = silver.sequence_track(bronze_of(spark, sent)).orderBy("event_time").collect()
    assert [(row["alert_type"], row["expected_sequence"], row["observed_sequence"]) for row in found] == [
        ("sequence_gap", 2, 3),
        ("duplicate_or_reordered_sequence", 4, 2),
    ]
    assert [row["message"] for row in found] == ["Expected sequence 2 but received 3.", "Received sequence 2 after 3."]


def test_open_and_close_follow_time_not_text(spark):
    sent = [trade(1, f"{T}Z", 100.0, 1), trade(2, f"{T}.100Z", 101.0, 1), trade(3, f"{T}.900000Z", 102.0, 1), trade(4, f"{T}.900Z", 103.0, 1)]
    bar = gold.bars(silver.silver_trades(bronze_of(spark, sent))).first()
    assert (bar["open"], bar["close"]) == (100.0, 103.0)


def test_raw_and_typed_topic_are_not_counted_twice(spark):
    sent = [trade(n, f"{T}Z", 1.0, 1) for n in (1, 2, 3)]
    both = messages(spark, sent).unionByName(messages(spark, sent, RAW_TOPIC))
    rows = bronze.bronze_rows(both)
    assert silver.sequence_gaps(rows).count() == 0
    assert silver.sequence_gaps(rows, source_topics=None).count() == 3
    assert silver.silver_trades(rows).count() == 3


def test_zero_volume_falls_back_to_price(spark):
    trades = silver.trade_rows(bronze_of(spark, [trade(1, f"{T}Z", 50.0, 0)]))
    assert gold.bars(trades).first()["vwap"] == 50.0
    assert live.bar_updates(trades).first()["vwap"] == 50.0
    assert live.rolling_metrics(trades).first()["rolling_vwap"] == 50.0


def test_bad_messages_are_kept_apart(spark):
    sent = ["{not json", '{"event_type":"trade"}', '{"schema_version":"1.0"}', "", trade(1, f"{T}Z", 1.0, 1)]
    found = messages(spark, sent)
    assert bronze.bronze_rows(found).count() == 1
    rejects = {row["source_offset"]: row["reason"] for row in bronze.bronze_rejects(found).collect()}
    assert rejects == {1: "malformed_json", 2: "missing_schema_version", 3: "missing_event_type", 4: "malformed_json"}


def test_bad_timestamp_is_null_not_an_error(spark):
    row = bronze_of(spark, [trade(1, "yesterday", 1.0, 1)]).first()
    assert row["event_time"] is None and row["event_date"] is None


def test_sequence_numbers_beyond_32_bits(spark):
    big = 5_000_000_000
    rows = bronze_of(spark, [trade(big, f"{T}Z", 1.0, big), trade(big + 2, f"{T}Z", 1.0, big)])
    assert silver.sequence_gaps(rows).first()["expected_sequence"] == big + 1
    assert gold.bars(silver.silver_trades(rows)).first()["volume"] == 2 * big


def test_empty_input_gives_empty_tables(spark):
    rows = bronze_of(spark, [])
    trades = silver.silver_trades(rows)
    bars = gold.bars(trades)
    for df in (trades, silver.sequence_gaps(rows), bars, gold.volatility_features(bars), live.rolling_metrics(silver.trade_rows(rows))):
        assert df.count() == 0
    report = reports.quality_report({"silver_trades": trades}).first()
    assert (report["row_count"], report["min_event_date"]) == (0, None)


def test_feed_rejections(spark):
    good = {"event_type": "trade", "symbol": "aapl", "exchange": "XNAS", "event_time": f"{T}Z", "sequence_number": 7, "price": 1.5, "size": 2}
    sent = [
        good,
        {**good, "event_type": "halt"},
        {k: v for k, v in good.items() if k not in ("price", "exchange")},
        {k: v for k, v in good.items() if k != "event_type"},
        {**good, "price": "dear"},
        "{",
        {**good, "trade_id": ""},
    ]
    checked = feed.feed_checked(messages(spark, sent))
    found = {row["offset"]: row["message"] for row in feed.validation_alerts(checked).collect()}
    assert found == {
        2: "Unsupported event_type 'halt'",
        3: "Missing required fields: ['exchange', 'price']",
        4: "Unsupported event_type None",
        5: "Invalid value for price",
        6: "Malformed JSON",
    }
    trades = {row["offset"]: row for row in feed.canonical_trades(checked).collect()}
    assert set(trades) == {1, 7} and trades[1]["symbol"] == "AAPL" and trades[1]["conditions"] == []
    again = {row["offset"]: row for row in feed.canonical_trades(feed.feed_checked(messages(spark, sent))).collect()}
    assert len(trades[7]["trade_id"]) == 64 and trades[7]["trade_id"] == again[7]["trade_id"]


def test_contract_rules(spark):
    good = trade(1, f"{T}Z", 1.5, 2)
    sent = [
        good,
        {**good, "price": 0},
        {**good, "size": 1.5},
        {**good, "sequence_number": -1, "extra": 1},
        {**good, "schema_version": "2.0", "symbol": 5},
        {**good, "event_time": "soon"},
        {**good, "conditions": ["a"], "trade_id": None},
        "[1]",
    ]
    found = {row["offset"]: row["violations"] for row in checks.contract_violations(messages(spark, sent), "trade").collect()}
    assert found == {
        1: [],
        2: ["exclusiveMinimum:price"],
        3: ["type:size"],
        4: ["minimum:sequence_number", "unknown:extra"],
        5: ["const:schema_version", "type:symbol"],
        6: ["format:event_time"],
        7: ["type:trade_id"],
        8: ["malformed"],
    }


def test_derived_events_meet_their_contracts(spark):
    from tickforge.sources.topics import as_messages

    rows = bronze_of(spark, [quote(1, f"{T}.1Z", 100.0, 100.04), trade(2, f"{T}.2Z", 100.0, 10), trade(3, f"{T}.3Z", 102.0, 30)])
    quotes, trades = silver.quote_rows(rows), silver.trade_rows(rows)
    for name, df in {
        "top_of_book": live.top_of_book(quotes, processed()),
        "bar_1s": live.bar_updates(trades),
        "rolling_metrics": live.rolling_metrics(trades),
    }.items():
        sent = as_messages(df, name, [c for c in df.columns if c not in live.SOURCE])
        assert [row["violations"] for row in checks.contract_violations(sent, name).collect()] == [[]] * df.count()
    alerts = live.spread_alerts(silver.quote_rows(bronze_of(spark, [quote(1, f"{T}Z", 2.0, 1.0)])))
    text = alerts.select(F.to_json(F.struct(*alerts.columns)).alias("value"))
    assert checks.contract_violations(text, "quality_alert").first()["violations"] == []


def test_newest_bar_and_metrics_are_the_last_rows_of_the_scans(spark):
    """On given events with late and repeated trades on two exchanges, at several times."""
    from tests.helpers import rows_of
    from tickforge.plans import market

    trades = silver.trade_rows(market.bronze(spark, "/root/testdata/sf0.001", hot=False)).persist()
    for until in ("2024-01-01 00:00:30", "2024-01-01 00:01:30", "2025-01-01"):
        seen = trades.where(F.col("ingest_time") <= F.lit(until).cast("timestamp"))
        shown = lambda df: rows_of(df.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]))
        assert shown(live.newest_bar(seen)) == shown(live.newest(live.bar_updates(seen, hot=False), ["symbol"]))
        assert shown(live.newest_metrics(seen, 5)) == shown(live.newest(live.rolling_metrics(seen, 5, hot=False), ["symbol"]))
    plan = live.newest_metrics(trades)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1


def test_latest_state_expiry_and_snapshot(spark):
    rows = bronze_of(spark, [quote(1, f"{T}Z", 100.0, 100.04), quote(2, f"{T}.5Z", 101.0, 101.04), trade(3, f"{T}Z", 100.0, 10)])
    quotes, trades = silver.quote_rows(rows), silver.trade_rows(rows)
    state = live.latest_state({"top_of_book": live.top_of_book(quotes, processed()), "bar_1s": live.bar_updates(trades)})
    alerts = live.spread_alerts(quotes)
    soon, late = (F.lit(f"2026-05-07 00:0{m}:00").cast("timestamp") for m in (1, 5))
    shot = live.symbol_snapshot(state, alerts, live.active_symbols(quotes), soon).first()
    assert '"sequence_number":2' in shot["top_of_book"] and shot["metrics"] is None
    gone = live.symbol_snapshot(state, alerts, live.active_symbols(quotes), late).first()
    assert gone["symbol"] == "AAPL" and gone["top_of_book"] is None


def test_alert_list_expires_and_is_bounded(spark):
    sent = [alert(n, f"2026-05-07T00:00:{n:02d}Z", "wide_spread") for n in range(1, 31)]
    from tickforge.contracts import ALERT_SCHEMA

    rows = bronze.payload(bronze_of(spark, sent), "quality_alert", ALERT_SCHEMA)
    alerts = feed.quality_alert_rows(rows.select("symbol", "exchange", "event_time", "payload.*"))
    at = lambda text: F.lit(text).cast("timestamp")
    kept = live.recent_alerts(alerts.unionByName(alerts), as_of=at("2026-05-07 00:10:00"))
    assert kept.count() == 25 and kept.agg(F.min("observed_sequence")).first()[0] == 6
    assert live.recent_alerts(alerts, as_of=at("2026-05-07 01:00:31")).count() == 0


NS = 1_700_000_000_123_456_789


def vendor_rows(spark, *records):
    base = {name: None for name in vendor.RECORD_SCHEMA.fieldNames()}
    rows = [tuple({**base, "record_id": n, "ts_event": NS + n, **record}.values()) for n, record in enumerate(records)]
    return spark.createDataFrame(rows, vendor.RECORD_SCHEMA)


def test_vendor_records(spark):
    mapping = {"record_type": "SymbolMappingMsg", "instrument_id": 101, "stype_in_symbol": "ES.FUT", "stype_out_symbol": "123456"}
    book = {
        "record_type": "MBP1Msg", "instrument_id": 101, "sequence": 42, "pretty_price": 4550.25, "size": 3, "action": "T", "side": "B",
        "levels": [(4550.0, 4550.25, 12, 8)],
    }
    bare = {"record_type": "TradeMsg", "instrument_id": 101, "sequence": 43, "pretty_price": 4550.5, "size": 2, "action": "T", "side": "A"}
    early = {**bare, "sequence": 1}
    records = vendor_rows(spark, early, mapping, book, bare, {**book, "levels": [(0.0, 1.0, 1, 1)], "action": "A"}, {**bare, "instrument_id": None})
    found = vendor.vendor_events(records, "GLBX").orderBy("record_id", "part").collect()
    assert [(row["record_id"], row["event_type"], row["symbol"]) for row in found] == [
        (0, "trade", "INSTRUMENT_101"),
        (2, "quote", "ES.FUT"),
        (2, "trade", "ES.FUT"),
        (3, "trade", "ES.FUT"),
        (5, "trade", "UNKNOWN"),
    ]
    assert (found[1]["bid_price"], found[1]["ask_size"], found[2]["price"], found[2]["sequence_number"]) == (4550.0, 8, 4550.25, 42)
    assert found[2]["conditions"] == ["B", "action=T"]


def test_percentile_is_the_nearest_element(spark):
    rows = [("a", float(v), dt.datetime(2026, 5, 7, 0, 0, v % 60)) for v in range(1, 101)] + [("b", 5.0, dt.datetime(2026, 5, 7))]
    df = spark.createDataFrame(rows, "tool string, ms double, at timestamp")
    found = {row["tool"]: row for row in reports.latency_summary(df, ["tool"], "ms", "at").collect()}
    assert (found["a"]["p95"], found["a"]["p99"], found["a"]["mean"]) == (95.0, 99.0, 50.5)
    assert (found["b"]["p95"], found["b"]["per_second"]) == (5.0, None)


def test_decode_keeps_other_columns(spark):
    decoded = bronze.raw_event_decode(bronze_of(spark, [trade(1, f"{T}Z", 1.5, 2)]), TRADE_SCHEMA).first()
    assert (decoded["price"], decoded["symbol"]) == (1.5, "AAPL")


def test_late_trade_changes_its_own_bar(spark):
    sent = [
        trade(1, f"{T}.100Z", 10.0, 1, ingest_time=f"{T}.100Z"),
        trade(2, "2026-05-07T00:00:01Z", 20.0, 1, ingest_time="2026-05-07T00:00:01Z"),
        trade(3, f"{T}.200Z", 30.0, 1, ingest_time="2026-05-07T00:00:02Z"),
    ]
    found = live.bar_updates(silver.trade_rows(bronze_of(spark, sent))).orderBy("ingest_time").collect()
    assert [(row["open"], row["close"], row["volume"]) for row in found] == [(10.0, 10.0, 1), (20.0, 20.0, 1), (10.0, 30.0, 2)]


def test_halt_is_not_a_market_event(spark):
    rows = bronze_of(spark, [event("halt", 1, f"{T}Z"), trade(2, f"{T}Z", 1.0, 1)])
    assert silver.silver_trades(rows).count() == 1 and silver.sequence_gaps(rows).count() == 0
    assert rows_of(rows.select("event_type")) == [("halt",), ("trade",)]
