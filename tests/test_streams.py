"""Streams fed in several micro-batches, restarted, or repeated, against the batch."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from tests.helpers import alert, event, messages, quote, rows_of, trade
from tickforge.contracts import ALERTS_TOPIC, BARS_TOPIC, TOP_OF_BOOK_TOPIC
from tickforge.operators import gold, live, silver, vendor
from tickforge.operators.bronze import bronze_rows
from tickforge.operators.feed import quality_alert_rows
from tickforge.plans import market
from tickforge.session import scratch_path
from tickforge.sources import topics
from tickforge.streaming import hot_state, jobs, sinks, snapshots, stateful


T = "2026-05-07T00:00:00"


@pytest.fixture(scope="module")
def sent(spark):
    """All messages of the small tables, cut into four files in arrival order."""
    place = scratch_path(spark, "sent")
    all_messages = market.typed_messages(spark, "/root/testdata/sf0.001", hot=False).persist()
    cuts = all_messages.selectExpr("approx_percentile(unix_micros(timestamp), array(0.25, 0.5, 0.75)) AS at").first()["at"]
    bounds = [None, *cuts, None]
    at = F.unix_micros("timestamp")
    for low, high in zip(bounds, bounds[1:]):
        part = all_messages.where((at > low) if low is not None else F.lit(True)).where((at <= high) if high is not None else F.lit(True))
        topics.write_topic(part.coalesce(1), "mixed", path=place)
        time.sleep(1.1)  # files are taken in order of their modification time
    return place, all_messages


def stream(spark, place, per_trigger=1):
    return topics.read_topics(spark, ("mixed",), "json", path=place, per_trigger=per_trigger)


def finish(df, place, name):
    jobs.run_available(df, f"{place}/{name}", f"{place}/{name}_checkpoint").awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{place}/{name}")


def test_sequence_track_over_batches(spark, sent):
    place, all_messages = sent
    found = finish(stateful.sequence_track_stream(stream(spark, place)), place, "track")
    assert rows_of(found) == rows_of(quality_alert_rows(silver.sequence_track(bronze_rows(all_messages), hot=False)))


def test_rolling_metrics_over_batches(spark, sent):
    place, all_messages = sent
    found = finish(stateful.rolling_metrics_stream(stream(spark, place), prices=10), place, "rolling")
    batch = live.rolling_metrics(silver.trade_rows(bronze_rows(all_messages)), prices=10, hot=False)
    shown = [F.round(name, 5).alias(name) if kind == "double" else F.col(name) for name, kind in batch.dtypes]
    assert rows_of(found.select(*shown)) == rows_of(batch.select(*shown))


def test_bars_over_batches(spark, sent):
    place, all_messages = sent
    bars = jobs.bar_stream(stream(spark, place), watermark="10 minutes")
    latest = snapshots.LatestRows(spark, f"{place}/bars", ["symbol", "exchange", "event_time"])
    jobs.each_batch(bars, latest.write, f"{place}/bars_checkpoint", output="update").awaitTermination()
    batch = gold.bars(silver.trade_rows(bronze_rows(all_messages)))
    fields = ["symbol", "exchange", "open", "high", "low", "close", "volume"]
    assert rows_of(latest.read().select(*fields)) == rows_of(batch.select(*fields))


def test_late_trades_change_their_bar_or_are_counted(spark):
    place = scratch_path(spark, "late")
    on_time = [trade(1, "2026-05-07T00:00:00.1Z", 10.0, 1), trade(2, "2026-05-07T00:10:00Z", 11.0, 2)]
    late = [trade(3, "2026-05-07T00:00:00.9Z", 12.0, 5)]
    for values in (on_time, [trade(4, "2026-05-07T00:20:00Z", 13.0, 1)], late):
        topics.write_topic(messages(spark, values).coalesce(1), "mixed", path=place)
        time.sleep(1.1)
    volumes, dropped, listener = {}, {}, jobs.DroppedRows()
    spark.streams.addListener(listener)
    for watermark in (None, "10 seconds"):
        latest = snapshots.LatestRows(spark, f"{place}/bars-{watermark}", ["symbol", "exchange", "event_time"])
        query = jobs.each_batch(jobs.bar_stream(stream(spark, place), watermark), latest.write, f"{place}/c-{watermark}", output="update")
        query.awaitTermination()
        volumes[watermark] = {r.event_time.minute: r.volume for r in latest.read().collect()}
        deadline = time.time() + 20  # the listener is told afterwards
        while watermark and not listener.by_query[str(query.id)] and time.time() < deadline:
            time.sleep(0.2)
        dropped[watermark] = listener.by_query[str(query.id)]
    spark.streams.removeListener(listener)
    assert volumes[None] == {0: 6, 10: 2, 20: 1} and dropped[None] == 0
    assert volumes["10 seconds"] == {0: 1, 10: 2, 20: 1} and dropped["10 seconds"] == 1


def test_bars_close_and_free_their_state(spark):
    """Batch after batch the closed bars and the late trades are all trades; the state does not grow."""
    place, sent, sizes = scratch_path(spark, "closing"), [], []
    outputs = sinks.SplitTables(f"{place}/out", ("bar", "late"))
    for batch in range(4):
        values = [trade(100 * batch + n, f"2026-05-07T00:{10 * batch:02d}:{n:02d}.5Z", 10.0 + n, 1) for n in range(30)]
        values += [trade(100 * batch + 50, f"2026-05-07T00:{10 * batch:02d}:05.7Z", 3.0, 2)]  # in time, out of order
        values += [trade(100 * batch + 60, "2026-05-07T00:00:02.1Z", 9.0, 5)]  # late from the second batch on
        sent += values
        topics.write_topic(messages(spark, values).coalesce(1), "mixed", path=f"{place}/topics")
        query = jobs.each_batch(stateful.closing_bar_stream(stream(spark, f"{place}/topics"), "10 seconds"), outputs.write, f"{place}/checkpoint")
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    bars, late = ({r.event_time: r for r in outputs.read(spark, k).collect()} if k == "bar" else outputs.read(spark, k).collect() for k in ("bar", "late"))
    assert [(r.sequence_number, r.close, r.volume) for r in sorted(late, key=lambda r: r.sequence_number)] == [(100 * b + 60, 9.0, 5) for b in (1, 2, 3)]
    closed = [v for v in sent if v["sequence_number"] % 100 != 60 or v["sequence_number"] < 100]
    open_still = [v for v in closed if v["event_time"] > "2026-05-07T00:30:19"]
    assert sum(r.trade_count for r in bars.values()) == len(closed) - len(open_still)
    assert sum(r.volume for r in bars.values()) == sum(v["size"] for v in closed) - sum(v["size"] for v in open_still)
    second = bars[dt.datetime(2026, 5, 7, 0, 0, 5)]
    assert (second.open, second.close, second.low, second.volume, second.trade_count) == (15.0, 3.0, 3.0, 3, 2)
    assert len(set(sizes)) == 1


def test_mappings_over_batches(spark):
    """Four micro-batches in order of time against the batch; a late record still gets the mapping before it."""
    place, records = scratch_path(spark, "vendor"), market.vendor_records(spark, "/root/testdata/sf0.001").persist()
    cuts = records.selectExpr("percentile_approx(ts_event, array(0.25, 0.5, 0.75)) AS at").first().at
    for low, high in zip([-1, *cuts], [*cuts, 1 << 62]):
        records.where(f"ts_event > {low} AND ts_event <= {high}").coalesce(1).write.mode("append").parquet(f"{place}/in")
        time.sleep(1.1)
    late = records.where(f"ts_event <= {cuts[0]} AND record_type <> 'SymbolMappingMsg'")
    late.coalesce(1).write.mode("append").parquet(f"{place}/in")
    sent = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    found = finish(stateful.symbol_resolution_stream(sent), place, "resolved").select("record_id", "resolved_symbol", "levels")
    batch = vendor.symbol_resolution(records, hot=False)
    again = batch.join(late.select("record_id"), "record_id", "left_semi")
    assert rows_of(found) == rows_of(batch.unionByName(again).select("record_id", "resolved_symbol", "levels"))


def test_restart_continues_where_it_stopped(spark, sent):
    place, all_messages = sent
    grown = scratch_path(spark, "grown")
    half = F.unix_micros("timestamp") % 2 == 0
    for part in (half, ~half):
        topics.write_topic(all_messages.where(part).coalesce(1), "mixed", path=grown)
        jobs.bronze_ingest(
            stream(spark, grown), f"{grown}/bronze", f"{grown}/checkpoint", processed_at=market.processed_at()
        ).awaitTermination()
    table = spark.read.parquet(f"{grown}/bronze")
    assert table.count() == all_messages.count()
    assert "event_date" in table.columns and table.where("event_type = 'trade'").inputFiles()


def test_hot_state_is_the_same_when_a_batch_comes_twice(spark, sent):
    place, all_messages = sent
    half = F.unix_micros("timestamp") % 2 == 0
    as_of = F.lit("2024-01-01 00:03:05").cast("timestamp")
    once, twice = (hot_state.HotState(spark, scratch_path(spark, "state"), as_of) for _ in range(2))
    once.upsert(all_messages, 0)
    twice.upsert(all_messages.where(half), 0)
    twice.upsert(all_messages.where(~half), 1)
    twice.upsert(all_messages.where(~half), 1)
    assert {row.state_kind for row in once.read().collect()} == {"latest_quote", "freshness", "alerts"}
    assert list(twice.finished()) == [0, 1]
    assert rows_of(once.read()) == rows_of(twice.read())
    assert once.read(dt.datetime(2030, 1, 1)).count() == 0


def alert_texts(spark, times):
    return messages(spark, [alert(n, t, "wide_spread") for n, t in enumerate(times, 1)], ALERTS_TOPIC)


def test_alert_lists_merge_are_bounded_and_end(spark):
    """Three batches, one of them twice, against a list kept in Python: newest 25, none from before a pause of an hour."""
    times = [f"2026-05-07T00:{n:02d}:00Z" for n in range(40)]
    sent = alert_texts(spark, times + ["2026-05-07T00:39:00Z"]).persist()
    state = hot_state.HotState(spark, scratch_path(spark, "lists"))
    number = F.col("offset")
    for batch, part in enumerate((number <= 10, (number > 25) & (number <= 41), (number > 10) & (number <= 25))):
        state.upsert(sent.where(part), batch)
        state.upsert(sent.where(part), batch)
    (row,) = state.read().collect()
    listed = [x["sequence_number"] for x in json.loads(row.payload)]
    assert listed == [41, 40, *range(39, 16, -1)] and row.expires_at.hour == 1

    later = alert_texts(spark, ["2026-05-07T01:38:59Z"]).withColumn("offset", F.lit(50))
    assert len(json.loads(_after(spark, sent, later)[0].payload)) == 25
    later = alert_texts(spark, ["2026-05-07T01:39:00Z"]).withColumn("offset", F.lit(50))
    assert len(json.loads(_after(spark, sent, later)[0].payload)) == 1
    assert state.read(dt.datetime(2026, 5, 7, 1, 38, 59)).count() == 1
    assert state.read(dt.datetime(2026, 5, 7, 1, 39)).count() == 0


def _after(spark, first, second):
    state = hot_state.HotState(spark, scratch_path(spark, "lists"))
    state.upsert(first, 0)
    state.upsert(second, 1)
    return state.read().collect()


def test_state_as_it_was(spark):
    """Versions are read by time, and only as many stay as asked for."""
    state = hot_state.HotState(spark, scratch_path(spark, "history"), keep=None)
    for batch, second in enumerate((1, 2, 5)):
        text = f"2026-05-07T00:00:0{second}Z"
        state.upsert(messages(spark, [quote(second, text, 1.0, 1.1)]).withColumn("timestamp", F.lit(text).cast("timestamp")), batch)
    at = lambda s: {r.sequence_number for r in state.read(dt.datetime(2026, 5, 7, 0, 0, s)).collect()}
    assert [at(0), at(1), at(2), at(4), at(5)] == [set(), {1}, {2}, {2}, {5}]
    state.keep = 2
    state.upsert(messages(spark, [quote(7, "2026-05-07T00:00:07Z", 1.0, 1.1)]), 3)
    assert list(state.finished()) == [2, 3]


def test_rebuild_from_offsets(spark):
    """A rebuild reads the given offsets alone, the dry run counts the same messages."""
    place = scratch_path(spark, "log")
    books = [event("top_of_book", n, f"{T}Z", symbol=s, processed_time=f"{T}Z", bid_price=float(n)) for n, s in ((1, "AAPL"), (2, "AAPL"), (3, "MSFT"))]
    topics.write_topic(messages(spark, books, TOP_OF_BOOK_TOPIC), TOP_OF_BOOK_TOPIC, path=place)
    topics.write_topic(messages(spark, [event("bar_1s", 4, f"{T}Z", open=1.0)], BARS_TOPIC), BARS_TOPIC, path=place)
    topics.write_topic(alert_texts(spark, [f"{T}Z"]), ALERTS_TOPIC, path=place)
    log = lambda **r: topics.read_offsets(spark, {TOP_OF_BOOK_TOPIC: r.get("books"), BARS_TOPIC: None, ALERTS_TOPIC: None}, "json", path=place)
    found = {(r.state_kind, r.symbol): r for r in hot_state.rebuilt_state(log()).collect()}
    assert found.keys() == {("top_of_book", "AAPL"), ("top_of_book", "MSFT"), ("freshness", "AAPL"), ("freshness", "MSFT"), ("bar_1s", "AAPL"), ("alerts", "AAPL")}
    assert json.loads(found["freshness", "AAPL"].payload)["status"] == "rebuilt" and found["top_of_book", "AAPL"].sequence_number == 2
    assert {k for _, k in ((r.state_kind, r.symbol) for r in hot_state.rebuilt_state(log(), "msft").collect())} == {"MSFT"}
    part = log(books={0: (1, 2)})
    assert {r.sequence_number for r in hot_state.rebuilt_state(part).where("state_kind = 'top_of_book'").collect()} == {1}
    counts = lambda m, *s: {r.state_kind: r.event_count for r in hot_state.rebuild_counts(m, *s).collect()}
    assert counts(log()) == {"top_of_book": 3, "bar_1s": 1, "alerts": 1}
    assert counts(part) == {"top_of_book": 1, "bar_1s": 1, "alerts": 1} and counts(log(), "msft") == {"top_of_book": 1}


def test_stale_monitor_reports_old_quotes(spark):
    place = scratch_path(spark, "stale")
    topics.write_topic(messages(spark, [quote(1, "2026-05-07T00:00:00Z", 1.0, 1.1)]), "mixed", path=place)
    alerts = stateful.stale_monitor_stream(topics.read_topics(spark, ("mixed",), "json", path=place), tick_ms=200)
    query = (
        alerts.writeStream.format("memory").queryName("stale_alerts_seen").outputMode("append")
        .option("checkpointLocation", f"{place}/checkpoint").trigger(processingTime="500 milliseconds").start()
    )
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("stale_alerts_seen").count() < 2:
            assert query.exception() is None
            time.sleep(1)
    finally:
        query.stop()
    found = spark.table("stale_alerts_seen").collect()
    assert len(found) >= 2 and {row["alert_type"] for row in found} == {"stale_symbol"}
    assert found[0]["message"].startswith("AAPL freshness lag is ")


def test_topic_sink_replaces_a_repeated_batch(spark):
    place = scratch_path(spark, "sink")
    sink = sinks.TopicSink("derived", path=place)
    sent = messages(spark, [quote(n, "2026-05-07T00:00:00Z", 1.0, 1.1) for n in (1, 2)])
    for batch in (0, 1, 1):
        sink.write(sent, batch)
    back = topics.read_topics(spark, ("derived",), "json", streaming=False, path=place)
    assert back.count() == 4 and back.where("timestamp IS NULL").count() == 0
