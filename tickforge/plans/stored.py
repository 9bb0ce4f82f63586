"""Registered queries that write under the shared folder and read back: sinks, tables
and streams run to the end of what the given tables hold."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tickforge.contracts import ALERTS_TOPIC, BARS_TOPIC, METRICS_TOPIC, QUOTES_TOPIC, RAW_FEED_TOPIC, RAW_TOPIC, TOP_OF_BOOK_TOPIC, TRADES_TOPIC
from tickforge.operators import feed, gold, live, reports, silver, vectors
from tickforge.plans import documents, market
from tickforge.plans.queries import DAY, Market, end, start, written
from tickforge.session import ROCKSDB_STATE, scratch_path
from tickforge.sources import folders, tables, topics
from tickforge.streaming import hot_state, jobs, sinks, snapshots, stateful

MIXED = "mixed"
AS_OF = [dt.datetime.fromisoformat(f"{DAY}T{text}+00:00") for text in ("00:01:00", "00:02:15")]


def _place(m: Market, name: str) -> str:
    return scratch_path(m.spark, name)


def _stored(m: Market, messages: DataFrame, place: str) -> DataFrame:
    """Messages written as JSON files and read back as a stream."""
    topics.write_topic(messages, MIXED, path=place)
    return topics.read_topics(m.spark, (MIXED,), "json", path=place)


def _streamed(m: Market, name: str, build, messages: DataFrame | None = None) -> DataFrame:
    """Run a stream over the messages into a table and read that table."""
    m.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_STATE)
    place = _place(m, name)
    stream = build(_stored(m, m.messages if messages is None else messages, f"{place}/topics"))
    jobs.run_available(stream, f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return m.spark.read.schema(stream.schema).parquet(f"{place}/out")


def _bronze_ingest(m: Market) -> DataFrame:
    place = _place(m, "bronze")
    stream = _stored(m, m.messages, f"{place}/topics")
    jobs.bronze_ingest(stream, f"{place}/table", f"{place}/checkpoint", market.RUN_ID, market.processed_at()).awaitTermination()
    return m.spark.read.parquet(f"{place}/table").drop("raw_event")


def _bars(m: Market) -> DataFrame:
    """Bars as they stand at the end of the stream, the open ones too."""
    m.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_STATE)
    place = _place(m, "bars")
    stream = jobs.bar_stream(_stored(m, m.messages, f"{place}/topics"))
    latest = snapshots.LatestRows(m.spark, f"{place}/bars", ["symbol", "exchange", "event_time"])
    jobs.each_batch(stream, latest.write, f"{place}/checkpoint", output="update").awaitTermination()
    return latest.read().select(*stream.columns)


LATE_CUTS = ("00:00:40", "00:01:20", "00:02:00")
LATE_DELAY_MS = 2000


def _late_trades(m: Market) -> DataFrame:
    """Closed bars and late trades of a stream in four batches, cut by arrival.

    The stream stops after each part and goes on from its checkpoint, so that a part is one batch of any number of files.
    """
    m.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_STATE)
    place = _place(m, "closing")
    messages, cuts = written(m.messages, f"{place}/messages"), [None, *(F.lit(f"{DAY} {cut}").cast("timestamp") for cut in LATE_CUTS), None]
    tables_of = sinks.SplitTables(f"{place}/out", ("bar", "late"))
    for after, until in zip(cuts, cuts[1:]):
        part = messages if after is None else messages.where(F.col("timestamp") > after)
        sent = _stored(m, part if until is None else part.where(F.col("timestamp") <= until), f"{place}/topics")
        closing = stateful.closing_bar_stream(sent, f"{LATE_DELAY_MS} milliseconds")
        jobs.each_batch(closing, tables_of.write, f"{place}/checkpoint").awaitTermination()
    return tables_of.read(m.spark, "bar").unionByName(tables_of.read(m.spark, "late"))


def _symbol_stream(m: Market) -> DataFrame:
    """Vendor records in three micro-batches, in order of their time; each is a run of the stream from its checkpoint."""
    m.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_STATE)
    place = _place(m, "vendor")
    records = written(m.records, f"{place}/all")
    third = [F.lit(x) for x in records.selectExpr("percentile_approx(ts_event, array(0.33, 0.67)) AS at").first().at]
    for low, high in zip([None, *third], [*third, None]):
        part = records if low is None else records.where(F.col("ts_event") > low)
        (part if high is None else part.where(F.col("ts_event") <= high)).write.mode("append").parquet(f"{place}/records")
        resolved = stateful.symbol_resolution_stream(m.spark.readStream.schema(records.schema).parquet(f"{place}/records"))
        jobs.run_available(resolved, f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return m.spark.read.schema(resolved.schema).parquet(f"{place}/out").select("record_id", "instrument_id", "resolved_symbol")


def _table_overwrite(m: Market) -> DataFrame:
    """Write trades by date, then replace one date by one symbol's trades, and read all back."""
    store = tables.TableStore(m.spark, _place(m, "lakehouse"))
    store.overwrite(m.trades, "silver_trades")
    one = reports.event_date_filter(m.trades, DAY).where(F.col("symbol") == "SYM05")
    store.overwrite(one, "silver_trades", only_present_partitions=True)
    return store.read("silver_trades")


def _table_read(m: Market) -> DataFrame:
    store = tables.TableStore(m.spark, _place(m, "lakehouse"))
    store.overwrite(m.quotes, "silver_quotes")
    return gold.spread_features(store.read("silver_quotes"))


def _table_append(m: Market) -> DataFrame:
    """Two runs of the report in one table, the first of them repeated; the tables it reports on are stored."""
    m, store = m.settled(), tables.TableStore(m.spark, _place(m, "lakehouse"))
    path = f"{store.base_path}/reports/quality"
    shown = {"silver_trades": written(m.trades, _place(m, "trades")), "silver_quotes": written(m.quotes, _place(m, "quotes"))}
    for run in ("run-1", "run-2", "run-1"):
        store.append(reports.quality_report(shown, DAY, run, market.processed_at()), path, run)
    return store.read_appended(path)


def _replay_output(m: Market) -> DataFrame:
    store = tables.TableStore(m.spark, _place(m, "lakehouse"))
    return store.read_path(store.replay_output(reports.replay_dry_run(m.bronze, DAY), DAY))


def _register_table(m: Market) -> DataFrame:
    place = _place(m, "lakehouse")
    store = tables.TableStore(m.spark, place)
    store.overwrite(m.bars, "gold_bars_1s")
    name = store.register("gold_bars_1s", "research_" + place.rsplit("-", 1)[-1])
    return m.spark.sql(f"SELECT symbol, exchange, count(*) AS bar_count, sum(volume) AS volume FROM {name} GROUP BY symbol, exchange")


def _index(m: Market) -> DataFrame:
    path = _place(m, "index")
    tables.save_index(vectors.with_embedding(documents.turn_chunks(m.spark, m.sf_dir)), path)
    return tables.load_index(m.spark, path).select("source_uri", "chunk_index", F.size("embedding").alias("slots"))


def _chunk_upsert(m: Market) -> DataFrame:
    """Index all notes, then index those with front matter again with another title."""
    index = folders.BucketedIndex(m.spark, _place(m, "chunks"))
    chunks = documents.note_chunks(m.spark, m.sf_dir).drop("tags")
    index.upsert(chunks.withColumn("indexed_at", start()))
    index.upsert(chunks.where("title LIKE 'Note %'").withColumn("title", F.concat(F.lit("New "), "title")).withColumn("indexed_at", end()))
    return index.read().select("source_uri", "chunk_index", "title", "indexed_at", F.md5("content").alias("content_md5"))


def _audit(m: Market) -> DataFrame:
    path = _place(m, "audit")
    calls = documents.audit_log(m.spark, m.sf_dir)
    failed = F.col("result_status") == "error"
    for batch, part in (("errors", calls.where(failed)), ("others", calls.where(~failed)), ("errors", calls.where(failed))):
        tables.append_audit(part, path, batch)
    return tables.read_audit(m.spark, path).groupBy("tool_name", "result_status").agg(
        F.count(F.lit(1)).alias("call_count"), F.sum("duration_ms").alias("duration_ms")
    )


def _placed(alerts: DataFrame) -> DataFrame:
    """Alerts with a place on their topic, as a broker would give them one."""
    number = F.pmod(F.xxhash64("symbol", "exchange", "alert_type", "observed_sequence", "event_time", "message"), F.lit(1 << 40))
    return alerts.withColumns({"source_topic": F.lit(ALERTS_TOPIC), "source_partition": F.lit(0).cast("long"), "source_offset": number})


def _derived(m: Market) -> dict[str, tuple[DataFrame, list[str]]]:
    """Derived events per topic with the fields of their message."""
    quotes, trades = m.quote_rows, m.trade_rows
    frames = {
        QUOTES_TOPIC: quotes.withColumn("event_type", F.lit("quote")).select(*feed.QUOTE_COLUMNS, *live.SOURCE),
        TOP_OF_BOOK_TOPIC: live.top_of_book(quotes, market.processed_at()),
        BARS_TOPIC: live.bar_updates(trades, hot=m.hot_seconds),
        METRICS_TOPIC: live.rolling_metrics(trades, hot=m.hot),
        ALERTS_TOPIC: _placed(m.alerts),
    }
    return {topic: (df, [c for c in df.columns if c not in live.SOURCE]) for topic, df in frames.items()}


def _derived_topic_sink(m: Market) -> DataFrame:
    place = _place(m, "topics")
    names = (QUOTES_TOPIC, TOP_OF_BOOK_TOPIC, BARS_TOPIC, METRICS_TOPIC)
    derived = _derived(m)
    for topic in names:
        df, fields = derived[topic]
        topics.write_topic(topics.as_messages(df, topic, fields), topic, path=place)
    back = topics.read_topics(m.spark, names, "json", streaming=False, path=place)
    return back.select("topic", "key", "partition", "offset", F.get_json_object("value", "$.sequence_number").cast("long").alias("sequence_number"))


def _state_messages(m: Market) -> DataFrame:
    return reduce(DataFrame.unionByName, [topics.as_messages(df, topic, fields) for topic, (df, fields) in _derived(m).items()])


def _entries(state: DataFrame) -> DataFrame:
    """Entries with the status of freshness and the types of the listed alerts, newest first."""
    listed = F.from_json("payload", "array<struct<alert_type string>>")["alert_type"]
    types = F.when(F.col("state_kind") == "alerts", F.array_join(listed, ","))
    status = F.get_json_object("payload", "$.status")
    return state.select("state_kind", "symbol", "event_time", "sequence_number", "expires_at", status.alias("status"), types.alias("alert_types"))


def _stream_hot_state(m: Market) -> DataFrame:
    place = _place(m, "hot")
    state = hot_state.HotState(m.spark, f"{place}/state", end())
    jobs.each_batch(_stored(m, _state_messages(m.settled()), f"{place}/topics"), state.upsert, f"{place}/checkpoint").awaitTermination()
    return _entries(state.read())


def _hot_state_upsert(m: Market) -> DataFrame:
    """The same entries in two batches by hand, the second one delivered twice."""
    messages = written(_state_messages(m.settled()), _place(m, "messages"))
    state = hot_state.HotState(m.spark, _place(m, "upsert"), end(), stored=True)
    even = F.col("offset") % 8 < 4
    for batch, part in ((0, even), (1, ~even), (1, ~even)):
        state.upsert(messages.where(part), batch)
    return _entries(state.read())


def _log(m: Market) -> DataFrame:
    """The derived topics from their first message to the last one that is there now."""
    place = _place(m, "log")
    derived = _derived(m.settled())
    for topic in hot_state.REBUILD_TOPICS:
        df, fields = derived[topic]
        topics.write_topic(topics.as_messages(df, topic, fields), topic, path=place)
    written = topics.read_topics(m.spark, hot_state.REBUILD_TOPICS, "json", streaming=False, path=place)
    ranges: dict[str, dict] = {}
    for r in written.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("until")).collect():
        ranges.setdefault(r.topic, {})[r.partition] = (0, r.until)
    return topics.read_offsets(m.spark, ranges, "json", path=place)


def _replayed(m: Market, as_of: dt.datetime) -> dict[str, DataFrame]:
    """The replayed state, its trades without copies stored once for the kinds that are made from them."""
    arrived = F.col("ingest_time") <= F.lit(as_of)
    trades = written(silver.latest_trades(m.trade_rows.where(arrived)), _place(m, "replayed"))
    return live.silver_state(trades, silver.latest_quotes(m.quote_rows.where(arrived)), F.lit(as_of))


def _state_differences(m: Market) -> DataFrame:
    """The stored state as it was at two times beside that of a replay up to then."""
    m = m.settled()
    messages = written(_state_messages(m), _place(m, "messages"))
    state = hot_state.HotState(m.spark, _place(m, "history"), end(), keep=None, stored=True)
    bounds = [None, *AS_OF, None]
    for batch, (after, until) in enumerate(zip(bounds, bounds[1:])):
        part = messages if after is None else messages.where(F.col("timestamp") > F.lit(after))
        state.upsert(part if until is None else part.where(F.col("timestamp") <= F.lit(until)), batch)
    return reduce(DataFrame.unionByName, [reports.state_differences(state.read(t), _replayed(m, t), F.lit(t)) for t in AS_OF])


def _feed_source(m: Market) -> DataFrame:
    """The raw feed read as a stream, each message parsed and judged."""

    def read(stream: DataFrame) -> DataFrame:
        checked = feed.feed_checked(stream)
        return checked.select("topic", "partition", "offset", "ingest_time", F.col("error").isNull().alias("usable"))

    return _streamed(m, "raw", read, m.feed)


def _bronze_ingest_rejects(m: Market) -> DataFrame:
    """What the ingest job cannot take in, with messages of a topic that is not its own."""
    place = _place(m, "rejects")
    sent = market.unchecked_messages(m.spark, m.sf_dir, m.hot).unionByName(m.feed)
    stream = _stored(m, sent, f"{place}/topics")
    for query in jobs.ingest_bronze(stream, f"{place}/table", f"{place}/rejects", f"{place}/checkpoint", market.RUN_ID):
        query.awaitTermination()
    return m.spark.read.parquet(f"{place}/rejects").drop("raw_event")


def _stream_stale_monitor(m: Market) -> DataFrame:
    """The monitor driven by a clock of one tick a second that is sent along with the quotes."""
    m.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_STATE)
    place = _place(m, "stale")
    seconds = F.sequence(start(), end(), F.expr("INTERVAL 1 SECOND"))
    ticks = m.quote_rows.select("symbol").distinct().select("symbol", F.explode(seconds).alias("tick_time"))
    ticks.write.parquet(f"{place}/clock")
    clock = m.spark.readStream.schema(ticks.schema).parquet(f"{place}/clock")
    alerts = stateful.stale_tick_stream(_stored(m, m.messages, f"{place}/topics"), clock)
    jobs.run_available(alerts, f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return m.spark.read.schema(alerts.schema).parquet(f"{place}/out")


def _stream_feed_handler(m: Market) -> DataFrame:
    """Everything the handler publishes, with the sequence alerts of a second query."""
    m.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_STATE)
    place = _place(m, "feed")
    outputs = sinks.FeedOutputs(path=f"{place}/published")
    jobs.each_batch(_stored(m, m.feed, f"{place}/topics"), outputs.write, f"{place}/checkpoint").awaitTermination()
    published = topics.read_topics(
        m.spark, (RAW_TOPIC, TRADES_TOPIC, QUOTES_TOPIC, ALERTS_TOPIC), "json", streaming=False, path=f"{place}/published"
    )
    typed = topics.read_topics(m.spark, (TRADES_TOPIC, QUOTES_TOPIC), "json", path=f"{place}/published")
    gaps = stateful.sequence_track_stream(typed)
    jobs.run_available(gaps, f"{place}/gaps", f"{place}/gap_checkpoint").awaitTermination()
    sent = published.select("topic", "key", F.get_json_object("value", "$.sequence_number").cast("long").alias("sequence_number"))
    raised = m.spark.read.schema(gaps.schema).parquet(f"{place}/gaps")
    return sent.unionByName(raised.select(F.lit(ALERTS_TOPIC).alias("topic"), F.col("symbol").alias("key"), "sequence_number"))


STORED = {
    "bronze_ingest": _bronze_ingest,
    "bronze_ingest_rejects": _bronze_ingest_rejects,
    "table_overwrite": _table_overwrite,
    "table_read": _table_read,
    "table_append": _table_append,
    "replay_output": _replay_output,
    "register_table": _register_table,
    "index_save_load": _index,
    "audit_append": _audit,
    "chunk_upsert": _chunk_upsert,
    "derived_topic_sink": _derived_topic_sink,
    "stream_top_of_book": lambda m: _streamed(m, "book", lambda s: jobs.top_of_book_stream(s, market.processed_at())),
    "stream_spread_alerts": lambda m: _streamed(m, "spread", jobs.spread_alert_stream),
    "stream_alert_union": lambda m: _streamed(m, "alerts", jobs.alert_stream),
    "stream_bars": _bars,
    "stream_late_trades": _late_trades,
    "stream_symbol_resolution": _symbol_stream,
    "stream_sequence_track": lambda m: _streamed(m, "track", stateful.sequence_track_stream),
    "stream_rolling_metrics": lambda m: _streamed(m, "rolling", stateful.rolling_metrics_stream),
    "stream_hot_state": _stream_hot_state,
    "hot_state_upsert": _hot_state_upsert,
    "hot_state_rebuild": lambda m: _entries(hot_state.rebuilt_state(_log(m))).drop("expires_at"),
    "hot_state_rebuild_symbol": lambda m: _entries(hot_state.rebuilt_state(_log(m), "sym05")).drop("expires_at"),
    "hot_state_rebuild_dry_run": lambda m: hot_state.rebuild_counts(_log(m)),
    "live_vs_replay": _state_differences,
    "divergence_counts": lambda m: reports.divergence_counts(_state_differences(m), time="as_of"),
    "feed_source": _feed_source,
    "stream_stale_monitor": _stream_stale_monitor,
    "stream_feed_handler": _stream_feed_handler,
}

REPORT = """
    SELECT '{zone}' AS zone, '{name}' AS table_name, '2024-01-01' AS report_date, count(*) AS row_count, min(event_date) AS min_event_date,
           max(event_date) AS max_event_date, r AS job_run_id, TIMESTAMP '2024-02-01 00:00:00' AS processed_at
    FROM {part} CROSS JOIN (VALUES ('run-1'), ('run-2')) AS runs(r) WHERE event_date = DATE '2024-01-01' GROUP BY r"""

LISTED = """
    SELECT 'alerts' AS state_kind, symbol, max(event_time) AS event_time, max(CASE WHEN alert_rank = 1 THEN sequence_number END) AS sequence_number,
           max(event_time) + INTERVAL 1 HOUR AS expires_at, NULL AS status, string_agg(alert_type, ',' ORDER BY alert_rank) AS alert_types
    FROM ranked_alerts WHERE alert_rank <= 25 GROUP BY symbol"""
STATE_ENTRIES = f"""
    SELECT state_kind, symbol, event_time, sequence_number, ingest_time + INTERVAL 120 SECONDS AS expires_at,
           CASE WHEN state_kind = 'freshness' THEN CASE WHEN shown > 2000 THEN 'stale' ELSE 'fresh' END END AS status, NULL AS alert_types
    FROM state UNION ALL {LISTED}"""
REBUILT = f"""
    SELECT state_kind, symbol, event_time, sequence_number, CASE WHEN state_kind = 'freshness' THEN 'rebuilt' END AS status, NULL AS alert_types
    FROM state WHERE state_kind <> 'latest_quote'
    UNION ALL SELECT state_kind, symbol, event_time, sequence_number, status, alert_types FROM ({LISTED})"""


def _differences_sql(as_of: str) -> str:
    """Newest live rows that arrived up to a time, and the same from rows without copies; field by field."""
    t = f"TIMESTAMP '{as_of}'"
    position = "event_time DESC, sequence_number DESC, ingest_time DESC, source_topic DESC, source_partition DESC, source_offset DESC"
    newest = f"QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY {position}) = 1"
    by_offset = "source_offset DESC, source_topic DESC, source_partition DESC"
    arrival = "ingest_time, source_topic, source_partition, source_offset"
    in_time = "event_time, sequence_number, source_offset, source_topic, source_partition"
    book, bar = "bid_price, bid_size, ask_price, ask_size, spread, mid_price", "open, high, low, close, volume, vwap"
    metric = "sample_count, rolling_volume, rolling_vwap, volatility_bps"

    def stacked(kind: str, fields: str, rows: str) -> str:
        shown = ", ".join(f"{f.strip()}::DOUBLE AS {f.strip()}" for f in fields.split(","))
        common = "symbol, sequence_number::DOUBLE AS sequence_number, epoch_us(event_time)::DOUBLE AS event_time_us"
        return f"""SELECT '{kind}' AS state_kind, symbol, field, round(value, 6) AS value FROM
            (UNPIVOT (SELECT {common}, {shown} FROM ({rows})) ON sequence_number, event_time_us, {fields} INTO NAME field VALUE value)"""

    alive = f"SELECT * FROM (SELECT * FROM {{}} WHERE ingest_time <= {t} {newest}) WHERE ingest_time + INTERVAL 120 SECONDS > {t}"
    live = [stacked("top_of_book", book, alive.format("books")), stacked("bar_1s", bar, alive.format("bar_rows")), stacked("metrics", metric, alive.format("metric_rows"))]
    replay = [
        stacked("top_of_book", book, f"SELECT * FROM sq {newest}"),
        stacked("bar_1s", bar, "SELECT * FROM sb QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY event_time DESC, sequence_number DESC, last_offset DESC) = 1"),
        stacked("metrics", metric, f"SELECT * FROM sm {newest}"),
    ]
    return f"""
    SELECT {t} AS as_of, state_kind, symbol, field, live_value, replay_value FROM (
      WITH sq AS (SELECT * FROM quote_rows WHERE ingest_time <= {t}
                  QUALIFY row_number() OVER (PARTITION BY symbol, exchange, sequence_number ORDER BY {by_offset}) = 1),
      st AS (SELECT * FROM trade_rows WHERE ingest_time <= {t}
             QUALIFY row_number() OVER (PARTITION BY symbol, exchange, sequence_number, trade_id ORDER BY {by_offset}) = 1),
      sb AS (SELECT symbol, exchange, date_trunc('second', event_time) AS event_time, max(sequence_number) AS sequence_number,
                    first(price ORDER BY {in_time}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY {in_time}) AS close,
                    sum(size) AS volume, sum((price * size)::DECIMAL(27,9))::DOUBLE / sum(size) AS vwap, max(source_offset) AS last_offset
             FROM st GROUP BY symbol, exchange, date_trunc('second', event_time)),
      sm AS (SELECT symbol, event_time, sequence_number, ingest_time, source_topic, source_partition, source_offset,
                    least(120, count(*) OVER w) AS sample_count, sum(size) OVER w AS rolling_volume,
                    (sum((price * size)::DECIMAL(27,9)) OVER w)::DOUBLE / sum(size) OVER w AS rolling_vwap,
                    coalesce(round((stddev_samp(r) OVER (PARTITION BY symbol, exchange ORDER BY {arrival}
                                    ROWS BETWEEN 118 PRECEDING AND CURRENT ROW)) * 10000, 6), 0) AS volatility_bps
             FROM (SELECT *, CASE WHEN price > 0 AND before > 0 THEN ln(price / before) END AS r
                   FROM (SELECT *, lag(price) OVER (PARTITION BY symbol, exchange ORDER BY {arrival}) AS before FROM st))
             WINDOW w AS (PARTITION BY symbol, exchange ORDER BY {arrival} ROWS UNBOUNDED PRECEDING)),
      l AS ({" UNION ALL ".join(live)}), r AS ({" UNION ALL ".join(replay)})
      SELECT state_kind, symbol, field, l.value AS live_value, r.value AS replay_value
      FROM l FULL OUTER JOIN r USING (state_kind, symbol, field)
      WHERE l.value IS DISTINCT FROM r.value)"""


DIFFERENCES = " UNION ALL ".join(_differences_sql(t.strftime("%Y-%m-%d %H:%M:%S")) for t in AS_OF)

STORED_SQL = {
    "bronze_ingest": """
    SELECT schema_version, event_type, symbol, exchange, event_time, ingest_time, sequence_number, event_date, source_topic,
           source_partition, source_offset, job_run_id, processed_at FROM events_sent""",
    "table_overwrite": f"SELECT * FROM silver_t WHERE event_date <> DATE '{DAY}' OR symbol = 'SYM05'",
    "table_read": "SELECT * REPLACE (round(avg_spread, 6) AS avg_spread, round(avg_mid_price, 6) AS avg_mid_price) FROM spreads",
    "table_append": REPORT.format(zone="silver", name="silver_trades", part="silver_t")
    + "\n    UNION ALL "
    + REPORT.format(zone="silver", name="silver_quotes", part="silver_q"),
    "replay_output": f"""
    SELECT source_topic, event_type, count(*) AS event_count, min(source_offset) AS first_offset, max(source_offset) AS last_offset,
           min(event_time) AS first_event_time, max(event_time) AS last_event_time, DATE '{DAY}' AS replay_date
    FROM events_sent WHERE event_date = DATE '{DAY}' GROUP BY source_topic, event_type""",
    "register_table": "SELECT symbol, exchange, count(*) AS bar_count, sum(volume)::BIGINT AS volume FROM bars GROUP BY symbol, exchange",
    "index_save_load": "SELECT source_uri, chunk_index, count(*)::INTEGER AS slots FROM turn_vectors GROUP BY source_uri, chunk_index",
    "audit_append": """
    SELECT tool_name, result_status, count(*) AS call_count, sum(duration_ms)::BIGINT AS duration_ms FROM audit GROUP BY tool_name, result_status""",
    "derived_topic_sink": """
    SELECT topic, symbol AS key, source_partition AS partition, source_offset AS "offset", sequence_number FROM (
      SELECT 'market.quotes.v1' AS topic, symbol, source_partition, source_offset, sequence_number FROM quote_rows
      UNION ALL SELECT 'market.state.top_of_book.v1', symbol, source_partition, source_offset, sequence_number FROM quote_rows
      UNION ALL SELECT 'market.bars.1s.v1', symbol, source_partition, source_offset, sequence_number FROM trade_rows
      UNION ALL SELECT 'market.metrics.rolling.v1', symbol, source_partition, source_offset, sequence_number FROM trade_rows)""",
    "stream_top_of_book": "SELECT * FROM books",
    "stream_spread_alerts": """
    SELECT '1.0' AS schema_version, 'quality_alert' AS event_type, symbol, exchange, event_time, event_time AS ingest_time,
           sequence_number, alert_type, severity, message, observed_sequence, expected_sequence FROM spread_alert_rows""",
    "stream_alert_union": """
    SELECT '1.0' AS schema_version, 'quality_alert' AS event_type, symbol, exchange, event_time, event_time AS ingest_time,
           sequence_number, alert_type, severity, message, observed_sequence, expected_sequence
    FROM (SELECT * FROM spread_alert_rows UNION ALL SELECT * FROM feed_alert_rows)""",
    "stream_bars": """
    SELECT '1.0' AS schema_version, 'bar_1s' AS event_type, symbol, exchange, window_start AS event_time, last_sequence AS sequence_number,
           open, high, low, close, volume, round(vwap, 6) AS vwap FROM sent_bars""",
    "stream_late_trades": f"""
    SELECT * FROM (WITH cut AS (SELECT *, {" + ".join(f"(ingest_time > TIMESTAMP '{DAY} {c}')::INT" for c in LATE_CUTS)} AS batch FROM trade_rows),
    marks AS (SELECT b AS batch, (SELECT epoch_us(max(event_time)) // 1000 - {LATE_DELAY_MS} FROM cut WHERE batch < b) AS mark_ms FROM range(0, {len(LATE_CUTS) + 2}) t(b)),
    seen AS (SELECT cut.*, date_trunc('second', event_time) AS second, epoch_ms(date_trunc('second', event_time)) + 1000 <= coalesce(mark_ms, 0) AS late
             FROM cut JOIN marks USING (batch))
    SELECT 'late' AS kind, symbol, exchange, event_time, sequence_number, NULL::DOUBLE AS open, NULL::DOUBLE AS high, NULL::DOUBLE AS low,
           price AS close, size AS volume, NULL::DOUBLE AS vwap, 1::BIGINT AS trade_count, source_offset FROM seen WHERE late
    UNION ALL
    SELECT 'bar', symbol, exchange, second, max(sequence_number), first(price ORDER BY event_time, sequence_number, source_offset, source_partition),
           max(price), min(price), last(price ORDER BY event_time, sequence_number, source_offset, source_partition), sum(size)::BIGINT,
           round(sum((price * size)::DECIMAL(27,9))::DOUBLE / sum(size), 6), count(*), NULL
    FROM seen WHERE NOT late GROUP BY symbol, exchange, second
    HAVING epoch_ms(second) + 1000 <= (SELECT mark_ms FROM marks WHERE batch = {len(LATE_CUTS) + 1}))""",
    "stream_symbol_resolution": "SELECT record_id, instrument_id, resolved_symbol FROM resolved",
    "stream_sequence_track": """
    SELECT '1.0' AS schema_version, 'quality_alert' AS event_type, symbol, exchange, event_time, event_time AS ingest_time,
           observed_sequence AS sequence_number, alert_type, severity, message, observed_sequence, expected_sequence FROM tracked""",
    "stream_rolling_metrics": "SELECT * REPLACE (round(rolling_vwap, 6) AS rolling_vwap) FROM metric_rows",
    "stream_hot_state": STATE_ENTRIES,
    "hot_state_upsert": STATE_ENTRIES,
    "hot_state_rebuild": REBUILT,
    "hot_state_rebuild_symbol": f"SELECT * FROM ({REBUILT}) WHERE symbol = 'SYM05'",
    "hot_state_rebuild_dry_run": """
    SELECT 'top_of_book' AS state_kind, count(*) AS event_count FROM quote_rows
    UNION ALL SELECT 'bar_1s', count(*) FROM trade_rows UNION ALL SELECT 'metrics', count(*) FROM trade_rows
    UNION ALL SELECT 'alerts', count(*) FROM alerts""",
    "live_vs_replay": DIFFERENCES,
    "divergence_counts": f"""
    SELECT symbol, time_bucket(INTERVAL 15 MINUTE, as_of) AS interval_start, count(*) AS difference_count FROM ({DIFFERENCES}) GROUP BY ALL""",
    "feed_source": """
    SELECT 'feed.synthetic.raw.v1' AS topic, source_partition AS partition, source_offset AS "offset", ingest_time,
           NOT cut AND NOT lacking AND sent_type = event_type AS usable FROM sent_feed""",
    "stream_stale_monitor": "",
    "bronze_ingest_rejects": f"""
    SELECT source_topic, source_partition, source_offset, CASE WHEN event_id % 43 = 0 THEN 'malformed_json' ELSE 'missing_schema_version' END AS reason
    FROM events_sent WHERE event_id % 43 = 0 OR event_id % 47 = 0
    UNION ALL SELECT '{RAW_FEED_TOPIC}', source_partition, source_offset, 'unknown_topic' FROM sent_feed""",
    "stream_feed_handler": """
    SELECT topic, key, sequence_number FROM feed_published""",
}
