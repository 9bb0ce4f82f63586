"""The same results in SQL over the given tables, written independently of the plans.

Each query is a WITH chain of the parts it names, followed by its own SELECT.
"""

from __future__ import annotations

import re

from tickforge.plans import market
from tickforge.plans.queries import DAY, HALF_AN_HOUR, HOLD_TICKS, INCIDENTS, SEARCHES, SEVERAL_DAYS

START = f"TIMESTAMP '{DAY} 00:00:00'"
MIDDLE = f"TIMESTAMP '{DAY} 00:01:30'"
END = f"TIMESTAMP '{DAY} 00:03:05'"
PROCESSED = "TIMESTAMP '2024-02-01 00:00:00'"
SPACES = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKENS = r"[A-Za-z0-9_.$:/-]+"
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%fZ')"
LINEAGE = (
    "schema_version, symbol, exchange, event_time, ingest_time, sequence_number, event_date, "
    "source_topic, source_partition, source_offset, job_run_id, processed_at"
)
SOURCE = "source_topic, source_partition, source_offset"
ARRIVAL = "ingest_time, source_topic, source_partition, source_offset"
BY_EVENT = "event_time, sequence_number, ingest_time, source_topic, source_partition, source_offset"


def _values(pairs: dict[str, str]) -> str:
    return ", ".join(f"('{name}', '{text}')" for name, text in pairs.items())


def _searched(pairs: dict[str, str], limit: int) -> str:
    """Top chunks per query, from token counts of both sides."""
    return f"""
    SELECT query_id, source_uri, chunk_index, score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_uri, chunk_index) AS result_rank
    FROM (SELECT q.query_id, v.source_uri, v.chunk_index, round(sum(q.weight * v.weight), 6) AS score
          FROM (SELECT query_id, idx, net / sqrt(sum(net * net) OVER (PARTITION BY query_id)) AS weight
                FROM (SELECT query_id, idx, sum(sign) AS net
                      FROM (SELECT query_id, sha256(lower(unnest(regexp_extract_all(query, '{TOKENS}')))) AS h
                            FROM (VALUES {_values(pairs)}) AS t(query_id, query)) AS tok,
                           LATERAL (SELECT {_slot('h')} AS idx, {_sign('h')} AS sign)
                      GROUP BY query_id, idx HAVING sum(sign) <> 0)) AS q
          JOIN note_vectors v USING (idx) GROUP BY ALL)
    WHERE score > 0
    QUALIFY result_rank <= {limit}"""


def _slot(h: str) -> str:
    return f"(CAST('0x' || substr({h}, 1, 8) AS BIGINT) % 384)::INTEGER"


def _sign(h: str) -> str:
    return f"CASE WHEN substr({h}, 10, 1) IN ('0','2','4','6','8','a','c','e') THEN 1 ELSE -1 END"


def _vectors(chunks: str) -> str:
    return f"""
    SELECT source_uri, chunk_index, idx, net / sqrt(sum(net * net) OVER (PARTITION BY source_uri, chunk_index)) AS weight
    FROM (SELECT source_uri, chunk_index, {_slot('h')} AS idx, sum({_sign('h')}) AS net
          FROM (SELECT source_uri, chunk_index, sha256(lower(unnest(regexp_extract_all(content, '{TOKENS}')))) AS h FROM {chunks})
          GROUP BY ALL HAVING sum({_sign('h')}) <> 0)"""


def _chunks(source: str, columns: str, text: str) -> str:
    return f"""
    SELECT {columns}, i::INTEGER AS chunk_index, array_to_string(list_slice(words, i * 190 + 1, i * 190 + 220), ' ') AS content
    FROM (SELECT *, unnest(range(0, greatest(0, ceil((len(words) - 220) / 190.0))::BIGINT + 1)) AS i
          FROM (SELECT {columns}, regexp_extract_all({text}, '[^{SPACES}]+') AS words FROM {source})
          WHERE len(words) > 0)"""


PARTS = {
    "base": """
    SELECT event_id, 'SYM' || lpad((user_id % 12)::VARCHAR, 2, '0') AS symbol,
           CASE WHEN (user_id // 12) % 2 = 0 THEN 'XNAS' ELSE 'XNYS' END AS exchange,
           make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 14400) AS event_time,
           CASE WHEN event_type IN ('purchase', 'click') THEN 'trade'
                WHEN event_type IN ('view', 'signup') THEN 'quote' ELSE 'quality_alert' END AS event_type,
           value, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k, user_id % 4 AS source_partition
    FROM events""",
    "numbered": """
    SELECT *, CASE WHEN event_type = 'quality_alert' THEN 0 ELSE
        sum(CASE WHEN event_type = 'quality_alert' THEN 0 WHEN event_id % 37 = 0 THEN 2 ELSE 1 END)
            OVER (PARTITION BY symbol, exchange ORDER BY event_id ROWS UNBOUNDED PRECEDING) END::BIGINT AS sequence_number
    FROM base""",
    "arrived": """
    SELECT *, event_id * 4 + CASE WHEN event_id % 41 = 0 THEN 1602 ELSE 0 END AS source_offset,
           event_time + CASE WHEN event_id % 41 = 0 THEN INTERVAL 7005 MILLISECONDS ELSE INTERVAL 5 MILLISECONDS END AS ingest_time,
           100 + value AS base_price
    FROM numbered
    UNION ALL
    SELECT *, event_id * 4 + 1, event_time + INTERVAL 9 MILLISECONDS, 100 + value + 0.5
    FROM numbered WHERE event_id % 53 = 0""",
    "events_sent": """
    SELECT '1.0' AS schema_version, event_type, symbol, exchange, event_time, ingest_time, sequence_number,
           event_time::DATE AS event_date,
           CASE event_type WHEN 'trade' THEN 'market.trades.v1' WHEN 'quote' THEN 'market.quotes.v1'
                ELSE 'market.quality.alerts.v1' END AS source_topic,
           source_partition, source_offset, 'run-1' AS job_run_id, """
    + PROCESSED
    + """ AS processed_at, event_id, k,
           CASE WHEN event_type = 'trade' THEN base_price END AS price,
           CASE WHEN event_type = 'trade' THEN k + 1 END AS size,
           CASE WHEN event_type = 'trade' AND k % 5 <> 0 THEN 'T' || event_id END AS sent_id,
           CASE WHEN event_type = 'trade' AND k % 3 = 0 THEN 'odd,lot' END AS sent_conditions,
           CASE WHEN event_type = 'quote' THEN base_price END AS bid_price,
           CASE WHEN event_type = 'quote' THEN k END AS bid_size,
           CASE WHEN event_type = 'quote' THEN base_price + (k - 5) / 100 END AS ask_price,
           CASE WHEN event_type = 'quote' THEN k + 2 END AS ask_size,
           CASE WHEN event_type = 'quality_alert' THEN
                CASE k % 3 WHEN 0 THEN 'stale_symbol' WHEN 1 THEN 'wide_spread' ELSE 'crossed_market' END END AS alert_type,
           CASE WHEN event_type = 'quality_alert' THEN CASE k % 3 WHEN 2 THEN 'critical' ELSE 'warning' END END AS severity,
           CASE WHEN event_type = 'quality_alert' THEN 'Alert with level ' || k || '.' END AS message
    FROM arrived""",
    "trade_rows": f"""
    SELECT {LINEAGE}, coalesce(sent_id, '') AS trade_id, price, size, coalesce(sent_conditions, '') AS conditions
    FROM events_sent WHERE event_type = 'trade'""",
    "quote_rows": f"""
    SELECT {LINEAGE}, bid_price, bid_size, ask_price, ask_size, round(ask_price - bid_price, 6) AS spread,
           round((ask_price + bid_price) / 2, 6) AS mid_price
    FROM events_sent WHERE event_type = 'quote'""",
    "silver_t": """
    SELECT * FROM trade_rows
    QUALIFY row_number() OVER (PARTITION BY symbol, exchange, sequence_number, trade_id
                               ORDER BY source_offset DESC, source_topic DESC, source_partition DESC) = 1""",
    "silver_q": """
    SELECT * FROM quote_rows
    QUALIFY row_number() OVER (PARTITION BY symbol, exchange, sequence_number
                               ORDER BY source_offset DESC, source_topic DESC, source_partition DESC) = 1""",
    "gaps": f"""
    SELECT schema_version, symbol, exchange, event_time, event_date,
           CASE WHEN sequence_number <= previous THEN 'duplicate_or_reordered_sequence' ELSE 'sequence_gap' END AS alert_type,
           previous + 1 AS expected_sequence, sequence_number AS observed_sequence, {SOURCE}, job_run_id, processed_at
    FROM (SELECT *, lag(sequence_number) OVER (PARTITION BY symbol, exchange
                    ORDER BY sequence_number, source_offset, source_topic, source_partition) AS previous
          FROM events_sent WHERE event_type <> 'quality_alert')
    WHERE sequence_number <> previous + 1""",
    "tracked": f"""
    SELECT symbol, exchange, ingest_time AS event_time,
           CASE WHEN sequence_number <= previous THEN 'duplicate_or_reordered_sequence' ELSE 'sequence_gap' END AS alert_type,
           CASE WHEN sequence_number <= previous THEN 'warning' ELSE 'critical' END AS severity,
           CASE WHEN sequence_number <= previous THEN 'Received sequence ' || sequence_number || ' after ' || previous || '.'
                ELSE 'Expected sequence ' || (previous + 1) || ' but received ' || sequence_number || '.' END AS message,
           sequence_number AS observed_sequence, previous + 1 AS expected_sequence
    FROM (SELECT *, max(sequence_number) OVER (PARTITION BY symbol, exchange ORDER BY {ARRIVAL}
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous
          FROM events_sent WHERE event_type <> 'quality_alert')
    WHERE sequence_number <> previous + 1""",
    "bars": """
    SELECT schema_version, symbol, exchange, window_start, event_date, open, high, low, close, volume,
           coalesce(notional / nullif(volume, 0), close) AS vwap, trade_count, first_sequence, last_sequence,
           first_source_offset, last_source_offset, job_run_id, processed_at
    FROM (SELECT '1.0' AS schema_version, symbol, exchange, date_trunc('second', event_time) AS window_start, event_date,
                 first(price ORDER BY event_time, sequence_number, source_offset, source_topic, source_partition) AS open,
                 max(price) AS high, min(price) AS low,
                 last(price ORDER BY event_time, sequence_number, source_offset, source_topic, source_partition) AS close,
                 sum(size)::BIGINT AS volume, sum((price * size)::DECIMAL(27,9))::DOUBLE AS notional, count(*) AS trade_count,
                 min(sequence_number) AS first_sequence, max(sequence_number) AS last_sequence,
                 min(source_offset) AS first_source_offset, max(source_offset) AS last_source_offset,
                 max(job_run_id) AS job_run_id, max(processed_at) AS processed_at
          FROM silver_t GROUP BY ALL)""",
    "sent_bars": """
    SELECT symbol, exchange, date_trunc('second', event_time) AS window_start, max(sequence_number) AS last_sequence,
           first(price ORDER BY event_time, sequence_number, source_offset, source_topic, source_partition) AS open,
           max(price) AS high, min(price) AS low,
           last(price ORDER BY event_time, sequence_number, source_offset, source_topic, source_partition) AS close,
           sum(size)::BIGINT AS volume, sum((price * size)::DECIMAL(27,9))::DOUBLE / sum(size) AS vwap
    FROM trade_rows GROUP BY ALL""",
    "spreads": """
    SELECT '1.0' AS schema_version, symbol, exchange, date_trunc('second', event_time) AS window_start, event_date,
           count(*) AS quote_count, min(spread) AS min_spread, max(spread) AS max_spread,
           sum(spread::DECIMAL(27,6))::DOUBLE / count(*) AS avg_spread, sum(mid_price::DECIMAL(27,6))::DOUBLE / count(*) AS avg_mid_price,
           min(sequence_number) AS first_sequence, max(sequence_number) AS last_sequence,
           min(source_offset) AS first_source_offset, max(source_offset) AS last_source_offset,
           max(job_run_id) AS job_run_id, max(processed_at) AS processed_at
    FROM silver_q GROUP BY ALL""",
    "volatility": """
    SELECT '1.0' AS schema_version, symbol, exchange, event_date, count(*) AS bar_count, count(r) AS return_count,
           coalesce(round(stddev_samp(r) * 10000, 6), 0) AS volatility_bps, min(window_start) AS first_window_start,
           max(window_start) AS last_window_start, max(job_run_id) AS job_run_id, max(processed_at) AS processed_at
    FROM (SELECT *, CASE WHEN close > 0 AND before > 0 THEN ln(close / before) END AS r
          FROM (SELECT *, lag(close) OVER (PARTITION BY symbol, exchange, event_date ORDER BY window_start) AS before FROM bars))
    GROUP BY symbol, exchange, event_date""",
    "annotations": f"""
    SELECT schema_version, symbol, exchange, event_time, event_date, alert_type AS annotation_type,
           CASE alert_type WHEN 'sequence_gap' THEN 'critical' ELSE 'warning' END AS severity,
           'Expected sequence ' || expected_sequence || ' but observed ' || observed_sequence || '.' AS message,
           'silver_sequence_gaps' AS source_table, {SOURCE}, job_run_id, processed_at
    FROM gaps
    UNION ALL
    SELECT schema_version, symbol, exchange, event_time, event_date, alert_type, severity, message,
           'bronze_market_events', {SOURCE}, job_run_id, processed_at
    FROM events_sent WHERE event_type = 'quality_alert'""",
    "features": """
    SELECT b.symbol, b.exchange, b.event_date, b.window_start, open, high, low, close, volume, vwap, avg_spread, max_spread
    FROM bars b LEFT JOIN spreads s USING (symbol, exchange, event_date, window_start)""",
    "books": f"""
    SELECT '1.0' AS schema_version, 'top_of_book' AS event_type, symbol, exchange, event_time, ingest_time, sequence_number,
           {PROCESSED} AS processed_time, bid_price, bid_size, ask_price, ask_size, spread, mid_price, {SOURCE}
    FROM quote_rows""",
    "spread_alert_rows": """
    SELECT symbol, exchange, ingest_time AS event_time, sequence_number,
           CASE WHEN spread < 0 THEN 'crossed_market' ELSE 'wide_spread' END AS alert_type,
           CASE WHEN spread < 0 THEN 'critical' ELSE 'warning' END AS severity,
           CASE WHEN spread < 0 THEN 'Ask price is below bid price.'
                ELSE 'Spread ' || spread || ' exceeded configured threshold.' END AS message,
           sequence_number AS observed_sequence, NULL::BIGINT AS expected_sequence
    FROM quote_rows WHERE spread < 0 OR spread > greatest(0.05, mid_price * 0.002)""",
    "feed_alert_rows": """
    SELECT symbol, exchange, event_time, 0::BIGINT AS sequence_number, alert_type, severity, message,
           NULL::BIGINT AS observed_sequence, NULL::BIGINT AS expected_sequence
    FROM events_sent WHERE event_type = 'quality_alert'""",
    "alerts": """
    SELECT '1.0' AS schema_version, 'quality_alert' AS event_type, symbol, exchange, event_time, event_time AS ingest_time,
           sequence_number, alert_type, severity, message, observed_sequence, expected_sequence
    FROM (SELECT * FROM spread_alert_rows UNION ALL SELECT * FROM feed_alert_rows
          UNION ALL SELECT symbol, exchange, event_time, observed_sequence, alert_type, severity, message,
                           observed_sequence, expected_sequence FROM tracked)""",
    "fresh": f"""
    SELECT '1.0' AS schema_version, symbol, exchange, event_time, ingest_time AS last_ingest_time, {END} AS last_processed_time,
           greatest(0, epoch_us({END}) - epoch_us(event_time)) // 1000 AS freshness_lag_ms,
           CASE WHEN greatest(0, epoch_us({END}) - epoch_us(event_time)) // 1000 > 2000 THEN 'stale' ELSE 'fresh' END AS status,
           sequence_number, {SOURCE}, ingest_time
    FROM quote_rows""",
    "bar_rows": f"""
    SELECT '1.0' AS schema_version, 'bar_1s' AS event_type, symbol, exchange, second AS event_time, ingest_time, sequence_number,
           first(price) OVER w AS open, max(price) OVER w AS high, min(price) OVER w AS low, price AS close,
           (sum(size) OVER w)::BIGINT AS volume,
           coalesce((sum((price * size)::DECIMAL(27,9)) OVER w)::DOUBLE / nullif(sum(size) OVER w, 0), price) AS vwap, {SOURCE}
    FROM (SELECT *, date_trunc('second', event_time) AS second FROM trade_rows)
    WINDOW w AS (PARTITION BY symbol, exchange, second ORDER BY {ARRIVAL} ROWS UNBOUNDED PRECEDING)""",
    "metric_rows": f"""
    SELECT '1.0' AS schema_version, 'rolling_metrics' AS event_type, symbol, exchange, event_time, ingest_time, sequence_number,
           least(120, count(*) OVER w) AS sample_count, (sum(size) OVER w)::BIGINT AS rolling_volume,
           coalesce((sum((price * size)::DECIMAL(27,9)) OVER w)::DOUBLE / nullif(sum(size) OVER w, 0), price) AS rolling_vwap,
           coalesce(round((stddev_samp(r) OVER (PARTITION BY symbol, exchange ORDER BY {ARRIVAL}
                           ROWS BETWEEN 118 PRECEDING AND CURRENT ROW)) * 10000, 6), 0) AS volatility_bps, {SOURCE}
    FROM (SELECT *, CASE WHEN price > 0 AND before > 0 THEN ln(price / before) END AS r
          FROM (SELECT *, lag(price) OVER (PARTITION BY symbol, exchange ORDER BY {ARRIVAL}) AS before FROM trade_rows))
    WINDOW w AS (PARTITION BY symbol, exchange ORDER BY {ARRIVAL} ROWS UNBOUNDED PRECEDING)""",
    "state": f"""
    SELECT * FROM (
      SELECT 'latest_quote' AS state_kind, symbol, exchange, event_time, sequence_number, ingest_time, {SOURCE}, bid_price AS shown FROM quote_rows
      UNION ALL SELECT 'top_of_book', symbol, exchange, event_time, sequence_number, ingest_time, {SOURCE}, mid_price FROM quote_rows
      UNION ALL SELECT 'bar_1s', symbol, exchange, event_time, sequence_number, ingest_time, {SOURCE}, vwap FROM bar_rows
      UNION ALL SELECT 'metrics', symbol, exchange, event_time, sequence_number, ingest_time, {SOURCE}, volatility_bps FROM metric_rows
      UNION ALL SELECT 'freshness', symbol, exchange, event_time, sequence_number, ingest_time, {SOURCE}, freshness_lag_ms FROM fresh)
    QUALIFY row_number() OVER (PARTITION BY state_kind, symbol ORDER BY event_time DESC, sequence_number DESC,
        CASE WHEN state_kind = 'freshness' THEN NULL ELSE ingest_time END DESC,
        source_topic DESC, source_partition DESC, source_offset DESC) = 1""",
    "distinct_alerts": """
    SELECT symbol, exchange, alert_type, observed_sequence, event_time, max(severity) AS severity, max(message) AS message,
           max(sequence_number) AS sequence_number
    FROM alerts GROUP BY symbol, exchange, alert_type, observed_sequence, event_time""",
    "ranked_alerts": """
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_time DESC, sequence_number DESC, alert_type, exchange,
                                 observed_sequence NULLS FIRST, message) AS alert_rank
    FROM distinct_alerts""",
    "live_bars": f"""
    SELECT symbol, exchange, date_trunc('second', event_time) AS window_start, first(price ORDER BY {ARRIVAL}) AS open,
           max(price) AS high, min(price) AS low, last(price ORDER BY {ARRIVAL}) AS close, sum(size)::DOUBLE AS volume,
           coalesce(sum((price * size)::DECIMAL(27,9))::DOUBLE / nullif(sum(size), 0), last(price ORDER BY {ARRIVAL})) AS vwap
    FROM trade_rows GROUP BY ALL""",
    "replay_bars": """
    SELECT symbol, exchange, window_start, open, high, low, close, volume::DOUBLE AS volume, vwap FROM bars""",
    "differences": """
    SELECT * FROM (
      SELECT symbol, exchange, window_start, field, round(l.v, 6) AS live_value, round(r.v, 6) AS replay_value
      FROM (UNPIVOT live_bars ON open, high, low, close, volume, vwap INTO NAME field VALUE v) l
      FULL OUTER JOIN (UNPIVOT replay_bars ON open, high, low, close, volume, vwap INTO NAME field VALUE v) r
      USING (symbol, exchange, window_start, field))
    WHERE live_value IS DISTINCT FROM replay_value""",
    "sent_feed": """
    SELECT *, event_id % 43 = 0 AS cut, event_id % 31 = 0 AS lacking, CASE WHEN event_id % 29 = 0 THEN 'halt' ELSE event_type END AS sent_type
    FROM events_sent WHERE event_type <> 'quality_alert'""",
    "feed_ok": "SELECT * FROM sent_feed WHERE NOT cut AND NOT lacking AND sent_type = event_type",
    "feed_published": f"""
    SELECT 'market.raw.v1' AS topic, symbol AS key, sequence_number FROM feed_ok
    UNION ALL SELECT source_topic, symbol, sequence_number FROM feed_ok
    UNION ALL SELECT 'market.quality.alerts.v1', CASE WHEN cut THEN 'UNKNOWN' ELSE symbol END, CASE WHEN cut THEN 0 ELSE sequence_number END
    FROM sent_feed WHERE cut OR lacking OR sent_type <> event_type
    UNION ALL SELECT 'market.quality.alerts.v1', symbol, sequence_number
    FROM (SELECT *, max(sequence_number) OVER (PARTITION BY symbol, exchange ORDER BY {ARRIVAL}
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM feed_ok)
    WHERE sequence_number <> previous + 1""",
    "ticks": f"SELECT unnest(range(0, 186)) AS tick, {START} + to_seconds(unnest(range(0, 186))) AS tick_time",
    "records": """
    SELECT event_id AS record_id, event_type, CASE WHEN user_id % 50 = 49 THEN NULL ELSE 100 + user_id % 12 END AS instrument_id,
           epoch_us(ts) * 1000 + 789 AS ts_event, CASE WHEN k % 11 = 0 THEN 0 ELSE event_id + 1 END AS sequence_number,
           CASE WHEN k % 13 = 0 THEN NULL ELSE value END AS price, k, value,
           CASE WHEN event_type IN ('click', 'purchase') THEN 'T' WHEN event_type = 'view' THEN 'A' END AS action,
           CASE k % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' END AS side,
           CASE WHEN event_type <> 'error' AND k % 7 = 0 THEN 'RAW' || k END AS raw_symbol,
           CASE WHEN event_type = 'error' AND k % 5 <> 0 THEN 'IN' || (k % 4) END AS in_symbol,
           CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN (1000 + k)::VARCHAR ELSE 'OUT' || k END END AS out_symbol
    FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events)""",
    "resolved": """
    SELECT *, coalesce(CASE WHEN instrument_id IS NOT NULL THEN
               last_value(mapping IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY ts_event, record_id ROWS UNBOUNDED PRECEDING) END,
               raw_symbol, in_symbol, out_symbol, 'INSTRUMENT_' || instrument_id, 'UNKNOWN') AS resolved_symbol
    FROM (SELECT *, CASE WHEN event_type = 'error' THEN
                        CASE WHEN in_symbol IS NOT NULL AND k % 2 = 0 THEN in_symbol ELSE out_symbol END END AS mapping
          FROM records)""",
    "notes": r"""
    SELECT 'docs:' || source || '/' || doc_id || '.md' AS source_uri,
           CASE WHEN doc_id % 2 = 0 THEN 'Note ' || doc_id ELSE doc_id::VARCHAR END AS title,
           CASE WHEN doc_id % 2 = 0 THEN lang || ',' || source ELSE '' END AS tags, 'docs' AS source_type, text AS body
    FROM documents""",
    "note_chunks": _chunks("notes", "source_uri, title, source_type", "body"),
    "note_vectors": _vectors("note_chunks"),
    "turns": "SELECT 'chat:' || conv_id || '/' || turn AS source_uri, text AS body FROM conversations",
    "turn_chunks": _chunks("turns", "source_uri", "body"),
    "turn_vectors": _vectors("turn_chunks"),
    "page_chunks": _chunks("(SELECT url AS source_uri, page_id, html FROM pages)", "source_uri", "html"),
    "searched": _searched(SEARCHES, 5),
    "fresh_found": _searched({f"SYM{n:02d}": f"SYM{n:02d} stale freshness redis alert runbook" for n in range(12)}, 5),
    "incident_found": _searched({name: f"{name} incident timeline symptoms runbook alerts" for name in INCIDENTS}, 6),
    "audit": """
    SELECT event_type AS tool_name, CASE WHEN value > 100 THEN 'error' ELSE 'ok' END AS result_status, value AS latency_ms,
           ts AS timestamp, 'user-' || user_id AS caller, props AS parameters, round(value)::BIGINT AS duration_ms FROM events""",
}

SNAPSHOT = f"""
    SELECT symbol, max(CASE WHEN state_kind = 'latest_quote' THEN round(q.ask_price, 6) END) AS ask_price,
           max(CASE WHEN state_kind = 'top_of_book' THEN q.spread END) AS spread,
           max(CASE WHEN state_kind = 'bar_1s' THEN b.close END) AS close,
           max(CASE WHEN state_kind = 'metrics' THEN m.sample_count END) AS sample_count,
           max(CASE WHEN state_kind = 'freshness' THEN CASE WHEN shown > 2000 THEN 'stale' ELSE 'fresh' END END) AS status,
           coalesce(max(alert_count), 0)::INTEGER AS alert_count, max(alert_types) AS alert_types
    FROM (SELECT DISTINCT symbol FROM (SELECT symbol FROM events_sent))
    LEFT JOIN (SELECT * FROM state WHERE ingest_time + INTERVAL 120 SECONDS > {END}) s USING (symbol)
    LEFT JOIN quote_rows q USING (symbol, source_topic, source_partition, source_offset)
    LEFT JOIN bar_rows b USING (symbol, source_topic, source_partition, source_offset)
    LEFT JOIN metric_rows m USING (symbol, source_topic, source_partition, source_offset)
    LEFT JOIN (SELECT symbol, count(*) AS alert_count, string_agg(alert_type, ',' ORDER BY alert_rank) AS alert_types
               FROM ranked_alerts WHERE alert_rank <= 10 GROUP BY symbol) a USING (symbol)
    GROUP BY symbol"""
BOOKED = "(event_type IN ('view', 'signup', 'click') AND NOT (instrument_id IS NOT NULL AND coalesce(in_symbol, out_symbol) IS NOT NULL))"
VENDOR = (
    "resolved_symbol AS symbol, 'GLBX' AS exchange, make_timestamp(ts_event // 1000) AS event_time, sequence_number, record_id"
)
ROUND_BARS = "* REPLACE (round(vwap, 6) AS vwap)"
FEED_TIME = "event_time, ingest_time, sequence_number"
OK_FEED = "NOT cut AND NOT lacking AND sent_type = event_type"

SELECTS = {
    "bronze_rows": f"""
    SELECT {LINEAGE}, event_type, '{{"schema_version":"1.0","event_type":"' || event_type || '","symbol":"' || symbol || '","exchange":"' || exchange
        || '","event_time":"' || {ISO.format('event_time')} || '","ingest_time":"' || {ISO.format('ingest_time')}
        || '","sequence_number":' || sequence_number
        || coalesce(',"price":' || price || ',"size":' || size, '') || coalesce(',"trade_id":"' || sent_id || '"', '')
        || CASE WHEN sent_conditions IS NULL THEN '' ELSE ',"conditions":["odd","lot"]' END
        || coalesce(',"bid_price":' || bid_price || ',"bid_size":' || bid_size || ',"ask_price":' || ask_price || ',"ask_size":' || ask_size, '')
        || coalesce(',"alert_type":"' || alert_type || '","severity":"' || severity || '","message":"' || message || '"', '')
        || '}}' AS raw_event
    FROM events_sent""",
    "bronze_rejects": f"""
    SELECT {SOURCE}, CASE WHEN event_id % 43 = 0 THEN 'malformed_json' ELSE 'missing_schema_version' END AS reason
    FROM events_sent WHERE event_id % 43 = 0 OR event_id % 47 = 0""",
    "raw_event_decode": f"SELECT event_type, symbol, {SOURCE}, price, size, sent_id AS trade_id, sent_conditions AS conditions FROM events_sent",
    "event_router": "SELECT event_type AS route, symbol, count(*) AS event_count FROM events_sent GROUP BY ALL",
    "lineage_columns": f"SELECT {LINEAGE} FROM silver_q",
    "canonical_trades": f"""
    SELECT schema_version, event_type, symbol, exchange, {FEED_TIME}, price, size,
           coalesce(sent_id, sha256(symbol || '|' || exchange || '|' || sequence_number || '|' || {ISO.format('event_time')} || '|' || source_offset)) AS trade_id,
           coalesce(sent_conditions, '') AS conditions, 'feed.synthetic.raw.v1' AS topic, source_partition AS partition, source_offset AS "offset"
    FROM sent_feed WHERE event_type = 'trade' AND {OK_FEED}""",
    "canonical_quotes": f"""
    SELECT schema_version, event_type, symbol, exchange, {FEED_TIME}, bid_price, bid_size, ask_price, ask_size,
           'feed.synthetic.raw.v1' AS topic, source_partition AS partition, source_offset AS "offset"
    FROM sent_feed WHERE event_type = 'quote' AND {OK_FEED}""",
    "feed_validation": f"""
    SELECT '1.0' AS schema_version, 'quality_alert' AS event_type, CASE WHEN cut THEN 'UNKNOWN' ELSE symbol END AS symbol,
           CASE WHEN cut THEN 'UNKNOWN' ELSE exchange END AS exchange, ingest_time AS event_time, ingest_time,
           CASE WHEN cut THEN 0 ELSE sequence_number END AS sequence_number, 'feed_validation_error' AS alert_type, 'critical' AS severity,
           CASE WHEN cut THEN 'Malformed JSON' WHEN sent_type = 'halt' THEN 'Unsupported event_type ''halt'''
                WHEN event_type = 'trade' THEN 'Missing required fields: [''price'']'
                ELSE 'Missing required fields: [''ask_size'', ''bid_price'']' END AS message,
           CASE WHEN cut THEN NULL ELSE sequence_number END AS observed_sequence, NULL::BIGINT AS expected_sequence,
           'feed.synthetic.raw.v1' AS topic, source_partition AS partition, source_offset AS "offset"
    FROM sent_feed WHERE NOT ({OK_FEED})""",
    "quality_alert_rows": """
    SELECT '1.0' AS schema_version, 'quality_alert' AS event_type, symbol, exchange, event_time, event_time AS ingest_time,
           sequence_number, alert_type, severity, message, observed_sequence, expected_sequence FROM feed_alert_rows""",
    "contract_violations": """
    SELECT event_type AS contract, source_partition AS partition, source_offset AS "offset",
           CASE WHEN event_id % 43 = 0 THEN 'malformed' WHEN event_id % 47 = 0 THEN 'required:schema_version' ELSE '' END AS violations
    FROM events_sent
    UNION ALL SELECT 'top_of_book', source_partition, source_offset, CASE WHEN source_offset % 59 = 0 THEN 'minimum:sequence_number' ELSE '' END
    FROM quote_rows
    UNION ALL SELECT contract, source_partition, source_offset, CASE WHEN source_offset % 59 <> 0 THEN '' WHEN contract = 'market' THEN 'enum:event_type'
                                                                     ELSE 'minimum:sequence_number' END
    FROM trade_rows CROSS JOIN (VALUES ('bar_1s'), ('rolling_metrics'), ('market')) AS kinds(contract)""",
    "top_of_book": "SELECT * FROM books",
    "spread_alerts": """
    SELECT '1.0' AS schema_version, 'quality_alert' AS event_type, symbol, exchange, event_time, event_time AS ingest_time,
           sequence_number, alert_type, severity, message, observed_sequence, expected_sequence FROM spread_alert_rows""",
    "freshness": "SELECT * EXCLUDE (ingest_time) FROM fresh",
    "vendor_quotes": f"""
    SELECT 'quote' AS event_type, {VENDOR}, value - 5 AS bid_price, k AS bid_size, value + 0.25 AS ask_price, k + 2 AS ask_size
    FROM resolved WHERE event_type IN ('view', 'signup', 'click') AND value - 5 > 0""",
    "vendor_trades": f"""
    SELECT 'trade' AS event_type, {VENDOR}, round(price, 6) AS price, k + 1 AS size,
           sha256(concat_ws('|', record_id, instrument_id, ts_event)) AS trade_id,
           coalesce(side, '') || ',action=T' AS conditions
    FROM resolved WHERE event_type IN ('click', 'purchase') AND price IS NOT NULL""",
    "vendor_events": f"""
    SELECT 'quote' AS event_type, {VENDOR}, value - 5 AS bid_price, k AS bid_size, value + 0.25 AS ask_price, k + 2 AS ask_size, 0 AS part,
           NULL::DOUBLE AS price, NULL::BIGINT AS size, NULL::VARCHAR AS trade_id, NULL::VARCHAR AS conditions
    FROM resolved WHERE event_type IN ('view', 'signup', 'click') AND value - 5 > 0
    UNION ALL
    SELECT 'trade', {VENDOR}, NULL, NULL, NULL, NULL, 1, round(price, 6), k + 1,
           sha256(concat_ws('|', record_id, instrument_id, ts_event)), coalesce(side, '') || ',action=T'
    FROM resolved WHERE event_type IN ('click', 'purchase') AND price IS NOT NULL""",
    "symbol_resolution": "SELECT record_id, instrument_id, resolved_symbol FROM resolved",
    "time_range_filter": f"""
    SELECT {LINEAGE}, event_type FROM events_sent
    WHERE event_time BETWEEN {START} AND {MIDDLE} AND symbol IN ('SYM01', 'SYM02') AND exchange = 'XNAS'""",
    "event_date_filter": f"SELECT {LINEAGE}, event_type FROM events_sent WHERE event_date = DATE '{DAY}'",
    "silver_trades": "SELECT * FROM silver_t",
    "silver_quotes": "SELECT * FROM silver_q",
    "sequence_gaps": "SELECT * FROM gaps",
    "sequence_track": "SELECT * FROM tracked",
    "bars_1s": f"SELECT {ROUND_BARS} FROM bars",
    "spread_features": "SELECT * REPLACE (round(avg_spread, 6) AS avg_spread, round(avg_mid_price, 6) AS avg_mid_price) FROM spreads",
    "volatility_features": "SELECT * FROM volatility",
    "quality_annotations": "SELECT * FROM annotations",
    "quality_summary": "SELECT annotation_type, severity, count(*) AS annotation_count FROM annotations GROUP BY ALL",
    "gold_scan": f"SELECT {ROUND_BARS} FROM bars WHERE symbol = 'SYM05' AND event_date = DATE '{DAY}'",
    "research_features": "SELECT * REPLACE (round(vwap, 6) AS vwap, round(avg_spread, 6) AS avg_spread) FROM features",
    "signal_frame": """
    SELECT * REPLACE (round(vwap, 6) AS vwap, round(avg_spread, 6) AS avg_spread, round(return_1s, 6) AS return_1s),
           CASE WHEN return_1s > 0 AND spread_ok THEN 1 ELSE 0 END AS toy_signal
    FROM (SELECT *, CASE WHEN previous_close > 0 THEN close / previous_close - 1 END AS return_1s, avg_spread <= 0.05 AS spread_ok
          FROM (SELECT *, lag(close) OVER (PARTITION BY symbol, exchange ORDER BY window_start) AS previous_close FROM features))""",
    "bar_updates": f"SELECT {ROUND_BARS} FROM bar_rows",
    "rolling_metrics": "SELECT * REPLACE (round(rolling_vwap, 6) AS rolling_vwap) FROM metric_rows",
    "latest_state": """
    SELECT state_kind, symbol, exchange, event_time, sequence_number, ingest_time + INTERVAL 120 SECONDS AS expires_at,
           round(shown, 6) AS shown FROM state""",
    "active_symbols": "SELECT symbol FROM quote_rows UNION SELECT symbol FROM trade_rows UNION SELECT symbol FROM alerts",
    "alert_stream_union": "SELECT * FROM alerts",
    "recent_alerts": f"""
    SELECT symbol, exchange, alert_type, observed_sequence, event_time, severity, message, sequence_number, alert_rank
    FROM (SELECT *, max(event_time) OVER (PARTITION BY symbol) AS latest FROM ranked_alerts)
    WHERE alert_rank <= 25 AND latest > {END} - INTERVAL 1 HOUR""",
    "symbol_snapshot": f"SELECT * FROM ({SNAPSHOT})",
    "freshness_breach": f"""
    SELECT symbol, {START} + to_seconds(since) AS stale_since, {START} + to_seconds(since + {HOLD_TICKS}) AS breach_from,
           {START} + to_seconds(until) AS breach_until, lag_ms
    FROM (SELECT symbol, min(tick) AS since, max(tick) AS until, max_by(lag_ms, tick) AS lag_ms
          FROM (SELECT *, tick - row_number() OVER (PARTITION BY symbol ORDER BY tick) AS span
                FROM (SELECT symbol, tick, max(lag_ms) AS lag_ms FROM (
                        SELECT t.tick, q.symbol, q.exchange, greatest(0, epoch_us({START}) + t.tick * 1000000
                                 - epoch_us(arg_max(q.event_time, row(q.ingest_time, q.source_topic, q.source_partition, q.source_offset)))) // 1000 AS lag_ms
                        FROM (SELECT unnest(range(0, 1861)) AS tick) t JOIN quote_rows q ON epoch_us(q.ingest_time) <= epoch_us({START}) + t.tick * 1000000
                        GROUP BY t.tick, q.symbol, q.exchange)
                      GROUP BY symbol, tick)
                WHERE lag_ms > 2000)
          GROUP BY symbol, span)
    WHERE since + {HOLD_TICKS} <= until""",
    "freshness_check": f"""
    SELECT f.symbol, f.exchange, f.event_time, f.freshness_lag_ms, f.status, x.ask_price, x.spread, x.close, x.sample_count, x.alert_count, x.alert_types,
           s.result_rank, s.source_uri, s.chunk_index, n.title, s.score
    FROM (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY symbol
          ORDER BY event_time DESC, sequence_number DESC, source_topic DESC, source_partition DESC, source_offset DESC) = 1) f
    LEFT JOIN ({SNAPSHOT}) x USING (symbol)
    LEFT JOIN fresh_found s ON s.query_id = f.symbol LEFT JOIN notes n ON n.source_uri = s.source_uri""",
    "quality_report": "\n    UNION ALL ".join(
        f"""SELECT '{zone}' AS zone, '{name}' AS table_name, 'all' AS report_date, count(*) AS row_count, min(event_date) AS min_event_date,
           max(event_date) AS max_event_date, 'run-1' AS job_run_id, {PROCESSED} AS processed_at FROM {part}"""
        for zone, name, part in (
            ("bronze", "bronze_market_events", "events_sent"),
            ("silver", "silver_trades", "silver_t"),
            ("silver", "silver_quotes", "silver_q"),
            ("silver", "silver_sequence_gaps", "gaps"),
            ("gold", "gold_bars_1s", "bars"),
            ("gold", "gold_spread_features", "spreads"),
            ("gold", "gold_volatility_features", "volatility"),
            ("gold", "gold_quality_annotations", "annotations"),
        )
    ),
    "replay_dry_run": f"""
    SELECT source_topic, event_type, count(*) AS event_count, min(source_offset) AS first_offset, max(source_offset) AS last_offset,
           min(event_time) AS first_event_time, max(event_time) AS last_event_time, DATE '{DAY}' AS replay_date
    FROM events_sent WHERE event_date = DATE '{DAY}' GROUP BY source_topic, event_type""",
    "replay_estimate": f"""
    SELECT source_topic, event_type, count(*) AS event_count, min(source_offset) AS first_offset, max(source_offset) AS last_offset,
           min(event_time) AS first_event_time, max(event_time) AS last_event_time
    FROM events_sent WHERE event_time BETWEEN {START} AND {MIDDLE} AND symbol IN ('SYM01', 'SYM07') GROUP BY source_topic, event_type""",
    "feed_event_rate": """
    SELECT event_type, symbol, exchange, time_bucket(INTERVAL 1 MINUTE, event_time) AS window_start, count(*) AS event_count,
           round(count(*) / 60, 6) AS per_second FROM events_sent GROUP BY ALL""",
    "gap_counts": """
    SELECT symbol, exchange, time_bucket(INTERVAL 5 MINUTE, event_time) AS window_start,
           time_bucket(INTERVAL 5 MINUTE, event_time) + INTERVAL 5 MINUTE AS window_end, count(*) AS gap_count FROM gaps GROUP BY ALL""",
    "live_vs_replay_bars": "SELECT * FROM differences",
    "divergence_counts_bars": """
    SELECT symbol, time_bucket(INTERVAL 15 MINUTE, window_start) AS interval_start, count(*) AS difference_count FROM differences GROUP BY ALL""",
    "gap_evidence": f"""
    SELECT g.symbol, g.exchange, g.observed_sequence, g.alert_type, g.expected_sequence, g.event_time, g.source_partition, g.source_offset,
           CASE WHEN n > 0 THEN 'market.quality.alerts.v1,' ELSE '' END
           || CASE WHEN g.source_topic = 'market.quotes.v1' THEN 'market.quotes.v1,market.raw.v1' ELSE 'market.raw.v1,market.trades.v1' END AS topics,
           coalesce(n, 0) AS alert_count, first_alert_time, last_alert_time
    FROM gaps g LEFT JOIN (
        SELECT symbol, exchange, observed_sequence, alert_type, count(*) AS n, min(event_time) AS first_alert_time, max(event_time) AS last_alert_time
        FROM tracked WHERE event_time BETWEEN {START} AND {END} GROUP BY ALL) a
      USING (symbol, exchange, observed_sequence, alert_type)
    WHERE g.event_time BETWEEN {START} AND {END}""",
    "lineage_trace": """
    SELECT symbol, exchange, window_start, trade_count AS bronze_rows, 'market.trades.v1' AS source_topics, source_partitions,
           first_source_offset AS first_offset, last_source_offset AS last_offset, '1.0' AS schema_versions, 'run-1' AS job_runs,
           first_sequence, last_sequence
    FROM bars JOIN (SELECT symbol, exchange, date_trunc('second', event_time) AS window_start,
                           array_to_string(list_sort(list(DISTINCT source_partition)), ',') AS source_partitions
                    FROM silver_t GROUP BY ALL) USING (symbol, exchange, window_start)""",
    "lineage_trace_spreads": """
    SELECT symbol, exchange, window_start, quote_count AS bronze_rows, 'market.quotes.v1' AS source_topics, source_partitions,
           first_source_offset AS first_offset, last_source_offset AS last_offset, '1.0' AS schema_versions, 'run-1' AS job_runs,
           first_sequence, last_sequence
    FROM spreads JOIN (SELECT symbol, exchange, date_trunc('second', event_time) AS window_start,
                              array_to_string(list_sort(list(DISTINCT source_partition)), ',') AS source_partitions
                       FROM silver_q GROUP BY ALL) USING (symbol, exchange, window_start)""",
    "tool_call_errors": """
    SELECT tool_name, result_status, time_bucket(INTERVAL 5 MINUTE, timestamp) AS window_start, count(*) AS call_count,
           result_status = 'error' AND count(*) > 3 AS elevated
    FROM audit GROUP BY tool_name, result_status, time_bucket(INTERVAL 5 MINUTE, timestamp)""",
    "latency_summary": """
    SELECT tool_name, count(*) AS request_count, round(count(*) * 1e6 / (epoch_us(max(timestamp)) - epoch_us(min(timestamp))), 6) AS per_second,
           round(sum(latency_ms::DECIMAL(27,9))::DOUBLE / count(*), 6) AS mean,
           list_sort(list(latency_ms))[round_even(0.95 * (count(*) - 1), 0)::BIGINT + 1] AS p95,
           list_sort(list(latency_ms))[round_even(0.99 * (count(*) - 1), 0)::BIGINT + 1] AS p99
    FROM audit GROUP BY tool_name""",
    "frontmatter": "SELECT source_uri, title, tags, source_type, md5(body) AS body_md5 FROM notes",
    "chunk_documents": "SELECT source_uri, chunk_index, md5(content) AS content_md5 FROM note_chunks",
    "chunk_pages": "SELECT source_uri, chunk_index, md5(content) AS content_md5 FROM page_chunks",
    "chunk_upsert": f"""
    SELECT source_uri, chunk_index, CASE WHEN title LIKE 'Note %' THEN 'New ' || title ELSE title END AS title,
           CASE WHEN title LIKE 'Note %' THEN {END} ELSE {START} END AS indexed_at, md5(content) AS content_md5 FROM note_chunks""",
    "hashed_embedding": "SELECT source_uri, chunk_index, idx, round(weight, 6) AS weight FROM turn_vectors",
    "cosine_pairs": """
    SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "vector_topk": """
    SELECT query_id, result_rank, source_uri, chunk_index, title, source_type, score, md5(content) AS content_md5
    FROM searched JOIN note_chunks USING (source_uri, chunk_index)""",
    "incident_summary": f"""
    SELECT incident_id,
           coalesce('Most relevant evidence is from ' || max(CASE WHEN result_rank = 1 THEN title || ': ' || substr(content, 1, 280) END),
                    'No indexed evidence found for this incident.') AS summary,
           coalesce(string_agg(CASE WHEN result_rank <= 3 THEN substr(content, 1, 240) END, ',' ORDER BY result_rank), '') AS timeline,
           coalesce(string_agg(source_uri, ',' ORDER BY result_rank), '') AS sources
    FROM (VALUES {", ".join(f"('{name}')" for name in INCIDENTS)}) AS i(incident_id)
    LEFT JOIN (SELECT * FROM incident_found JOIN note_chunks USING (source_uri, chunk_index)) ON query_id = incident_id
    GROUP BY incident_id""",
    "table_conformance": "",
    "stale_alerts": "",
}


def _stale_sql() -> str:
    """The monitor loop itself: one step per tick, the mark carried from step to step."""
    return f"""
    WITH RECURSIVE {{parts}},
    lags AS MATERIALIZED (
      SELECT t.tick, t.tick_time, q.symbol,
             arg_max(q.exchange, row(q.ingest_time, q.source_topic, q.source_partition, q.source_offset)) AS exchange,
             greatest(0, epoch_us(t.tick_time) - epoch_us(arg_max(q.event_time, row(q.ingest_time, q.source_topic, q.source_partition, q.source_offset)))) // 1000 AS lag_ms
      FROM ticks t JOIN quote_rows q ON q.ingest_time <= t.tick_time GROUP BY t.tick, t.tick_time, q.symbol),
    walk(tick, symbol, exchange, tick_time, lag_ms, mark, raised) AS (
      SELECT -1::BIGINT, symbol, '', {START}, 0::BIGINT, 0::BIGINT, false FROM (SELECT DISTINCT symbol FROM quote_rows)
      UNION ALL
      SELECT w.tick + 1, w.symbol, coalesce(l.exchange, ''), coalesce(l.tick_time, {START}), coalesce(l.lag_ms, 0),
             CASE WHEN coalesce(l.lag_ms, 0) <= 2000 THEN 0 WHEN l.lag_ms - w.mark >= 2000 THEN l.lag_ms ELSE w.mark END,
             coalesce(l.lag_ms > 2000 AND l.lag_ms - w.mark >= 2000, false)
      FROM walk w LEFT JOIN lags l ON l.symbol = w.symbol AND l.tick = w.tick + 1 WHERE w.tick < 185)
    SELECT '1.0' AS schema_version, 'quality_alert' AS event_type, symbol, exchange, tick_time AS event_time, tick_time AS ingest_time,
           0::BIGINT AS sequence_number, 'stale_symbol' AS alert_type, 'warning' AS severity,
           symbol || ' freshness lag is ' || lag_ms || ' ms.' AS message, NULL::BIGINT AS observed_sequence, NULL::BIGINT AS expected_sequence
    FROM walk WHERE raised"""


def _needed(sql: str) -> list[str]:
    """The parts a text names, each after those it builds on."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in found and re.search(rf"\b(FROM|JOIN|UNPIVOT)\s+{name}\b", text):
                visit(PARTS[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def _with(sql: str) -> str:
    parts = ",\n".join(f"{name} AS MATERIALIZED ({PARTS[name]})" for name in _needed(sql))
    if "{parts}" in sql:
        return sql.replace("{parts}", parts)
    return f"WITH {parts}\n{sql}" if parts else sql


def _conformance_sql() -> str:
    from tickforge.contracts import LINEAGE_COLUMNS, TABLE_CONTRACTS

    parts = {
        "bronze_market_events": "events_sent",
        "silver_trades": "silver_t",
        "silver_quotes": "silver_q",
        "silver_sequence_gaps": "gaps",
        "gold_bars_1s": "bars",
        "gold_spread_features": "spreads",
        "gold_volatility_features": "volatility",
        "gold_quality_annotations": "annotations",
    }
    rows = []
    for name, part in parts.items():
        contract = TABLE_CONTRACTS[name]
        for column in contract.required_columns:
            nulls = "0" if column == "raw_event" else f"count(*) - count({column})"
            rows.append(
                f"SELECT '{name}' AS table_name, '{column}' AS column_name, true AS present, {nulls} AS null_count, count(*) AS row_count, "
                f"{str(column in contract.partition_columns).lower()} AS is_partition, {str(column in LINEAGE_COLUMNS).lower()} AS is_lineage, "
                f"NULL::VARCHAR AS error FROM {part}"
            )
    rows.append("SELECT 'gold_unknown', NULL, false, NULL, NULL, false, false, 'unknown_table'")
    return "\nUNION ALL ".join(rows)


DATED = {
    "event_date": """bronze_rows lineage_columns time_range_filter event_date_filter silver_trades silver_quotes sequence_gaps
        bars_1s spread_features volatility_features quality_annotations gold_scan research_features signal_frame
        bronze_ingest table_overwrite table_read""".split(),
    "min_event_date max_event_date": ["quality_report", "table_append"],
    "replay_date": ["replay_dry_run", "replay_output"],
}


TILED = "sequence_gaps sequence_track rolling_metrics bar_updates signal_frame symbol_resolution".split()


def _dates_as_text(name: str, sql: str) -> str:
    """Dates as text on both sides: clients differ in how they hand out a DATE."""
    for columns, names in DATED.items():
        if name in names:
            casts = ", ".join(f"{column}::VARCHAR AS {column}" for column in columns.split())
            return f"SELECT * REPLACE ({casts}) FROM ({sql})"
    return sql


def oracle_sql() -> dict[str, str]:
    from tickforge.plans.stored import STORED_SQL

    selects = {**SELECTS, "table_conformance": _conformance_sql(), "stale_alerts": _stale_sql(), **STORED_SQL, "stream_stale_monitor": _stale_sql()}
    found = {name: _dates_as_text(name, _with(sql)) for name, sql in selects.items()}
    found |= {f"{name}_tiled": found[name] for name in TILED}
    found["vector_topk_postings"] = found["vector_topk"]
    scale = {**dict.fromkeys(SEVERAL_DAYS, market.WIDE), **dict.fromkeys(HALF_AN_HOUR, market.HALF_HOUR)}
    return {name: sql.replace("// 14400", f"// {scale.get(name, market.DENSE)}") for name, sql in found.items()}
