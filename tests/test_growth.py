"""What must not grow faster than the input: steps that are done once, in many tasks, in small parts."""

import datetime as dt

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickforge.functions import scans
from tickforge.contracts import EVENT_CONTRACTS
from tickforge.operators import checks, live, reports, vectors
from tickforge.plans import market, stored
from tickforge.plans.market import DENSE, TABLE_COLUMNS
from tickforge.plans.queries import BATCH, Market
from tickforge.session import scratch_path
from tickforge.sources import folders, postings
from tickforge.streaming import hot_state, stateful


@pytest.fixture
def small(spark, tmp_path):
    """A market of 1200 events."""
    kinds = ["purchase", "click", "view", "signup", "error"]
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=36 * i), i % 31, kinds[i * 7 % 5], 20.0 + i % 13, f'{{"k": {i % 17}}}') for i in range(1200)]
    spark.createDataFrame(rows, TABLE_COLUMNS["events"]).write.parquet(f"{tmp_path}/events.parquet")
    return Market(spark, str(tmp_path), DENSE)


@pytest.fixture
def places(spark, tmp_path, monkeypatch):
    """Known scratch folders, and no partitions joined because they are small."""
    monkeypatch.setattr(stored, "_place", lambda m, name: f"{tmp_path}/scratch/{name}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield tmp_path / "scratch"
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_parts_of_the_late_trades_are_written_by_many_tasks(small, places):
    found = stored._late_trades(small)
    assert found.where("kind = 'bar'").count() > 100
    assert len(list((places / "closing/topics/mixed").glob("part-*"))) > 4


def test_parts_of_the_vendor_records_are_written_by_many_tasks(small, places):
    assert stored._symbol_stream(small).count() == 1200
    assert len(list((places / "vendor/records").glob("part-*"))) > 3


class Value:
    """A value state that is kept here."""

    value = None

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_records_wait_packed_and_leave_in_the_parts_they_came_in():
    processor, parts = stateful.KnownMappings(), []
    processor.init(Value())
    rows = [(5, 1, None), (7, 2, "B"), (7, 3, None), (3, 4, "A"), (9, 5, None), (7, 1, None), (2, 9, None)]
    for begin in range(0, len(rows), 2):
        parts.append(pd.DataFrame([(*r, f"r{r[1]}") for r in rows[begin : begin + 2]], columns=["ts_event", "record_id", "offered_symbol", "record"]))
    found = list(processor.handleInputRows((100,), iter(parts), None))
    assert [len(f) for f in found] == [2, 2, 2, 1]
    assert [x for f in found for x in f["mapped_symbol"]] == ["A", "B", "B", "A", "B", "A", None]
    later = pd.DataFrame([(8, 1, None, "x"), (4, 1, "C", "y"), (5, 0, None, "z")], columns=["ts_event", "record_id", "offered_symbol", "record"])
    assert list(next(processor.handleInputRows((100,), iter([later]), None))["mapped_symbol"]) == ["B", "C", "C"]


def test_packed_records_come_back_as_they_were(spark):
    when = dt.datetime(2024, 1, 1, 0, 0, 0, 123456)
    rows = [(1, 1 << 60, 1, "é\n\"", 0.1, [(1.5, None, None, 3)], when), (2, None, None, None, float("nan"), [], None), (3, 0, 0, "", -0.0, [(None,) * 4, None], when)]
    df = spark.createDataFrame(rows, "record_id long, a long, b int, c string, d double, levels array<struct<x: double, y: double, z: long, w: long>>, t timestamp")
    text = F.to_json(F.struct(*df.columns), stateful.PACKED)
    back = df.select(F.inline(F.array(F.from_json(text, df.schema, stateful.PACKED))))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_state_messages_are_made_once(small, monkeypatch, tmp_path):
    seen = []
    monkeypatch.setattr(stored, "_place", lambda m, name: f"{tmp_path}/scratch/{name}")
    monkeypatch.setattr(hot_state.HotState, "upsert", lambda self, messages, batch: seen.append(messages))
    stored._hot_state_upsert(small)
    assert len(seen) == 3 and all("/scratch/messages/" in f for df in seen for f in df.inputFiles())


def test_replayed_trades_are_made_once_per_time(small, monkeypatch, tmp_path):
    taken, own = [], live.silver_state
    numbers = iter(range(100))
    monkeypatch.setattr(stored, "_place", lambda m, name: f"{tmp_path}/scratch/{name}/{next(numbers)}")
    monkeypatch.setattr(live, "silver_state", lambda trades, quotes, as_of: taken.append(trades) or own(trades, quotes, as_of))
    stored._state_differences(small)
    assert len(taken) == 2 and all("/scratch/replayed/" in f for df in taken for f in df.inputFiles())


def test_reported_tables_are_made_once(small, monkeypatch):
    seen, own = [], reports.quality_report
    monkeypatch.setattr(reports, "quality_report", lambda tables, *rest: seen.extend(tables.values()) or own(tables, *rest))
    assert stored._table_append(small).count() == 4
    assert len(seen) == 6 and len({f for df in seen for f in df.inputFiles()}) == len({f for df in seen[:2] for f in df.inputFiles()})
    assert all("/trades-" in f or "/quotes-" in f for df in seen for f in df.inputFiles())


def test_wide_rows_are_cut_into_more_tiles(spark, monkeypatch):
    rows = spark.range(4000).select((F.col("id") % 3).alias("k"), "id", F.lit("x").alias("wide"))
    tiles = lambda: scans.range_tiles(rows, ["k"], ["id"]).select(scans.TILE).distinct().count()
    assert tiles() == 2
    monkeypatch.setattr(scans, "TILE_BYTES", 20_000)
    assert tiles() >= 7


def test_chunks_of_an_upsert_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    index = folders.BucketedIndex(spark, scratch_path(spark, "index"), buckets=4)
    for n, version in ((30, 0), (10, 1)):
        rows = [(f"doc:{i}", 0, f"text {version}", dt.datetime(2026, 5, 7 + version)) for i in range(n)]
        df = spark.createDataFrame(rows, "source_uri string, chunk_index int, content string, indexed_at timestamp")
        index.upsert(df.mapInPandas(counted, df.schema))
    assert made.value == 40
    assert sorted(r.content for r in index.read().collect()) == ["text 0"] * 20 + ["text 1"] * 10
    assert not index.names("sent")


def test_texts_are_embedded_in_slices(monkeypatch):
    texts = pa.array(["a b", None, "c" * 50, "", "d e f", "é" * 30, "g"])
    parts = vectors.text_slices(texts, 40)
    assert sum((p.to_pylist() for p in parts), []) == texts.to_pylist()
    assert max(len("".join(x or "" for x in p.to_pylist()).encode()) for p in parts) <= 40 + 60 and len(parts) > 2
    assert [len(p) for p in vectors.text_slices(pa.array([], pa.string()))] == [0]
    whole = vectors._embedded(texts, 16)
    assert pa.concat_arrays([vectors._embedded(p, 16) for p in parts]).to_pylist() == whole.to_pylist()


CHUNKS = [(f"doc:{i}", k, f"word{i} word{k} common text number {i * k}") for i in range(40) for k in range(3)]


def test_winners_are_broadcast_not_the_chunks_shuffled(spark):
    chunks = vectors.with_embedding(spark.createDataFrame(CHUNKS, "source_uri string, chunk_index int, content string"))
    asked = spark.createDataFrame([("q", "common word3")], "query_id string, query string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = vectors.vector_topk(chunks, asked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


def test_a_search_over_postings_scores_once(spark, monkeypatch):
    """What is counted before it is broadcast is not made from scores."""
    index = postings.PostingIndex.save(vectors.with_embedding(spark.createDataFrame(CHUNKS, "source_uri string, chunk_index int, content string")), scratch_path(spark, "p"))
    asked = spark.createDataFrame([("q", "common word3"), ("r", "word5 text")], "query_id string, query string")
    counted, own = [], postings.few
    monkeypatch.setattr(postings, "few", lambda df, limit=vectors.BROADCAST_SLOTS, of=None: counted.append(df if of is None else of) or own(df, limit, of))
    assert index.search(asked).count() == 10
    assert counted and not any({"score", "share"} & {*df.columns} for df in counted)


def test_events_are_numbered_once_for_their_check_and_leave_the_task_of_their_symbol(small, spark, monkeypatch, tmp_path):
    numbered, own = [], market.market_events
    monkeypatch.setattr(market, "market_events", lambda *args, **kw: numbered.append(args) or own(*args, **kw))
    one = small.spark.read.parquet(f"{small.sf_dir}/events.parquet").withColumn("user_id", F.lit(5).cast("long"))
    one.write.parquet(f"{tmp_path}/one/events.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = BATCH["contract_violations"](Market(spark, f"{tmp_path}/one", DENSE))
        tasks = {r.contract: r.n for r in found.groupBy("contract", F.spark_partition_id().alias("task")).count().groupBy("contract").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(numbered) == 1
    assert set(tasks) == set(EVENT_CONTRACTS) and min(tasks["bar_1s"], tasks["rolling_metrics"]) > 1


TEXT = '"symbol": "A", "exchange": "X", "event_time": "2024-01-01T00:00:00Z", "ingest_time": "2024-01-01T00:00:00Z", "schema_version": "1.0", "event_type": "trade"'
HEAD = f'"sequence_number": 1, {TEXT}'
MARKET = {
    f"{{{HEAD}}}": [],
    f'{{{HEAD}, "payload": {{"price": 1.5, "size": 2}}}}': [],
    f'{{{HEAD}, "payload": {{"a b": {{"c": [1]}}}}}}': [],
    f'{{{HEAD}, "payload": {{"a": "b"}}, "port": {{"c": "d"}}}}': ["unknown:port"],
    f'{{{HEAD}, "x: STRING, y": 1}}': ["unknown:x: STRING, y"],
    f'{{{TEXT}, "sequence_number": 2.0}}': [],
    f'{{{TEXT}, "sequence_number": 2.5}}': ["type:sequence_number"],
    f'{{{TEXT}, "sequence_number": null}}': ["type:sequence_number"],
    f"{{{TEXT}}}": ["required:sequence_number"],
    f'{{{HEAD}, "symbol": "B"}}': ["malformed"],
    "{}": ["required:event_time", "required:event_type", "required:exchange", "required:ingest_time", "required:schema_version", "required:sequence_number", "required:symbol"],
    "null": ["malformed"],
}


def test_rules_are_looked_up_one_by_one_only_for_documents_that_are_not_sound(spark):
    events = spark.createDataFrame([(text,) for text in MARKET], "value string")
    assert {r.value: r.violations for r in checks.contract_violations(events, "market").collect()} == MARKET
    parsed = events.withColumn("document", F.explode(F.array(F.try_parse_json("value"))))
    sound = {r.value for r in parsed.where(checks._sound(EVENT_CONTRACTS["market"])).collect()}
    assert sound == {text for text in list(MARKET)[:2]}
    assert {r.value: r.v for r in parsed.withColumn("v", checks._broken(EVENT_CONTRACTS["market"], "value")).collect()} == MARKET
