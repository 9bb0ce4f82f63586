import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from tests.helpers import bronze_of, messages, processed, rows_of, trade
from tickforge.contracts import TRADES_TOPIC
from tickforge.operators import checks, gold, reports, silver, text
from tickforge.session import scratch_path
from tickforge.sources import documents, folders, tables, topics


def test_markdown_files(spark, tmp_path):
    notes = {
        "Window Tuning.md": '---\ntitle: "Window Tuning"\ntags: [windows, "latency"]\n---\nUse event time windows.',
        "deep/er/plain.md": "no front matter here",
        ".hidden.md": "not this",
        "other.txt": "nor this",
    }
    for name, content in notes.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    found = {row["source_uri"]: row for row in text.frontmatter(documents.document_source(spark, str(tmp_path)), "vault").collect()}
    assert set(found) == {"vault:Window Tuning.md", "vault:deep/er/plain.md"}
    first = found["vault:Window Tuning.md"]
    assert (first["title"], first["tags"], first["body"]) == ("Window Tuning", ["windows", "latency"], "Use event time windows.")
    assert (found["vault:deep/er/plain.md"]["title"], found["vault:deep/er/plain.md"]["tags"]) == ("plain", [])
    one = documents.document_source(spark, str(tmp_path / "Window Tuning.md")).collect()
    assert [row["path"] for row in one] == ["Window Tuning.md"]


def trades_on(spark, *days):
    sent = [trade(n, f"2026-05-{day:02d}T00:00:00Z", 1.0 * n, 1) for n, day in enumerate(days, 1)]
    return silver.silver_trades(bronze_of(spark, sent))


def test_one_date_is_replaced_alone(spark):
    store = tables.TableStore(spark, scratch_path(spark, "store"))
    store.overwrite(trades_on(spark, 1, 2, 2), "silver_trades")
    store.overwrite(trades_on(spark, 2), "silver_trades", only_present_partitions=True)
    by_day = {row["event_date"].day: row["count"] for row in store.read("silver_trades").groupBy("event_date").count().collect()}
    assert by_day == {1: 1, 2: 1}
    store.overwrite(trades_on(spark, 3), "silver_trades")
    assert store.read("silver_trades").count() == 1


def test_date_predicate_prunes_partitions(spark):
    store = tables.TableStore(spark, scratch_path(spark, "store"))
    bars = gold.bars(trades_on(spark, 1, 2, 3))
    store.overwrite(bars, "gold_bars_1s")
    scan = gold.gold_scan(store.read("gold_bars_1s"), "aapl", dt.date(2026, 5, 2), "2026-05-03")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert scan.count() == 2
    assert "PartitionFilters: [isnotnull(event_date" in plan and "EqualTo(symbol,AAPL)" in plan


def test_report_replay_and_registration(spark):
    store = tables.TableStore(spark, scratch_path(spark, "store"))
    store.overwrite(trades_on(spark, 1, 2), "silver_trades")
    report = reports.quality_report({"silver_trades": store.read("silver_trades")}, "2026-05-02", "r", processed())
    path = f"{store.base_path}/reports"
    for run in ("r", "s/1", "r"):
        store.append(report, path, run)
    assert [row["row_count"] for row in store.read_appended(path).collect()] == [1, 1]
    replay = reports.replay_dry_run(bronze_of(spark, [trade(1, "2026-05-02T00:00:00Z", 1.0, 1)]), "2026-05-02")
    assert store.replay_output(replay, "2026-05-02").endswith("/replay/dry_run/event_date=2026-05-02")
    name = store.register("silver_trades", "research_" + store.base_path[-12:])
    assert spark.table(name).count() == 2


def test_conformance_names_what_is_missing(spark):
    found = checks.table_conformance({"silver_trades": trades_on(spark, 1).drop("price"), "nope": trades_on(spark, 1)})
    price = found.where("column_name = 'price'").first()
    assert (price["present"], price["null_count"], price["row_count"]) == (False, None, 1)
    assert found.where("table_name = 'nope'").first()["error"] == "unknown_table"


def test_topics_keep_messages(spark):
    place = scratch_path(spark, "topic")
    sent = messages(spark, [trade(1, "2026-05-07T00:00:00Z", 1.0, 1)]).withColumn("timestamp", F.lit("2026-05-07 00:00:00.123456").cast("timestamp"))
    topics.write_topic(sent, TRADES_TOPIC, path=place)
    assert rows_of(topics.read_topics(spark, (TRADES_TOPIC,), "json", streaming=False, path=place)) == rows_of(sent)
    assert topics.read_topics(spark, (TRADES_TOPIC,), "json", path=place).isStreaming


def test_audit_appends(spark):
    place = scratch_path(spark, "audit")
    row = [("lookup", "demo", "{}", "ok", 12, dt.datetime(2026, 5, 7))]
    record = spark.createDataFrame(row, "tool_name string, caller string, parameters string, result_status string, duration_ms long, timestamp timestamp")
    for batch, rows in (("a", record), ("b", record.union(record)), ("a", record), ("b", record.union(record))):
        tables.append_audit(rows, place, batch)
    assert tables.read_audit(spark, place).count() == 3


def test_a_run_is_replaced_as_a_whole(spark):
    """A run again, with other rows and columns; an attempt that was never committed does not count."""
    table = folders.RunTable(spark, scratch_path(spark, "runs"))
    table.write(spark.range(3).withColumn("run", F.lit("one")), "one")
    table.write(spark.range(10, 12).withColumn("run", F.lit("two")), "two")
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 2, 10, 11]
    table.write(spark.range(5, 6).withColumn("extra", F.lit(1)), "one")
    found = {r.id: (r.run, r.extra) for r in table.read().collect()}
    assert found == {5: (None, 1), 10: ("two", None), 11: ("two", None)}
    spark.range(99, 100).write.parquet(f"{table.path}/runs/one/2")  # died before its commit
    assert {r.id for r in table.read().collect()} == {5, 10, 11}
    table.write(spark.range(7, 8), "one")
    assert {r.id for r in table.read().collect()} == {7, 10, 11}


def test_an_upsert_rewrites_the_buckets_it_touches(spark):
    index = folders.BucketedIndex(spark, scratch_path(spark, "index"), buckets=8)
    rows = lambda ids, text: spark.createDataFrame(
        [(f"doc:{i}", k, f"{text} {i} {k}", dt.datetime(2026, 5, 7)) for i in ids for k in range(2)], "source_uri string, chunk_index int, content string, indexed_at timestamp"
    )
    assert index.upsert(rows(range(40), "old")) == list(range(8))
    files = lambda: {f.split("/bucket=")[1]: f for f in index.read().inputFiles()}
    before = files()
    touched = index.upsert(rows([3], "new").union(rows([41], "first")))
    after = files()
    assert 0 < len(touched) <= 2
    kept = {name for name in before if int(name.split("/")[0]) not in touched}
    assert kept <= after.keys() and {after[n] for n in kept} == {before[n] for n in kept}
    assert all(f"generation=1/bucket={b}" in f for b in touched for n, f in after.items() if n.startswith(f"{b}/"))
    found = {(r.source_uri, r.chunk_index): r.content for r in index.read().collect()}
    assert found == {(f"doc:{i}", k): f"{'new' if i == 3 else 'first' if i == 41 else 'old'} {i} {k}" for i in [*range(40), 41] for k in range(2)}
    index.upsert(rows([3], "newer"))
    assert index.upsert(rows([], "none")) == [] and list(index.finished()) == [1, 2]
    assert "generation=0" not in " ".join(f for f in index.read().inputFiles() if any(f"bucket={b}/" in f for b in touched))


def test_work_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        assert str(Path(scratch_path(spark, "x")).parent) == folder.rstrip("/")
