"""Topics as message frames: Kafka where the package is there, JSON files elsewhere."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickforge.contracts import MESSAGE_SCHEMA
from tickforge.functions.columns import iso_utc

COLUMNS = MESSAGE_SCHEMA.fieldNames()


def read_topics(
    spark: SparkSession,
    topics: tuple[str, ...],
    source: str = "kafka",
    streaming: bool = True,
    starting: str = "earliest",
    per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """Messages (key, value, topic, partition, offset, timestamp) of some topics.

    ``kafka`` takes the connector's own options; ``json`` takes ``path`` with one folder
    per topic. ``per_trigger`` bounds a micro-batch in offsets or in files.
    """
    reader = spark.readStream if streaming else spark.read
    if source == "kafka":
        reader = reader.format("kafka").option("subscribe", ",".join(topics))
        if streaming or starting == "earliest":
            reader = reader.option("startingOffsets", starting)
        if per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", per_trigger)
        loaded = reader.options(**options).load()
        return loaded.select(
            F.col("key").cast("string").alias("key"),
            F.col("value").cast("string").alias("value"),
            "topic",
            F.col("partition").cast("long").alias("partition"),
            "offset",
            "timestamp",
        )
    if source != "json":
        raise ValueError(f"unknown topic source {source!r}")
    path = options.pop("path").rstrip("/")
    reader = reader.format("json").schema(MESSAGE_SCHEMA).option("recursiveFileLookup", True)
    if streaming and per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    names = topics[0] if len(topics) == 1 else "{" + ",".join(topics) + "}"
    return reader.options(**options).load(f"{path}/{names}").select(*COLUMNS)


def read_offsets(spark: SparkSession, ranges: dict[str, dict[int, tuple[int, int]] | None], source: str = "kafka", **options: str) -> DataFrame:
    """Messages between two offsets, per topic and partition the first one and the one after the last.

    A topic without ranges is read as a whole; of one that has them, other partitions are left out.
    """
    topics = tuple(ranges)
    if source == "kafka":
        partitions = {t: {str(p): r for p, r in parts.items()} for t, parts in ranges.items() if parts}
        whole = [t for t, parts in ranges.items() if not parts]
        parts = [read_topics(spark, tuple(whole), "kafka", streaming=False, **options)] if whole else []
        if partitions:
            bounds = [json.dumps({t: {p: r[i] for p, r in own.items()} for t, own in partitions.items()}) for i in (0, 1)]
            assigned = json.dumps({t: [int(p) for p in own] for t, own in partitions.items()})
            loaded = spark.read.format("kafka").option("assign", assigned).option("startingOffsets", bounds[0]).option("endingOffsets", bounds[1])
            parts.append(loaded.options(**options).load().selectExpr("cast(key as string) key", "cast(value as string) value", "topic", "cast(partition as long) partition", "offset", "timestamp"))
        return reduce(DataFrame.unionByName, parts)
    messages = read_topics(spark, topics, source, streaming=False, **options)
    wanted = F.lit(False)
    for topic, parts in ranges.items():
        own = F.col("topic") == topic
        if parts:
            between = [(F.col("partition") == p) & (F.col("offset") >= lo) & (F.col("offset") < hi) for p, (lo, hi) in parts.items()]
            own = own & reduce(lambda a, b: a | b, between)
        wanted = wanted | own
    return messages.where(wanted)


def write_topic(messages: DataFrame, topic: str, sink: str = "json", **options: str) -> None:
    """Append messages to one topic."""
    if sink == "kafka":
        messages.select("key", "value").write.format("kafka").option("topic", topic).options(**options).save()
        return
    path = options.pop("path").rstrip("/")
    stamped = messages.withColumn("timestamp", iso_utc("timestamp"))
    stamped.select(*COLUMNS).write.mode(options.pop("mode", "append")).json(f"{path}/{topic}")


def as_messages(events: DataFrame, topic: str, value: list[str]) -> DataFrame:
    """Events with their source position as messages keyed by symbol."""
    times = {field.name for field in events.schema if field.dataType.typeName() == "timestamp"}
    fields = [iso_utc(name).alias(name) if name in times else F.col(name) for name in sorted(value)]
    return events.select(
        F.col("symbol").alias("key"),
        F.to_json(F.struct(*fields)).alias("value"),
        F.lit(topic).alias("topic"),
        F.col("source_partition").alias("partition"),
        F.col("source_offset").alias("offset"),
        F.col("ingest_time").alias("timestamp"),
    )
