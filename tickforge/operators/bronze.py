"""Bronze: decoded messages with lineage, and the messages that do not decode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tickforge.contracts import ENVELOPE_SCHEMA, TABLE_CONTRACTS
from tickforge.functions.columns import event_date, parse_utc


SOURCE_TYPES = {"topic": "string", "partition": "long", "offset": "long"}
TYPED: dict[str, Callable[[Column], Column]] = {"symbol": F.upper, "event_time": parse_utc, "ingest_time": parse_utc}
"""Envelope fields that are not taken as they are in the message."""


def _decoded(messages: DataFrame) -> DataFrame:
    """(source_..., raw_event, event) with each message parsed once: filters on the fields are not
    pushed below the generator, where the optimizer would repeat the parse for every predicate."""
    source = [F.col(name).cast(kind).alias(f"source_{name}") for name, kind in SOURCE_TYPES.items()]
    text = messages.select(*source, F.col("value").cast("string").alias("raw_event"))
    return text.select("*", F.explode(F.array(F.from_json("raw_event", ENVELOPE_SCHEMA))).alias("event"))


def _as_it_is(field: Column) -> Column:
    return field


def _accepted() -> Column:
    return F.col("event.schema_version").isNotNull() & F.col("event.event_type").isNotNull()


def bronze_rows(messages: DataFrame, job_run_id: str = "manual", processed_at: Column | None = None) -> DataFrame:
    """The columns of the bronze contract for every decodable message."""
    columns = {name: TYPED.get(name, _as_it_is)(F.col(f"event.{name}")) for name in ENVELOPE_SCHEMA.names}
    columns["event_date"] = event_date(columns["event_time"])
    columns["job_run_id"] = F.lit(job_run_id)
    columns["processed_at"] = F.current_timestamp() if processed_at is None else processed_at
    wanted = TABLE_CONTRACTS["bronze_market_events"].required_columns
    return _decoded(messages).where(_accepted()).select(*[columns.get(name, F.col(name)).alias(name) for name in wanted])


def bronze_rejects(messages: DataFrame) -> DataFrame:
    """Messages without a readable version and type, kept instead of dropped."""
    return (
        _decoded(messages)
        .where(~_accepted())
        .select(
            "source_topic",
            "source_partition",
            "source_offset",
            "raw_event",
            F.when(F.json_object_keys("raw_event").isNull(), "malformed_json")
            .when(F.col("event.schema_version").isNull(), "missing_schema_version")
            .otherwise("missing_event_type")
            .alias("reason"),
        )
    )


def payload(bronze: DataFrame, event_type: str, schema) -> DataFrame:
    """Rows of one type with their typed payload."""
    return bronze.where(F.col("event_type") == event_type).withColumn("payload", F.from_json("raw_event", schema))


def raw_event_decode(bronze: DataFrame, schema) -> DataFrame:
    """Every row with the given payload fields read from its raw text."""
    decoded = F.from_json("raw_event", schema)
    return bronze.withColumn("payload", decoded).select(*bronze.columns, "payload.*")


def event_router(bronze: DataFrame) -> dict[str, DataFrame]:
    """One frame for each event type that has its own path."""
    return {name: bronze.where(F.col("event_type") == name) for name in ("trade", "quote", "quality_alert")}
