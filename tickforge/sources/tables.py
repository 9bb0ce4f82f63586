"""Zone tables on shared storage: read, overwrite, append, register."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tickforge.contracts import TABLE_CONTRACTS
from tickforge.sources.folders import RunTable


@dataclass(frozen=True)
class TableStore:
    """Tables as ``base_path/zone/name`` in one format.

    Parquet by default; any format the runtime has, such as delta, can be named.
    """

    spark: SparkSession
    base_path: str
    format: str = "parquet"

    def path(self, name: str) -> str:
        return f"{self.base_path.rstrip('/')}/{TABLE_CONTRACTS[name].zone}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.read_path(self.path(name))

    def read_path(self, path: str) -> DataFrame:
        return self.spark.read.format(self.format).load(path)

    def overwrite(self, df: DataFrame, name: str, only_present_partitions: bool = False) -> None:
        """Replace the table, or only the partitions that ``df`` has rows for.

        Rows are rebalanced on the partition columns: few files per date, and a date
        that is much larger than the others is split.
        """
        columns = TABLE_CONTRACTS[name].partition_columns
        writer = df.hint("rebalance", *columns).write.format(self.format).mode("overwrite").partitionBy(*columns)
        mode = "dynamic" if only_present_partitions else "static"
        writer.option("partitionOverwriteMode", mode).save(self.path(name))

    def append(self, df: DataFrame, path: str, run_id: str) -> None:
        """Add the rows of a run; the same run again replaces them."""
        RunTable(self.spark, path).write(df, run_id)

    def read_appended(self, path: str) -> DataFrame:
        return RunTable(self.spark, path).read()

    def replay_output(self, df: DataFrame, date: dt.date | str) -> str:
        """Write a replay summary to its own place, away from the tables."""
        path = f"{self.base_path.rstrip('/')}/replay/dry_run/event_date={date}"
        df.write.format(self.format).mode("overwrite").save(path)
        return path

    def register(self, name: str, database: str) -> str:
        """Make the stored table known to SQL under ``database``."""
        location = f"{self.base_path.rstrip('/')}/databases/{database}"
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} USING {self.format} LOCATION '{self.path(name)}'")
        if self.format == "parquet":
            self.spark.sql(f"MSCK REPAIR TABLE {database}.{name}")
        return f"{database}.{name}"


def save_index(chunks: DataFrame, path: str) -> None:
    """Store embedded chunks; a later load needs no embedding."""
    chunks.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


AUDIT_COLUMNS = ["tool_name", "caller", "parameters", "result_status", "duration_ms", "timestamp"]


def append_audit(records: DataFrame, path: str, batch_id: str) -> None:
    """Add call records to the append-only audit table; a batch that is sent again is there once."""
    RunTable(records.sparkSession, path).write(records.select(*AUDIT_COLUMNS), batch_id)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return RunTable(spark, path).read()
