"""Run registered queries beside their SQL and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)):
        return round(float(value), 6)
    return value


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(spark_df, connection, sql: str) -> list[str]:
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    expected = rows_of(names, result.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} against {sorted(names)}"]
    found = rows_of(spark_df.columns, spark_df.collect())
    if found == expected:
        return []
    missing, extra = expected - found, found - expected
    return [f"rows {sum(found.values())} against {sum(expected.values())}"] + [
        f"{label} {row}" for label, side in (("missing", missing), ("extra", extra)) for row in list(side)[:3]
    ]


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tickforge.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql = connect(sf_dir), oracle_sql()
    for name, build in queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            if name in sql:
                found = differences(build(spark, sf_dir), connection, sql[name])
            else:
                found = [] if build(spark, sf_dir).count() >= 0 else ["no rows"]
        except Exception as error:  # noqa: BLE001 - one failing query should not hide the others
            found = [f"{type(error).__name__}: {str(error)[:700]}"]
        print(f"{name}: {'ok' if not found else 'DIFFERS'} {time.time() - began:.1f}s", flush=True)
        for line in found:
            print("   ", line[:700], flush=True)


if __name__ == "__main__":
    main()
