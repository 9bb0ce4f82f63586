"""The first rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key in the given order, with their place from 1 as ``rank``.

    Spark turns the limit into a group limit before the shuffle: a task sends at most
    ``n`` rows of a key however often that key occurs.
    """
    place = rank or "_place"
    found = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n)
    return found if rank else found.drop(place)
