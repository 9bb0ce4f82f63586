"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickforge.contracts import SCHEMA_VERSION

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_utc(value: str | Column) -> Column:
    """ISO-8601 text to timestamp; NULL when it does not parse."""
    return F.try_to_timestamp(col(value))


def iso_utc(value: str | Column) -> Column:
    return F.date_format(col(value), ISO_FORMAT)


def event_date(value: str | Column) -> Column:
    return F.to_date(col(value))


def window_start(value: str | Column, interval: str = "1 second") -> Column:
    """Start of the tumbling window that holds the event."""
    if interval == "1 second":
        return F.date_trunc("second", col(value))
    return F.window(col(value), interval).start


def nanos_to_timestamp(name: str) -> Column:
    """Nanoseconds since the epoch, cut to microseconds."""
    return F.expr(f"timestamp_micros({name} div 1000)")


def lag_ms(event_time: str | Column, as_of: str | Column) -> Column:
    gap = F.unix_micros(col(as_of)) - F.unix_micros(col(event_time))
    return F.greatest(F.lit(0).cast("long"), F.floor(gap / F.lit(1000)).cast("long"))


def round6(value: Column) -> Column:
    return F.round(value, 6)


def notional(price: str | Column, size: str | Column) -> Column:
    """price * size as a decimal, so that a sum does not depend on row order."""
    return (col(price) * col(size)).cast("decimal(27,9)")


def weighted_price(total: Column, volume: Column, fallback: Column) -> Column:
    return F.coalesce(F.try_divide(total.cast("double"), volume), fallback)


def log_return(previous: Column, current: Column) -> Column:
    return F.when((previous > 0) & (current > 0), F.ln(current / previous))


def spread_of(bid: str | Column, ask: str | Column) -> Column:
    return round6(col(ask) - col(bid))


def mid_of(bid: str | Column, ask: str | Column) -> Column:
    return round6((col(ask) + col(bid)) / F.lit(2.0))


def version() -> Column:
    return F.lit(SCHEMA_VERSION)


def is_digits(value: str | Column) -> Column:
    return col(value).rlike("^[0-9]+$")
