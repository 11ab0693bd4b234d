"""Epoch-millisecond arithmetic on columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_millis(ms: Column) -> Column:
    """Epoch milliseconds as a timestamp, keeping the milliseconds."""
    return F.timestamp_millis(ms.cast("bigint"))


def cutoff_like(df: DataFrame, column: str, ms: int | Column) -> Column:
    """A literal instant, or a scalar subquery's, in the type of a time column, so that a comparison is pushed to the scan."""
    return at_millis(ms if isinstance(ms, Column) else F.lit(ms)).cast(df.schema[column].dataType)


def micros(col: Column) -> Column:
    """Epoch microseconds; a time without zone is read in the session's zone."""
    return F.unix_micros(col.cast("timestamp"))


def elapsed_exceeds(now_ms: Column, since_ms: Column, minutes: Column) -> Column:
    """Strictly more than ``minutes`` have passed; 64-bit throughout."""
    return (now_ms - since_ms) > minutes.cast("bigint") * F.lit(60000).cast("bigint")


def hours_between(now_ms: Column, since_ms: Column) -> Column:
    """Elapsed hours rounded half up to two decimals, from whole seconds."""
    seconds = F.floor(now_ms / 1000) - F.floor(since_ms / 1000)
    hundredths = F.floor((seconds * 100 + 1800) / 3600)
    return hundredths.cast("double") / F.lit(100.0)


def in_zone(ms: Column, zone: str) -> Column:
    """Wall-clock timestamp of epoch milliseconds in a display zone."""
    return F.from_utc_timestamp(at_millis(ms), zone)
