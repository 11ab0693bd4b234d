"""Partition columns of logs, and bounds that leave whole partitions of a log unread.

A log is kept by the UTC day of its rows and by one of PARTS hashes of what a row is about (a
table, a job). The functions work on any DataFrame and change nothing where it has no such column.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns' names, and into how many parts a day is dealt.
DAY, PART = "log_day", "log_part"
PARTS = 16
LOG_COLUMNS = f"{DAY} date, {PART} int"
_DAY_MS = 86_400_000


def day_of(ms: Column) -> Column:
    """The UTC day of epoch milliseconds, whatever the session's zone."""
    return F.date_from_unix_date(F.floor(ms / _DAY_MS).cast("int"))


def part_of(about: Column) -> Column:
    return F.pmod(F.xxhash64(about.cast("string")), F.lit(PARTS)).cast("int")


def dealt(df: DataFrame, ms: Column, about: Column) -> DataFrame:
    """Rows with the partition columns of a log."""
    return df.withColumns({DAY: day_of(ms), PART: part_of(about)})


def since(log: DataFrame, ms: Column) -> DataFrame:
    """Without the days before an instant, a literal or a scalar subquery; rows of its own day all stay."""
    return log.filter(F.col(DAY) >= day_of(ms)) if DAY in log.columns else log


def until(log: DataFrame, ms: Column) -> DataFrame:
    """Without the days after an instant; rows of its own day all stay."""
    return log.filter(F.col(DAY) <= day_of(ms)) if DAY in log.columns else log


def about(log: DataFrame, column: str, value: str) -> DataFrame:
    """The rows about one table or job."""
    rows = log.filter(F.col(column) == value)
    return rows.filter(F.col(PART) == part_of(F.lit(value))) if PART in log.columns else rows
