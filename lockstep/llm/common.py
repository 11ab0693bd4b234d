"""Reading, settling and small expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.scratch import checkpoint_root

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """The same rows from the shared checkpoint folder, with their lineage cut.

    The folder is the one that the cluster names in spark.checkpoint.dir; where none is set, a local
    master gets a temporary one and a cluster an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or checkpoint_root(df.sparkSession))
    return df.checkpoint()


def shielded(docs: DataFrame, used: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns renamed but those used, so that none clashes with one that an operator adds,
    and the way back for a result with the same columns."""
    names = docs.columns
    safe = docs.toDF(*[name if name in used else f"__other{k}" for k, name in enumerate(names)])
    return safe, lambda result: result.toDF(*names)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """Mark a settled table for broadcasting if a count shows that it is small enough."""
    return F.broadcast(df) if df.count() <= most_rows else df


def least_count(counts: DataFrame, n: str, most_rows: int) -> int:
    """The least power of two that at most so many rows have as their count n."""
    power = F.floor(F.log2(n)).cast("int")
    rows = counts.groupBy(power.alias("power")).agg(F.count("*").alias("rows")).collect()  # 63 at most
    least, total = 1 << (max((r["power"] for r in rows), default=-1) + 1), 0
    for r in sorted(rows, reverse=True):
        total += r["rows"]
        if total > most_rows:
            break
        least = 1 << r["power"]
    return least


def hexdraw(*parts: Column | str) -> Column:
    """A number in (0, 1) that depends on the given texts alone: 52 bits of their MD5."""
    joined = F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    high = F.conv(F.substring(F.md5(joined.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (high.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def hexdraw_sql(joined: str) -> str:
    """The same number as hexdraw in DuckDB; joined: an expression for the joined text."""
    return f"((('0x' || substr(md5({joined}), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"


def as_key(column: Column) -> Column:
    """An id as text, 'null' for null."""
    return F.coalesce(column.cast("string"), F.lit("null"))


def held_out(column: Column, parts: int) -> Column:
    """Does crc32 of the id's text leave remainder 2? A null id is never held out."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % parts == 2, F.lit(False))
