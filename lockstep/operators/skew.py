"""Joining a large log with a list of keys: broadcast when small, sliced when not."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep import scratch

# A list is broadcast while its checked size stays below both bounds.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024

# The list of hot keys is broadcast while its counted rows stay below this.
HOT_KEYS = 100_000


def width(columns: list[str]) -> Column:
    """Bytes of a row's columns as text; NULL columns count nothing."""
    sizes = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns]
    return reduce(lambda a, b: a + b, [s.cast("bigint") for s in sizes])


def list_size(df: DataFrame, key: str, value: str) -> tuple[int, int, int, int | None]:
    """Rows, bytes, the most rows of one key, and the highest value of a list. Runs it once to find out."""
    counted = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(width(df.columns)).alias("bytes"), F.max(value).alias("top")
    )
    rows, nbytes, most, top = counted.agg(F.sum("n"), F.sum("bytes"), F.max("n"), F.max("top")).first()
    return rows or 0, nbytes or 0, most or 0, top


def hot_keys(df: DataFrame, keys: list[str], slice_rows: int = 4_000_000) -> DataFrame:
    """Keys too heavy for one task, with the number of slices each should get."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > slice_rows)
        .select(
            *keys,
            F.ceil(F.col("_n") / slice_rows).cast("int").alias("_slices"),
        )
    )


def sliced_join(
    small: DataFrame,
    big: DataFrame,
    keys: list[str],
    spread_by: list[str],
    slice_rows: int = 4_000_000,
) -> DataFrame:
    """Inner equi-join in which a hot key of ``big`` is spread over many tasks.

    Rows of a hot key get a slice number from ``spread_by``; the matching rows of
    ``small`` are repeated once per slice. Other keys take one slice. Every pair
    is produced exactly once, so the result equals the plain join.
    """
    scratch.checkpoint_root(big.sparkSession)
    hot = hot_keys(big, keys, slice_rows).checkpoint()
    hot = F.broadcast(hot) if hot.count() <= HOT_KEYS else hot
    sliced = (
        big.join(hot, keys, "left")
        .withColumn(
            "_slice",
            F.coalesce(
                F.pmod(F.xxhash64(*spread_by), F.col("_slices")).cast("int"), F.lit(0)
            ),
        )
        .drop("_slices")
    )
    repeated = (
        small.join(hot, keys, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)))
        .drop("_slices")
    )
    return repeated.join(sliced, keys + ["_slice"]).drop("_slice")
