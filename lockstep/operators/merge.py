"""Keyed upsert and dense counters."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockstep import scratch
from lockstep.operators.skew import BROADCAST_BYTES, BROADCAST_ROWS, width


class DuplicateKeyError(ValueError):
    """A merge source has several rows for one key, or for one key and place in its sequence."""


def _any_null(keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def require_unique(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Fail when a non-NULL key occurs twice; return the number and bytes of the keys.

    Partial aggregation collapses a heavily repeated key before the shuffle.
    """
    row = (
        df.filter(~_any_null(keys))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("rows"), F.sum(width(keys)).alias("bytes"))
        .first()
    )
    if (row["most"] or 0) > 1:
        raise DuplicateKeyError(f"source has up to {row['most']} rows per key {keys}")
    return row["rows"], row["bytes"] or 0


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Matched rows take the source's values, new rows are added, the rest is kept.

    A match replaces every column, so the result is the target without the matched
    keys plus the source. Should a matched key occur several times in the target, its
    source row is repeated as often. When the batch's keys are few and small, which is
    checked, they are broadcast and the target is never shuffled; otherwise adaptive
    execution may split the anti join at a repeated target key. A NULL key matches
    nothing: such rows are kept on both sides.
    """
    source = source.select(*target.columns)
    rows, nbytes = require_unique(source, keys)
    known, given = target.select(*keys), source.select(*keys)
    if rows <= broadcast_rows and nbytes <= BROADCAST_BYTES:
        given = F.broadcast(given.filter(~_any_null(keys)))
        known = known.join(given, keys, "left_semi")
    result = target.join(given, keys, "left_anti").select(*target.columns).unionByName(source)
    # counted before the shuffle, so a heavily repeated key is one row by then
    repeats = (
        known.filter(~_any_null(keys))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
    )
    if repeats.isEmpty():
        return result
    again = source.join(repeats, keys).withColumn(
        "_n", F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("_n")))
    )
    return result.unionByName(again.select(*target.columns))


def newest(source: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row of the highest ``sequence`` of every key; rows with a NULL in the key all stay.

    Two rows of a key at one place in the sequence, or none, are an error, also below the highest. Rows are first counted by
    key and place, which spreads a key with most of the updates over all tasks; of the counted
    ones each task keeps one row per key before these meet.
    """
    rest = [c for c in source.columns if c not in keys]
    known = source.filter(~_any_null(keys))
    placed = known.groupBy(*keys, F.col(sequence).alias("_at")).agg(
        F.first(F.struct(*rest)).alias("_row"), F.count(F.lit(1)).alias("_n")
    )
    scratch.checkpoint_root(source.sparkSession)
    best = (
        placed.groupBy(*keys)
        .agg(
            F.max_by("_row", "_at").alias("_row"),
            F.max("_n").alias("_n"),
            F.count_if(F.col("_at").isNull()).alias("_unplaced"),
        )
        .checkpoint()
    )
    seen = best.agg(F.max("_n"), F.max("_unplaced")).first()
    if (seen[0] or 0) > 1 or seen[1]:
        raise DuplicateKeyError(f"source has rows of one key {keys} with equal or no {sequence}")
    found = best.select(*keys, "_row.*").select(*source.columns)
    return found.unionByName(source.filter(_any_null(keys)))


def upsert_newest(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    sequence: str,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Upsert several updates of a key in any order: the highest ``sequence`` wins.

    The target's own sequence is the mark that a source row has to exceed, so rows that come late, or again, lose.
    Beyond that as ``upsert``. A NULL mark in the target loses to everything.
    """
    batch = newest(source.select(*target.columns), keys, sequence)
    asked = batch.select(*keys).filter(~_any_null(keys))
    marks = (
        target.select(*keys, F.col(sequence).alias("_mark"))
        .join(asked, keys, "left_semi")
        .groupBy(*keys)
        .agg(F.max("_mark").alias("_mark"))
    )
    ahead = F.col("_mark").isNull() | (F.col(sequence) > F.col("_mark"))
    winners = batch.join(marks, keys, "left").filter(ahead).select(*target.columns).checkpoint()
    return upsert(target, winners, keys, broadcast_rows)


def next_counter(target: DataFrame, counter: str) -> int:
    """Highest counter in use, 0 for an empty table."""
    return target.agg(F.coalesce(F.max(counter), F.lit(0)).alias("top")).first()["top"]


def assign_counter(df: DataFrame, order_by: list[str], start: int, counter: str) -> DataFrame:
    """Add ``start + 1 .. start + n`` in ``order_by`` order, without gaps.

    Rows are range-partitioned and numbered inside their partition; the partition
    sizes then give each partition its offset. Ties are broken by where a row stood, so that
    equal values can be split between partitions. The numbered rows are checkpointed in between,
    so both passes see the same rows even when an executor is lost. The offset table has one row
    per partition.
    """
    position = F.monotonically_increasing_id()
    numbered = (
        df.withColumn("_tie", position)
        .repartitionByRange(*order_by, "_tie")
        .sortWithinPartitions(*order_by, "_tie")
        .drop("_tie")
        .withColumn("_part", F.shiftright(position, 33))
        .withColumn("_row", position.bitwiseAND(F.lit((1 << 33) - 1)))
    )
    scratch.checkpoint_root(df.sparkSession)
    numbered = numbered.checkpoint()
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(counter, (F.col("_offset") + F.col("_row") + F.lit(start + 1)).cast("bigint"))
        .drop("_part", "_row", "_offset")
    )
