"""What changed between two states of a table, as rows to put and keys to take out."""

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.operators import marks

# Fixed value: marks the keys of a change set that are gone.
GONE = "_gone"


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equal keys of two sides; NULL equals NULL."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def change_set(new: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """All newer rows of the keys in ``found`` (as reconcile.diff_keys names them), and the keys that are gone.

    Gone keys have NULL in all other columns. Of the newer rows only those that a bitmap of the keys hits are joined.
    """
    if GONE in new.columns:
        raise ValueError(f"{GONE} is a column of change sets, not of tables")
    changed = found.select(*keys, (F.col("src_rows") == 0).alias(GONE))
    near = marks.hit(new, keys, marks.bitmap_of(changed, keys)) if marks.usable(new, changed, keys) else new
    put = near.join(changed, same_keys(near, changed, keys), "left_semi").withColumn(GONE, F.lit(False))
    gone = changed.filter(GONE).select(
        *[(F.col(f.name) if f.name in keys else F.lit(None)).cast(f.dataType).alias(f.name) for f in new.schema],
        GONE,
    )
    return put.unionByName(gone)


def merged(changes: list[DataFrame], keys: list[str]) -> DataFrame:
    """Change sets of the same keys that follow each other, as one: what the last to name a key says of it."""
    if len(changes) == 1:
        return changes[0]
    steps = [c.select(F.struct(*keys).alias("_key"), F.struct("*").alias("_row"), F.lit(i).alias("_step")) for i, c in enumerate(changes)]
    rows = reduce(DataFrame.unionByName, steps)
    last = rows.groupBy(F.col("_key").alias("_named")).agg(F.max("_step").alias("_last"))
    newest = F.col("_key").eqNullSafe(F.col("_named")) & (F.col("_step") == F.col("_last"))
    return rows.join(last, newest, "left_semi").select("_row.*")


def put(target: DataFrame, change: DataFrame, keys: list[str], few: bool = False) -> DataFrame:
    """A table after a change set: without the rows of its keys, with the rows it brings.

    With ``few`` the change set's keys are broadcast. Otherwise the target is the large side of an anti join, which adaptive
    execution may split at a repeated key.
    """
    named = change.select(*keys).distinct()
    kept = target.join(F.broadcast(named) if few else named, same_keys(target, named, keys), "left_anti")
    return kept.unionByName(change.filter(~F.col(GONE)).drop(GONE))


def put_all(target: DataFrame, changes: list[tuple[DataFrame, list[str]]], few: bool = False) -> DataFrame:
    """A table after change sets that follow each other, each with its keys.

    Change sets of the same keys are merged first, so that the target meets them once. Unless they are ``few``, the target
    is read twice: rows that a bitmap of their keys misses stay without a join and don't move.
    """
    runs = [(run[0][1], [c for c, _ in run]) for _, g in groupby(changes, lambda x: sorted(x[1])) for run in [list(g)]]
    if len(runs) == 1 and not few:
        keys, change = runs[0][0], merged(runs[0][1], runs[0][0])
        if marks.usable(target, change, keys):
            bits = marks.bitmap_of(change, keys)
            return marks.missed(target, keys, bits).unionByName(put(marks.hit(target, keys, bits), change, keys))
    for keys, run in runs:
        target = put(target, merged(run, keys), keys, few)
    return target
