"""Queries over the commit log: group members, new commits, as-of versions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockstep import scratch
from lockstep.functions.pruning import since, until
from lockstep.functions.times import at_millis, cutoff_like, micros
from lockstep.model import GROUP_KEY
from lockstep.operators.skew import BROADCAST_BYTES, BROADCAST_ROWS, list_size, sliced_join

# Above this many cutoffs of one table an as-of join sorts commits and cutoffs together.
MAX_CUTOFFS = 16

# Fixed value: one more than the widest 64-bit version, as a decimal.
_SHIFT = "cast(10000000000000000000 as decimal(20,0))"


def _rank(ts: str, version: str) -> Column:
    """(commit time, version) as one exact decimal that orders like the pair.

    Aggregating a struct falls back to sorting on both sides of the shuffle; a
    decimal keeps ``max`` in the hash aggregate. 19 digits of microseconds and 19
    of version fit in decimal(38).
    """
    return micros(F.col(ts)).cast("decimal(19,0)") * F.expr(_SHIFT) + F.col(version)


def _version_of(rank: str) -> Column:
    return F.expr(f"cast(pmod({rank}, {_SHIFT}) as bigint)")


def _millis_of(rank: str) -> Column:
    return F.floor(F.expr(f"cast(({rank} - pmod({rank}, {_SHIFT})) / {_SHIFT} as bigint)") / 1000)


def group_tables(groups: DataFrame) -> DataFrame:
    """One row per (group, table) in declared order; groups without tables vanish."""
    return groups.select(
        *[c for c in groups.columns if c != "tables"],
        F.posexplode("tables").alias("position", "table_name"),
    )


def last_commits(commits: DataFrame) -> DataFrame:
    """Time of the last commit of every table."""
    return commits.groupBy("table_name").agg(F.max("ts").alias("last_commit"))


def has_new_commits(groups: DataFrame, commits: DataFrame) -> DataFrame:
    """Per group: does any of its tables have a commit strictly after ``last_ms``?

    The log is reduced to one row per table before it meets the groups, so a table
    with most of the commits costs no more than any other. Commits no newer than the least
    ``last_ms`` are left at the scan, and days before it are not opened; a group without one has nothing new by definition.
    """
    least = groups.agg(F.min("last_ms").alias("least")).scalar()
    commits = since(commits, least).filter(F.col("ts") > cutoff_like(commits, "ts", least))
    members = groups.select(
        *GROUP_KEY, "last_ms", F.explode_outer("tables").alias("table_name")
    )
    newer = F.col("last_commit") > at_millis(F.col("last_ms"))
    return (
        members.join(last_commits(commits), "table_name", "left")
        .groupBy(*GROUP_KEY)
        .agg(F.coalesce(F.bool_or(newer), F.lit(False)).alias("has_new"))
    )


def as_of_time(commits: DataFrame, cutoff_ms: int, operation: str | None = None) -> DataFrame:
    """Latest version of every table at or before one common cutoff.

    The cutoff reaches the scan as a pushed filter and the rest is a single
    partially aggregated shuffle.
    """
    eligible = until(commits, F.lit(cutoff_ms)).filter(F.col("ts") <= cutoff_like(commits, "ts", cutoff_ms))
    if operation is not None:
        eligible = eligible.filter(F.col("operation") == operation)
    return (
        eligible.groupBy("table_name")
        .agg(F.max(_rank("ts", "version")).alias("_rank"))
        .select(
            "table_name",
            _version_of("_rank").alias("version"),
            _millis_of("_rank").alias("commit_ms"),
        )
    )


def as_of(
    targets: DataFrame,
    commits: DataFrame,
    cutoff_col: str = "cutoff_ms",
    operation: str | None = None,
    extras: dict[str, Column] | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    slice_rows: int = 4_000_000,
) -> DataFrame:
    """Latest version at or before each target's own cutoff.

    Keeps every row and column of ``targets`` and adds ``version``, ``commit_ms``
    and the ``extras`` (numeric expressions over the chosen commit); they are NULL
    where the history has nothing that early. Equal commit times resolve to the
    greatest version.

    The distinct (table, cutoff) pairs are evaluated once, checkpointed and measured; days of the log after the
    last cutoff are not opened. With few
    cutoffs per table they are broadcast while they are small, so that the log is aggregated
    where it lies; a longer list is joined by table, hot tables being spread over slices. Should
    a table have many cutoffs, see ``_as_of_sorted``.
    """
    extras = extras or {}
    if operation is not None:
        commits = commits.filter(F.col("operation") == operation)
    scratch.checkpoint_root(targets.sparkSession)
    asked = targets.select("table_name", F.col(cutoff_col).alias("_cutoff")).distinct().checkpoint()
    rows, nbytes, most, last = list_size(asked, "table_name", "_cutoff")
    if last is not None:
        commits = until(commits, F.lit(last))
    log = commits.select(
        "table_name",
        "ts",
        "version",
        _rank("ts", "version").alias("_rank"),
        *[c.alias(name) for name, c in extras.items()],
    )
    best = [F.max("_rank").alias("_rank"), *[F.max_by(n, "_rank").alias(n) for n in extras]]
    if most > MAX_CUTOFFS:
        found = _as_of_sorted(asked, log, list(extras))
    elif rows <= broadcast_rows and nbytes <= BROADCAST_BYTES:
        found = _best_until(log.join(F.broadcast(asked), "table_name"), best)
    else:
        pairs = sliced_join(asked, log, ["table_name"], ["version"], slice_rows)
        found = _best_until(pairs, best)
    found = found.select(
        "table_name",
        F.col("_cutoff").alias(cutoff_col),
        _version_of("_rank").alias("version"),
        _millis_of("_rank").alias("commit_ms"),
        *extras,
    )
    return targets.join(found, ["table_name", cutoff_col], "left")


def _best_until(pairs: DataFrame, best: list[Column]) -> DataFrame:
    """The best commit of each (table, cutoff) among those not after the cutoff."""
    return (
        pairs.filter(F.col("ts") <= at_millis(F.col("_cutoff")))
        .groupBy("table_name", "_cutoff")
        .agg(*best)
    )


def _as_of_sorted(asked: DataFrame, log: DataFrame, extras: list[str]) -> DataFrame:
    """As-of with many cutoffs per table: work grows with their number plus the commits'.

    Commits and cutoffs are sorted by table and time into ranges, so that a table with most of
    them is cut into many. A running maximum inside each range answers what lies in it; what the
    table's earlier ranges hold, one row each, is carried over.
    """
    at = ["table_name", "_at", "_kind"]
    tables = asked.select("table_name").distinct()
    commits = log.join(tables, "table_name", "left_semi").select(
        "table_name", micros(F.col("ts")).alias("_at"), F.lit(0).alias("_kind"), "_rank", *extras
    )
    cutoffs = asked.filter("_cutoff is not null").select(
        "table_name", (F.col("_cutoff") * 1000).alias("_at"), F.lit(1).alias("_kind"), "_cutoff"
    )
    events = (
        commits.unionByName(cutoffs, allowMissingColumns=True)
        .repartitionByRange(*at, "_rank")
        .withColumn("_part", F.spark_partition_id())
        .checkpoint()
    )

    def best(over=None) -> list[Column]:
        columns = {"_rank": F.max("_rank"), **{n: F.max_by(n, "_rank") for n in extras}}
        return [(c.over(over) if over else c).alias(f"_b_{n}") for n, c in columns.items()]

    inside = Window.partitionBy("_part", "table_name").orderBy("_at", "_kind")
    seen = events.select("_part", "table_name", "_kind", "_cutoff", *best(inside)).filter("_kind = 1")
    parts = events.filter("_kind = 0").groupBy("_part", "table_name").agg(
        F.max("_rank").alias("_rank"), *[F.max_by(n, "_rank").alias(n) for n in extras]
    )
    # One row per range of a table, and one that asks for it where only cutoffs fell into the range.
    parts = events.select("_part", "table_name").distinct().join(parts, ["_part", "table_name"], "left")
    earlier = Window.partitionBy("table_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_part", "table_name", F.struct(*best(earlier)).alias("_carried"))
    names = ["_rank", *extras]
    chosen = F.when(F.col("_b__rank").isNotNull(), F.struct(*[F.col(f"_b_{n}") for n in names]))
    chosen = F.coalesce(chosen, F.col("_carried"))
    return (
        seen.join(carried, ["_part", "table_name"])
        .select("table_name", "_cutoff", chosen.alias("_c"))
        .filter("_c._b__rank is not null")
        .select("table_name", "_cutoff", *[F.col(f"_c._b_{n}").alias(n) for n in names])
    )
