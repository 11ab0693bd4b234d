"""Ship what changed since the last copy of a table, in place of the table.

A copy at the staging location may be a change set: a version that holds the newer rows of every key
whose rows differ from those of the version it builds on, and the bare keys that are gone. What
differs is found at the source between its own two versions, by their kept digest trees, so neither
the staged copy nor the destination is read for it. The destination, if it holds the version that the change set
builds on, takes out the named keys' rows and adds the shipped ones; otherwise it reads the staged copies back
to the last whole one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep import scratch
from lockstep.model import CLONE
from lockstep.operators.changes import change_set
from lockstep.sources import digests, snapshots

# A whole copy is made where a change set would bring more than this share of the rows, or
# would be the one after so many others.
MOST_SHARE = 0.5
MOST_STEPS = 20


def held_version(spark: SparkSession, root: str, table: str, version: int | None) -> int | None:
    """Which source version a copy holds (its latest version by default)."""
    log = snapshots.commits_of(spark, root, table)
    if version is not None:
        log = log.filter(F.col("version") == version)
    held = F.when(F.col("operation") == CLONE, F.col("operation_parameters")["sourceVersion"].try_cast("bigint"))
    row = log.select(held.alias("held"), "version").orderBy(F.desc("version")).first()
    return row["held"] if row else None


def between(
    spark: SparkSession, root: str, table: str, base: int, version: int, keys: list[str]
) -> DataFrame | None:
    """The change set from one version to another; None where the table had better be copied whole.

    That is where the columns differ, or where more than MOST_SHARE of the rows would be shipped. A key may
    repeat; all its newer rows are shipped.
    """
    new, old = (snapshots.read_version(spark, root, table, v) for v in (version, base))
    if [(f.name, f.dataType) for f in new.schema] != [(f.name, f.dataType) for f in old.schema]:
        return None
    scratch.checkpoint_root(spark)
    found = digests.diff_versions(spark, (root, table, version), (root, table, base), keys).checkpoint()
    shipped = found.agg(F.coalesce(F.sum("src_rows"), F.lit(0))).first()[0]
    rows = snapshots.row_count(spark, root, table, version)
    if rows is not None and shipped > MOST_SHARE * rows:
        return None
    return change_set(new, found, keys)


def _steps(spark: SparkSession, root: str, table: str, version: int) -> int:
    """How many change sets a version is away from the last whole copy."""
    steps, layout = 0, snapshots.layout_of(spark, root, table, version)
    while "base" in layout:
        steps, layout = steps + 1, snapshots.layout_of(spark, root, table, layout["base"])
    return steps


def stage(
    spark: SparkSession,
    src_root: str,
    stage_root: str,
    table: str,
    keys: list[str],
    version: int,
    stage_version: int,
) -> tuple[int, int, str]:
    """Write a source version to the staging location, not yet visible: as a change set where that can be.

    It builds on the latest staged copy. Returns (rows, bytes, layout) like ``snapshots.copy``.
    """
    latest = snapshots.latest_version(spark, stage_root, table)
    held = held_version(spark, stage_root, table, latest) if latest is not None else None
    change = None
    if held is not None and held <= version and _steps(spark, stage_root, table, latest) < MOST_STEPS:
        change = between(spark, src_root, table, held, version, keys)
    if change is None:
        return snapshots.copy(spark, src_root, stage_root, table, version, stage_version)
    rows, nbytes, _ = snapshots.write_version(change, stage_root, table, stage_version)
    layout = snapshots.layout_of(spark, src_root, table, version)
    return rows, nbytes, json.dumps(layout | {"base": latest, "keys": keys})


def deliver(
    spark: SparkSession, stage_root: str, dst_root: str, table: str, version: int, dst_version: int
) -> tuple[int, int, str]:
    """Write a staged copy to the destination, not yet visible.

    Where the destination's latest version is one that the staged copy builds on, only the change sets
    since then are read.
    """
    latest = snapshots.latest_version(spark, dst_root, table)
    held = held_version(spark, dst_root, table, latest) if latest is not None else None
    ahead, at = [], version
    layout = snapshots.layout_of(spark, stage_root, table, at)
    parts = layout.get("partition_by")
    while "base" in layout and at != held:
        ahead.append((at, layout))
        at = layout["base"]
        layout = snapshots.layout_of(spark, stage_root, table, at)
    if not ahead or at != held:
        return snapshots.copy(spark, stage_root, dst_root, table, version, dst_version)
    result = snapshots.read_version(spark, dst_root, table, latest)
    result = snapshots.apply_changes(spark, result, stage_root, table, ahead[::-1])
    return snapshots.write_version(result, dst_root, table, dst_version, parts)


def _commit(spark, root, table, version, source_version, written, at_ms) -> int:
    at = snapshots.now_millis() if at_ms is None else at_ms
    rows, nbytes, layout = written
    snapshots.commit(spark, root, [snapshots.clone_row(table, version, at, source_version, rows, nbytes, layout)])
    return version


def stage_table(
    spark: SparkSession,
    src_root: str,
    stage_root: str,
    table: str,
    keys: list[str],
    version: int | None = None,
    at_ms: int | None = None,
) -> int:
    """Stage one table at a version (latest by default) and commit it; returns the staged version."""
    version = snapshots.resolve(spark, src_root, table, version)
    number = snapshots.next_version(spark, stage_root, table)
    written = stage(spark, src_root, stage_root, table, keys, version, number)
    return _commit(spark, stage_root, table, number, version, written, at_ms)


def deliver_table(
    spark: SparkSession, stage_root: str, dst_root: str, table: str, at_ms: int | None = None
) -> int:
    """Deliver the latest staged copy of one table and commit it; returns the destination's version."""
    version = snapshots.resolve(spark, stage_root, table)
    number = snapshots.next_version(spark, dst_root, table)
    written = deliver(spark, stage_root, dst_root, table, version, number)
    return _commit(spark, dst_root, table, number, version, written, at_ms)
