"""Group releases: the one row that makes a group's copied versions visible together."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.functions.pruning import about
from lockstep.model import GROUP_KEY, RELEASES
from lockstep.sources import snapshots
from lockstep.sources.logs import append_dealt, read_dealt, small_frame


def load(spark: SparkSession, root: str) -> DataFrame:
    """All releases of a root, kept by day and by group."""
    return read_dealt(spark, f"{root}/_releases", RELEASES)


def append(spark: SparkSession, groups: dict[tuple[str, str], list[tuple[str, int]]], root: str, at_ms: int) -> None:
    """Release groups, each with the (table, version) pairs of its declared tables, at one time."""
    rows = [(*key, at_ms, [{"table_name": t, "version": v} for t, v in sorted(of)]) for key, of in groups.items()]
    log = small_frame(spark, rows, RELEASES)
    append_dealt(log, f"{root}/_releases", F.col("release_ms"), F.col("group_name"))


def latest(releases: DataFrame) -> DataFrame:
    """One row per (group, table): the versions of each group's latest release."""
    newest = releases.groupBy(*GROUP_KEY).agg(F.max("release_ms").alias("release_ms"))
    return releases.join(newest, [*GROUP_KEY, "release_ms"]).select(
        *GROUP_KEY, "release_ms", F.inline("members")
    )


def members(spark: SparkSession, root: str, workspace_name: str, group_name: str) -> dict[str, int]:
    """Tables and versions of a group's latest release."""
    ours = about(load(spark, root), "group_name", group_name).filter(F.col("workspace_name") == workspace_name)
    newest = ours.select("release_ms", "members").orderBy(F.desc("release_ms")).first()
    return {m["table_name"]: m["version"] for m in (newest["members"] if newest else [])}


def read_group(
    spark: SparkSession, root: str, workspace_name: str, group_name: str
) -> dict[str, DataFrame]:
    """The tables of a group, all as of the same release."""
    found = members(spark, root, workspace_name, group_name)
    return {table: snapshots.read_version(spark, root, table, version) for table, version in found.items()}
