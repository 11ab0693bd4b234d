"""Which staged groups wait for delivery, and which staged version of each table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockstep.model import CLONE, GROUP_KEY
from lockstep.operators.history import as_of, group_tables
from lockstep.plans.decide import NO_VERSION
from lockstep.sources import releases

# Fixed value: the decision of a group that is delivered.
DELIVER = "deliver"


def pending(state: DataFrame) -> DataFrame:
    """Groups staged since their last delivery; equal times count as pending."""
    staged, delivered = F.col("sync_time_to_region"), F.col("sync_time_in_region")
    return state.filter(staged.isNotNull() & (delivered.isNull() | (staged >= delivered)))


def plan(state: DataFrame, commits: DataFrame, released: DataFrame | None = None) -> DataFrame:
    """One row per (group, table) awaiting delivery, with staged and source version.

    Without ``released`` a table's version is its latest copy staged by the time the
    group was. Given the staging location's releases, each group gets exactly the
    versions released together, also when groups share a table. A table without a
    version blocks its whole group.
    """
    members = group_tables(
        pending(state)
        .withColumn("tables", F.array_distinct("tables"))
        .select(*GROUP_KEY, "tables", "sync_time_to_region")
    )
    source_version = F.col("operation_parameters")["sourceVersion"].try_cast("bigint")
    if released is None:
        found = as_of(
            members, commits, "sync_time_to_region", CLONE, {"source_version": source_version}
        )
    else:
        staged = commits.filter(F.col("operation") == CLONE).select(
            "table_name", "version", source_version.alias("source_version")
        )
        chosen = releases.latest(released).drop("release_ms")
        found = members.join(chosen, [*GROUP_KEY, "table_name"], "left").join(
            staged, ["table_name", "version"], "left"
        )
    whole = F.bool_and(F.col("version").isNotNull()).over(Window.partitionBy(*GROUP_KEY))
    return found.select(
        *GROUP_KEY,
        "position",
        "table_name",
        "sync_time_to_region",
        "version",
        "source_version",
        F.when(whole, F.lit(DELIVER)).otherwise(F.lit(NO_VERSION)).alias("decision"),
    )
