"""Reconciliation report over the control table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.functions.metrics import entries, metric
from lockstep.functions.times import hours_between, in_zone
from lockstep.model import GROUP_KEY, NOT_SYNCED, SYNCED


def build(state: DataFrame, now_ms: int, zone: str = "UTC") -> DataFrame:
    """Per copied table: source and target version and size, lag and sync status.

    Rows come from the source metrics, so a group never copied does not appear. Source and
    target metrics are flattened to one row per table and joined on group and table, so the work
    grows with the tables, however many of them a group has.
    """
    last, now = F.col("last_successful_run_time"), F.lit(now_ms).cast("bigint")
    sent = state.filter(F.col("source_operation_metrics").isNotNull())
    targets = (
        sent.select(*GROUP_KEY, F.explode(entries(F.col("target_operation_metrics"))).alias("_target"))
        .withColumn("_table", F.col("_target.key"))
        .dropDuplicates([*GROUP_KEY, "_table"])
    )
    rows = sent.withColumn("_source", F.explode(entries(F.col("source_operation_metrics"))))
    rows = rows.withColumn("_table", F.col("_source.key")).join(targets, [*GROUP_KEY, "_table"], "left")
    source_version = metric(F.col("_source"), "sync_commit_version")
    target_version = metric(F.col("_target"), "sync_commit_version")
    source_size = metric(F.col("_source"), "source_table_size")
    target_size = metric(F.col("_target"), "source_table_size")
    scheduled = F.coalesce("workflow_name", F.lit("")) == ""
    agrees = (source_size == target_size) & (scheduled | (source_version == target_version))
    return rows.select(
        *GROUP_KEY,
        "workflow_name",
        F.col("_source.key").alias("table_name"),
        in_zone(last, zone).alias("last_successful_run_time"),
        "sync_reason",
        in_zone(F.col("sync_time_to_region"), zone).alias("sync_time_to_region"),
        in_zone(F.col("sync_time_in_region"), zone).alias("sync_time_in_region"),
        source_version.alias("source_sync_commit_version"),
        source_size.alias("source_table_size"),
        target_version.alias("target_sync_commit_version"),
        target_size.alias("target_table_size"),
        hours_between(now, last).alias("hours_since_last_sync"),
        F.when(agrees, SYNCED).otherwise(NOT_SYNCED).alias("sync_status"),
    )
