"""Queries over workflow listings and run logs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.functions.pruning import since
from lockstep.model import RUN_SUCCESS


def resolve_workflows(groups: DataFrame, jobs: DataFrame, name: str = "workflow") -> DataFrame:
    """Add ``workflow_id``: the first listed job of that name, NULL when there is none."""
    first = jobs.groupBy(F.col("name").alias(name)).agg(
        F.min_by(F.col("job_id").cast("string"), "listing_pos").alias("workflow_id")
    )
    return groups.join(first, name, "left")


def last_success(runs: DataFrame) -> DataFrame:
    """End of the last successful run of every job."""
    return (
        runs.filter(F.col("result_state") == RUN_SUCCESS)
        .groupBy(F.col("job_id").cast("string").alias("job_id"))
        .agg(F.max("end_time_ms").alias("last_end_ms"))
    )


def recent(watermarks: DataFrame, runs: DataFrame) -> DataFrame:
    """The runs that can matter to any watermark ``last_ms``: all, if there is a row without one.

    The bound is a scalar subquery: it is pushed to the scan, and days before it are not opened.
    """
    unbounded = F.lit(-1).cast("bigint")
    mark = F.when(F.count_if(F.col("last_ms").isNull()) == 0, F.min("last_ms")).otherwise(unbounded)
    least = watermarks.agg(mark.alias("least")).scalar()
    return since(runs, least).filter(F.col("end_time_ms") > least)


def latest_success(watermarks: DataFrame, runs: DataFrame) -> DataFrame:
    """Add ``run_end_ms``: the latest successful end after ``last_ms``, else NULL.

    The latest success is after the watermark exactly when any success is, so one
    aggregate per job answers every watermark.
    """
    job = F.col("job_id").cast("string")
    after = F.col("last_ms").isNull() | (F.col("last_end_ms") > F.col("last_ms"))
    return (
        watermarks.withColumn("job_id", job)
        .join(last_success(runs), "job_id", "left")
        .withColumn("run_end_ms", F.when(after, F.col("last_end_ms")))
        .drop("last_end_ms")
    )
