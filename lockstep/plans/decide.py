"""Which groups to copy now, and which version of each of their tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockstep.functions.times import elapsed_exceeds
from lockstep.model import GROUP_KEY, SCHEDULE_TIME, THRESHOLD_TIME, WORKFLOW_TIME
from lockstep.operators.history import as_of, group_tables, has_new_commits
from lockstep.operators.runs import latest_success, recent

# Reasons for leaving a group alone.
NO_NEW_COMMITS = "skip:no_new_commits"
NOT_VALIDATED = "skip:not_validated"
NO_SUCCESSFUL_RUN = "skip:no_successful_run"
WAITING = "skip:waiting_for_workflow"
INTERVAL_NOT_MET = "skip:interval_not_met"
NO_VERSION = "skip:no_version"


def decide(
    state: DataFrame, workspaces: DataFrame, commits: DataFrame, runs: DataFrame, now_ms: int
) -> DataFrame:
    """One row per group with ``decision`` and, where it is to be copied, ``cutoff_ms``.

    Only groups of the given workspaces are looked at.

    A group is considered when it was never synced or any of its tables has a newer
    commit. A workflow group is then cut off at its last successful run, or at now
    once the failover interval has passed; a scheduled group at now once its interval
    has passed. Both logs are aggregated to one row per table and per job first.
    """
    state = state.withColumn("last_ms", F.col("last_successful_run_time"))
    intervals = workspaces.select(
        "workspace_name", "sync_interval_mins", "sync_failover_interval_mins"
    )
    groups = state.join(intervals, "workspace_name").join(
        has_new_commits(state, commits), GROUP_KEY
    )
    groups = latest_success(groups.withColumn("job_id", F.col("workflow_id")), recent(state, runs))

    now, last = F.lit(now_ms).cast("bigint"), F.col("last_ms")
    first = last.isNull() | F.col("sync_status").isNull()
    considered = (F.size("tables") > 0) & (first | F.col("has_new"))
    has_workflow = F.coalesce(F.col("workflow_id"), F.lit("")) != ""
    ran = F.col("run_end_ms").isNotNull()

    decision = (
        F.when(~considered, NO_NEW_COMMITS)
        .when(has_workflow & ~F.col("validated"), NOT_VALIDATED)
        .when(has_workflow & ran, WORKFLOW_TIME)
        .when(has_workflow & last.isNull(), NO_SUCCESSFUL_RUN)
        .when(
            has_workflow & elapsed_exceeds(now, last, F.col("sync_failover_interval_mins")),
            THRESHOLD_TIME,
        )
        .when(has_workflow, WAITING)
        .when(
            last.isNull() | elapsed_exceeds(now, last, F.col("sync_interval_mins")), SCHEDULE_TIME
        )
        .otherwise(INTERVAL_NOT_MET)
    )
    cutoff = F.when(F.col("decision") == WORKFLOW_TIME, F.col("run_end_ms")).when(
        F.col("decision").isin(THRESHOLD_TIME, SCHEDULE_TIME), now
    )
    return (
        groups.withColumn("decision", decision)
        .withColumn("cutoff_ms", cutoff)
        .select(
            *GROUP_KEY, "workflow_name", "workflow_id", "tables", "last_ms", "decision", "cutoff_ms"
        )
    )


def build(decisions: DataFrame, commits: DataFrame, on_missing: str = "block") -> DataFrame:
    """One row per (group, table) of every group to be copied, with its version.

    A table without a version at the cutoff blocks its whole group, or with
    ``on_missing="skip"`` only drops out of the copy.
    """
    if on_missing not in ("block", "skip"):
        raise ValueError("on_missing must be 'block' or 'skip'")
    members = group_tables(
        decisions.filter(F.col("cutoff_ms").isNotNull()).withColumn("tables", F.array_distinct("tables"))
    )
    plan = as_of(members, commits)
    if on_missing == "skip":
        return plan.filter(F.col("version").isNotNull())
    # a group's own tables, which its control row lists anyway
    whole = F.bool_and(F.col("version").isNotNull()).over(Window.partitionBy(*GROUP_KEY))
    return plan.withColumn("decision", F.when(whole, F.col("decision")).otherwise(NO_VERSION))
