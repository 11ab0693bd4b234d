"""Schemas and fixed values shared by all modules."""

from pyspark.sql import types as T

# Statuses, reasons, defaults and names that callers match on.
IN_PROGRESS = "In Progress"
SUCCESS = "Success"
WORKFLOW_TIME = "workflow_time"
THRESHOLD_TIME = "threshold_time"
SCHEDULE_TIME = "schedule_time"
SYNCED = "Synced"
NOT_SYNCED = "Not Synced"
CLONE = "CLONE"
RUN_SUCCESS = "SUCCESS"
SCHEDULED_GROUP = "scheduled_sync"
UNNAMED_GROUP = "Unnamed"
DEFAULT_INTERVAL_MINS = 720
DEFAULT_FAILOVER_MINS = 2160
DEFAULT_RETRIES = "3"

GROUP_KEY = ["workspace_name", "group_name"]

STRING, LONG, INT, BOOL, TIME = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.BooleanType(),
    T.TimestampType(),
)
STRINGS = T.ArrayType(STRING)
STRING_MAP = T.MapType(STRING, STRING)


def struct(required: tuple[str, ...] = (), **fields: T.DataType) -> T.StructType:
    """Struct of the given fields in order; nullable unless required."""
    return T.StructType([T.StructField(n, t, n not in required) for n, t in fields.items()])


CONFIG = struct(
    secret_scope=STRING,
    workspaces=T.ArrayType(
        struct(
            workspace_name=STRING,
            workspace_instance_url=STRING,
            workspace_pat_key=STRING,
            sync_location_primary=STRING,
            sync_location_secondary=STRING,
            sync_failure_notification=STRING,
            sync_success_notification=STRING,
            sync_interval_mins=INT,
            sync_failover_interval_mins=INT,
            sync_max_retries=STRING,
            sync_groups=T.ArrayType(
                struct(
                    group_name=STRING, group_owner_email=STRING, workflow=STRING, tables=STRINGS
                )
            ),
        )
    ),
)

STATE = struct(
    required=("workspace_name", "group_name", "tables", "validated"),
    workspace_name=STRING,
    group_name=STRING,
    workflow_name=STRING,
    workflow_id=STRING,
    tables=STRINGS,
    validated=BOOL,
    last_successful_run_time=LONG,
    sync_status=STRING,
    sync_reason=STRING,
    sync_time_to_region=LONG,
    sync_time_in_region=LONG,
    source_operation_metrics=STRING,
    target_operation_metrics=STRING,
)

# The seven state columns a run writes; a changed declaration resets them.
RUN_STATE = [
    "last_successful_run_time",
    "sync_status",
    "sync_reason",
    "sync_time_to_region",
    "sync_time_in_region",
    "source_operation_metrics",
    "target_operation_metrics",
]
# What the receiver records of them.
RECEIVED = ["sync_time_in_region", "target_operation_metrics"]

COMMITS = struct(
    table_name=STRING,
    version=LONG,
    ts=TIME,
    operation=STRING,
    operation_parameters=STRING_MAP,
    operation_metrics=STRING_MAP,
)

MEMBERS = T.ArrayType(struct(table_name=STRING, version=LONG))

RELEASES = struct(workspace_name=STRING, group_name=STRING, release_ms=LONG, members=MEMBERS)

JOBS = struct(job_id=STRING, name=STRING, listing_pos=LONG)

RUNS = struct(job_id=STRING, start_time_ms=LONG, end_time_ms=LONG, result_state=STRING)

GOLD = struct(
    file_name=STRING,
    parsed_data=STRING,
    parsed_time=TIME,
    workspace_name=STRING,
    merge_counter=LONG,
    merge_time=TIME,
)

METRICS_TYPE = "array<map<string,struct<metrics:map<string,string>>>>"
