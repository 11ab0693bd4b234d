"""Validation of the declared config, as rows and columns."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.functions.names import is_qualified
from lockstep.model import (
    DEFAULT_FAILOVER_MINS,
    DEFAULT_INTERVAL_MINS,
    DEFAULT_RETRIES,
    GROUP_KEY,
    SCHEDULED_GROUP,
    UNNAMED_GROUP,
)
from lockstep.operators.runs import resolve_workflows

# Fields a workspace cannot do without.
REQUIRED = [
    "secret_scope",
    "workspace_name",
    "workspace_instance_url",
    "workspace_pat_key",
    "sync_location_primary",
    "sync_location_secondary",
]


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def _no_tables() -> Column:
    return F.coalesce(F.size("tables"), F.lit(0)) <= 0


class ConfigError(ValueError):
    """A config breaks a rule."""


def require_valid(workspaces: DataFrame, groups: DataFrame) -> None:
    """Fail, naming the broken rules, unless the config keeps all of them."""
    broken = [tuple(r) for r in violations(workspaces, groups).collect()]
    if broken:
        raise ConfigError(f"broken config: {sorted(map(str, broken))}")


def violations(workspaces: DataFrame, groups: DataFrame) -> DataFrame:
    """Broken rules as (workspace_name, entity, rule); an empty result is a valid config.

    Missing required workspace fields, group names declared twice in a workspace, groups
    with a workflow but without tables, and groups naming a table without three parts.
    """
    rules = F.array_compact(F.array(*[F.when(_blank(c), F.lit(f"missing_{c}")) for c in REQUIRED]))
    missing = workspaces.select(
        "workspace_name", F.lit("workspace").alias("entity"), F.explode(rules).alias("rule")
    )
    repeated = (
        groups.filter(~_blank("group_name"))
        .groupBy(*GROUP_KEY)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select(
            "workspace_name", F.col("group_name").alias("entity"), F.lit("duplicate_group").alias("rule")
        )
    )
    malformed = F.coalesce(F.exists("tables", lambda t: ~is_qualified(t)), F.lit(False))
    tables = groups.select(
        "workspace_name",
        F.coalesce("group_name", F.lit(UNNAMED_GROUP)).alias("entity"),
        F.when(~_blank("workflow") & _no_tables(), F.lit("missing_tables"))
        .when(malformed, F.lit("malformed_table_name"))
        .alias("rule"),
    ).filter(F.col("rule").isNotNull())
    return missing.unionByName(repeated).unionByName(tables)


def with_defaults(workspaces: DataFrame) -> DataFrame:
    """Fill absent, zero or empty intervals and retries."""

    def minutes(name: str, default: int) -> Column:
        return F.when(F.coalesce(F.col(name), F.lit(0)) == 0, F.lit(default)).otherwise(F.col(name))

    return workspaces.withColumns(
        {
            "sync_interval_mins": minutes("sync_interval_mins", DEFAULT_INTERVAL_MINS),
            "sync_failover_interval_mins": minutes(
                "sync_failover_interval_mins", DEFAULT_FAILOVER_MINS
            ),
            "sync_max_retries": F.when(_blank("sync_max_retries"), F.lit(DEFAULT_RETRIES)).otherwise(
                F.col("sync_max_retries")
            ),
        }
    )


def valid_groups(groups: DataFrame) -> DataFrame:
    """Named groups that have a workflow or tables, or are the scheduled group.

    A missing name becomes a placeholder, an empty one drops the group.
    """
    named = groups.withColumn("group_name", F.coalesce("group_name", F.lit(UNNAMED_GROUP)))
    return named.filter(
        (F.col("group_name") != "")
        & (~_blank("workflow") | ~_no_tables() | (F.col("group_name") == SCHEDULED_GROUP))
    )


def summary(workspaces: DataFrame, groups: DataFrame) -> DataFrame:
    """Per workspace: groups kept, interval and retries."""
    counted = groups.groupBy("workspace_name").agg(F.count(F.lit(1)).alias("groups_validated"))
    return workspaces.join(counted, "workspace_name", "left").select(
        "workspace_name",
        F.coalesce("groups_validated", F.lit(0)).alias("groups_validated"),
        F.col("sync_interval_mins").alias("default_schedule"),
        F.col("sync_max_retries").alias("max_retries"),
    )


def changed(state: DataFrame, declared: DataFrame) -> DataFrame:
    """Groups present on both sides whose workflow or tables differ.

    An absent workflow equals an empty one; tables compare in order.
    """
    new = declared.select(
        *GROUP_KEY,
        F.coalesce("workflow", F.lit("")).alias("_workflow"),
        F.col("tables").alias("_tables"),
    )
    return (
        state.join(new, GROUP_KEY)
        .filter(
            (F.coalesce("workflow_name", F.lit("")) != F.col("_workflow"))
            | ~F.col("tables").eqNullSafe(F.col("_tables"))
        )
        .select(*GROUP_KEY)
    )


def validate(
    declared: DataFrame, state: DataFrame, jobs: DataFrame, catalog: DataFrame
) -> DataFrame:
    """Declared groups with workflow id and validity, ready to merge into the control table.

    A group already validated and unchanged is taken over without looking again.
    Any other is valid when its workflow exists (or none is declared) and all its
    tables are listed. Each group stands alone: an invalid one is kept as such and
    does not affect the rest.
    """
    old = state.select(
        *GROUP_KEY,
        F.col("workflow_id").alias("_workflow_id"),
        F.coalesce("workflow_name", F.lit("")).alias("_workflow_name"),
        F.col("tables").alias("_tables"),
        F.col("validated").alias("_validated"),
    )
    workflow = F.coalesce("workflow", F.lit(""))
    unchanged = (
        F.coalesce(F.col("_validated"), F.lit(False))
        & (F.col("_workflow_name") == workflow)
        & F.col("_tables").eqNullSafe(F.col("tables"))
    )
    groups = (
        declared.select(*GROUP_KEY, "workflow", F.coalesce("tables", F.array().cast("array<string>")).alias("tables"))
        .join(old, GROUP_KEY, "left")
        .withColumn("_known", F.coalesce(unchanged, F.lit(False)))
    )
    groups = resolve_workflows(groups, jobs)
    probes = groups.filter(~F.col("_known")).select(*GROUP_KEY, F.explode("tables").alias("table_name"))
    listed = catalog.select("table_name").distinct().withColumn("_listed", F.lit(True))
    tables_ok = (
        probes.join(listed, "table_name", "left")
        .groupBy(*GROUP_KEY)
        .agg(F.bool_and(F.col("_listed").isNotNull()).alias("_tables_ok"))
    )
    workflow_ok = (workflow == "") | F.col("workflow_id").isNotNull()
    tables_valid = F.coalesce("_tables_ok", F.lit(True)) & ~(
        ~_blank("workflow") & _no_tables()
    )
    return groups.join(tables_ok, GROUP_KEY, "left").select(
        *GROUP_KEY,
        workflow.alias("workflow_name"),
        F.when(F.col("_known"), F.col("_workflow_id"))
        .when(workflow == "", F.lit(""))
        .otherwise(F.col("workflow_id"))
        .alias("workflow_id"),
        "tables",
        (F.col("_known") | (workflow_ok & tables_valid)).alias("validated"),
    )
