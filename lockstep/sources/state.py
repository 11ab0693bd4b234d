"""The control table: one row per group with its config, watermarks and metrics.

It is joined on reading from two plain tables with one writer each: declarations and what
the sender records, and what the receiver records. So a sender and a receiver can record
at the same time without losing either's update.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.model import GROUP_KEY, LONG, RECEIVED, RUN_STATE, STATE, struct
from lockstep.operators.merge import require_unique
from lockstep.sources import snapshots
from lockstep.sources.paths import version_dir

STATE_TABLE = "sync.meta.state"
RECEIVED_TABLE = "sync.meta.received"

# ``declaration`` tells for which declaration of the group the receiver recorded.
RECEIVED_ROWS = struct(
    **{f.name: f.dataType for f in STATE if f.name in GROUP_KEY + RECEIVED}, declaration=LONG
)


# What a group declares.
DECLARED = ["workflow_name", "tables", "validated"]


def _declaration() -> Column:
    """Changes exactly when a group's run state is reset."""
    return F.xxhash64(*[x for c in DECLARED for x in (F.isnull(c), F.col(c))])


def create(spark: SparkSession, root: str, at_ms: int | None = None) -> int:
    """Create an empty control table unless it exists; returns the version of what the sender wrote."""
    version = snapshots.latest_version(spark, root, STATE_TABLE)
    if version is not None:
        return version
    snapshots.ensure(spark, root, RECEIVED_TABLE, RECEIVED_ROWS, at_ms)
    return snapshots.publish(spark.createDataFrame([], STATE), root, STATE_TABLE, "CREATE", at_ms, version=0)


def _sent(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """What the sender wrote, and its version."""
    version = create(spark, root)
    return spark.read.schema(STATE).parquet(version_dir(root, STATE_TABLE, version)), version


def _received(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """What the receiver wrote, and its version; -1 before its first record."""
    version = snapshots.latest_version(spark, root, RECEIVED_TABLE)
    if version is None:
        return spark.createDataFrame([], RECEIVED_ROWS), -1
    return spark.read.schema(RECEIVED_ROWS).parquet(version_dir(root, RECEIVED_TABLE, version)), version


def load(spark: SparkSession, root: str) -> DataFrame:
    """The control table as of now, created empty when absent."""
    sent = _sent(spark, root)[0].withColumn("declaration", _declaration())
    return patch(sent, _received(spark, root)[0], [*GROUP_KEY, "declaration"], checked=False)


def save(state: DataFrame, root: str, at_ms: int | None = None, version: int | None = None) -> int:
    """Publish new declarations and sender's records; what the receiver recorded stays."""
    columns = [F.col(f.name).cast(f.dataType) for f in STATE]
    rows = state.select(*columns)
    return snapshots.publish(rows, root, STATE_TABLE, "MERGE", at_ms, sized=False, version=version)


def record(patches: DataFrame, root: str, writer: str, checked: bool = True) -> None:
    """Set run-state columns of the addressed groups on behalf of the sender or the receiver.

    Two patches for one group are an error; ``checked=False`` skips looking for them.
    """
    if checked:
        require_unique(patches, GROUP_KEY)
    spark = patches.sparkSession
    if writer == "sender":
        sent, version = _sent(spark, root)
        save(patch(sent, patches, checked=False), root, version=version + 1)
        return
    known = _sent(spark, root)[0].select(*GROUP_KEY, _declaration().alias("declaration"))
    new = patches.join(known, GROUP_KEY).select(
        *[
            (F.col(f.name) if f.name in [*patches.columns, "declaration"] else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in RECEIVED_ROWS
        ]
    )
    old, version = _received(spark, root)
    both = [*GROUP_KEY, "declaration"]
    values = [F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) for c in RECEIVED]
    merged = new.alias("new").join(old.alias("old"), both, "left").select(*both, *values)
    rest = old.join(new, GROUP_KEY, "left_anti")
    rows = merged.select(*RECEIVED_ROWS.names).unionByName(rest.select(*RECEIVED_ROWS.names))
    snapshots.publish(rows, root, RECEIVED_TABLE, "MERGE", sized=False, version=version + 1)


def register_view(spark: SparkSession, root: str, view: str = "sync_state") -> None:
    """Make the latest control table available to SQL text."""
    load(spark, root).createOrReplaceTempView(view)


def merge_config(
    state: DataFrame, declared: DataFrame, workspaces: DataFrame | None = None
) -> DataFrame:
    """Bring the control table in line with the declared groups.

    ``declared`` has workspace_name, group_name, workflow_name, workflow_id, tables
    and validated. A group whose workflow, tables or validity differ takes the
    declared values and loses its run state; an equal group is untouched; a new one
    is inserted; one no longer declared is deleted. Only the workspaces at hand
    (those of ``workspaces``, by default those declared) are affected.
    """
    ours = (declared if workspaces is None else workspaces).select("workspace_name").distinct()
    fields = ["workflow_name", "workflow_id", "tables", "validated"]
    old = state.withColumn("_old", F.lit(True))
    new = declared.select(
        *GROUP_KEY, *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_new")
    )
    merged = old.join(new, GROUP_KEY, "full").join(
        ours.withColumn("_ours", F.lit(True)), "workspace_name", "left"
    )
    is_new, is_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    differs = ~(
        F.col("workflow_name").eqNullSafe(F.col("_workflow_name"))
        & F.col("tables").eqNullSafe(F.col("_tables"))
        & F.col("validated").eqNullSafe(F.col("_validated"))
    )
    take = is_new & (~is_old | differs)
    kept = merged.filter(is_new | F.col("_ours").isNull())
    return kept.select(
        *GROUP_KEY,
        *[F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fields],
        *[F.when(~take, F.col(c)).alias(c) for c in RUN_STATE],
    ).select(*STATE.names)


def patch(
    state: DataFrame, patches: DataFrame, keys: list[str] = GROUP_KEY, checked: bool = True
) -> DataFrame:
    """Set the supplied columns of the addressed groups; an absent or NULL field keeps its value.

    Two patches for one group are an error; ``checked=False`` skips looking for them.
    """
    if checked:
        require_unique(patches, keys)
    changed = [c for c in RUN_STATE if c in patches.columns]
    new = patches.select(*keys, *[F.col(c).alias(f"_{c}") for c in changed])
    return state.join(new, keys, "left").select(
        *[
            F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in changed else F.col(c)
            for c in STATE.names
        ]
    )
