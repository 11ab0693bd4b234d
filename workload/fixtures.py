"""Histories, configs and control tables derived from the given tables.

Everything grows with the input: one source table per user, three tables per group,
one config workspace per customer. No derivation collects or numbers rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The moment queries run at, and a mid-history cutoff (UTC).
NOW_MS = 1706745600000  # 2024-02-01
CUTOFF_MS = 1705276800000  # 2024-01-15
DAY_MS = 86400000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events; their wall-clock time counts as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table(spark, sf_dir, "events")


def _group_id() -> Column:
    return F.floor(F.col("user_id") / 3)


def _table_name(user: Column) -> Column:
    return F.concat(F.lit("lake.raw.u"), user.cast("string"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a commit of its user's table."""
    none = F.lit(None).cast("string")
    is_clone = F.col("event_type") == "signup"
    return events(spark, sf_dir).select(
        _table_name(F.col("user_id")).alias("table_name"),
        F.col("event_id").alias("version"),
        "ts",
        F.when(is_clone, "CLONE")
        .when(F.col("event_type") == "purchase", "MERGE")
        .otherwise("WRITE")
        .alias("operation"),
        F.create_map(
            F.lit("sourceVersion"), F.when(is_clone, F.col("event_id").cast("string")).otherwise(none)
        ).alias("operation_parameters"),
        F.create_map(F.lit("sourceTableSize"), (1000 + F.col("event_id") % 3).cast("string")).alias(
            "operation_metrics"
        ),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and errors are workflow runs of the user's group; kinds 1, 2, 4 never succeed."""
    end_ms = F.unix_millis(F.col("ts").cast("timestamp"))
    succeeds = (F.col("event_type") == "purchase") & ~(_group_id() % 10).isin(1, 2, 4)
    return (
        events(spark, sf_dir)
        .filter(F.col("event_type").isin("purchase", "error"))
        .select(
            _group_id().cast("string").alias("job_id"),
            (end_ms - 60000).alias("start_time_ms"),
            end_ms.alias("end_time_ms"),
            F.when(succeeds, "SUCCESS").otherwise("FAILED").alias("result_state"),
        )
    )


def group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(_group_id().alias("gid")).distinct()


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten kinds of workspace, among which the groups are spread."""
    kind = (F.col("gid") % 10).alias("kind")
    return (
        group_ids(spark, sf_dir)
        .select(kind)
        .distinct()
        .select(
            F.concat(F.lit("ws"), F.col("kind").cast("string")).alias("workspace_name"),
            F.when(F.col("kind").isin(2, 9), 100000).otherwise(15).alias("sync_interval_mins"),
            F.when(F.col("kind") == 2, 100000).otherwise(10).alias("sync_failover_interval_mins"),
            F.lit("3").alias("sync_max_retries"),
        )
    )


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One control row per group; its kind (gid % 10) decides how it stands."""
    gid, kind = F.col("gid"), F.col("gid") % 10
    last = (
        F.when(kind.isin(0, 4, 8), None)
        .when(kind == 6, F.lit(1706659200000))
        .otherwise(F.lit(1704844800000) + kind * DAY_MS)
    )
    delivered = F.when(kind.isin(1, 5), None).when(kind == 7, last + 1).otherwise(last)
    return group_ids(spark, sf_dir).select(
        F.concat(F.lit("ws"), kind.cast("string")).alias("workspace_name"),
        F.concat(F.lit("g"), gid.cast("string")).alias("group_name"),
        F.when(kind < 7, F.concat(F.lit("wf"), gid.cast("string"))).otherwise("").alias("workflow_name"),
        F.when(kind < 7, gid.cast("string")).otherwise("").alias("workflow_id"),
        F.array(*[_table_name(gid * 3 + i) for i in range(3)]).alias("tables"),
        (kind != 3).alias("validated"),
        last.cast("bigint").alias("last_successful_run_time"),
        F.when(last.isNotNull(), "Success").alias("sync_status"),
        F.when(last.isNotNull(), F.when(kind < 7, "workflow_time").otherwise("schedule_time")).alias(
            "sync_reason"
        ),
        last.cast("bigint").alias("sync_time_to_region"),
        delivered.cast("bigint").alias("sync_time_in_region"),
        F.lit(None).cast("string").alias("source_operation_metrics"),
        F.lit(None).cast("string").alias("target_operation_metrics"),
    )


def config_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer declares a workspace; segment and nation leave gaps in it."""
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        F.lit("scope").alias("secret_scope"),
        F.col("c_name").alias("workspace_name"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("host"), nation.cast("string"))).alias(
            "workspace_instance_url"
        ),
        F.when(segment == "MACHINERY", "").otherwise("key").alias("workspace_pat_key"),
        F.lit("primary").alias("sync_location_primary"),
        F.when(nation != 3, F.lit("secondary")).alias("sync_location_secondary"),
        F.when(segment == "BUILDING", 0)
        .when(segment == "FURNITURE", None)
        .otherwise(nation * 10 + 5)
        .cast("int")
        .alias("sync_interval_mins"),
        F.when(segment == "HOUSEHOLD", 0).otherwise(nation * 20 + 5).cast("int").alias(
            "sync_failover_interval_mins"
        ),
        F.when(segment == "BUILDING", "").when(segment != "MACHINERY", "5").alias("sync_max_retries"),
    )


def config_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order declares a group of its customer's workspace."""
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.format_string("Customer#%09d", "o_custkey").alias("workspace_name"),
        F.when(priority == "1-URGENT", None)
        .when(priority == "5-LOW", "")
        .when(priority == "2-HIGH", "scheduled_sync")
        .when(priority == "3-MEDIUM", F.concat(F.lit("g"), key))
        .otherwise(F.concat(F.lit("g"), status))
        .alias("group_name"),
        F.when(status == "O", F.concat(F.lit("wf"), F.year("o_orderdate").cast("string")))
        .when(status == "P", "")
        .alias("workflow"),
        F.when(F.col("o_totalprice") < 100000, None)
        .when(F.col("o_totalprice") < 150000, F.array().cast("array<string>"))
        .otherwise(
            F.array(
                F.concat(F.lit("lake.sales.o"), key),
                F.concat(F.lit("lake.sales.c"), F.col("o_custkey").cast("string")),
            )
        )
        .alias("tables"),
    )


def config_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON config document per order: its workspace with that one group."""
    spaces = config_workspaces(spark, sf_dir)
    group = F.struct("group_name", "workflow", "tables")
    fields = [c for c in spaces.columns if c != "secret_scope"]
    return (
        config_groups(spark, sf_dir)
        .select("workspace_name", group.alias("g"))
        .join(spaces, "workspace_name")
        .select(
            F.to_json(
                F.struct(
                    "secret_scope",
                    F.array(F.struct(*fields, F.array("g").alias("sync_groups"))).alias("workspaces"),
                )
            ).alias("document")
        )
    )


def declared_state(spark: SparkSession, sf_dir: str, where: str = "c_acctbal < 6000") -> DataFrame:
    """Control rows of customers; by default some declared ones have none."""
    c = table(spark, sf_dir, "customer").filter(where)
    ms = F.lit(NOW_MS) - F.col("c_custkey") * 1000
    return c.select(
        F.concat(F.lit("ws"), F.col("c_nationkey").cast("string")).alias("workspace_name"),
        F.col("c_name").alias("group_name"),
        F.col("c_mktsegment").alias("workflow_name"),
        F.col("c_custkey").cast("string").alias("workflow_id"),
        F.array(F.concat(F.lit("lake.crm.c"), F.col("c_custkey").cast("string"))).alias("tables"),
        (F.col("c_acctbal") >= 3000).alias("validated"),
        ms.alias("last_successful_run_time"),
        F.lit("Success").alias("sync_status"),
        F.lit("workflow_time").alias("sync_reason"),
        (ms + 1).alias("sync_time_to_region"),
        (ms + 2).alias("sync_time_in_region"),
        F.lit(None).cast("string").alias("source_operation_metrics"),
        F.lit(None).cast("string").alias("target_operation_metrics"),
    )


def declared_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of the customers whose balance is above 0; some differ from the state."""
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    return c.select(
        F.concat(F.lit("ws"), F.col("c_nationkey").cast("string")).alias("workspace_name"),
        F.col("c_name").alias("group_name"),
        F.when(F.col("c_mktsegment") == "BUILDING", None)
        .otherwise(F.col("c_mktsegment"))
        .alias("workflow_name"),
        F.concat(F.lit("j"), F.col("c_custkey").cast("string")).alias("workflow_id"),
        F.when(
            F.col("c_nationkey") == 7, F.array(F.lit("lake.crm.all"))
        )
        .otherwise(F.array(F.concat(F.lit("lake.crm.c"), F.col("c_custkey").cast("string"))))
        .alias("tables"),
        F.lit(True).alias("validated"),
    )


def declared_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workspaces a merge is about: nations outside region 0."""
    return (
        table(spark, sf_dir, "nation")
        .filter("n_regionkey <> 0")
        .select(F.concat(F.lit("ws"), F.col("n_nationkey").cast("string")).alias("workspace_name"))
    )
