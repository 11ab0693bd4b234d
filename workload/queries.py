"""One query per operator, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep import scratch
from lockstep.functions.metrics import encode_metrics, flatten_metrics
from lockstep.functions.names import qualify
from lockstep.model import GROUP_KEY
from lockstep.operators import generate, history, merge, reconcile, runs
from lockstep.plans import decide, deliver, medallion, report, sync, validate
from lockstep.sources import (
    catalog,
    changesets,
    config,
    digests,
    files,
    paths,
    releases,
    snapshots,
    sqltables,
    state,
)
from lockstep.sources.logs import append_dealt
from lockstep.streaming import ingest, upsert
from workload import fixtures as fx


def _joined(column: str = "tables"):
    return F.concat_ws(",", F.col(column)).alias(column)


# --- histories -----------------------------------------------------------------


def q_version_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return history.as_of_time(fx.commits(spark, sf), fx.CUTOFF_MS)


def _members(spark: SparkSession, sf: str) -> DataFrame:
    groups = fx.state(spark, sf).select(
        *GROUP_KEY, "tables", F.col("last_successful_run_time").alias("cutoff_ms")
    )
    return history.group_tables(groups)


def q_version_as_of_targets(spark: SparkSession, sf: str) -> DataFrame:
    return history.as_of(_members(spark, sf), fx.commits(spark, sf)).drop("position")


def q_version_as_of_many(spark: SparkSession, sf: str) -> DataFrame:
    """The version of its table six hours after every commit: many cutoffs per table."""
    log = fx.commits(spark, sf)
    cutoff = F.unix_millis(F.col("ts").cast("timestamp")) + 6 * 3600 * 1000
    asked = log.select("table_name", cutoff.alias("cutoff_ms"))
    return history.as_of(asked, log).select("table_name", "cutoff_ms", "version")


def q_clone_version_as_of(spark: SparkSession, sf: str) -> DataFrame:
    extras = {"source_version": F.col("operation_parameters")["sourceVersion"].try_cast("bigint")}
    found = history.as_of(
        _members(spark, sf), fx.commits(spark, sf), operation="CLONE", extras=extras
    )
    return found.drop("position")


def q_group_tables(spark: SparkSession, sf: str) -> DataFrame:
    members = history.group_tables(fx.state(spark, sf).select(*GROUP_KEY, "tables"))
    return qualify(members, location="stage").withColumn("position", F.col("position").cast("bigint"))


def q_new_commits_by_group(spark: SparkSession, sf: str) -> DataFrame:
    groups = fx.state(spark, sf).withColumn("last_ms", F.col("last_successful_run_time"))
    return history.has_new_commits(groups, fx.commits(spark, sf))


def q_new_commits_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The same over a stored log, of which only the days after the least watermark are opened."""
    log, root = fx.commits(spark, sf), scratch.new_dir(spark, "log")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    append_dealt(log.withColumn("ts", F.col("ts").cast("timestamp")), f"{root}/_commits", ms, F.col("table_name"), small=False)
    late = fx.state(spark, sf).withColumn("last_ms", F.lit(fx.CUTOFF_MS) + F.col("last_successful_run_time") % fx.DAY_MS)
    return history.has_new_commits(late, snapshots.commits(spark, root))


def q_latest_success(spark: SparkSession, sf: str) -> DataFrame:
    marks = fx.state(spark, sf).select(
        F.col("workflow_id").alias("job_id"), F.col("last_successful_run_time").alias("last_ms")
    )
    return runs.latest_success(marks.filter("job_id <> ''"), fx.runs(spark, sf))


def q_resolve_workflows(spark: SparkSession, sf: str) -> DataFrame:
    groups = fx.table(spark, sf, "customer").select(
        F.col("c_name").alias("group_name"),
        F.concat(F.lit("wf"), F.col("c_nationkey").cast("string")).alias("workflow"),
    )
    jobs = fx.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("job_id"),
        F.concat(F.lit("wf"), F.col("s_nationkey").cast("string")).alias("name"),
        F.col("s_suppkey").alias("listing_pos"),
    )
    return runs.resolve_workflows(groups, jobs)


# --- plans ---------------------------------------------------------------------


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    return decide.decide(
        fx.state(spark, sf),
        fx.workspaces(spark, sf),
        fx.commits(spark, sf),
        fx.runs(spark, sf),
        fx.NOW_MS,
    )


def q_sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _decisions(spark, sf).select(*GROUP_KEY, "workflow_id", "decision", "cutoff_ms")


def q_copy_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan = decide.build(_decisions(spark, sf), fx.commits(spark, sf))
    return plan.select(*GROUP_KEY, "table_name", "cutoff_ms", "decision", "version", "commit_ms")


def q_pending_delivery(spark: SparkSession, sf: str) -> DataFrame:
    return deliver.pending(fx.state(spark, sf)).select(
        *GROUP_KEY, "sync_time_to_region", "sync_time_in_region"
    )


def q_delivery_plan(spark: SparkSession, sf: str) -> DataFrame:
    return deliver.plan(fx.state(spark, sf), fx.commits(spark, sf)).drop("position")


# --- config and control table --------------------------------------------------


def q_config_load(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch.new_dir(spark, "config")
    fx.config_documents(spark, sf).write.text(path)
    workspaces, groups = config.load(spark, path, multi_line=False)
    per_space = workspaces.groupBy("workspace_name").agg(
        F.count(F.lit(1)).alias("documents"),
        F.max("sync_interval_mins").cast("bigint").alias("sync_interval_mins"),
        F.max("sync_max_retries").alias("sync_max_retries"),
    )
    per_group = groups.groupBy("workspace_name").agg(
        F.count("group_name").alias("named_groups"),
        F.count("workflow").alias("workflows"),
        F.sum(F.coalesce(F.array_size("tables"), F.lit(0))).alias("tables"),
    )
    return per_space.join(per_group, "workspace_name", "left")


def q_workspace_lookup(spark: SparkSession, sf: str) -> DataFrame:
    found = config.workspace(fx.config_workspaces(spark, sf), "Customer#000000007")
    return found.select("workspace_name", "workspace_pat_key", "sync_location_primary")


def q_config_violations(spark: SparkSession, sf: str) -> DataFrame:
    return validate.violations(fx.config_workspaces(spark, sf), fx.config_groups(spark, sf))


def q_config_defaults(spark: SparkSession, sf: str) -> DataFrame:
    filled = validate.with_defaults(fx.config_workspaces(spark, sf))
    return filled.select(
        "workspace_name",
        F.col("sync_interval_mins").cast("bigint").alias("sync_interval_mins"),
        F.col("sync_failover_interval_mins").cast("bigint").alias("sync_failover_interval_mins"),
        "sync_max_retries",
    )


def q_valid_groups(spark: SparkSession, sf: str) -> DataFrame:
    kept = validate.valid_groups(fx.config_groups(spark, sf))
    return kept.select(*GROUP_KEY, "workflow", _joined())


def q_config_summary(spark: SparkSession, sf: str) -> DataFrame:
    workspaces = validate.with_defaults(fx.config_workspaces(spark, sf))
    groups = validate.valid_groups(fx.config_groups(spark, sf))
    result = validate.summary(workspaces, groups)
    return result.withColumn("default_schedule", F.col("default_schedule").cast("bigint"))


def _declared(spark: SparkSession, sf: str) -> DataFrame:
    return fx.declared_groups(spark, sf).withColumnRenamed("workflow_name", "workflow")


def q_config_changed(spark: SparkSession, sf: str) -> DataFrame:
    return validate.changed(fx.declared_state(spark, sf), _declared(spark, sf))


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Listed tables: one per customer with an order."""
    return fx.table(spark, sf, "orders").select(
        F.concat(F.lit("lake.crm.c"), F.col("o_custkey").cast("string")).alias("table_name")
    ).distinct()


def q_missing_tables(spark: SparkSession, sf: str) -> DataFrame:
    members = history.group_tables(fx.declared_groups(spark, sf).select(*GROUP_KEY, "tables"))
    return catalog.missing_tables(members, _catalog(spark, sf)).drop("position")


def q_unreadable_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Every table that a root's commits name, with the rows committed and whether they can be read.

    One is whole, one has a file that is not parquet, one lost rows, one folder was never written, and
    one has good rows again after a damaged version.
    """
    root, damaged = scratch.new_dir(spark, "probed"), F.lit("not a parquet file").alias("value")
    names = {x: f"lake.sales.{x}" for x in ("orders", "lineitem", "customer", "events", "part")}
    sides = {x: fx.table(spark, sf, x) for x in ("orders", "lineitem", "customer", "part")}
    for x, df in sides.items():
        snapshots.publish(df, root, names[x])
    for x in ("lineitem", "part"):
        spark.range(1).select(damaged).write.mode("append").text(paths.version_dir(root, names[x], 0))
    snapshots.publish(sides["part"], root, names["part"])
    fewer = sides["customer"].filter("c_acctbal >= 0")
    fewer.write.mode("overwrite").parquet(paths.version_dir(root, names["customer"], 0))
    rows = {"numOutputRows": str(fx.table(spark, sf, "events").count())}
    snapshots.commit(spark, root, [snapshots.commit_row(names["events"], 0, fx.NOW_MS, "WRITE", {}, rows)])
    committed = snapshots.commits(spark, root).groupBy("table_name").agg(
        F.max_by(F.col("operation_metrics")["numOutputRows"].cast("bigint"), "version").alias("row_count")
    )
    bad = catalog.unreadable(spark, root)
    return (
        catalog.listing_of_root(spark, root)
        .join(committed, "table_name")
        .join(bad, "table_name", "left")
        .select("table_name", "row_count", F.col("reason").isNull().alias("readable"))
    )


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    jobs = fx.table(spark, sf, "orders").select(
        F.concat(F.lit("j"), F.col("o_custkey").cast("string")).alias("job_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "AUTOMOBILE")
        .when(F.col("o_orderpriority") == "2-HIGH", "HOUSEHOLD")
        .otherwise("MACHINERY")
        .alias("name"),
        F.col("o_orderkey").alias("listing_pos"),
    )
    return validate.validate(
        _declared(spark, sf), fx.declared_state(spark, sf), jobs, _catalog(spark, sf)
    )


def q_group_validity(spark: SparkSession, sf: str) -> DataFrame:
    return _validated(spark, sf).withColumn("tables", _joined())


def q_config_merge(spark: SparkSession, sf: str) -> DataFrame:
    merged = state.merge_config(
        fx.declared_state(spark, sf),
        fx.declared_groups(spark, sf),
        fx.declared_workspaces(spark, sf),
    )
    return merged.withColumn("tables", _joined())


def q_state_patch(spark: SparkSession, sf: str) -> DataFrame:
    patches = fx.table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(
        F.concat(F.lit("ws"), F.col("c_nationkey").cast("string")).alias("workspace_name"),
        F.col("c_name").alias("group_name"),
        F.when(F.col("c_acctbal") > 2000, "In Progress").alias("sync_status"),
        F.when(F.col("c_acctbal") > 4000, F.lit(fx.NOW_MS)).alias("sync_time_to_region"),
    )
    patched = state.patch(fx.declared_state(spark, sf, "true"), patches)
    return patched.withColumn("tables", _joined())


# --- metrics and report --------------------------------------------------------


def _with_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Control rows whose metrics were measured at, and a day before, their last run."""
    base = fx.state(spark, sf).filter("last_successful_run_time is not null")
    groups = base.select(
        *GROUP_KEY,
        "workflow_name",
        "tables",
        F.col("last_successful_run_time").alias("source_ms"),
        (F.col("last_successful_run_time") - fx.DAY_MS).alias("target_ms"),
    )
    log = fx.commits(spark, sf)
    source = history.as_of(history.group_tables(groups), log, "source_ms").filter("version is not null")
    target = history.as_of(history.group_tables(groups), log, "target_ms").filter("version is not null")
    size = (F.lit(1000) + F.col("version") % 3).alias("source_table_size")
    workflow = F.col("workflow_name") != ""
    source = source.select(
        *GROUP_KEY,
        "position",
        "table_name",
        F.when(workflow, F.col("commit_ms")).alias("sync_commit_timestamp"),
        F.when(workflow, F.col("version")).alias("sync_commit_version"),
        size,
    )
    target = target.select(
        *GROUP_KEY,
        "position",
        "table_name",
        F.col("version").cast("string").alias("sync_commit_version"),
        size,
    )
    source = encode_metrics(
        source,
        "source_operation_metrics",
        ["sync_commit_timestamp", "sync_commit_version", "source_table_size"],
    )
    target = encode_metrics(
        target, "target_operation_metrics", ["sync_commit_version", "source_table_size"]
    )
    return (
        base.drop("source_operation_metrics", "target_operation_metrics")
        .join(source, GROUP_KEY, "left")
        .join(target, GROUP_KEY, "left")
    )


def q_metrics_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return flatten_metrics(_with_metrics(spark, sf), "source_operation_metrics")


def q_sync_report(spark: SparkSession, sf: str) -> DataFrame:
    result = report.build(_with_metrics(spark, sf), fx.NOW_MS, "UTC")
    times = ["last_successful_run_time", "sync_time_to_region", "sync_time_in_region"]
    return result.withColumns({c: F.unix_millis(c) for c in times})


# --- merge, counter, sample data -----------------------------------------------


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"
    )


def _text(df: DataFrame, *times: str) -> DataFrame:
    """Zone-less times as text, which every engine prints alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in times})


def _upsert_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders up to 1998 as the table, repriced orders from 1997 on as the batch."""
    orders = _orders(spark, sf)
    target = orders.filter("o_orderdate < timestamp_ntz'1999-01-01'")
    source = orders.filter("o_orderdate >= timestamp_ntz'1997-01-01'")
    source = source.withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return target.drop("o_orderdate"), source.drop("o_orderdate")


def q_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return merge.upsert(*_upsert_sides(spark, sf), ["o_orderkey"])


def q_merge_counter(spark: SparkSession, sf: str) -> DataFrame:
    orders = _orders(spark, sf).drop("o_orderdate")
    start = merge.next_counter(orders, "o_orderkey")
    return merge.assign_counter(orders, ["o_totalprice", "o_orderkey"], start, "merge_counter")


def q_silver_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _text(medallion.to_silver(fx.table(spark, sf, "events"), "value", 50), "ts")


def q_gold_count(spark: SparkSession, sf: str) -> DataFrame:
    return medallion.to_gold(fx.table(spark, sf, "lineitem"), "l_partkey")


def q_generate_raw(spark: SparkSession, sf: str) -> DataFrame:
    return generate.sample_rows(fx.table(spark, sf, "orders"), 7, "o_orderkey")


def q_medallion_tables(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch.new_dir(spark, "medallion")
    names = {"raw": "lake.raw.raw_data", "silver": "lake.stage.silver_data", "gold": "lake.main.gold_data"}
    ids = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    medallion.run_tables(ids, root, names, 7)
    return snapshots.read(spark, root, names["gold"])


# --- snapshots and reconciliation ----------------------------------------------


def q_clone_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Publish two versions, stage the older, deliver it, read the delivery."""
    roots = [scratch.new_dir(spark, f"clone-{i}") for i in range(3)]
    orders, name = _orders(spark, sf), "lake.sales.orders"
    first = orders.filter("o_orderdate < timestamp_ntz'1998-01-01'")
    snapshots.publish(first, roots[0], name, at_ms=fx.CUTOFF_MS)
    snapshots.publish(orders, roots[0], name, at_ms=fx.NOW_MS)
    version = snapshots.resolve(spark, roots[0], name, as_of_ms=fx.NOW_MS - 1)
    snapshots.clone(spark, roots[0], roots[1], name, version)
    snapshots.clone(spark, roots[1], roots[2], name)
    return _text(snapshots.read(spark, roots[2], name), "o_orderdate")


def q_clone_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """Stage and deliver a table partitioned by texts that look like numbers."""
    roots = [scratch.new_dir(spark, f"parts-{i}") for i in range(3)]
    lines = fx.table(spark, sf, "lineitem").withColumn("part", F.lpad(F.col("l_linenumber").cast("string"), 3, "0"))
    name = "lake.sales.lines"
    snapshots.publish(lines, roots[0], name, partition_by=["part"])
    snapshots.clone(spark, roots[0], roots[1], name)
    snapshots.clone(spark, roots[1], roots[2], name)
    return _text(snapshots.read(spark, roots[2], name), "l_shipdate")


def q_register(spark: SparkSession, sf: str) -> DataFrame:
    """Views of two catalogs that hold a table of one name, read back."""
    root = scratch.new_dir(spark, "views")
    parts = []
    for catalog, table, key in (("one", "orders", "o_orderkey"), ("two", "customer", "c_custkey")):
        name = f"{catalog}.sales.t"
        version = snapshots.publish(fx.table(spark, sf, table).select(F.col(key).alias("id")), root, name)
        view = spark.table(snapshots.register(spark, root, name, version))
        parts.append(view.select(F.lit(name).alias("table_name"), "id"))
    return parts[0].unionByName(parts[1])


def _altered(lineitem: DataFrame) -> DataFrame:
    """A copy that lost some rows, repeats some and has others changed."""
    kept = lineitem.filter("not (l_returnflag = 'A' and l_quantity = 50)")
    changed = kept.withColumn(
        "l_tax",
        F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") == 7), None).otherwise(F.col("l_tax")),
    )
    return changed.unionByName(lineitem.filter("l_returnflag = 'R' and l_quantity = 49"))


def q_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    lineitem = fx.table(spark, sf, "lineitem")
    return reconcile.diff_keys(lineitem, _altered(lineitem), ["l_orderkey", "l_linenumber"])


def q_reconcile_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Rows on both sides of an altered copy, all keys in one bucket."""
    lineitem = fx.table(spark, sf, "lineitem")
    return reconcile.diff(lineitem, _altered(lineitem), ["l_orderkey"], 1)


def q_changed_only_clone(spark: SparkSession, sf: str) -> DataFrame:
    """Copy, find nothing to copy, change a few rows at the source, copy again, read the copy."""
    src, dst = scratch.new_dir(spark, "src"), scratch.new_dir(spark, "dst")
    orders, name = _orders(spark, sf).drop("o_orderdate"), "lake.sales.orders"
    snapshots.publish(orders, src, name)
    for _ in range(2):
        if snapshots.clone(spark, src, dst, name, changed_only=True) != 0:
            raise AssertionError("an unchanged table was copied")
    priced = F.when(F.col("o_custkey") == 11, 0.0).otherwise(F.col("o_totalprice"))
    snapshots.publish(orders.withColumn("o_totalprice", priced), src, name)
    snapshots.clone(spark, src, dst, name, changed_only=True)
    return snapshots.read(spark, dst, name)


_LINE = ["l_orderkey", "l_linenumber"]


def _shipped(spark: SparkSession, sf: str) -> tuple[str, str, str]:
    """A table staged and delivered whole, then as it was altered, then with some orders' lines changed."""
    src, stage, dst = (scratch.new_dir(spark, x) for x in ("src", "stage", "dst"))
    lineitem, name = fx.table(spark, sf, "lineitem"), "lake.sales.lines"
    altered = _altered(lineitem)
    taxed = F.when(F.col("l_orderkey") % 1000 == 1, 0.5).otherwise(F.col("l_tax"))
    for n, state_of in enumerate((lineitem, altered, altered.withColumn("l_tax", taxed))):
        snapshots.publish(state_of, src, name)
        changesets.stage_table(spark, src, stage, name, _LINE)
        if n != 1:  # the second change set waits, so that the destination takes two at once
            changesets.deliver_table(spark, stage, dst, name)
    return src, stage, dst


def q_change_set(spark: SparkSession, sf: str) -> DataFrame:
    """A destination that was brought up to date by change sets alone."""
    _, _, dst = _shipped(spark, sf)
    return _text(snapshots.read(spark, dst, "lake.sales.lines"), "l_shipdate")


def q_change_set_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that each staged copy holds, against the rows of the table it stands for."""
    src, stage, _ = _shipped(spark, sf)
    staged = snapshots.commits(spark, stage).select(
        F.col("operation_parameters")["sourceVersion"].cast("bigint").alias("version"),
        F.col("operation_metrics")["numOutputRows"].cast("bigint").alias("staged_rows"),
    )
    whole = snapshots.commits(spark, src).select(
        "version", F.col("operation_metrics")["numOutputRows"].cast("bigint").alias("table_rows")
    )
    return whole.join(staged, "version")


def q_reconcile_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that differ between two versions, by their kept digest trees."""
    root, name = scratch.new_dir(spark, "trees"), "lake.sales.lines"
    lineitem = fx.table(spark, sf, "lineitem")
    snapshots.publish(lineitem, root, name)
    snapshots.publish(_altered(lineitem), root, name)
    return digests.diff_versions(spark, (root, name, 0), (root, name, 1), _LINE)


def _group_roots(spark: SparkSession, sf: str):
    """A source with a finished and an unfinished load of two groups, synced once."""
    src, stage, dst = [scratch.new_dir(spark, f"sync-{i}") for i in range(3)]
    early = "timestamp_ntz'1998-01-01'"
    orders, lineitem = fx.table(spark, sf, "orders"), fx.table(spark, sf, "lineitem")
    customer = fx.table(spark, sf, "customer")
    hour = 3600000
    t0 = fx.CUTOFF_MS
    snapshots.publish(orders.filter(f"o_orderdate < {early}"), src, "lake.sales.orders", at_ms=t0)
    snapshots.publish(lineitem.filter(f"l_shipdate < {early}"), src, "lake.sales.lines", at_ms=t0 + 1)
    snapshots.publish(customer, src, "lake.crm.customer", at_ms=t0)
    # the next load has replaced one of two tables when the sender runs
    snapshots.publish(orders, src, "lake.sales.orders", at_ms=t0 + 2 * hour)
    spaces = spark.createDataFrame(
        [("ws", 15, 10, "3")],
        "workspace_name string, sync_interval_mins int, sync_failover_interval_mins int, sync_max_retries string",
    )
    declared = spark.createDataFrame(
        [
            ("ws", "sales", "load_sales", "1", ["lake.sales.orders", "lake.sales.lines"], True),
            ("ws", "scheduled_sync", "", "", ["lake.crm.customer"], True),
        ],
        "workspace_name string, group_name string, workflow_name string, workflow_id string, "
        "tables array<string>, validated boolean",
    )
    run_log = spark.createDataFrame(
        [("1", t0, t0 + hour, "SUCCESS"), ("1", t0 + hour, t0 + 3 * hour, "FAILED")],
        "job_id string, start_time_ms bigint, end_time_ms bigint, result_state string",
    )
    state.save(state.merge_config(state.load(spark, stage), declared), stage, t0)
    sync.sync("sender", spark, spaces, run_log, src, stage, now_ms=t0 + 4 * hour)
    sync.sync("receiver", spark, spaces, stage, dst)
    return src, stage, dst


def q_group_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and value of every table delivered by a full sender and receiver run."""
    _, _, dst = _group_roots(spark, sf)
    tables = releases.read_group(spark, dst, "ws", "sales")
    tables |= releases.read_group(spark, dst, "ws", "scheduled_sync")
    keys = {
        "lake.sales.orders": "o_orderkey",
        "lake.sales.lines": "l_orderkey",
        "lake.crm.customer": "c_custkey",
    }
    parts = [
        tables[name].agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("row_count"),
            F.sum(key).alias("key_sum"),
        )
        for name, key in keys.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_group_switch(spark: SparkSession, sf: str) -> DataFrame:
    """What SQL reads of a group released once, with newer versions written, and after its next release."""
    root, early = scratch.new_dir(spark, "switch"), "timestamp_ntz'1998-01-01'"
    sides = {
        "lake.sales.orders": (fx.table(spark, sf, "orders"), "o_orderdate", "o_orderkey"),
        "lake.sales.lines": (fx.table(spark, sf, "lineitem"), "l_shipdate", "l_orderkey"),
    }

    def write(condition: str) -> None:
        for name, (df, day, _) in sides.items():
            version = snapshots.publish(df.filter(condition.format(day)), root, name)
            sqltables.add_version(spark, root, name, version, snapshots.layout_of(spark, root, name, version))

    def release(version: int) -> None:
        members = [(name, version) for name in sides]
        releases.append(spark, {("ws", "sales"): members}, root, fx.NOW_MS + version)

    def seen(moment: str) -> DataFrame:
        parts = [
            f"SELECT '{moment}' AS moment, '{name}' AS table_name, count(*) AS row_count, sum({key}) AS key_sum "
            f"FROM {name.replace('.', '__', 1)}"
            for name, (_, _, key) in sides.items()
        ]
        return spark.sql(" UNION ALL ".join(parts)).checkpoint()

    write(f"{{}} < {early}")
    release(0)
    sqltables.register_group(spark, root, "ws", "sales")
    first = seen("released")
    write("true")
    between = seen("between")
    release(1)
    return first.unionByName(between).unionByName(seen("switched"))


def q_sql_time_travel(spark: SparkSession, sf: str) -> DataFrame:
    """A table at a version, at a time and before its first commit, in SQL text alone."""
    root, name = scratch.new_dir(spark, "travel"), "lake.past.orders"
    orders = _orders(spark, sf)
    for n, year in enumerate((1996, 1998, 2100)):
        rows = orders.filter(f"o_orderdate < timestamp_ntz'{year}-01-01'")
        snapshots.publish(rows, root, name, at_ms=fx.CUTOFF_MS + n * fx.DAY_MS)
    sqltables.register_time_travel(spark, root, name)
    half = fx.DAY_MS // 2
    return spark.sql(f"""
        SELECT 'at' AS asked, o_orderstatus, count(*) AS n FROM lake__past__orders_at(0) GROUP BY o_orderstatus
        UNION ALL SELECT 'as_of', o_orderstatus, count(*)
        FROM lake__past__orders_as_of({fx.CUTOFF_MS + fx.DAY_MS + half}) GROUP BY o_orderstatus
        UNION ALL SELECT 'gained', n.o_orderstatus, count(*) FROM lake__past__orders_at(2) n
        LEFT ANTI JOIN lake__past__orders_at(1) o ON n.o_orderkey = o.o_orderkey GROUP BY n.o_orderstatus
        UNION ALL SELECT 'before', '-', count(*) FROM lake__past__orders_as_of({fx.CUTOFF_MS - 1})""")


def q_sql_state(spark: SparkSession, sf: str) -> DataFrame:
    """The control table, after the receiver recorded deliveries, and one group of it, in SQL text alone."""
    root = scratch.new_dir(spark, "control")
    control = fx.declared_state(spark, sf, "true")
    state.save(control, root)
    times = control.filter("validated").select(*GROUP_KEY, F.lit(fx.NOW_MS).alias("sync_time_in_region"))
    state.record(times, root, "receiver")
    sqltables.register_state(spark, root)
    return spark.sql("""
        SELECT workspace_name, group_name, workflow_name, array_join(tables, ',') AS tables, sync_time_in_region
        FROM sync__meta.state
        UNION ALL SELECT 'one', group_name, workflow_name, array_join(tables, ','), sync_time_in_region
        FROM sync__meta__group_state((SELECT min(workspace_name) FROM sync__meta.state WHERE group_name = 'Customer#000000001'),
                                     'Customer#000000001')""")


def q_group_sync_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report after a full run: versions agree and every table is synced."""
    _, stage, _ = _group_roots(spark, sf)
    result = report.build(state.load(spark, stage), fx.NOW_MS)
    return result.select(
        "group_name",
        "table_name",
        "sync_reason",
        "source_sync_commit_version",
        "target_sync_commit_version",
        "sync_status",
    )


def q_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What a sender's and a receiver's runs say of groups that were synced, failed and skipped.

    A failed group, one of whose tables can't be read, is tried as often as its workspace says, staged in no
    part and not delivered; the others are.
    """
    src, stage, dst = (scratch.new_dir(spark, f"runs-{i}") for i in range(3))
    t0, hour = fx.CUTOFF_MS, 3600000
    for name in ("orders", "lineitem", "customer", "part"):
        snapshots.publish(fx.table(spark, sf, name), src, f"lake.sales.{name}", at_ms=t0)
    snapshots.commit(spark, src, [snapshots.commit_row("lake.sales.lost", 0, t0, "WRITE")])
    spaces = spark.createDataFrame(
        [("ws", 15, 10, "2")],
        "workspace_name string, sync_interval_mins int, sync_failover_interval_mins int, sync_max_retries string",
    )
    groups = {
        "good": ("1", ["lake.sales.orders", "lake.sales.lineitem"]),
        "broken": ("1", ["lake.sales.part", "lake.sales.lost"]),
        "waiting": ("2", ["lake.sales.orders"]),
        "absent": ("1", ["lake.sales.customer", "lake.sales.unknown"]),
        "scheduled_sync": ("", ["lake.sales.customer"]),
    }
    declared = spark.createDataFrame(
        [("ws", name, "load" if job else "", job, tables, True) for name, (job, tables) in groups.items()],
        "workspace_name string, group_name string, workflow_name string, workflow_id string, "
        "tables array<string>, validated boolean",
    )
    ran = spark.createDataFrame(
        [("1", t0, t0 + hour, "SUCCESS"), ("2", t0, t0 + hour, "FAILED")],
        "job_id string, start_time_ms bigint, end_time_ms bigint, result_state string",
    )
    state.save(state.merge_config(state.load(spark, stage), declared), stage, t0)
    waits: list[float] = []
    sync.sync("sender", spark, spaces, ran, src, stage, now_ms=t0 + 2 * hour, sleep=waits.append)
    sync.sync("receiver", spark, spaces, stage, dst, sleep=waits.append)
    if len(waits) != 1:
        raise AssertionError(f"one copy was to be tried twice, not {len(waits)} calls again")

    def told(root: str) -> DataFrame:
        held = snapshots.commits(spark, root).groupBy("table_name").agg(
            F.sum(F.col("operation_metrics")["numOutputRows"].cast("bigint")).alias("rows")
        )
        run = spark.read.parquet(f"{root}/_runs")
        members = run.select("mode", "group_name", F.explode("tables").alias("table_name"))
        rows = members.join(held, "table_name").groupBy("mode", "group_name").agg(F.sum("rows").alias("row_count"))
        failed = F.col("error").isNotNull().alias("failed")
        synced = F.when(F.col("sync_status") == "Success", F.col("row_count")).alias("row_count")
        return run.join(rows, ["mode", "group_name"], "left").select(
            "mode", "group_name", "decision", "sync_status", failed, synced
        )

    return told(stage).unionByName(told(dst))


def q_clone_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that staged and delivered copies report, and whether the bytes they report are those of their files."""
    roots = [scratch.new_dir(spark, f"sizes-{i}") for i in range(3)]
    names = {x: f"lake.sales.{x}" for x in ("orders", "lineitem", "customer")}
    for table, name in names.items():
        parts = ["l_linestatus"] if table == "lineitem" else None
        snapshots.publish(fx.table(spark, sf, table), roots[0], name, partition_by=parts)
        snapshots.clone(spark, roots[0], roots[1], name)
        snapshots.clone(spark, roots[1], roots[2], name)

    def told(copy: str, root: str) -> DataFrame:
        files_of = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        stored = files_of.option("pathGlobFilter", "*.parquet").load([paths.table_dir(root, n) for n in names.values()])
        stored = stored.select(
            F.regexp_extract("path", "/lake/sales/([^/]+)/", 1).alias("name"), "length"
        ).groupBy(F.concat(F.lit("lake.sales."), "name").alias("table_name")).agg(F.sum("length").alias("bytes"))
        metrics = F.col("operation_metrics")
        return snapshots.commits(spark, root).join(stored, "table_name", "left").select(
            F.lit(copy).alias("copy"),
            "table_name",
            metrics["numOutputRows"].cast("bigint").alias("row_count"),
            (metrics["sourceTableSize"].cast("bigint") == F.col("bytes")).alias("bytes_agree"),
        )

    return told("staged", roots[1]).unionByName(told("delivered", roots[2]))


# --- files and streams ---------------------------------------------------------


def _landing(spark: SparkSession, sf: str) -> str:
    """Documents as landed text files, one folder per source, at most 200 documents per file."""
    path = scratch.new_dir(spark, "landing")
    (
        fx.table(spark, sf, "documents")
        .select("source", "text")
        .write.option("maxRecordsPerFile", 200)
        .partitionBy("source")
        .text(path)
    )
    return path


def _by_source(bronze: DataFrame) -> DataFrame:
    """Bytes landed and characters parsed per source folder."""
    source = F.regexp_extract("file_name", "source=([^/]+)/", 1)
    silver = medallion.parse_files(bronze)
    chars = silver.groupBy(source.alias("source")).agg(
        F.sum(F.length("parsed_data")).alias("chars")
    )
    size = bronze.groupBy(source.alias("source")).agg(F.sum("length").alias("bytes"))
    return size.join(chars, "source")


def q_ingest_files(spark: SparkSession, sf: str) -> DataFrame:
    landing = _landing(spark, sf)
    if not files.has_files(spark, landing):
        raise LookupError("nothing landed")
    return _by_source(files.ingest_files(spark, landing, "ws"))


def q_ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    landing = _landing(spark, sf)
    stream = ingest.landed(spark, landing, "ws", scratch.new_dir(spark, "archive"))
    bronze = ingest.ingest_stream(
        stream, scratch.new_dir(spark, "bronze"), scratch.new_dir(spark, "progress")
    )
    return _by_source(bronze)


def q_medallion_files(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch.new_dir(spark, "files")
    names = {"bronze": "lake.raw.bronze", "silver": "lake.stage.silver", "gold": "lake.main.gold"}
    landing, archive = _landing(spark, sf), scratch.new_dir(spark, "archive")
    medallion.run_files(spark, landing, root, names, "ws", fx.NOW_MS, archive)
    if medallion.run_files(spark, f"{landing}/source=src0", root, names, "ws", fx.NOW_MS):
        raise AssertionError("archived files were ingested again")
    gold = snapshots.read(spark, root, names["gold"])
    source = F.regexp_extract("file_name", "source=([^/]+)/", 1)
    return gold.groupBy(source.alias("source"), F.unix_millis("merge_time").alias("merge_ms")).agg(
        F.sum(F.length("parsed_data")).alias("chars")
    )


def q_archived_files(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of every source in the archive, and left in the landing zone, after a batch."""
    root = scratch.new_dir(spark, "files")
    names = {"bronze": "lake.raw.bronze", "silver": "lake.stage.silver", "gold": "lake.main.gold"}
    landing, archive = _landing(spark, sf), scratch.new_dir(spark, "archive")
    medallion.run_files(spark, landing, root, names, "ws", fx.NOW_MS, archive)

    def held(folder: str, column: str) -> DataFrame:
        found = files.ingest_files(spark, folder, "ws").filter(~F.col("path").endswith("_SUCCESS"))
        source = F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")
        return found.groupBy(source).agg(F.sum("length").alias(column))

    left = F.coalesce("left_bytes", F.lit(0).cast("bigint")).alias("left_bytes")
    return held(archive, "archived_bytes").join(held(landing, "left_bytes"), "source", "full").select(
        "source", "archived_bytes", left
    )


def q_upsert_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Per-customer totals of two periods, merged as two streamed batches."""
    root, landing = scratch.new_dir(spark, "gold"), scratch.new_dir(spark, "updates")
    progress, name = scratch.new_dir(spark, "progress"), "lake.main.totals"
    orders = _orders(spark, sf)
    schema = "o_custkey bigint, n bigint, top double"
    for period in ("o_orderdate < timestamp_ntz'2001-01-01'", "o_orderdate >= timestamp_ntz'2001-01-01'"):
        totals = orders.filter(period).groupBy("o_custkey").agg(
            F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top")
        )
        totals.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        upsert.upsert_stream(stream, root, name, ["o_custkey"], progress)
    return snapshots.read(spark, root, name)


def _backlog(spark: SparkSession, sf: str) -> DataFrame:
    """Events of users as updates of their row."""
    return fx.events(spark, sf).select("user_id", "event_id", "event_type", "value")


def q_upsert_newest(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as of even events, then all odd ones at once: the latest event of each user stands."""
    log = _backlog(spark, sf)
    before = merge.newest(log.filter("event_id % 2 = 0"), ["user_id"], "event_id")
    return merge.upsert_newest(before, log.filter("event_id % 2 = 1"), ["user_id"], "event_id")


def q_upsert_stream_newest(spark: SparkSession, sf: str) -> DataFrame:
    """A backlog with many updates per key, the later half of it first: late rows lose."""
    root, landing, name = scratch.new_dir(spark, "newest"), scratch.new_dir(spark, "backlog"), "lake.main.users"
    log, progress = _backlog(spark, sf), scratch.new_dir(spark, "progress")
    middle = log.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    for part in (log.filter(F.col("event_id") > middle), log.filter(F.col("event_id") <= middle)):
        part.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(log.schema).parquet(landing)
        upsert.upsert_stream(stream, root, name, ["user_id"], progress, "event_id")
    return snapshots.read(spark, root, name)


def q_stream_two_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams with checkpoints of their own into one table: both arrive."""
    root, name = scratch.new_dir(spark, "two"), "lake.main.keys"
    schema = "source string, id bigint"
    for table, key in (("orders", "o_orderkey"), ("customer", "c_custkey")):
        landing = scratch.new_dir(spark, table)
        fx.table(spark, sf, table).select(F.lit(table).alias("source"), F.col(key).alias("id")).write.parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        upsert.upsert_stream(stream, root, name, ["source", "id"], scratch.new_dir(spark, "progress"))
    return snapshots.read(spark, root, name)


def q_stream_new_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Landed files, a lost checkpoint, and files that landed since: all are in gold once."""
    root, landing = scratch.new_dir(spark, "late"), scratch.new_dir(spark, "landing")
    names = {"bronze": "lake.raw.bronze", "silver": "lake.stage.silver", "gold": "lake.main.gold"}
    documents = fx.table(spark, sf, "documents").select("source", "text")
    for late in (False, True):
        part = documents.where((F.col("source") >= "src5") == late)
        part.write.mode("append").partitionBy("source").text(landing)
        stream = ingest.landed(spark, landing, "ws")
        ingest.run_files_stream(stream, root, names, scratch.new_dir(spark, "progress"))
    gold = snapshots.read(spark, root, names["gold"])
    source = F.regexp_extract("file_name", "source=([^/]+)/", 1)
    return gold.groupBy(source.alias("source")).agg(F.sum(F.length("parsed_data")).alias("chars"))


def all_queries():
    return {name: fn for name, fn in globals().items() if name.startswith("q_")}
