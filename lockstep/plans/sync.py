"""Run a sync: copy what the plan says, then publish groups and control table."""

from __future__ import annotations

import json
import random
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockstep.functions.metrics import encode_metrics
from lockstep.model import (
    GROUP_KEY,
    IN_PROGRESS,
    INT,
    LONG,
    SCHEDULE_TIME,
    STRING,
    SUCCESS,
    THRESHOLD_TIME,
    WORKFLOW_TIME,
    struct,
)
from lockstep.plans import decide, deliver, validate
from lockstep.scratch import checkpoint_root
from lockstep.sources import changesets, releases, snapshots, sqltables, state
from lockstep.sources.logs import append_log, small_frame

_OUTCOME = struct(
    workspace_name=STRING,
    group_name=STRING,
    position=INT,
    table_name=STRING,
    version=LONG,
    dst_version=LONG,
    rows=LONG,
    bytes=LONG,
    layout=STRING,
    error=STRING,
)


# Fixed value: the error of a copy that was ended or not begun because its group had failed.
GIVEN_UP = "GivenUp: another table of the group failed"


def retry(
    fn: Callable,
    tries: int = 3,
    sleep: Callable[[float], None] = time.sleep,
    jitter: Callable[[], float] = lambda: random.uniform(0, 2),
    stop: Callable[[], bool] = lambda: False,
):
    """Call ``fn`` up to ``tries`` times; waits 10 s more each time, plus up to 2 s.

    Once ``stop`` says so a failure is not followed by another call.
    """
    for attempt in range(1, tries + 1):
        try:
            return fn()
        except Exception:
            if attempt == tries or stop():
                raise
            sleep(10 * attempt + jitter())
            if stop():
                raise


class _Groups:
    """Which groups of a run have failed; ends the running copies of one that does.

    The jobs of a group's copies carry a tag of its own. Other groups' jobs, and those of other runs, go on.
    """

    def __init__(self, spark: SparkSession):
        self._context, self._run = spark.sparkContext, uuid.uuid4().hex
        self._lock, self._tags, self._failed = threading.Lock(), {}, set()

    def tag(self, group: tuple) -> str:
        with self._lock:
            return self._tags.setdefault(group, f"lockstep-{self._run}-{len(self._tags)}")

    def failed(self, group: tuple) -> bool:
        with self._lock:
            return group in self._failed

    def fail(self, group: tuple) -> bool:
        """Mark a group and end its other copies; False if it had failed before."""
        tag = self.tag(group)
        with self._lock:
            if group in self._failed:
                return False
            self._failed.add(group)
        self._context.cancelJobsWithTag(tag)
        return True


def _largest_first(plan: DataFrame, commits: DataFrame) -> DataFrame:
    """The copy list with each version's committed bytes, groups and their tables by size, largest first.

    A long copy that starts last would keep a run waiting for it alone. A group's tables stay together, so that
    it is complete, and published, early. Versions whose commits tell no size come last.
    """
    metrics, key = F.col("operation_metrics"), ["table_name", "version"]
    nbytes = F.coalesce(metrics["numOutputBytes"], metrics["sourceTableSize"]).try_cast("bigint")
    sizes = commits.join(plan.select(*key), key, "left_semi").groupBy(*key).agg(F.max(nbytes).alias("nbytes"))
    sized = plan.join(sizes, key, "left")
    group = F.coalesce(F.sum("nbytes").over(Window.partitionBy(*GROUP_KEY)), F.lit(0))
    return sized.withColumn("group_bytes", group).orderBy(
        F.desc("group_bytes"), *GROUP_KEY, F.desc_nulls_last("nbytes"), "position"
    )


def _numbered(plan: DataFrame, dst_commits: DataFrame) -> DataFrame:
    """Give every planned copy the destination version it will write, and its group's size.

    Groups sharing a table write consecutive versions of it.
    """
    top = dst_commits.groupBy("table_name").agg(F.max("version").alias("_top"))
    nth = F.row_number().over(Window.partitionBy("table_name").orderBy(*GROUP_KEY))
    return (
        plan.withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy(*GROUP_KEY)))
        .join(top, "table_name", "left")
        .withColumn("dst_version", F.coalesce("_top", F.lit(-1)) + nth)
        .drop("_top")
    )


def _copied_groups(
    spark: SparkSession,
    plan: DataFrame,
    copy: Callable[[Row], tuple[int, int, str]],
    max_workers: int,
    sleep: Callable[[float], None],
    publish_every_s: float,
) -> Iterator[list[tuple]]:
    """Run one distributed copy job per planned row, ``max_workers`` at a time, in the plan's order.

    Yields the outcomes of finished groups, at most once per ``publish_every_s`` and
    at the end, so that a long run makes groups visible as they complete. Only the
    copy list, one small row per table, reaches the driver. A failed copy becomes an
    outcome with an error instead of ending the run. It ends its group, which can't be published any
    more: running copies are cancelled, others not begun nor tried again. Where the session
    schedules fairly, each group has a pool of its own.
    """
    groups = _Groups(spark)
    context = spark.sparkContext
    fair = context.getConf().get("spark.scheduler.mode", "FIFO").upper() == "FAIR"

    def one(row: Row) -> tuple[Row, tuple]:
        group = (row["workspace_name"], row["group_name"])
        key = (*group, row["position"], row["table_name"], row["version"], row["dst_version"])
        if groups.failed(group):
            return row, (*key, None, None, None, GIVEN_UP)
        tag = groups.tag(group)
        context.addJobTag(tag)
        if fair:
            context.setLocalProperty("spark.scheduler.pool", ".".join(group))
        try:
            done = retry(lambda: copy(row), row["tries"], sleep, stop=lambda: groups.failed(group))
            return row, (*key, *done, None)
        except Exception as error:
            first = groups.fail(group)
            ended = not first and "CANCELLED" in str(error).upper()
            return row, (*key, None, None, None, GIVEN_UP if ended else f"{type(error).__name__}: {error}")
        finally:
            context.removeJobTag(tag)

    open_groups: dict[tuple, list[tuple]] = {}
    finished: list[tuple] = []
    published = time.monotonic()
    # One target a row: each has local properties of its own, so that no thread sees another's tag.
    targets = [inheritable_thread_target(spark)(partial(one, row)) for row in plan.toLocalIterator()]
    with ThreadPool(max_workers) as pool:
        for row, outcome in pool.imap_unordered(lambda target: target(), targets):
            group = outcome[:2]
            open_groups.setdefault(group, []).append(outcome)
            if len(open_groups[group]) == row["group_size"]:
                finished += open_groups.pop(group)
            if finished and time.monotonic() - published >= publish_every_s:
                yield finished
                finished, published = [], time.monotonic()
    if finished:
        yield finished


def _complete(outcomes: list[tuple]) -> list[tuple]:
    """Outcomes of the groups in which every copy succeeded."""
    failed = {o[:2] for o in outcomes if o[-1] is not None}
    return [o for o in outcomes if o[:2] not in failed]


def _publish(spark: SparkSession, root: str, done: list[tuple], at_ms: int) -> DataFrame:
    """Commit the copied versions, then release their groups; returns the copies."""
    copies = small_frame(spark, done, _OUTCOME)
    snapshots.commit(
        spark, root, [snapshots.clone_row(o[3], o[5], at_ms, *o[4:5], *o[6:9]) for o in done]
    )
    groups: dict[tuple[str, str], list[tuple[str, int]]] = {}
    for o in done:
        groups.setdefault(o[:2], []).append((o[3], o[5]))
    releases.append(spark, groups, root, at_ms)
    return copies


def _with_tries(plan: DataFrame, workspaces: DataFrame) -> DataFrame:
    tries = workspaces.select(
        "workspace_name",
        F.greatest(F.coalesce(F.col("sync_max_retries").try_cast("int"), F.lit(3)), F.lit(1)).alias(
            "tries"
        ),
    )
    return plan.join(tries, "workspace_name")


def _summarise(
    spark: SparkSession, groups: DataFrame, outcomes: list[tuple], root: str, at_ms: int, mode: str
) -> DataFrame:
    """One row per group looked at, skipped and failed ones included; kept in ``_runs``."""
    per_group = (
        small_frame(spark, outcomes, _OUTCOME)
        .groupBy(*GROUP_KEY)
        .agg(F.coalesce(F.max(F.when(F.col("error") != GIVEN_UP, F.col("error"))), F.max("error")).alias("error"))
        .withColumn("_copied", F.lit(True))
    )
    copied = F.col("_copied").isNotNull()
    result = (
        groups.join(per_group, GROUP_KEY, "left")
        .withColumn(
            "sync_status", F.when(copied & F.col("error").isNull(), F.lit(SUCCESS))
        )
        .withColumn("mode", F.lit(mode))
        .withColumn("run_ms", F.lit(at_ms).cast("bigint"))
        .select(
            "run_ms", "mode", *GROUP_KEY, "workflow_name", "workflow_id", "tables",
            "last_successful_run_time", "sync_status", "decision", "error",
        )
    )
    log = f"{root}/_runs"
    append_log(result, log)
    return spark.read.schema(result.schema).parquet(log).filter(
        (F.col("run_ms") == at_ms) & (F.col("mode") == mode)
    )


def send(
    spark: SparkSession,
    workspaces: DataFrame,
    runs: DataFrame,
    source_root: str,
    stage_root: str,
    now_ms: int | None = None,
    clock: Callable[[], int] = snapshots.now_millis,
    max_workers: int = 10,
    on_missing: str = "block",
    publish_every_s: float = 60.0,
    sleep: Callable[[float], None] = time.sleep,
    declared: DataFrame | None = None,
    keys: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Stage every group due now and return one row per group with its decision.

    With ``declared``, the config's groups, a broken config is an error before anything is read
    or copied. Tables with ``keys`` are staged as change sets where that is less than the table.

    The control table lives in the staging location. Data is written first, then the
    commits, then the releases, then the control table, so a run that stops midway
    leaves the previous release of each group in place.
    """
    if declared is not None:
        validate.require_valid(workspaces, declared)
    checkpoint_root(spark)
    now = clock() if now_ms is None else now_ms
    commits = snapshots.commits(spark, source_root)
    control = state.load(spark, stage_root)
    decisions = decide.decide(control, workspaces, commits, runs, now).checkpoint()
    plan = _with_tries(decide.build(decisions, commits, on_missing), workspaces)
    plan = _numbered(plan, snapshots.commits(spark, stage_root)).checkpoint()
    due = plan.filter(F.col("decision") != decide.NO_VERSION)

    started = due.filter(F.col("decision").isin(WORKFLOW_TIME, THRESHOLD_TIME))
    started = started.select(*GROUP_KEY).distinct().withColumn("sync_status", F.lit(IN_PROGRESS))
    if not started.isEmpty():
        retry(lambda: state.record(started, stage_root, "sender", checked=False), sleep=sleep)

    def copy(row: Row) -> tuple[int, int, str]:
        table, versions = row["table_name"], (row["version"], row["dst_version"])
        if keys and table in keys:
            return changesets.stage(spark, source_root, stage_root, table, keys[table], *versions)
        return snapshots.copy(spark, source_root, stage_root, table, *versions)

    def publish(done: list[tuple]) -> None:
        done_ms = clock()
        copies = _publish(spark, stage_root, done, done_ms)
        patches = _source_patches(copies, due, done_ms)
        retry(lambda: state.record(patches, stage_root, "sender", checked=False), sleep=sleep)

    outcomes = []
    ordered = _largest_first(due, commits)
    for finished in _copied_groups(spark, ordered, copy, max_workers, sleep, publish_every_s):
        outcomes += finished
        done = _complete(finished)
        if done:
            publish(done)

    planned = plan.select(*GROUP_KEY, F.col("decision").alias("_planned")).distinct()
    groups = (
        decisions.join(planned, GROUP_KEY, "left")
        .withColumn("decision", F.coalesce("_planned", "decision"))
        .withColumn("last_successful_run_time", F.coalesce("cutoff_ms", "last_ms"))
    )
    return _summarise(spark, groups, outcomes, stage_root, clock(), "sender")


def _source_patches(copies: DataFrame, due: DataFrame, done_ms: int) -> DataFrame:
    """What the control table records of staged groups."""
    by_workflow = F.col("decision") != SCHEDULE_TIME
    copied = copies.join(
        due.select(*GROUP_KEY, "table_name", "decision", "commit_ms", "cutoff_ms"),
        [*GROUP_KEY, "table_name"],
    ).select(
        *GROUP_KEY,
        "position",
        "table_name",
        "decision",
        "cutoff_ms",
        F.when(by_workflow, F.col("commit_ms")).alias("sync_commit_timestamp"),
        F.when(by_workflow, F.col("version")).alias("sync_commit_version"),
        F.col("bytes").alias("source_table_size"),
    )
    metrics = encode_metrics(
        copied,
        "source_operation_metrics",
        ["sync_commit_timestamp", "sync_commit_version", "source_table_size"],
    )
    return (
        copied.groupBy(*GROUP_KEY)
        .agg(
            F.max("cutoff_ms").alias("last_successful_run_time"),
            F.max("decision").alias("sync_reason"),
        )
        .join(metrics, GROUP_KEY)
        .withColumn("sync_status", F.lit(SUCCESS))
        .withColumn("sync_time_to_region", F.lit(done_ms).cast("bigint"))
    )


def receive(
    spark: SparkSession,
    workspaces: DataFrame,
    stage_root: str,
    dst_root: str,
    clock: Callable[[], int] = snapshots.now_millis,
    max_workers: int = 10,
    register: bool = False,
    publish_every_s: float = 60.0,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Deliver every staged group and return one row per pending group.

    Readers of the destination see a group change when its release row appears, after all of its
    tables have been written; with ``register`` SQL readers of the session's views do, too.
    """
    checkpoint_root(spark)
    started_ms = clock()
    control = state.load(spark, stage_root)
    ours = workspaces.select("workspace_name").distinct()
    control = control.join(ours, "workspace_name", "left_semi").checkpoint()
    released = releases.load(spark, stage_root)
    plan = deliver.plan(control, snapshots.commits(spark, stage_root), released)
    plan = _with_tries(plan, workspaces)
    plan = _numbered(plan, snapshots.commits(spark, dst_root)).checkpoint()
    due = plan.filter(F.col("decision") == deliver.DELIVER)

    def copy(row: Row) -> tuple[int, int, str]:
        table, version = row["table_name"], row["version"]
        rows, _, layout = changesets.deliver(spark, stage_root, dst_root, table, version, row["dst_version"])
        return rows, snapshots.version_size(spark, stage_root, table, version), layout

    def publish(done: list[tuple]) -> None:
        if register:  # before the release, so that its row is all that changes what readers see
            for o in done:
                sqltables.add_version(spark, dst_root, o[3], o[5], json.loads(o[8]))
        copies = _publish(spark, dst_root, done, clock())
        if register:
            for o in done:
                sqltables.released_view(spark, dst_root, *o[:2], o[3], json.loads(o[8]))
        patches = _target_patches(copies, due, started_ms)
        retry(lambda: state.record(patches, stage_root, "receiver", checked=False), sleep=sleep)

    outcomes = []
    ordered = _largest_first(due, snapshots.commits(spark, stage_root))
    for finished in _copied_groups(spark, ordered, copy, max_workers, sleep, publish_every_s):
        outcomes += finished
        done = _complete(finished)
        if done:
            publish(done)

    planned = plan.select(*GROUP_KEY, "decision").distinct()
    groups = control.drop("sync_status").join(planned, GROUP_KEY)
    return _summarise(spark, groups, outcomes, dst_root, clock(), "receiver")


def _target_patches(copies: DataFrame, due: DataFrame, started_ms: int) -> DataFrame:
    """What the control table records of delivered groups."""
    copied = copies.join(
        due.select(*GROUP_KEY, "table_name", "source_version"), [*GROUP_KEY, "table_name"]
    ).select(
        *GROUP_KEY,
        "position",
        "table_name",
        F.col("source_version").cast("string").alias("sync_commit_version"),
        F.col("bytes").alias("source_table_size"),
    )
    return encode_metrics(
        copied, "target_operation_metrics", ["sync_commit_version", "source_table_size"]
    ).withColumn("sync_time_in_region", F.lit(started_ms).cast("bigint"))


def sync(mode: str, spark: SparkSession, *args, **kwargs) -> DataFrame:
    """Run one side: ``sender`` or ``receiver``."""
    sides = {"sender": send, "receiver": receive}
    if mode not in sides:
        raise ValueError(f"mode must be one of {sorted(sides)}, got {mode!r}")
    return sides[mode](spark, *args, **kwargs)
