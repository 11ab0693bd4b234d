"""Logs kept by day and part, and the partitions that lookups leave unread."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from lockstep.functions import pruning
from lockstep.model import COMMITS
from lockstep.operators import history, runs
from lockstep.sources import snapshots
from lockstep.sources.logs import append_dealt, read_dealt
from tests.test_history import T0, at

DAY = 86_400_000


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def stored(spark, root):
    """One commit of each of five tables on each of twelve days."""
    rows = [snapshots.commit_row(f"a.b.t{t}", d, T0 + d * DAY + t, "WRITE") for d in range(12) for t in range(5)]
    log = spark.createDataFrame(rows, COMMITS)
    append_dealt(log, f"{root}/_commits", F.unix_millis("ts"), F.col("table_name"), small=False)
    return root


def test_rows_come_back_from_the_partitions_of_their_day(spark, stored):
    log = snapshots.commits(spark, stored)
    assert log.count() == 60
    days = log.select(pruning.DAY, F.to_date("ts").alias("d")).distinct().collect()
    assert len(days) == 12 and all(r[0] == r[1] for r in days)


def test_new_commits_open_no_day_before_the_least_watermark(spark, stored):
    groups = spark.createDataFrame(
        [("w", "g", ["a.b.t0", "a.b.t1"], T0 + 10 * DAY), ("w", "h", ["a.b.t2"], T0 + 11 * DAY + 2)],
        "workspace_name string, group_name string, tables array<string>, last_ms bigint",
    )
    found = history.has_new_commits(groups, snapshots.commits(spark, stored))
    assert {(r.group_name, r.has_new) for r in found.collect()} == {("g", True), ("h", False)}
    scan = plan_of(found).split("PartitionFilters: ")[1].split("\n")[0]
    assert "log_day" in scan and "ubquery" in scan


def test_a_lookup_opens_one_part(spark, stored):
    assert snapshots.latest_version(spark, stored, "a.b.t3") == 11
    assert snapshots.latest_version(spark, stored, "a.b.none") is None
    own = snapshots.commits_of(spark, stored, "a.b.t3")
    assert "log_part" in plan_of(own).split("PartitionFilters: ")[1].split("\n")[0]
    assert snapshots.resolve(spark, stored, "a.b.t3", as_of_ms=T0 + 4 * DAY) == 3


def test_as_of_opens_no_day_after_the_last_cutoff(spark, stored):
    log = snapshots.commits(spark, stored)
    early = history.as_of_time(log, T0 + 2 * DAY + 1)
    assert {(r.table_name, r.version) for r in early.collect()} == {
        ("a.b.t0", 2), ("a.b.t1", 2), ("a.b.t2", 1), ("a.b.t3", 1), ("a.b.t4", 1)
    }
    assert "log_day" in plan_of(early).split("PartitionFilters: ")[1].split("\n")[0]
    asked = spark.createDataFrame([("a.b.t0", T0 + 3 * DAY), ("a.b.t1", T0), ("a.b.t1", None)], "table_name string, cutoff_ms bigint")
    got = history.as_of(asked, log)
    assert {(r.table_name, r.version) for r in got.collect()} == {("a.b.t0", 3), ("a.b.t1", None)}
    assert "log_day" in plan_of(got).split("PartitionFilters: ")[1].split("\n")[0]


def test_runs_are_bounded_by_the_least_watermark(spark, root):
    rows = [(str(j), T0 + d * DAY, T0 + d * DAY + 5, "SUCCESS" if d % 2 else "FAILED") for d in range(8) for j in range(3)]
    schema = "job_id string, start_time_ms bigint, end_time_ms bigint, result_state string"
    append_dealt(spark.createDataFrame(rows, schema), root, F.col("end_time_ms"), F.col("job_id"), small=False)
    log = read_dealt(spark, root, spark.createDataFrame([], schema).schema)
    marks = spark.createDataFrame([("0", T0 + 7 * DAY), ("1", T0 + 7 * DAY + 5)], "job_id string, last_ms bigint")
    kept = runs.recent(marks, log)
    assert "log_day" in plan_of(kept).split("PartitionFilters: ")[1].split("\n")[0]
    assert {r.job_id: r.run_end_ms for r in runs.latest_success(marks, kept).collect()} == {"0": T0 + 7 * DAY + 5, "1": None}
    unbounded = marks.union(spark.createDataFrame([("2", None)], marks.schema))
    assert runs.recent(unbounded, log).count() == 24


def test_days_do_not_follow_the_sessions_zone(spark, root):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
        snapshots.commit(spark, root, [snapshots.commit_row("a.b.c", 0, T0 - 1, "WRITE")])
        assert str(snapshots.commits(spark, root).first()[pruning.DAY]) == str(at(T0 - 1).date())
        assert snapshots.resolve(spark, root, "a.b.c", as_of_ms=T0 - 1) == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
