import threading
import time

import pytest
from pyspark.sql import functions as F

from lockstep.operators import reconcile
from lockstep.plans import report, sync, validate
from lockstep.sources import releases, snapshots, state

T0 = 1_700_000_000_000
HOUR = 3_600_000
A, B, C = "lake.sales.a", "lake.sales.b", "lake.ref.c"


def rows(spark, lo, hi):
    return spark.range(lo, hi).select("id", (F.col("id") * 2).alias("v"))


def spaces(spark, tries="1"):
    return spark.createDataFrame(
        [("w", 15, 10, tries)],
        "workspace_name string, sync_interval_mins int, sync_failover_interval_mins int, sync_max_retries string",
    )


def runs(spark, *ends):
    return spark.createDataFrame(
        [("1", 0, e, "SUCCESS") for e in ends],
        "job_id string, start_time_ms bigint, end_time_ms bigint, result_state string",
    )


def declare(spark, stage, *groups):
    declared = spark.createDataFrame(
        [("w", name, "load" if job else "", job, tables, True) for name, job, tables in groups],
        "workspace_name string, group_name string, workflow_name string, workflow_id string, "
        "tables array<string>, validated boolean",
    )
    state.save(state.merge_config(state.load(spark, stage), declared), stage)


@pytest.fixture
def places(spark, root):
    """A source in which a second load has so far replaced only one of two tables."""
    src, stage, dst = f"{root}/src", f"{root}/stage", f"{root}/dst"
    snapshots.publish(rows(spark, 0, 100), src, A, at_ms=T0)
    snapshots.publish(rows(spark, 0, 50), src, B, at_ms=T0 + 1)
    snapshots.publish(rows(spark, 0, 10), src, C, at_ms=T0)
    snapshots.publish(rows(spark, 0, 120), src, A, at_ms=T0 + 2 * HOUR)
    declare(spark, stage, ("sales", "1", [A, B]), ("scheduled_sync", "", [C]))
    return src, stage, dst


def send(spark, places, run_ends, now, **kw):
    out = sync.send(spark, spaces(spark), runs(spark, *run_ends), places[0], places[1], now_ms=now,
                    sleep=lambda s: None, **kw)
    return {r["group_name"]: (r["decision"], r["sync_status"]) for r in out.collect()}


def receive(spark, places, **kw):
    out = sync.receive(spark, spaces(spark), places[1], places[2], sleep=lambda s: None, **kw)
    return {r["group_name"]: (r["decision"], r["sync_status"]) for r in out.collect()}


def control(spark, places):
    return {r["group_name"]: r for r in state.load(spark, places[1]).collect()}


def test_interrupted_load_is_copied_as_of_the_last_finished_run(spark, places):
    src, stage, dst = places
    assert send(spark, places, [T0 + HOUR], T0 + 3 * HOUR) == {
        "sales": ("workflow_time", "Success"),
        "scheduled_sync": ("schedule_time", "Success"),
    }
    assert receive(spark, places, register=True) == {
        "sales": ("deliver", "Success"), "scheduled_sync": ("deliver", "Success")}
    delivered = releases.read_group(spark, dst, "w", "sales")
    assert set(delivered) == {A, B}
    for name, df in delivered.items():
        at_run_end = snapshots.read(spark, src, name, as_of_ms=T0 + HOUR)
        assert reconcile.diff(at_run_end, df, ["id"], 16).isEmpty()
    assert delivered[A].count() == 100
    assert spark.table("lake__sales.a").count() == 100

    row = control(spark, places)["sales"]
    assert (row["last_successful_run_time"], row["sync_status"], row["sync_reason"]) == (
        T0 + HOUR, "Success", "workflow_time")
    table = {r["table_name"]: r for r in report.build(state.load(spark, stage), T0 + 4 * HOUR).collect()}
    assert {r["sync_status"] for r in table.values()} == {"Synced"}
    assert table[A]["source_sync_commit_version"] == table[A]["target_sync_commit_version"] == 0
    assert table[C]["source_sync_commit_version"] is None
    assert table[A]["hours_since_last_sync"] == 3.0

    assert receive(spark, places) == {}
    assert send(spark, places, [T0 + HOUR, T0 + 4 * HOUR], T0 + 4 * HOUR)["sales"] == ("workflow_time", "Success")
    receive(spark, places, register=True)
    assert releases.read_group(spark, dst, "w", "sales")[A].count() == 120
    assert spark.table("lake__sales.a").count() == 120


def test_failure_between_tables_leaves_the_previous_release(spark, places, monkeypatch):
    src, stage, dst = places
    send(spark, places, [T0 + HOUR], T0 + HOUR)
    before = control(spark, places)["sales"]
    real = snapshots.copy

    def broken(spark, a, b, table, *rest):
        if table == B:
            raise OSError("storage went away")
        return real(spark, a, b, table, *rest)

    monkeypatch.setattr(snapshots, "copy", broken)
    got = send(spark, places, [T0 + 3 * HOUR], T0 + 3 * HOUR)
    assert got["sales"] == ("workflow_time", None)
    assert got["scheduled_sync"][0] == "skip:no_new_commits"
    members = releases.read_group(spark, stage, "w", "sales")
    assert members[A].count() == 100
    after = control(spark, places)["sales"]
    assert after["sync_status"] == "In Progress"
    assert after["last_successful_run_time"] == before["last_successful_run_time"]
    assert snapshots.latest_version(spark, stage, A) == 0

    monkeypatch.setattr(snapshots, "copy", real)
    assert send(spark, places, [T0 + 3 * HOUR], T0 + 3 * HOUR)["sales"] == ("workflow_time", "Success")
    assert releases.read_group(spark, stage, "w", "sales")[A].count() == 120


def test_failed_delivery_keeps_the_destination(spark, places, monkeypatch):
    src, stage, dst = places
    send(spark, places, [T0 + HOUR], T0 + HOUR)
    receive(spark, places)
    send(spark, places, [T0 + 3 * HOUR], T0 + 3 * HOUR)
    real = snapshots.copy
    monkeypatch.setattr(
        snapshots, "copy",
        lambda s, a, b, t, *r: (_ for _ in ()).throw(OSError("no")) if t == B else real(s, a, b, t, *r),
    )
    assert receive(spark, places)["sales"] == ("deliver", None)
    assert releases.read_group(spark, dst, "w", "sales")[A].count() == 100


def test_groups_sharing_a_table_get_their_own_version(spark, root):
    src, stage, dst = places = (f"{root}/src", f"{root}/stage", f"{root}/dst")
    snapshots.publish(rows(spark, 0, 10), src, A, at_ms=T0)
    snapshots.publish(rows(spark, 0, 20), src, A, at_ms=T0 + 2 * HOUR)
    declare(spark, stage, ("early", "1", [A]), ("scheduled_sync", "", [A]))
    send(spark, places, [T0 + HOUR], T0 + 3 * HOUR)
    receive(spark, places)
    assert releases.read_group(spark, dst, "w", "early")[A].count() == 10
    assert releases.read_group(spark, dst, "w", "scheduled_sync")[A].count() == 20


def test_broken_config_stops_before_any_copy(spark, places):
    groups = spark.createDataFrame([("w", "g", "", []), ("w", "g", "load", ["a.b.c"])],
                                   "workspace_name string, group_name string, workflow string, tables array<string>")
    with pytest.raises(validate.ConfigError):
        sync.send(spark, full_spaces(spark), runs(spark, T0 + HOUR), places[0], places[1],
                  now_ms=T0 + HOUR, declared=groups)
    assert releases.load(spark, places[1]).isEmpty()


def full_spaces(spark):
    fields = [*validate.REQUIRED, "sync_max_retries"]
    names = list(dict.fromkeys(["workspace_name", *fields]))
    return spark.createDataFrame([tuple("w" for _ in names)], ", ".join(f"{n} string" for n in names))


def test_run_log_keeps_skipped_groups(spark, places):
    send(spark, places, [], T0 + HOUR)
    got = spark.read.parquet(f"{places[1]}/_runs").collect()
    assert {r["group_name"]: r["decision"] for r in got} == {
        "sales": "skip:no_successful_run", "scheduled_sync": "schedule_time"}


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="mode"):
        sync.sync("both", spark)


def test_retry_waits_longer_each_time_and_reraises():
    waits, calls = [], []

    def failing():
        calls.append(1)
        raise OSError(len(calls))

    with pytest.raises(OSError, match="3"):
        sync.retry(failing, 3, waits.append, lambda: 0.5)
    assert waits == [10.5, 20.5]
    assert sync.retry(lambda: 7, 1, waits.append) == 7


def test_copies_are_retried(spark, places, monkeypatch):
    real, failures = snapshots.copy, {A: 1}

    def flaky(spark, a, b, table, *rest):
        if failures.get(table, 0):
            failures[table] -= 1
            raise OSError("once")
        return real(spark, a, b, table, *rest)

    monkeypatch.setattr(snapshots, "copy", flaky)
    waits = []
    out = sync.send(spark, spaces(spark, "2"), runs(spark, T0 + HOUR), places[0], places[1],
                    now_ms=T0 + HOUR, sleep=waits.append)
    assert {r["sync_status"] for r in out.collect()} == {"Success"}
    assert len(waits) == 1


def test_groups_are_published_as_they_finish(spark, places):
    """With no waiting between publications every group gets its own release."""
    send(spark, places, [T0 + HOUR], T0 + HOUR, publish_every_s=0, max_workers=1)
    times = [r["release_ms"] for r in releases.load(spark, places[1]).collect()]
    assert len(set(times)) == 2


def test_sender_and_receiver_record_side_by_side(spark, root):
    declare(spark, root, ("g", "1", [A]))
    key = "workspace_name string, group_name string, "
    record = lambda writer, schema, *values: state.record(
        spark.createDataFrame([("w", "g", *values)], key + schema), root, writer)
    record("sender", "sync_status string", "In Progress")
    record("receiver", "sync_time_in_region bigint", 5)
    record("sender", "sync_status string, sync_time_to_region bigint", "Success", 6)
    seen = lambda: tuple(state.load(spark, root).select(
        "sync_status", "sync_time_to_region", "sync_time_in_region").first())
    assert seen() == ("Success", 6, 5)


def test_receivers_record_outlives_a_publish_of_what_was_read_before(spark, root):
    declare(spark, root, ("g", "1", [A]))
    before = state.load(spark, root)
    row = spark.createDataFrame([("w", "g", 5)], "workspace_name string, group_name string, sync_time_in_region bigint")
    state.record(row, root, "receiver")
    state.save(before, root)
    assert state.load(spark, root).first()["sync_time_in_region"] == 5
    declare(spark, root, ("g", "2", [A, B]))  # another declaration starts anew
    assert state.load(spark, root).first()["sync_time_in_region"] is None


def test_errors_are_kept_whole(spark, places, monkeypatch):
    def failing(*_):
        raise OSError("x" * 5000)

    monkeypatch.setattr(snapshots, "copy", failing)
    out = sync.send(spark, spaces(spark, "1"), runs(spark, T0 + HOUR), places[0], places[1],
                    now_ms=T0 + HOUR, sleep=lambda s: None)
    assert {len(r["error"]) for r in out.collect()} == {5000 + len("OSError: ")}


def test_a_failed_table_ends_its_groups_running_copy_alone(spark, places, monkeypatch):
    real, running, other = snapshots.copy, threading.Event(), threading.Event()
    calls = []

    def copy(spark, a, b, table, *rest):
        calls.append(table)
        if table == A:
            running.set()
            spark.range(10**15).select(F.sum(F.hash("id"))).collect()  # for hours
        if table == C:
            done = real(spark, a, b, table, *rest)
            other.set()
            return done
        assert running.wait(60) and other.wait(60)
        while not spark.sparkContext.statusTracker().getActiveJobsIds():
            time.sleep(0.05)
        raise OSError("storage went away")

    monkeypatch.setattr(snapshots, "copy", copy)
    out = sync.send(spark, spaces(spark, "3"), runs(spark, T0 + HOUR), places[0], places[1],
                    now_ms=T0 + HOUR, sleep=lambda s: None).collect()
    got = {r["group_name"]: r for r in out}
    assert got["scheduled_sync"]["sync_status"] == "Success"
    assert got["sales"]["sync_status"] is None and got["sales"]["error"] == "OSError: storage went away"
    assert calls.count(A) == 1  # ended, and not tried again
    assert calls.count(B) == 3  # its own tries are its own
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_tags_stay_with_their_group(spark, places, monkeypatch):
    real, seen, both = snapshots.copy, {}, threading.Barrier(3, timeout=60)

    def copy(spark, a, b, table, *rest):
        both.wait()  # all three copies hold their tags
        seen[table] = set(spark.sparkContext.getJobTags())
        both.wait()
        return real(spark, a, b, table, *rest)

    monkeypatch.setattr(snapshots, "copy", copy)
    send(spark, places, [T0 + HOUR], T0 + HOUR, max_workers=3)
    assert seen[A] == seen[B] != seen[C] and {len(tags) for tags in seen.values()} == {1}
    assert not spark.sparkContext.getJobTags()


def test_tables_of_a_failed_group_are_not_begun(spark, places, monkeypatch):
    calls = []

    def copy(spark, a, b, table, *rest):
        calls.append(table)
        raise OSError("no")

    monkeypatch.setattr(snapshots, "copy", copy)
    send(spark, places, [T0 + HOUR], T0 + HOUR, max_workers=1)
    assert len(calls) == 2 and len({A, B} & set(calls)) == 1


def test_largest_group_and_table_first(spark):
    plan = spark.createDataFrame(
        [("w", "small", 0, "a", 1), ("w", "big", 0, "b", 1), ("w", "big", 1, "c", 2), ("w", "none", 0, "d", 0)],
        "workspace_name string, group_name string, position int, table_name string, version bigint")
    commits = spark.createDataFrame(
        [("a", 1, {"numOutputBytes": "50"}), ("b", 1, {"sourceTableSize": "40"}), ("c", 2, {"numOutputBytes": "60"}),
         ("c", 1, {"numOutputBytes": "999"}), ("d", 0, {"numOutputBytes": "x"})],
        "table_name string, version bigint, operation_metrics map<string,string>")
    assert [r["table_name"] for r in sync._largest_first(plan, commits).collect()] == ["c", "b", "a", "d"]
