import random

import pytest

from lockstep.model import STATE
from lockstep.plans import decide, deliver
from tests.test_history import T0, log

NOW = T0 + 100_000_000
MIN = 60_000


def group(name="g", tables=("c.s.a",), workflow="1", validated=True, last=T0, status="Success", **kw):
    row = dict.fromkeys(STATE.names)
    row.update(
        workspace_name="w", group_name=name, workflow_id=workflow, workflow_name=workflow and "wf",
        tables=list(tables), validated=validated, last_successful_run_time=last, sync_status=status,
    )
    row.update(kw)
    return tuple(row[n] for n in STATE.names)


def decisions(spark, groups, commits, runs=(), interval=10, failover=10, now=NOW):
    spaces = spark.createDataFrame(
        [("w", interval, failover, "3")],
        "workspace_name string, sync_interval_mins int, sync_failover_interval_mins int, sync_max_retries string",
    )
    run_log = spark.createDataFrame(
        [(j, 0, e, r) for j, e, r in runs],
        "job_id string, start_time_ms bigint, end_time_ms bigint, result_state string",
    )
    state = spark.createDataFrame(groups, STATE)
    return decide.decide(state, spaces, log(spark, commits), run_log, now)


def one(spark, g, commits, runs=(), **kw):
    row = decisions(spark, [g], commits, runs, **kw).first()
    return row["decision"], row["cutoff_ms"]


NEW = [("c.s.a", 1, T0 + 1)]


def test_no_new_commits(spark):
    assert one(spark, group(), [("c.s.a", 0, T0)]) == ("skip:no_new_commits", None)


def test_first_sync_needs_no_commits_check(spark):
    assert one(spark, group(last=None, status=None), [], [("1", T0 + 5, "SUCCESS")]) == (
        "workflow_time", T0 + 5)
    assert one(spark, group(status=None), [("c.s.a", 0, T0)], [("1", T0 + 5, "SUCCESS")])[0] == "workflow_time"


def test_empty_table_list_never_triggers(spark):
    assert one(spark, group(tables=(), last=None, workflow=""), NEW)[0] == "skip:no_new_commits"


def test_not_validated(spark):
    assert one(spark, group(validated=False), NEW)[0] == "skip:not_validated"


def test_scheduled_group_does_not_need_validation(spark):
    assert one(spark, group(validated=False, workflow=""), NEW)[0] == "schedule_time"


def test_workflow_time_uses_run_end(spark):
    assert one(spark, group(), NEW, [("1", T0 + 7, "SUCCESS")]) == ("workflow_time", T0 + 7)


def test_first_sync_without_successful_run(spark):
    assert one(spark, group(last=None), NEW, [("1", T0 + 7, "FAILED")])[0] == "skip:no_successful_run"


def test_failover_threshold_is_strict(spark):
    assert one(spark, group(), NEW, now=T0 + 10 * MIN + 1) == ("threshold_time", T0 + 10 * MIN + 1)
    assert one(spark, group(), NEW, now=T0 + 10 * MIN)[0] == "skip:waiting_for_workflow"


def test_interval_is_strict_and_its_own_setting(spark):
    g = group(workflow="")
    assert one(spark, g, NEW, now=T0 + 20 * MIN + 1, interval=20, failover=1) == (
        "schedule_time", T0 + 20 * MIN + 1)
    assert one(spark, g, NEW, now=T0 + 20 * MIN, interval=20, failover=1)[0] == "skip:interval_not_met"


def test_first_scheduled_sync(spark):
    assert one(spark, group(workflow=None, last=None), NEW) == ("schedule_time", NOW)


def test_long_interval_does_not_overflow(spark):
    assert one(spark, group(workflow=""), NEW, interval=100_000)[0] == "skip:interval_not_met"


def plan(spark, groups, commits, runs=(), on_missing="block"):
    found = decisions(spark, groups, commits, runs)
    rows = decide.build(found, log(spark, commits), on_missing).collect()
    return {(r["group_name"], r["table_name"]): (r["decision"], r["version"]) for r in rows}


def test_all_tables_of_a_triggered_group_are_copied(spark):
    commits = [("c.s.a", 4, T0 + 1), ("c.s.b", 2, T0 - 9)]
    got = plan(spark, [group(tables=("c.s.a", "c.s.b"))], commits, [("1", T0 + 7, "SUCCESS")])
    assert got == {("g", "c.s.a"): ("workflow_time", 4), ("g", "c.s.b"): ("workflow_time", 2)}


def test_missing_version_blocks_only_its_group(spark):
    groups = [group("g", ("c.s.a", "c.s.gone")), group("h", ("c.s.a",))]
    got = plan(spark, groups, NEW, [("1", T0 + 7, "SUCCESS")])
    assert got[("g", "c.s.a")] == ("skip:no_version", 1)
    assert got[("h", "c.s.a")] == ("workflow_time", 1)
    got = plan(spark, groups, NEW, [("1", T0 + 7, "SUCCESS")], on_missing="skip")
    assert set(got) == {("g", "c.s.a"), ("h", "c.s.a")}
    assert got[("g", "c.s.a")] == ("workflow_time", 1)


def expected_decision(g, commits, runs, interval, failover, now):
    g = dict(zip(STATE.names, g))
    last, first = g["last_successful_run_time"], None in (g["last_successful_run_time"], g["sync_status"])
    new = last is not None and any(t in g["tables"] and ms > last for t, _, ms in commits)
    if not g["tables"] or not (first or new):
        return "skip:no_new_commits", None
    if g["workflow_id"]:
        if not g["validated"]:
            return "skip:not_validated", None
        ends = [e for j, e, r in runs if j == g["workflow_id"] and r == "SUCCESS" and (last is None or e > last)]
        if ends:
            return "workflow_time", max(ends)
        if last is None:
            return "skip:no_successful_run", None
        return ("threshold_time", now) if now - last > failover * MIN else ("skip:waiting_for_workflow", None)
    if last is None or now - last > interval * MIN:
        return "schedule_time", now
    return "skip:interval_not_met", None


def test_decisions_match_brute_force(spark):
    rng = random.Random(11)
    pick = rng.choice
    commits = [(f"c.s.t{rng.randrange(30)}", i, T0 + rng.randrange(100) * MIN) for i in range(150)]
    runs = [(str(rng.randrange(8)), T0 + rng.randrange(100) * MIN, pick(["SUCCESS", "FAILED"])) for _ in range(20)]
    groups = [
        group(
            f"g{i}",
            tables=[f"c.s.t{rng.randrange(32)}" for _ in range(rng.randrange(4))],
            workflow=pick(["", None, str(rng.randrange(10))]),
            validated=pick([True, True, False]),
            last=pick([None, T0 + rng.randrange(100) * MIN]),
            status=pick([None, "Success", "In Progress"]),
        )
        for i in range(300)
    ]
    now = T0 + 100 * MIN
    got = {r["group_name"]: (r["decision"], r["cutoff_ms"])
           for r in decisions(spark, groups, commits, runs, 40, 25, now).collect()}
    want = {g[1]: expected_decision(g, commits, runs, 40, 25, now) for g in groups}
    assert got == want
    assert len({d for d, _ in want.values()}) == 8


def delivery(spark, groups, commits):
    rows = deliver.plan(spark.createDataFrame(groups, STATE), log(spark, commits)).collect()
    return {(r["group_name"], r["table_name"]): (r["decision"], r["version"], r["source_version"]) for r in rows}


CLONED = [("c.s.a", 0, T0, "CLONE", {"sourceVersion": "5"}), ("c.s.a", 1, T0 + 9, "CLONE", {"sourceVersion": "6"})]


@pytest.mark.parametrize(
    "to, arrived, pending",
    [(None, None, False), (5, None, True), (5, 5, True), (6, 5, True), (5, 6, False)],
)
def test_pending(spark, to, arrived, pending):
    g = group(sync_time_to_region=to, sync_time_in_region=arrived)
    assert deliver.pending(spark.createDataFrame([g], STATE)).count() == int(pending)


def test_delivery_takes_the_copy_staged_by_then(spark):
    assert delivery(spark, [group(sync_time_to_region=T0 + 8)], CLONED) == {("g", "c.s.a"): ("deliver", 0, 5)}


def test_one_table_without_copy_blocks_the_group(spark):
    got = delivery(spark, [group(tables=("c.s.a", "c.s.b"), sync_time_to_region=T0 + 8)],
                   CLONED + [("c.s.b", 0, T0, "WRITE", {})])
    assert {d for d, _, _ in got.values()} == {"skip:no_version"}
