import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lockstep.functions.names import qualify, split_name
from lockstep.model import COMMITS
from lockstep.operators import history, runs
from lockstep.operators.skew import hot_keys, list_size

T0 = 1_704_067_200_000


def at(ms):
    return datetime.fromtimestamp(ms / 1000, tz=timezone.utc)


def log(spark, rows):
    """rows of (table, version, ms[, operation[, parameters]])"""
    full = [(r[0], r[1], at(r[2]), *(list(r[3:]) + ["WRITE", {}][len(r) - 3 :]), {}) for r in rows]
    return spark.createDataFrame(full, COMMITS)


def targets(spark, rows):
    return spark.createDataFrame(rows, "table_name string, cutoff_ms bigint")


def as_of(spark, rows, asked, **kw):
    found = history.as_of(targets(spark, asked), log(spark, rows), **kw).collect()
    return {(r["table_name"], r["cutoff_ms"]): r["version"] for r in found}


def test_cutoff_before_first_commit_gives_null(spark):
    assert as_of(spark, [("a", 0, T0)], [("a", T0 - 1), ("b", T0)]) == {
        ("a", T0 - 1): None,
        ("b", T0): None,
    }


def test_equal_times_resolve_to_greatest_version(spark):
    assert as_of(spark, [("a", 3, T0), ("a", 7, T0), ("a", 5, T0)], [("a", T0)])[("a", T0)] == 7


def test_cutoff_keeps_its_milliseconds(spark):
    rows = [("a", 0, T0 + 400), ("a", 1, T0 + 901)]
    assert as_of(spark, rows, [("a", T0 + 900)])[("a", T0 + 900)] == 0


def test_repeated_hour_is_not_shifted(spark):
    """01:30 happens twice on this night in Chicago; the instant decides, not the wall clock."""
    spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
    try:
        first = 1_730_615_400_000  # 2024-11-03 01:30 CDT
        rows = [("a", 0, first), ("a", 1, first + 3_600_000)]
        assert as_of(spark, rows, [("a", first + 1000)])[("a", first + 1000)] == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_operation_filter_and_extras(spark):
    rows = [("a", 0, T0, "CLONE", {"sourceVersion": "41"}), ("a", 1, T0 + 5, "WRITE", {})]
    extras = {"sv": F.col("operation_parameters")["sourceVersion"].try_cast("bigint")}
    row = history.as_of(
        targets(spark, [("a", T0 + 9)]), log(spark, rows), operation="CLONE", extras=extras
    ).first()
    assert (row["version"], row["commit_ms"], row["sv"]) == (0, T0, 41)


# broadcast; joined by table, plain and sliced; sorted together
WAYS = [(16, 500_000, 1), (16, 0, 4_000_000), (16, 0, 20), (0, 0, 4_000_000)]


@pytest.mark.parametrize("max_cutoffs, broadcast_rows, slice_rows", WAYS)
def test_as_of_matches_brute_force(spark, monkeypatch, max_cutoffs, broadcast_rows, slice_rows):
    """Random histories, one table with a third of all commits, by every way of joining."""
    monkeypatch.setattr(history, "MAX_CUTOFFS", max_cutoffs)
    rng = random.Random(5)
    rows, version = [], 0
    for _ in range(900):
        table = "hot" if rng.random() < 0.34 else f"t{rng.randrange(40)}"
        rows.append((table, version, T0 + rng.randrange(200)))
        version += 1
    names = ["hot", "none"] + [f"t{i}" for i in range(40)]
    asked = [(n, T0 + c) for n in names for c in {rng.randrange(-5, 210) for _ in range(4)}]
    expected = {}
    for name, cutoff in asked:
        known = [(ms, v) for t, v, ms in rows if t == name and ms <= cutoff]
        expected[(name, cutoff)] = max(known)[1] if known else None
    got = as_of(spark, rows, asked, broadcast_rows=broadcast_rows, slice_rows=slice_rows)
    assert got == expected


@pytest.mark.parametrize("max_cutoffs", [16, 0])
def test_as_of_extras_belong_to_the_chosen_commit(spark, monkeypatch, max_cutoffs):
    monkeypatch.setattr(history, "MAX_CUTOFFS", max_cutoffs)
    rows = [("a", v, T0 + v * 400_000, "CLONE", {"sourceVersion": str(900 - v)}) for v in range(9)]
    extras = {"sv": F.col("operation_parameters")["sourceVersion"].try_cast("bigint")}
    asked = [("a", T0 + v * 400_000 + 5) for v in range(9)]
    got = history.as_of(targets(spark, asked), log(spark, rows), extras=extras)
    assert sorted((r["version"], r["sv"]) for r in got.collect()) == [(v, 900 - v) for v in range(9)]


def test_many_cutoffs_of_one_table(spark):
    rows = [("hot", i, T0 + i * 60_000) for i in range(40)]
    asked = [("hot", T0 + i * 60_000) for i in range(40)]
    assert list_size(targets(spark, asked), "table_name", "cutoff_ms")[::2] == (40, 40)
    assert as_of(spark, rows, asked) == {("hot", T0 + i * 60_000): i for i in range(40)}


def test_as_of_keeps_all_target_rows(spark):
    asked = [("a", T0), ("a", T0), ("b", T0)]
    assert history.as_of(targets(spark, asked), log(spark, [("a", 0, T0)])).count() == 3


def test_hot_keys_are_those_above_the_slice(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"))
    assert [tuple(r) for r in hot_keys(df, ["k"], slice_rows=100).collect()] == [(0, 4)]


def test_as_of_time_agrees_with_as_of(spark):
    rows = [("a", i, T0 + i * 7 % 50) for i in range(50)] + [("b", 1, T0 + 99)]
    found = {r["table_name"]: r["version"] for r in history.as_of_time(log(spark, rows), T0 + 20).collect()}
    assert found == {"a": as_of(spark, rows, [("a", T0 + 20)])[("a", T0 + 20)]}


def new_commits(spark, last, commits, tables=("a", "b")):
    groups = spark.createDataFrame(
        [("w", "g", list(tables), last)],
        "workspace_name string, group_name string, tables array<string>, last_ms bigint",
    )
    return history.has_new_commits(groups, log(spark, commits)).first()["has_new"]


def test_commit_at_the_watermark_is_not_new(spark):
    assert new_commits(spark, T0, [("a", 0, T0)]) is False
    assert new_commits(spark, T0, [("a", 0, T0 + 1)]) is True


def test_one_changed_table_is_enough(spark):
    assert new_commits(spark, T0, [("a", 0, T0 - 5), ("b", 0, T0 + 5)]) is True


def test_empty_history_and_empty_table_list_are_not_new(spark):
    assert new_commits(spark, T0, []) is False
    assert new_commits(spark, T0, [("a", 0, T0 + 1)], tables=()) is False


def test_qualify_splits_names_and_rejects_others(spark):
    df = spark.createDataFrame([("c.s.t",)], "table_name string")
    row = qualify(df, location="loc").first()
    assert (row["catalog"], row["schema"], row["table"], row["path"]) == ("c", "s", "t", "loc/c/s/t")
    for bad in ("s.t", "a.b.c.d", "a..c", None):
        with pytest.raises(Exception, match="catalog.schema.table"):
            qualify(spark.createDataFrame([(bad,)], "table_name string")).collect()
    with pytest.raises(ValueError):
        split_name("s.t")


def test_latest_success(spark):
    run_log = spark.createDataFrame(
        [("1", 0, T0 + 5, "SUCCESS"), ("1", 0, T0 + 9, "FAILED"), ("1", 0, T0 + 2, "SUCCESS"),
         ("2", 0, T0 + 1, "FAILED")],
        "job_id string, start_time_ms bigint, end_time_ms bigint, result_state string",
    )
    marks = spark.createDataFrame(
        [("1", None), ("1", T0 + 4), ("1", T0 + 5), ("2", None), ("3", None)],
        "job_id string, last_ms bigint",
    )
    found = {(r["job_id"], r["last_ms"]): r["run_end_ms"] for r in runs.latest_success(marks, run_log).collect()}
    assert found == {
        ("1", None): T0 + 5,
        ("1", T0 + 4): T0 + 5,
        ("1", T0 + 5): None,
        ("2", None): None,
        ("3", None): None,
    }


def test_run_started_before_the_watermark_counts(spark):
    """Only the end of a run is compared with the watermark."""
    run_log = spark.createDataFrame(
        [("1", T0 - 100, T0 + 100, "SUCCESS")],
        "job_id string, start_time_ms bigint, end_time_ms bigint, result_state string",
    )
    marks = spark.createDataFrame([("1", T0)], "job_id string, last_ms bigint")
    assert runs.latest_success(marks, run_log).first()["run_end_ms"] == T0 + 100


def test_first_listed_job_wins(spark):
    jobs = spark.createDataFrame(
        [("9", "wf", 2), ("7", "wf", 1), ("5", "other", 0)],
        "job_id string, name string, listing_pos bigint",
    )
    groups = spark.createDataFrame([("g1", "wf"), ("g2", "gone")], "group_name string, workflow string")
    found = {r["group_name"]: r["workflow_id"] for r in runs.resolve_workflows(groups, jobs).collect()}
    assert found == {"g1": "7", "g2": None}
