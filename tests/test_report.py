import json

import pytest
from pyspark.sql import functions as F

from lockstep.functions.metrics import encode_metrics, flatten_metrics
from lockstep.model import STATE
from lockstep.plans import report
from tests.test_plan import group

NOW = 1_704_067_200_000


def source(*tables):
    return json.dumps([
        {t: {"metrics": {"sync_commit_timestamp": NOW, "sync_commit_version": v, "source_table_size": s}}}
        for t, v, s in tables])


def target(*tables):
    return json.dumps([
        {t: {"metrics": {"sync_commit_version": str(v), "source_table_size": s}}} for t, v, s in tables])


def build(spark, *groups, now=NOW, zone="UTC"):
    return report.build(spark.createDataFrame(list(groups), STATE), now, zone).collect()


@pytest.mark.parametrize(
    "src, dst, workflow, status",
    [
        (("a", 1, 9), ("a", 1, 9), "wf", "Synced"),
        (("a", 1, 9), ("a", 2, 9), "wf", "Not Synced"),
        (("a", 1, 9), ("a", 1, 8), "wf", "Not Synced"),
        (("a", 1, 9), ("b", 1, 9), "wf", "Not Synced"),
        (("a", 1, 9), ("a", 2, 9), "", "Synced"),
        (("a", 1, 9), ("a", 2, 9), None, "Synced"),
        (("a", 1, 9), ("a", 1, 8), "", "Not Synced"),
    ],
)
def test_status(spark, src, dst, workflow, status):
    rows = build(spark, group("g", ("a",), workflow_name=workflow,
                              source_operation_metrics=source(src), target_operation_metrics=target(dst)))
    assert [r["sync_status"] for r in rows] == [status]


def test_missing_target_is_not_synced(spark):
    (row,) = build(spark, group("g", ("a",), source_operation_metrics=source(("a", 1, 9))))
    assert row["sync_status"] == "Not Synced" and row["target_table_size"] is None


def test_group_never_copied_does_not_appear(spark):
    assert build(spark, group("g", ("a",))) == []


def test_table_in_two_groups_gives_one_row_each(spark):
    groups = [group(n, ("a",), source_operation_metrics=source(("a", v, 9)),
                    target_operation_metrics=target(("a", v, 9))) for n, v in (("g", 1), ("h", 2))]
    rows = build(spark, *groups)
    assert sorted((r["group_name"], r["source_sync_commit_version"], r["sync_status"]) for r in rows) == [
        ("g", 1, "Synced"), ("h", 2, "Synced")]


@pytest.mark.parametrize("seconds, hours", [(0, 0.0), (18, 0.01), (17, 0.0), (5400, 1.5), (3600 * 48 + 6 * 3, 48.01)])
def test_hours_round_half_up(spark, seconds, hours):
    g = group("g", ("a",), last=NOW - seconds * 1000, source_operation_metrics=source(("a", 1, 9)))
    assert build(spark, g)[0]["hours_since_last_sync"] == hours


def test_display_zone(spark):
    g = group("g", ("a",), last=NOW, source_operation_metrics=source(("a", 1, 9)))
    (row,) = build(spark, g, zone="America/Chicago")
    assert str(row["last_successful_run_time"]) == "2023-12-31 18:00:00"


def test_columns_in_order(spark):
    assert report.build(spark.createDataFrame([], STATE), NOW).columns == [
        "workspace_name", "group_name", "workflow_name", "table_name", "last_successful_run_time",
        "sync_reason", "sync_time_to_region", "sync_time_in_region", "source_sync_commit_version",
        "source_table_size", "target_sync_commit_version", "target_table_size",
        "hours_since_last_sync", "sync_status"]


def test_metrics_text_round_trip(spark):
    copies = spark.createDataFrame(
        [("w", "g", 1, "c.s.b", None, None, 7), ("w", "g", 0, "c.s.a", NOW, 3, 9)],
        "workspace_name string, group_name string, position int, table_name string, "
        "sync_commit_timestamp bigint, sync_commit_version bigint, source_table_size bigint",
    )
    values = ["sync_commit_timestamp", "sync_commit_version", "source_table_size"]
    encoded = encode_metrics(copies, "source_operation_metrics", values)
    assert json.loads(encoded.first()["source_operation_metrics"]) == [
        {"c.s.a": {"metrics": {"sync_commit_timestamp": NOW, "sync_commit_version": 3, "source_table_size": 9}}},
        {"c.s.b": {"metrics": {"source_table_size": 7}}},
    ]
    flat = {r["table_name"]: tuple(r)[3:] for r in flatten_metrics(encoded, "source_operation_metrics").collect()}
    assert flat == {"c.s.a": (NOW, 3, 9), "c.s.b": (None, None, 7)}


def test_text_and_number_versions_both_parse(spark):
    texts = spark.createDataFrame(
        [("w", "g", source(("a", 4, 1))), ("w", "h", target(("a", 4, 1))), ("w", "i", None)],
        "workspace_name string, group_name string, m string")
    assert [r["sync_commit_version"] for r in flatten_metrics(texts, "m").collect()] == [4, 4]


def test_table_name_with_quotes(spark):
    g = group("g", ("a'b",), source_operation_metrics=source(("a'b", 1, 9)),
              target_operation_metrics=target(("a'b", 1, 9)))
    assert build(spark, g)[0]["sync_status"] == "Synced"
