import json

import pytest
from pyspark.sql import functions as F

from lockstep.model import RUN_STATE, STATE
from lockstep.operators.merge import DuplicateKeyError
from lockstep.plans import validate
from lockstep.sources import catalog, config, state
from tests.test_plan import group

SPACE = dict(
    workspace_name="w", workspace_instance_url="host", workspace_pat_key="key",
    sync_location_primary="p", sync_location_secondary="s",
    sync_interval_mins=15, sync_failover_interval_mins=10, sync_max_retries="4",
)


def group_json(name="g", **kw):
    return {"group_name": name, "workflow": "wf", "tables": ["c.s.a", "c.s.b"], **kw}


def load(spark, root, *groups, scope="scope", **space):
    document = {"secret_scope": scope, "workspaces": [{**SPACE, **space, "sync_groups": list(groups)}]}
    path = f"{root}/config.json"
    with open(path, "w") as f:
        json.dump(document, f, indent=1)
    return config.load(spark, path)


def rules(workspaces, groups):
    return sorted((r["entity"], r["rule"]) for r in validate.violations(workspaces, groups).collect())


def test_complete_config_has_no_violation(spark, root):
    workspaces, groups = load(spark, root, group_json(), group_json("scheduled_sync", workflow=None))
    assert rules(workspaces, groups) == []
    assert [(g["group_name"], g["workflow"], g["tables"]) for g in groups.collect()] == [
        ("g", "wf", ["c.s.a", "c.s.b"]),
        ("scheduled_sync", None, ["c.s.a", "c.s.b"]),
    ]
    assert config.workspace(workspaces, "w").count() == 1
    assert config.workspace(workspaces, "x").isEmpty()


def test_line_delimited_documents(spark, root):
    with open(f"{root}/lines.json", "w") as f:
        for name in ("a", "b"):
            space = {**SPACE, "workspace_name": name, "sync_groups": [group_json()]}
            f.write(json.dumps({"secret_scope": "x", "workspaces": [space]}) + "\n")
    workspaces, groups = config.load(spark, f"{root}/lines.json", multi_line=False)
    assert workspaces.count() == groups.count() == 2


def test_duplicate_group_in_a_workspace(spark, root):
    assert rules(*load(spark, root, group_json(), group_json())) == [("g", "duplicate_group")]


def test_same_group_in_two_workspaces_is_allowed(spark, root):
    workspaces, groups = load(spark, root, group_json())
    both = groups.unionByName(groups.withColumn("workspace_name", F.lit("w2")))
    assert rules(workspaces, both) == []


@pytest.mark.parametrize("field", validate.REQUIRED)
@pytest.mark.parametrize("value", [None, ""])
def test_missing_required_field(spark, root, field, value):
    kw = {"scope": value} if field == "secret_scope" else {field: value}
    workspaces, groups = load(spark, root, group_json(), **kw)
    assert ("workspace", f"missing_{field}") in rules(workspaces, groups)


def test_workflow_group_without_tables_is_a_violation(spark, root):
    assert rules(*load(spark, root, group_json(tables=None))) == [("g", "missing_tables")]


def test_malformed_table_name_is_a_violation(spark, root):
    assert rules(*load(spark, root, group_json(tables=["c.s.a", "s.b"]))) == [("g", "malformed_table_name")]


@pytest.mark.parametrize("empty", [dict.fromkeys(["sync_interval_mins", "sync_failover_interval_mins", "sync_max_retries"]),
                                   {"sync_interval_mins": 0, "sync_failover_interval_mins": 0, "sync_max_retries": ""}])
def test_defaults(spark, root, empty):
    workspaces, _ = load(spark, root, **empty)
    row = validate.with_defaults(workspaces).first()
    assert (row["sync_interval_mins"], row["sync_failover_interval_mins"], row["sync_max_retries"]) == (720, 2160, "3")


def test_given_settings_stay(spark, root):
    row = validate.with_defaults(load(spark, root)[0]).first()
    assert (row["sync_interval_mins"], row["sync_failover_interval_mins"], row["sync_max_retries"]) == (15, 10, "4")


def test_valid_groups(spark, root):
    _, groups = load(
        spark, root,
        group_json("bare", workflow=None, tables=None),
        group_json("scheduled_sync", workflow=None, tables=None),
        group_json("", workflow="wf"),
        {"workflow": "wf"},
        group_json("tables_only", workflow=""),
    )
    kept = {r["group_name"] for r in validate.valid_groups(groups).collect()}
    assert kept == {"scheduled_sync", "Unnamed", "tables_only"}


def test_summary_counts_groups(spark, root):
    workspaces, groups = load(spark, root, group_json(), group_json("h"))
    row = validate.summary(workspaces, groups).first()
    assert tuple(row) == ("w", 2, 15, "4")
    assert validate.summary(workspaces, groups.limit(0)).first()["groups_validated"] == 0


def declared(spark, *rows):
    return spark.createDataFrame(
        [("w", *r) for r in rows],
        "workspace_name string, group_name string, workflow string, tables array<string>",
    )


def validated(spark, declarations, old=(), jobs=(("1", "wf", 0),), tables=("c.s.a",)):
    found = validate.validate(
        declared(spark, *declarations),
        spark.createDataFrame(list(old), STATE),
        spark.createDataFrame(list(jobs), "job_id string, name string, listing_pos bigint"),
        spark.createDataFrame([(t,) for t in tables], "table_name string"),
    )
    return {r["group_name"]: (r["workflow_id"], r["validated"]) for r in found.collect()}


def test_one_invalid_group_does_not_affect_others(spark):
    got = validated(spark, [("bad", "wf", ["c.s.gone"]), ("good", "wf", ["c.s.a"]), ("nojob", "xx", ["c.s.a"])])
    assert got == {"bad": ("1", False), "good": ("1", True), "nojob": (None, False)}


def test_scheduled_group_has_empty_workflow_id(spark):
    assert validated(spark, [("scheduled_sync", None, ["c.s.a"])]) == {"scheduled_sync": ("", True)}


def test_unchanged_validated_group_is_taken_over(spark):
    old = group("g", ("c.s.gone",), workflow="77")
    assert validated(spark, [("g", "wf", ["c.s.gone"])], [old]) == {"g": ("77", True)}
    assert validated(spark, [("g", "wf", ["c.s.gone", "c.s.a"])], [old]) == {"g": ("1", False)}
    assert validated(spark, [("g", "wf2", ["c.s.gone"])], [old]) == {"g": (None, False)}


def test_workflow_without_tables_is_invalid(spark):
    assert validated(spark, [("g", "wf", None)]) == {"g": ("1", False)}


def test_changed(spark):
    old = spark.createDataFrame(
        [group("same", ("a", "b")), group("order", ("b", "a")), group("none", workflow=None, workflow_name=None)], STATE
    )
    new = declared(spark, ("same", "wf", ["a", "b"]), ("order", "wf", ["a", "b"]), ("none", "", ["c.s.a"]))
    assert [r["group_name"] for r in validate.changed(old, new).collect()] == ["order"]


def test_missing_tables_and_listing(spark):
    spark.range(1).createOrReplaceTempView("probe_view")
    listed = catalog.listing(spark, ["default"], "lake")
    assert "lake.default.probe_view" in {r["table_name"] for r in listed.collect()}
    members = spark.createDataFrame([("lake.default.probe_view",), ("lake.x.y",)], "table_name string")
    assert [r["table_name"] for r in catalog.missing_tables(members, listed).collect()] == ["lake.x.y"]


FULL = dict(last=5, sync_reason="workflow_time", sync_time_to_region=6, sync_time_in_region=7,
            source_operation_metrics="[]", target_operation_metrics="[]")


def merged(spark, old, new, workspaces=("w",)):
    new = spark.createDataFrame(
        [("w", *r) for r in new],
        "workspace_name string, group_name string, workflow_name string, workflow_id string, "
        "tables array<string>, validated boolean",
    )
    spaces = spark.createDataFrame([(w,) for w in workspaces], "workspace_name string")
    result = state.merge_config(spark.createDataFrame(old, STATE), new, spaces)
    assert result.columns == STATE.names
    return {(r["workspace_name"], r["group_name"]): r for r in result.collect()}


@pytest.mark.parametrize(
    "new",
    [("g", "wf2", "9", ["c.s.a"], True), ("g", None, "9", ["c.s.a"], True),
     ("g", "wf", "9", ["c.s.b"], True), ("g", "wf", "9", ["c.s.a"], False)],
)
def test_changed_group_takes_declaration_and_loses_run_state(spark, new):
    row = merged(spark, [group(**FULL)], [new])[("w", "g")]
    assert (row["workflow_name"], row["workflow_id"], row["tables"], row["validated"]) == new[1:]
    assert all(row[c] is None for c in RUN_STATE)


def test_null_workflow_in_state_counts_as_changed(spark):
    row = merged(spark, [group(**FULL, workflow_name=None)], [("g", "wf", "9", ["c.s.a"], True)])[("w", "g")]
    assert row["workflow_name"] == "wf" and row["last_successful_run_time"] is None


def test_table_order_counts(spark):
    row = merged(spark, [group(tables=("a", "b"), **FULL)], [("g", "wf", "1", ["b", "a"], True)])[("w", "g")]
    assert row["tables"] == ["b", "a"] and row["sync_status"] is None


def test_equal_group_is_untouched(spark):
    row = merged(spark, [group(**FULL)], [("g", "wf", "other", ["c.s.a"], True)])[("w", "g")]
    assert tuple(row) == group(**FULL)


def test_insert_delete_and_foreign_workspace(spark):
    foreign = group("g", workspace_name="w2", **FULL)
    got = merged(spark, [group("gone"), foreign], [("new", "wf", "1", ["c.s.a"], True)])
    assert set(got) == {("w", "new"), ("w2", "g")}
    assert tuple(got[("w2", "g")]) == foreign


def test_nothing_declared_still_deletes(spark):
    assert merged(spark, [group("stale")], []) == {}


def test_patch_keeps_absent_and_null_fields(spark):
    old = spark.createDataFrame([group("a", **FULL), group("b", **FULL)], STATE)
    patches = spark.createDataFrame(
        [("w", "a", "In Progress", None)],
        "workspace_name string, group_name string, sync_status string, sync_time_to_region bigint",
    )
    got = {r["group_name"]: tuple(r) for r in state.patch(old, patches).collect()}
    assert got["b"] == group("b", **FULL)
    assert got["a"] == group("a", status="In Progress", **FULL)


def test_patching_a_group_twice_is_an_error(spark):
    old = spark.createDataFrame([group("a")], STATE)
    patches = spark.createDataFrame(
        [("w", "a", "x"), ("w", "a", "y")], "workspace_name string, group_name string, sync_status string"
    )
    with pytest.raises(DuplicateKeyError):
        state.patch(old, patches)


def test_state_table_round_trip(spark, root):
    assert state.load(spark, root).count() == 0
    state.save(spark.createDataFrame([group(**FULL)], STATE), root)
    assert [tuple(r) for r in state.load(spark, root).collect()] == [group(**FULL)]
    state.register_view(spark, root)
    assert spark.sql("select group_name from sync_state").first()[0] == "g"
