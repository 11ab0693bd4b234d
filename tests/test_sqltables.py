"""Releases, versions and the control table as SQL text sees them."""

import pytest
from pyspark.sql import functions as F

from lockstep.model import RECEIVED, STATE
from lockstep.sources import changesets, releases, snapshots, sqltables, state
from tests.test_pruning import plan_of

ONE, TWO = "lake.sql.one", "lake.sql.two"


def write(spark, root, n, tables=(ONE, TWO), **more):
    """One more version with n rows of each table; made known to SQL."""
    for table in tables:
        df = spark.range(n).select("id", F.format_string("%03d", F.col("id") % 2).alias("p"))
        version = snapshots.publish(df, root, table, partition_by=["p"] if table == TWO else None, **more)
        sqltables.add_version(spark, root, table, version, snapshots.layout_of(spark, root, table, version))
    return version


def release(spark, root, version, ms, group="g"):
    releases.append(spark, {("w", group): [(ONE, version), (TWO, version)]}, root, ms)


def counts(spark):
    text = "SELECT (SELECT count(*) FROM lake__sql.one) AS a, (SELECT count(*) FROM lake__sql.two WHERE p LIKE '00_') AS b"
    return tuple(spark.sql(text).first())


def test_one_release_row_switches_all_views(spark, root):
    release(spark, root, write(spark, root, 4), 1)
    release(spark, root, 0, 99, group="other")
    views = sqltables.register_group(spark, root, "w", "g")
    assert views == {ONE: "lake__sql.one", TWO: "lake__sql.two"}
    assert counts(spark) == (4, 4)
    version = write(spark, root, 10)
    assert counts(spark) == (4, 4)
    release(spark, root, version, 2)
    assert counts(spark) == (10, 10)
    release(spark, root, 0, 3)  # a release may go back
    assert counts(spark) == (4, 4)
    scan = plan_of(spark.table("lake__sql.two"))
    assert "Subquery" in scan.split("PartitionFilters: ")[1].split("\n")[0]
    assert len(spark.table("lake__sql.two").filter("p = '001'").collect()) == 2


def test_other_columns_and_another_root(spark, root):
    release(spark, root, write(spark, root, 4), 1)
    sqltables.register_group(spark, root, "w", "g")
    wider = spark.range(3).select("id", F.lit("000").alias("p"), F.lit(1.5).alias("x"))
    for table in (ONE, TWO):
        snapshots.publish(wider, root, table)
    release(spark, root, 1, 2)
    sqltables.register_group(spark, root, "w", "g")
    assert spark.table("lake__sql.one").columns == ["id", "p", "x"] and counts(spark) == (3, 3)
    elsewhere = f"{root}/elsewhere"
    release(spark, elsewhere, write(spark, elsewhere, 7), 1)
    sqltables.register_group(spark, elsewhere, "w", "g")
    assert counts(spark) == (7, 7)


def test_change_sets_and_a_clashing_column_are_refused(spark, root):
    with pytest.raises(ValueError, match="clash"):
        sqltables.add_version(spark, root, ONE, 0, {"schema": spark.range(1).select(F.col("id").alias("_version")).schema.jsonValue()})
    src, stage = f"{root}/src", f"{root}/stage"
    for n in (40, 41):
        snapshots.publish(spark.range(n), src, ONE)
        changesets.stage_table(spark, src, stage, ONE, ["id"])
    with pytest.raises(ValueError, match="change set"):
        sqltables.add_version(spark, stage, ONE, 1, snapshots.layout_of(spark, stage, ONE, 1))


@pytest.mark.parametrize("table", [ONE, TWO])
def test_tables_at_versions_and_times(spark, root, table):
    for n in (1, 2, 3):
        write(spark, root, n, (table,), at_ms=86_400_000 * n + 5)
    at, as_of = sqltables.register_time_travel(spark, root, table)
    ask = lambda text: spark.sql(f"SELECT count(*) FROM {text}").first()[0]
    assert [ask(f"{at}({v})") for v in (0, 1, 2, 7)] == [1, 2, 3, 0]
    days = [86_400_000 * n + 5 for n in (1, 2, 3)]
    assert [ask(f"{as_of}({ms})") for ms in (days[0] - 1, days[0], days[1] - 1, days[1], 10**14)] == [0, 1, 1, 2, 3]
    scan = plan_of(spark.sql(f"SELECT * FROM {at}(1)")).split("PartitionFilters: ")
    assert any("= 1)" in part.split("\n")[0] for part in scan[1:])
    snapshots.write_version(spark.range(5).select("id", F.lit("000").alias("p")), root, table, 9, ["p"] if table == TWO else None)
    sqltables.add_version(spark, root, table, 9, snapshots.layout_of(spark, root, table, 2))
    assert ask(f"{at}(9)") == 0  # written, not committed


def test_state_is_read_live(spark, root):
    row = {f.name: None for f in STATE} | {"workspace_name": "w", "group_name": "it's", "tables": ["t"], "validated": True}
    assert sqltables.register_state(spark, root) == ("sync__meta.state", "sync__meta__group_state")
    assert spark.sql("SELECT * FROM sync__meta.state").count() == 0
    state.save(spark.createDataFrame([tuple(row.values()), tuple((row | {"group_name": "h"}).values())], STATE), root)
    state.record(spark.createDataFrame([("w", "h", 7)], "workspace_name string, group_name string, sync_time_in_region bigint"), root, "receiver")
    got = spark.sql("SELECT * FROM sync__meta.state")
    assert sorted(map(str, got.collect())) == sorted(map(str, state.load(spark, root).collect()))
    assert got.columns == STATE.names and set(RECEIVED) <= set(got.columns)
    one = spark.sql(r"SELECT sync_time_in_region, tables FROM sync__meta__group_state('w', 'it\'s')").collect()
    assert [tuple(r) for r in one] == [(None, ["t"])]
    changed = spark.createDataFrame([tuple((row | {"group_name": "h", "workflow_name": "new"}).values())], STATE)
    state.save(changed, root)
    assert [r.sync_time_in_region for r in spark.sql("SELECT * FROM sync__meta.state").collect()] == [None]
