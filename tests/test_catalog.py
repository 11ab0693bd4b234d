import os

import pytest
from pyspark.sql import functions as F

from lockstep.sources import catalog, changesets, snapshots
from lockstep.sources.paths import version_dir

A, B, C, D = (f"lake.sales.{x}" for x in "abcd")


def rows(spark, n, files=3):
    return spark.range(n).withColumn("v", F.col("id") * 2).repartition(files)


def data_files(root, table, version):
    where = version_dir(root, table, version)
    return sorted(f"{where}/{x}" for x in os.listdir(where) if x.endswith(".parquet"))


def overwrite(path, content=b"not parquet at all"):
    with open(path, "wb") as f:
        f.write(content)
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(crc):
        os.unlink(crc)


def bad(df):
    return {r["table_name"]: r["reason"] for r in df.collect()}


@pytest.mark.parametrize("at_once", [2, 50])
def test_unreadable_tables_come_out_as_rows(spark, root, monkeypatch, at_once):
    monkeypatch.setattr(catalog, "PROBED_AT_ONCE", at_once)
    names = [f"lake.sales.t{i}" for i in range(7)]
    for i, name in enumerate(names):
        snapshots.publish(rows(spark, 10 * i), root, name)  # the first has no rows
    assert bad(catalog.unreadable(spark, root)) == {}
    overwrite(data_files(root, names[3], 0)[0])
    os.unlink(data_files(root, names[5], 0)[0])
    snapshots.commit(spark, root, [snapshots.commit_row(D, 4, 5, "WRITE")])  # nothing was written
    found = bad(catalog.unreadable(spark, root))
    assert set(found) == {names[3], names[5], D}
    assert "not a Parquet file" in found[names[3]] and "50 committed" in found[names[5]] and "missing" in found[D]
    assert {r[0] for r in catalog.listing_of_root(spark, root).collect()} == {*names, D}


def test_only_the_latest_version_counts(spark, root):
    snapshots.publish(rows(spark, 10), root, A)
    overwrite(data_files(root, A, 0)[0])
    snapshots.publish(rows(spark, 12), root, A)
    assert bad(catalog.unreadable(spark, root)) == {}


def test_a_foreign_file_and_partitions(spark, root):
    snapshots.publish(rows(spark, 10).withColumn("p", F.col("id") % 2), root, A, partition_by=["p"])
    snapshots.publish(rows(spark, 10), root, B)
    assert bad(catalog.unreadable(spark, root)) == {}
    overwrite(f"{version_dir(root, B, 0)}/part-late.parquet")
    assert set(bad(catalog.unreadable(spark, root))) == {B}


def test_versions_that_a_change_set_builds_on(spark, root):
    src, stage = f"{root}/src", f"{root}/stage"
    for changed in (0, 1, 2):
        df = rows(spark, 100).withColumn("v", F.when(F.col("id") < changed, -1).otherwise(F.col("v")))
        snapshots.publish(df, src, A)
        changesets.stage_table(spark, src, stage, A, ["id"])
    assert bad(catalog.unreadable(spark, stage)) == {}
    overwrite(data_files(stage, A, 0)[0])
    assert bad(catalog.unreadable(spark, stage))[A].startswith("0: ")


def test_a_root_without_commits(spark, root):
    assert bad(catalog.unreadable(spark, root)) == {}


def test_session_tables(spark, root):
    spark.sql("CREATE SCHEMA IF NOT EXISTS probed")
    for name in ("good", "damaged", "gone"):
        rows(spark, 10, 1).write.parquet(f"{root}/{name}")
        spark.sql(f"CREATE OR REPLACE VIEW probed.{name} AS SELECT * FROM parquet.`{root}/{name}`")
    listed = catalog.listing(spark, ["probed"], "lake")
    assert bad(catalog.unreadable_in_session(spark, listed)) == {}
    for file in os.listdir(f"{root}/damaged"):
        if file.endswith(".parquet"):
            overwrite(f"{root}/damaged/{file}")
    spark.sql("DROP VIEW probed.gone")
    assert set(bad(catalog.unreadable_in_session(spark, listed))) == {"lake.probed.damaged", "lake.probed.gone"}
