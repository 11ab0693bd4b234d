import pytest
from pyspark.sql import functions as F

from lockstep import scratch
from lockstep.model import GOLD
from lockstep.operators import reconcile
from lockstep.sources import paths, snapshots

NAME = "lake.raw.t"


def test_versions_and_times(spark, root):
    assert snapshots.publish(spark.range(3), root, NAME, at_ms=1000) == 0
    assert snapshots.publish(spark.range(5), root, NAME, at_ms=2000) == 1
    count = lambda **kw: snapshots.read(spark, root, NAME, **kw).count()
    assert (count(), count(version=0), count(as_of_ms=1999), count(as_of_ms=2000)) == (5, 3, 3, 5)
    for missing in ({"version": 7}, {"as_of_ms": 999}):
        with pytest.raises(LookupError):
            snapshots.read(spark, root, NAME, **missing)


def test_uncommitted_version_is_invisible_and_replaced(spark, root):
    snapshots.publish(spark.range(3), root, NAME)
    snapshots.write_version(spark.range(99), root, NAME, 1)
    assert snapshots.read(spark, root, NAME).count() == 3
    assert snapshots.publish(spark.range(4), root, NAME) == 1
    assert snapshots.read(spark, root, NAME).count() == 4


def test_rows_and_bytes_are_reported(spark, root):
    rows, nbytes, _ = snapshots.write_version(spark.range(1000), root, NAME, 0)
    assert rows == 1000
    assert nbytes == paths.size(spark, [paths.version_dir(root, NAME, 0)]) > 0


def test_ensure_creates_once(spark, root):
    assert snapshots.ensure(spark, root, NAME, GOLD) == snapshots.ensure(spark, root, NAME, GOLD) == 0
    assert snapshots.read(spark, root, NAME).schema.names == GOLD.names


def test_partitioned_table_keeps_its_columns(spark, root):
    df = spark.range(10).select("id", (F.col("id") % 2).cast("int").alias("p"))
    snapshots.publish(df, root, NAME, partition_by=["p"])
    assert sorted(map(tuple, snapshots.read(spark, root, NAME).select("id", "p").collect())) == [
        (i, i % 2) for i in range(10)]


def test_register_replaces_the_view(spark, root):
    for n in (3, 5):
        version = snapshots.publish(spark.range(n), root, "lake.probe.t")
        assert snapshots.register(spark, root, "lake.probe.t", version) == "lake__probe.t"
        assert spark.table("lake__probe.t").count() == n


def test_register_keeps_catalogs_apart_and_types(spark, root):
    for catalog, n in (("one", 2), ("two", 7)):
        df = spark.range(n).select("id", F.lpad(F.col("id").cast("string"), 3, "0").alias("p"))
        version = snapshots.publish(df, root, f"{catalog}.sd.t", partition_by=["p"])
        snapshots.register(spark, root, f"{catalog}.sd.t", version)
    assert (spark.table("one__sd.t").count(), spark.table("two__sd.t").count()) == (2, 7)
    assert {r.p for r in spark.table("one__sd.t").collect()} == {"000", "001"}
    with pytest.raises(ValueError, match="underscores"):
        snapshots.register(spark, root, "a__b.c.t", 0)


def files(path):
    import pathlib

    return {str(p.relative_to(path)) for p in pathlib.Path(path).rglob("*.parquet")}


def test_partition_values_keep_their_type_through_copies(spark, root):
    src, dst = f"{root}/src", f"{root}/dst"
    rows = [(1, "01", 5), (2, "007", None), (3, None, 6)]
    df = spark.createDataFrame(rows, "id int, p string, q int").select("p", "id", "q")
    snapshots.publish(df, src, NAME, partition_by=["p"])
    snapshots.clone(spark, src, dst, NAME)
    for root_ in (src, dst):
        got = snapshots.read(spark, root_, NAME)
        assert got.dtypes == df.dtypes
        assert sorted(map(tuple, got.collect()), key=str) == sorted(((p, i, q) for i, p, q in rows), key=str)
    assert {f.split("/")[0] for f in files(f"{dst}/lake/raw/t/v=0")} == {
        "p=01", "p=007", "p=__HIVE_DEFAULT_PARTITION__"}


def test_empty_text_can_not_be_a_partition(spark, root):
    df = spark.createDataFrame([(1, "")], "id int, p string")
    with pytest.raises(ValueError, match="empty text"):
        snapshots.publish(df, root, NAME, partition_by=["p"])
    assert snapshots.latest_version(spark, root, NAME) is None


def test_changed_only_clone_copies_what_changed(spark, root):
    src, dst = f"{root}/src", f"{root}/dst"
    clone = lambda: snapshots.clone(spark, src, dst, NAME, changed_only=True)
    nested = lambda n: spark.range(n).select(F.array("id").alias("only"))
    snapshots.publish(nested(5), src, NAME)
    assert (clone(), clone()) == (0, 0)
    snapshots.publish(nested(4), src, NAME)
    assert (clone(), clone()) == (1, 1)
    snapshots.publish(nested(4).withColumn("more", F.lit(1)), src, NAME)
    assert clone() == 2 and snapshots.read(spark, dst, NAME).columns == ["only", "more"]


def test_clone_commit_names_its_source_version(spark, root):
    src, dst = f"{root}/src", f"{root}/dst"
    snapshots.publish(spark.range(1), src, NAME)
    snapshots.publish(spark.range(2), src, NAME)
    snapshots.clone(spark, src, dst, NAME, version=0)
    row = snapshots.commits(spark, dst).first()
    assert (row["operation"], row["operation_parameters"]["sourceVersion"]) == ("CLONE", "0")
    assert snapshots.read(spark, dst, NAME).count() == 1


def test_scratch_uses_the_named_folder(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    first = scratch.new_dir(spark, "x")
    if named:
        assert first.startswith(named)
    assert first != scratch.new_dir(spark, "x")


def test_merge_publishes_a_version(spark, root):
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id bigint, v int")
    merge = lambda df: snapshots.merge(df, root, NAME, ["id"])
    content = lambda **kw: dict(map(tuple, snapshots.read(spark, root, NAME, **kw).collect()))
    assert merge(rows(range(100), 0)) == 0
    assert merge(rows([3, 200], 1)) == 1
    expected = {**{i: 0 for i in range(100)}, 3: 1, 200: 1}
    assert content() == expected
    assert content(version=0) == {i: 0 for i in range(100)}
    assert merge(rows([], 1)) == 2
    assert content() == expected


def test_merge_into_a_published_table_keeps_its_layout(spark, root):
    snapshots.publish(spark.range(50).withColumn("v", F.lit(0)), root, NAME, partition_by=["v"])
    for v in (1, 2):
        source = spark.range(45, 55).select(F.lit(v).alias("v"), F.col("id").cast("int").alias("id"))
        snapshots.merge(source, root, NAME, ["id"])
    got = snapshots.read(spark, root, NAME)
    assert dict(map(tuple, got.select("id", "v").collect())) == {
        **{i: 0 for i in range(45)}, **{i: 2 for i in range(45, 55)}}
    assert {f.split("/")[0] for f in files(f"{root}/lake/raw/t/v=2")} == {"v=0", "v=2"}


def test_merge_of_nothing_into_nothing(spark, root):
    empty = spark.createDataFrame([], "id bigint, v int")
    snapshots.merge(empty, root, NAME, ["id"])
    assert snapshots.read(spark, root, NAME).count() == 0
