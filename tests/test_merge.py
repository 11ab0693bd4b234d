import random

import pytest
from pyspark.sql import functions as F

from lockstep.operators import generate, merge, reconcile
from lockstep.plans import medallion


def kv(spark, rows):
    return spark.createDataFrame(rows, "k string, v int")


@pytest.mark.parametrize("broadcast_rows", [100, 0])
def test_upsert(spark, broadcast_rows):
    target = kv(spark, [("a", 1), ("b", 2), ("b", 3), ("c", None), (None, 4)])
    source = kv(spark, [("b", 20), ("c", 30), ("d", None), (None, 40)]).select("v", "k")
    got = merge.upsert(target, source, ["k"], broadcast_rows)
    assert got.columns == ["k", "v"]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(
        [("a", 1), ("b", 20), ("b", 20), ("c", 30), ("d", None), (None, 4), (None, 40)], key=key
    )


@pytest.mark.parametrize("broadcast_rows", [10_000, 0])
def test_upsert_matches_brute_force(spark, broadcast_rows):
    rng = random.Random(3)
    old = {(rng.randrange(50), rng.randrange(9)): i for i in range(300)}
    new = {(rng.randrange(70), rng.randrange(9)): -i for i in range(200)}
    frame = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], "a int, b int, v int")
    got = merge.upsert(frame(old), frame(new), ["a", "b"], broadcast_rows)
    assert {(r["a"], r["b"]): r["v"] for r in got.collect()} == {**old, **new}
    assert got.count() == len({**old, **new})


def test_small_batch_leaves_the_target_where_it_is(spark):
    target, source = spark.range(1000).withColumn("v", F.lit(1)), spark.range(5).withColumn("v", F.lit(2))
    plan = merge.upsert(target, source, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    plan = merge.upsert(target, source, ["id"], 0)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan


def test_upsert_into_empty_table(spark):
    assert merge.upsert(kv(spark, []), kv(spark, [("a", 1)]), ["k"]).count() == 1


def test_null_source_value_overwrites(spark):
    got = merge.upsert(kv(spark, [("a", 1)]), kv(spark, [("a", None)]), ["k"])
    assert got.first()["v"] is None


def test_duplicate_source_key_is_an_error(spark):
    with pytest.raises(merge.DuplicateKeyError):
        merge.upsert(kv(spark, []), kv(spark, [("a", 1), ("a", 2)]), ["k"])


def test_counter_is_dense_and_ordered(spark):
    rng = random.Random(4)
    values = list(range(997))
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    got = merge.assign_counter(df, ["v"], 41, "n").collect()
    assert sorted((r["v"], r["n"]) for r in got) == [(v, v + 42) for v in range(997)]


def test_counter_with_one_value_in_a_third_of_the_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v"))
    got = merge.assign_counter(df, ["v"], 0, "n")
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 3001))
    assert got.filter("v = -1").agg(F.max("n")).first()[0] == 1000


def test_counter_of_nothing(spark):
    assert merge.assign_counter(kv(spark, []), ["k"], 5, "n").count() == 0
    assert merge.next_counter(kv(spark, []), "v") == 0


NESTED = "k int, a string, b string, s struct<x:int,y:string>, l array<string>, m map<string,int>"


def nested(spark, *rows):
    return spark.createDataFrame(list(rows), NESTED)


BASE = (1, None, "x", (None, "y"), ["p", None], {"a": 1, "b": 2})


@pytest.mark.parametrize(
    "other",
    [
        (1, "x", None, (None, "y"), ["p", None], {"a": 1, "b": 2}),
        (1, None, "x", (1, "y"), ["p", None], {"a": 1, "b": 2}),
        (1, None, "x", None, ["p", None], {"a": 1, "b": 2}),
        (1, None, "x", (None, "y"), [None, "p"], {"a": 1, "b": 2}),
        (1, None, "x", (None, "y"), ["p"], {"a": 1, "b": 2}),
        (1, None, "x", (None, "y"), [], {"a": 1, "b": 2}),
        (1, None, "x", (None, "y"), None, {"a": 1, "b": 2}),
        (1, None, "x", (None, "y"), ["p", None], {"a": 2, "b": 1}),
        (1, None, "x", (None, "y"), ["p", None], None),
    ],
)
def test_any_difference_shows(spark, other):
    assert reconcile.diff(nested(spark, BASE), nested(spark, other), ["k"], 8).count() == 1


def test_equal_copies_do_not_differ(spark):
    again = (1, None, "x", (None, "y"), ["p", None], {"b": 2, "a": 1})
    two = nested(spark, BASE, (2, *BASE[1:]))
    other = nested(spark, (2, *BASE[1:]), again).repartition(3)
    assert reconcile.diff(two, other, ["k"], 8).isEmpty()
    assert reconcile.diff(two.limit(0), other.limit(0), ["k"], 8).isEmpty()


def test_repeated_rows_differ(spark):
    once, other = kv(spark, [("a", 1), ("a", 1)]), kv(spark, [("a", 2), ("a", 2)])
    assert reconcile.diff(once, other, ["k"], 4).count() == 1
    row = reconcile.diff(once, once.unionByName(once), ["k"], 4).first()
    assert (row["src_rows"], row["dst_rows"]) == (2, 4)


def test_diff_keys_names_exactly_the_altered_keys(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("v"))
    altered = df.filter("id <> 17").withColumn("v", F.when(F.col("id") == 4000, -1).otherwise(F.col("v")))
    altered = altered.unionByName(spark.createDataFrame([(9999, 1)], "id bigint, v bigint"))
    got = {tuple(r) for r in reconcile.diff_keys(df, altered, ["id"], 64).collect()}
    assert got == {(17, 1, 0), (4000, 1, 1), (9999, 0, 1)}


def test_diff_keys_with_null_key(spark):
    got = reconcile.diff_keys(kv(spark, [(None, 1)]), kv(spark, [(None, 2)]), ["k"], 4).collect()
    assert [tuple(r) for r in got] == [(None, 1, 1)]


def test_bucket_count_is_bounded(spark):
    with pytest.raises(ValueError):
        reconcile.diff(kv(spark, []), kv(spark, []), ["k"], 10_000_000)


def test_generated_rows_are_reproducible(spark):
    first = {tuple(r) for r in generate.generate_raw(spark, seed=3).collect()}
    again = {tuple(r) for r in generate.sample_rows(spark.range(100).repartition(9), 3).collect()}
    assert first == again and len(first) == 100
    assert {r[0] for r in first} == set(range(100))
    assert all(len(n) == 10 and n.isalnum() and n.isascii() for _, n, _ in first)
    assert all(1 <= v <= 100 for _, _, v in first)
    assert first != {tuple(r) for r in generate.generate_raw(spark, seed=4).collect()}


def test_table_pipeline(spark, root):
    from lockstep.sources import snapshots

    names = {"raw": "lake.raw.r", "silver": "lake.stage.s", "gold": "lake.main.g"}
    medallion.run_tables(spark.range(100), root, names, seed=1)
    raw, silver, gold = [snapshots.read(spark, root, names[n]) for n in ("raw", "silver", "gold")]
    assert raw.count() == 100
    assert silver.count() == raw.filter("value > 50").count() == gold.agg(F.sum("count")).first()[0]
    assert silver.filter("value <= 50").isEmpty()
