"""Change sets, digest trees and ordered upserts."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lockstep.operators import changes, marks, merge, reconcile
from lockstep.sources import changesets, digests, snapshots
from lockstep.sources.paths import exists, version_dir
from lockstep.streaming import upsert

NAME = "lake.sales.t"
SCHEMA = "k int, g string, x double"


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def frame(spark, values):
    return spark.createDataFrame(values, SCHEMA)


def sample(n, seed=1):
    draw = random.Random(seed)
    return [(draw.randrange(n) if draw.random() > 0.02 else None, draw.choice("abc"), draw.random()) for _ in range(n)]


def ship(spark, root, states, partition_by=None):
    src, stage, dst = (f"{root}/{x}" for x in ("src", "stage", "dst"))
    for state in states:
        snapshots.publish(frame(spark, state), src, NAME, partition_by=partition_by)
        changesets.stage_table(spark, src, stage, NAME, ["k"])
        changesets.deliver_table(spark, stage, dst, NAME)
        expected = rows(frame(spark, state))
        assert rows(snapshots.read(spark, stage, NAME)) == rows(snapshots.read(spark, dst, NAME)) == expected
    return src, stage, dst


def staged_rows(spark, stage):
    log = snapshots.commits(spark, stage).orderBy("version")
    return [int(r.operation_metrics["numOutputRows"]) for r in log.collect()]


def test_one_changed_row_ships_one_row(spark, root):
    before = [(k, "a", float(k)) for k in range(500)]
    after = [(k, "a", -1.0 if k == 7 else float(k)) for k in range(500)]
    _, stage, _ = ship(spark, root, [before, after, after, after[1:]])
    assert staged_rows(spark, stage) == [500, 1, 0, 1]


def test_repeated_and_null_keys_and_partitions(spark, root):
    one = sample(300)
    two = [(k, g, None if k == 5 else x) for k, g, x in one[20:]] + [(None, None, 0.5), (999, "b", 1.0)] + one[-4:]
    ship(spark, root, [one, two, [r for r in two if r[0] is not None]], ["g"])


def test_a_large_change_is_copied_whole(spark, root):
    before, after = [(k, "a", 0.0) for k in range(50)], [(k, "a", 1.0) for k in range(50)]
    _, stage, _ = ship(spark, root, [before, after])
    assert staged_rows(spark, stage) == [50, 50]
    assert "base" not in snapshots.layout_of(spark, stage, NAME, 1)


def test_a_new_column_is_copied_whole(spark, root):
    src, stage, dst = ship(spark, root, [sample(20)])
    snapshots.publish(frame(spark, sample(20)).withColumn("y", F.lit(1)), src, NAME)
    changesets.stage_table(spark, src, stage, NAME, ["k"])
    changesets.deliver_table(spark, stage, dst, NAME)
    assert snapshots.read(spark, dst, NAME).columns == ["k", "g", "x", "y"]


def test_a_destination_far_behind_and_a_new_one(spark, root):
    src, stage, dst = ship(spark, root, [sample(100)])
    for n in range(1, 4):
        snapshots.publish(frame(spark, sample(100)[n:]), src, NAME)
        changesets.stage_table(spark, src, stage, NAME, ["k"])
    for to in (dst, f"{root}/new"):
        changesets.deliver_table(spark, stage, to, NAME)
        assert rows(snapshots.read(spark, to, NAME)) == rows(frame(spark, sample(100)[3:]))


def test_steps_are_bounded(spark, root, monkeypatch):
    monkeypatch.setattr(changesets, "MOST_STEPS", 1)
    _, stage, _ = ship(spark, root, [sample(60)[n:] for n in range(3)])
    assert ["base" in snapshots.layout_of(spark, stage, NAME, v) for v in range(3)] == [False, True, False]


def test_only_the_change_set_is_read(spark, root):
    src, stage, dst = ship(spark, root, [sample(100), sample(100)[1:]])
    plan = snapshots.read_change(spark, stage, NAME, 1, snapshots.layout_of(spark, stage, NAME, 1)).inputFiles()
    assert plan and all("/v=1/" in f for f in plan)
    with pytest.raises(ValueError, match="change set"):
        snapshots.register(spark, stage, NAME, 1)


@pytest.mark.parametrize("leaf_rows", [1, 16, 4096])
def test_trees_find_what_a_full_comparison_finds(spark, root, leaf_rows):
    one, two = sample(400), sample(400)[15:] + sample(30, 2)
    for state in (one, two):
        snapshots.publish(frame(spark, state), root, NAME)
    found = digests.diff_versions(spark, (root, NAME, 0), (root, NAME, 1), ["k"], leaf_rows)
    assert rows(found) == rows(reconcile.diff_keys(frame(spark, one), frame(spark, two), ["k"]))


def test_trees_of_different_depth_and_empty_tables(spark, root):
    for n in (0, 5, 2000):
        snapshots.publish(frame(spark, sample(n)), root, NAME)
    for a, b in ((0, 1), (1, 2), (2, 0), (0, 0)):
        found = digests.diff_versions(spark, (root, NAME, a), (root, NAME, b), ["k"], 8)
        sides = [snapshots.read_version(spark, root, NAME, v) for v in (a, b)]
        assert rows(found) == rows(reconcile.diff_keys(*sides, ["k"]))


def test_equal_trees_spare_the_tables(spark, root):
    for _ in range(2):
        snapshots.publish(frame(spark, sample(50)), root, NAME)
    sides = (root, NAME, 0), (root, NAME, 1)
    assert digests.diff_versions(spark, *sides, ["k"]).isEmpty()
    for v in (0, 1):  # an empty folder in place of the data: only the kept trees can answer
        spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(version_dir(root, NAME, v))
    assert digests.diff_versions(spark, *sides, ["k"]).isEmpty()


def test_a_half_written_tree_is_built_again(spark, root):
    snapshots.publish(frame(spark, sample(50)), root, NAME)
    first = rows(digests.tree(spark, root, NAME, 0, ["k"]))
    path = digests._tree_dir(root, NAME, 0, ["k"])
    spark.range(3).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    assert not exists(spark, f"{path}/_SUCCESS")
    assert rows(digests.tree(spark, root, NAME, 0, ["k"])) == first


def test_scattered_changes_group_few_rows_by_key(spark, root, monkeypatch):
    one = [(k, "a", float(k)) for k in range(3000)] + [(None, "b", 1.0)] * 2
    two = [(k, g, -1.0 if k in range(0, 3000, 100) else x) for k, g, x in one[1:]]
    for state in (one, two):
        snapshots.publish(frame(spark, state), root, NAME)
    grouped, real = [], digests._unequal_keys

    def seen(sides, keys):
        grouped.extend(df.count() for df in sides)
        return real(sides, keys)

    monkeypatch.setattr(digests, "_unequal_keys", seen)
    found = digests.diff_versions(spark, (root, NAME, 0), (root, NAME, 1), ["k"])  # one leaf holds all rows
    assert rows(found) == rows(reconcile.diff_keys(frame(spark, one), frame(spark, two), ["k"]))
    assert found.count() == 30 and max(grouped) < 60


def test_rows_are_dealt_to_tasks_before_they_are_matched(spark, root, monkeypatch):
    one = [(k, "a", float(k)) for k in range(3000)] + [(None, "b", 1.0)] * 2
    two = [(k, g, -1.0 if k in range(0, 3000, 100) else x) for k, g, x in one[1:]]
    for state in (one, two):
        snapshots.publish(frame(spark, state), root, NAME)
    plans, real = [], marks.bitmap

    def seen(places):
        plans.append(places._jdf.queryExecution().optimizedPlan().toString())
        return real(places)

    monkeypatch.setattr(marks, "bitmap", seen)
    expected = rows(reconcile.diff_keys(frame(spark, one), frame(spark, two), ["k"]))
    for most in (2000, 100, 10_000):  # several tasks; leaves with more rows than a task; one task
        monkeypatch.setattr(digests, "MATCH_ROWS", most, raising=False)
        assert rows(digests.diff_versions(spark, (root, NAME, 0), (root, NAME, 1), ["k"], 500)) == expected
    dealt = ["RepartitionByExpression [place" in p for p in plans]
    assert dealt == [True, False, False]


def test_a_bitmap_hits_all_its_keys_and_few_others(spark):
    keys = [(k, g) for k in (None, *range(0, 4000, 50)) for g in ("a", None)]
    df = spark.createDataFrame([(k, g) for k in (None, *range(4000)) for g in ("a", None)], "k long, g string")
    bits = marks.bitmap_of(spark.createDataFrame(keys, df.schema), ["k", "g"])
    hit, missed = marks.hit(df, ["g", "k"], bits), marks.missed(df, ["k", "g"], bits)
    assert rows(hit.union(missed)) == rows(df)
    assert set(map(str, keys)) <= set(rows(hit)) and hit.count() < len(keys) + 20
    assert marks.hit(df, ["k"], marks.bitmap_of(df.limit(0), ["k"])).isEmpty()


def test_keys_that_hash_apart_are_joined_whole(spark):
    target = frame(spark, [(1, "a", 0.0), (2, "b", 0.0)])
    wide = spark.createDataFrame([(1, "z", 1.0, False)], "k long, g string, x double, _gone boolean")
    assert not marks.usable(target, wide, ["k"])
    assert rows(changes.put_all(target, [(wide, ["k"])])) == ["(1, 'z', 1.0)", "(2, 'b', 0.0)"]
    collated = target.selectExpr("collate(g, 'UTF8_LCASE') as g")
    assert not marks.usable(collated, collated, ["g"])


def test_merged_change_sets_equal_one_after_the_other(spark):
    draw, schema = random.Random(5), f"{SCHEMA}, _gone boolean"
    target, steps = frame(spark, sample(300)), []
    for _ in range(4):
        named = draw.sample([*range(300), None], 60)
        body = [(k, g, draw.random(), False) for k in named[20:] for g in draw.choice(["a", "bc", "aa"])]
        steps.append(spark.createDataFrame([(k, None, None, True) for k in named[:20]] + body, schema))
    expected = target
    for step in steps:
        expected = changes.put(expected, step, ["k"])
    for few in (False, True):
        assert rows(changes.put_all(target, [(s, ["k"]) for s in steps], few)) == rows(expected)
    for step, keys in zip(steps, (["k"], ["k", "g"])):
        target = changes.put(target, step, keys)
    mixed = [(steps[0], ["k"]), (steps[1], ["k", "g"])]
    assert rows(changes.put_all(frame(spark, sample(300)), mixed)) == rows(target)


def test_rows_without_a_change_do_not_move(spark, root):
    for name, df in (("t", frame(spark, sample(300))), ("c", frame(spark, sample(300)[:9]).withColumn("_gone", F.lit(False)))):
        df.write.parquet(f"{root}/{name}")
    target, change = (spark.read.parquet(f"{root}/{x}") for x in "tc")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        result = changes.put_all(target, [(change, ["k"])])
        plan = result._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(threshold, kept)
    stays = plan.split("Join LeftAnti")[1]
    assert "_marks_row" in stays.split("\n")[0] and "rightHint=(strategy=broadcast)" in stays.split("\n")[0]


def test_large_change_sets_past_a_bitmap(spark, root, monkeypatch):
    monkeypatch.setattr(snapshots, "FEW_ROWS", -1)
    one = sample(300)
    two = [(k, g, None if k == 5 else x) for k, g, x in one[20:]] + [(None, None, 0.5), (999, "b", 1.0)] + one[-4:]
    src, stage, _ = ship(spark, root, [one, two, [r for r in two if r[0] is not None]], ["g"])
    changesets.deliver_table(spark, stage, f"{root}/new", NAME)
    assert rows(snapshots.read(spark, f"{root}/new", NAME)) == rows(snapshots.read(spark, src, NAME))


UPDATES = st.lists(
    st.tuples(st.sampled_from([1, 2, 3, None]), st.integers(0, 40), st.sampled_from("ab")),
    max_size=12, unique_by=lambda r: r[:2] if r[0] is not None else (id(r), 0),
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(UPDATES, UPDATES)
def test_highest_sequence_wins(spark, first, second):
    seen = {}
    for k, s, v in first + second:
        if k is not None and (k not in seen or s > seen[k][0]):
            seen[k] = (s, v)
    nulls = [r for r in first + second if r[0] is None]
    schema = "k int, s int, v string"
    before = merge.newest(spark.createDataFrame(first, schema), ["k"], "s")
    got = merge.upsert_newest(before, spark.createDataFrame(second, schema), ["k"], "s")
    assert rows(got) == sorted(map(str, [(k, *x) for k, x in seen.items()] + nulls))


@pytest.mark.parametrize("updates", [[(1, 5, "a"), (1, 5, "b")], [(1, None, "a")], [(1, 9, "c"), (1, 5, "a"), (1, 5, "a")]])
def test_equal_or_missing_places_are_an_error(spark, updates):
    with pytest.raises(merge.DuplicateKeyError):
        merge.newest(spark.createDataFrame(updates, "k int, s int, v string"), ["k"], "s")


def test_stream_with_a_backlog_in_disorder(spark, root):
    landing, schema = f"{root}/in", "k int, s int, v string"
    for part in ([(1, 9, "late"), (1, 7, "x"), (2, 1, "a")], [(1, 8, "y"), (2, 2, "b"), (2, 0, "c"), (3, 1, "n")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        upsert.upsert_stream(stream, f"{root}/gold", NAME, ["k"], f"{root}/progress", "s")
    assert rows(snapshots.read(spark, f"{root}/gold", NAME)) == ["(1, 9, 'late')", "(2, 2, 'b')", "(3, 1, 'n')"]
