import os
import time

import pytest
from pyspark.sql import functions as F

from lockstep.plans import medallion
from lockstep.sources import files, snapshots
from lockstep.streaming import ingest, upsert

NAMES = {"bronze": "lake.raw.b", "silver": "lake.stage.s", "gold": "lake.main.g"}


def land(directory, name, text):
    os.makedirs(directory, exist_ok=True)
    with open(f"{directory}/{name}", "w", encoding="utf-8") as f:
        f.write(text)


def base(df):
    return F.element_at(F.split("file_name", "/"), -1)


def gold(spark, root):
    df = snapshots.read(spark, root, NAMES["gold"])
    return {r["f"]: r for r in df.withColumn("f", base(df)).collect()}


def test_has_files(spark, root):
    os.makedirs(f"{root}/landing")
    assert files.has_files(spark, f"{root}/landing") is False
    land(f"{root}/landing", "a.txt", "x")
    assert files.has_files(spark, f"{root}/landing") is True


def test_bronze_and_silver(spark, root):
    long = "zażółć\n" * 5000
    land(f"{root}/landing", "a.txt", long)
    os.utime(f"{root}/landing/a.txt", (1_700_000_000.75, 1_700_000_000.75))
    bronze = files.ingest_files(spark, f"{root}/landing", "w")
    assert bronze.columns == ["path", "modificationTime", "length", "content",
                              "file_modified_time", "file_name", "workspace_name"]
    row = medallion.parse_files(bronze).first()
    assert row["parsed_data"] == long and row["workspace_name"] == "w"
    assert row["file_name"].endswith("/landing/a.txt")
    assert row["parsed_time"].timestamp() == 1_700_000_000 or str(row["parsed_time"]).endswith(":20")


def test_file_pipeline(spark, root):
    landing = f"{root}/landing"
    os.makedirs(landing)
    run = lambda now: medallion.run_files(spark, landing, f"{root}/t", NAMES, "w", now)
    assert run(1000) is False
    land(landing, "a.txt", "one")
    land(landing, "b.txt", "two")
    assert run(1000) is True
    assert sorted(r["merge_counter"] for r in gold(spark, f"{root}/t").values()) == [1, 2]
    land(landing, "a.txt", "changed")
    land(landing, "c.txt", "three")
    assert run(2000) is True
    rows = gold(spark, f"{root}/t")
    assert {n: r["parsed_data"] for n, r in rows.items()} == {"a.txt": "changed", "b.txt": "two", "c.txt": "three"}
    assert sorted(r["merge_counter"] for r in rows.values()) == [3, 4, 5]


def test_stream_archives_only_committed_files(spark, root):
    landing, archive = f"{root}/landing", f"{root}/archive"

    def run():
        stream = ingest.landed(spark, landing, "w", archive)
        return ingest.ingest_stream(stream, f"{root}/bronze", f"{root}/progress")

    land(landing, "a.txt", "one")
    assert run().count() == 1
    land(landing, "b.txt", "two")
    assert run().count() == 2
    land(landing, "late.txt", "not yet seen")
    deadline = time.time() + 20
    while os.path.exists(f"{landing}/a.txt") and time.time() < deadline:
        time.sleep(0.2)
    moved = {f for _, _, names in os.walk(archive) for f in names if not f.startswith(".")}
    assert "late.txt" not in moved and os.path.exists(f"{landing}/late.txt")
    assert moved <= {"a.txt", "b.txt"}
    bronze = run()
    assert {r[0] for r in bronze.select(base(bronze)).collect()} == {"a.txt", "b.txt", "late.txt"}
    assert run().count() == 3


def test_file_stream_to_gold_and_replay(spark, root):
    landing, tables = f"{root}/landing", f"{root}/t"

    def run(progress):
        stream = ingest.landed(spark, landing, "w", max_files=1)
        ingest.run_files_stream(stream, tables, NAMES, progress)

    land(landing, "a.txt", "one")
    land(landing, "b.txt", "two")
    run(f"{root}/p1")
    assert sorted(r["merge_counter"] for r in gold(spark, tables).values()) == [1, 2]
    version = snapshots.latest_version(spark, tables, NAMES["gold"])
    run(f"{root}/p1")
    assert snapshots.latest_version(spark, tables, NAMES["gold"]) == version
    # a lost checkpoint: what landed is merged again by name, and nothing that came since is lost
    land(landing, "c.txt", "three")
    run(f"{root}/p2")
    land(landing, "d.txt", "four")
    run(f"{root}/p2")
    assert {n: r["parsed_data"] for n, r in gold(spark, tables).items()} == {
        "a.txt": "one", "b.txt": "two", "c.txt": "three", "d.txt": "four"}


def test_batch_archives_what_it_ingested(spark, root):
    landing, archive = f"{root}/landing", f"{root}/archive"
    land(landing, "a.txt", "one")
    run = lambda: medallion.run_files(spark, landing, f"{root}/t", NAMES, "w", 1000, archive)
    assert run() is True
    assert os.listdir(archive) and not os.path.exists(f"{landing}/a.txt")
    assert run() is False
    land(landing, "b.txt", "two")
    assert run() is True
    assert {n: r["parsed_data"] for n, r in gold(spark, f"{root}/t").items()} == {"a.txt": "one", "b.txt": "two"}


def test_archiving_many_files_and_a_failing_one(spark, root, monkeypatch):
    landing, archive = f"{root}/landing", f"{root}/archive"
    for i in range(60):
        land(f"{landing}/d{i % 3}", f"f{i}.txt", str(i))
    monkeypatch.setattr(files, "WAITING", 4)
    listed = files.ingest_files(spark, landing, "w").select("file_name").checkpoint()
    real = files.move

    def flaky(spark, name, *where):
        if name.endswith("/f30.txt"):
            raise OSError("denied")
        return real(spark, name, *where)

    monkeypatch.setattr(files, "move", flaky)
    with pytest.raises(OSError, match="denied"):
        files.archive(listed, landing, archive, movers=5)
    assert os.path.exists(f"{landing}/d0/f30.txt")
    left = sum(name.endswith(".txt") for _, _, names in os.walk(landing) for name in names)
    monkeypatch.setattr(files, "move", real)
    assert files.archive(listed, landing, archive, movers=5) == left
    assert {x for _, _, names in os.walk(archive) for x in names if x.endswith(".txt")} == {f"f{i}.txt" for i in range(60)}
    assert files.archive(listed, landing, archive) == 0


def test_a_replayed_batch_is_skipped(spark, root):
    mark = {"stream": "id", "batchId": "3"}
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    snapshots.merge(rows, root, "lake.main.t", ["k"], None, mark)
    assert ingest.applied(spark, root, "lake.main.t", mark)
    assert not ingest.applied(spark, root, "lake.main.t", {**mark, "stream": "other"})
    assert not ingest.applied(spark, root, "lake.main.t", {**mark, "batchId": "4"})


def test_two_streams_into_one_table(spark, root):
    for k in (1, 2):
        spark.createDataFrame([(k, "v")], "k int, v string").write.parquet(f"{root}/in{k}")
        stream = spark.readStream.schema("k int, v string").parquet(f"{root}/in{k}")
        upsert.upsert_stream(stream, root, "lake.main.t", ["k"], f"{root}/progress{k}")
    assert {r["k"] for r in snapshots.read(spark, root, "lake.main.t").collect()} == {1, 2}


def test_upsert_stream(spark, root):
    schema = "k int, v string"

    def batch(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        upsert.upsert_stream(stream, root, "lake.main.t", ["k"], f"{root}/progress")
        return dict(map(tuple, snapshots.read(spark, root, "lake.main.t").collect()))

    assert batch((1, "a"), (2, "b")) == {1: "a", 2: "b"}
    assert batch((2, "B"), (3, "c")) == {1: "a", 2: "B", 3: "c"}
    with pytest.raises(Exception, match="rows per key"):
        batch((4, "x"), (4, "y"))
    assert dict(map(tuple, snapshots.read(spark, root, "lake.main.t").collect())) == {1: "a", 2: "B", 3: "c"}
