"""Listing of the tables a session or a root has, of those that are lacking, and of those that can't be read."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lockstep.functions.names import split_name
from lockstep.model import STRING, struct
from lockstep.sources import snapshots
from lockstep.sources.logs import small_frame
from lockstep.sources.paths import exists, version_dir

# Tables probed by one plan.
PROBED_AT_ONCE = 50

_READ_ERRORS = (PySparkException, Py4JJavaError)
_UNREADABLE = struct(table_name=STRING, reason=STRING)


def listing(spark: SparkSession, schemas: list[str], catalog: str) -> DataFrame:
    """``table_name`` of every table or view in the given schemas of a catalog."""
    names = [
        (f"{catalog}.{schema}.{t.name}",)
        for schema in schemas
        for t in spark.catalog.listTables(schema)
    ]
    return spark.createDataFrame(names, "table_name string")


def listing_of_root(spark: SparkSession, root: str) -> DataFrame:
    """``table_name`` of every table that a root's commits name."""
    return snapshots.commits(spark, root).select("table_name").distinct()


def missing_tables(members: DataFrame, catalog: DataFrame) -> DataFrame:
    """Group members whose table is not in the listing."""
    return members.join(catalog.select("table_name"), "table_name", "left_anti")


def _resting_on(spark: SparkSession, root: str) -> dict[str, list[tuple[int, int | None]]]:
    """For each table of a root its latest version and those that it builds on, with the rows committed.

    Commits since a table's last whole version reach the driver, small rows whose number
    ``changesets.MOST_STEPS`` bounds.
    """
    base = F.get_json_object(F.col("operation_parameters")[snapshots.LAYOUT], "$.base").try_cast("bigint")
    log = snapshots.commits(spark, root).select(
        "table_name",
        "version",
        F.col("operation_metrics")["numOutputRows"].try_cast("bigint").alias("rows"),
        base.alias("base"),
    )
    whole = log.filter("base is null").groupBy("table_name").agg(F.max("version").alias("whole"))
    recent = log.join(whole, "table_name").filter("version >= whole")
    commits: dict[str, dict] = {}
    for row in recent.toLocalIterator():
        commits.setdefault(row["table_name"], {})[row["version"]] = (row["rows"], row["base"])
    found = {}
    for table, versions in commits.items():
        chain, at = [], max(versions)
        while at is not None:
            rows, before = versions[at]
            chain.append((at, rows))
            at = before
        found[table] = chain
    return found


def _stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row without columns per row stored in a folder: file footers tell, no data page is read."""
    reader = spark.read.schema(T.StructType([])).option("recursiveFileLookup", True)
    return reader.option("ignoreCorruptFiles", False).option("ignoreMissingFiles", False).parquet(path)


def _counts(frames: list[tuple[str, DataFrame]]) -> dict[str, int]:
    """Rows per name, all frames in one plan."""
    parts = [df.select(F.lit(name).alias("name")) for name, df in frames]
    return dict(map(tuple, reduce(DataFrame.unionAll, parts).groupBy("name").count().toLocalIterator()))


def _text(error: Exception) -> str:
    """The innermost cause of a read error, on one line."""
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    causes = [line for line in lines if line.startswith("Caused by:")]
    return causes[-1].removeprefix("Caused by:").strip() if causes else lines[0]


def _probe(frames: list[tuple[str, DataFrame]]) -> tuple[dict[str, int], dict[str, str]]:
    """Rows of each frame that can be read, and why each other can't.

    All are read by one plan; if that fails its halves are, so one bad frame among n costs log n plans.
    """
    if not frames:
        return {}, {}
    try:
        return {name: 0 for name, _ in frames} | _counts(frames), {}
    except _READ_ERRORS as error:
        if len(frames) == 1:
            return {}, {frames[0][0]: _text(error)}
    middle = len(frames) // 2
    (rows, bad), (more, worse) = _probe(frames[:middle]), _probe(frames[middle:])
    return rows | more, bad | worse


def _probe_all(frames: list[tuple[str, DataFrame]]) -> tuple[dict[str, int], dict[str, str]]:
    rows, bad = {}, {}
    for i in range(0, len(frames), PROBED_AT_ONCE):
        more, worse = _probe(frames[i : i + PROBED_AT_ONCE])
        rows, bad = rows | more, bad | worse
    return rows, bad


def unreadable(spark: SparkSession, root: str) -> DataFrame:
    """Tables named by a root's commits whose latest version can't be read: ``table_name`` and ``reason``.

    The footer of every file is opened, also of the versions that a change set builds on, and the rows they
    tell are compared with those committed: missing folders, lost, damaged and forbidden files, and files
    that are too many, are found; a damaged data page behind a good footer is not. No rows if all is well.
    """
    frames, committed, bad = [], {}, {}
    for table, chain in _resting_on(spark, root).items():
        for version, rows in chain:
            name = f"{table} version {version}"
            path = version_dir(root, table, version)
            committed[name] = (table, rows)
            try:
                if exists(spark, path):
                    frames.append((name, _stored_rows(spark, path)))
                else:
                    bad[name] = "its folder is missing"
            except _READ_ERRORS as error:
                bad[name] = _text(error)
    found, failed = _probe_all(frames)
    bad |= failed
    for name, rows in found.items():
        if committed[name][1] not in (None, rows):
            bad[name] = f"{rows} rows found, {committed[name][1]} committed"
    reasons: dict[str, list[str]] = {}
    for name, why in sorted(bad.items()):
        reasons.setdefault(committed[name][0], []).append(f"{name.rsplit(' version ', 1)[1]}: {why}")
    return small_frame(spark, [(table, "; ".join(why)) for table, why in reasons.items()], _UNREADABLE)


def unreadable_in_session(spark: SparkSession, tables: DataFrame) -> DataFrame:
    """Listed session tables (``table_name`` with its three parts) of which not one row can be asked for.

    Names are looked up in the session's schema, as ``listing`` gives them; a table that is
    gone counts as one that can't be read.
    """
    frames, bad = [], {}
    for row in tables.select("table_name").distinct().toLocalIterator():
        _, schema, name = split_name(row["table_name"])
        try:
            frames.append((row["table_name"], spark.table(f"`{schema}`.`{name}`").limit(1)))
        except _READ_ERRORS as error:
            bad[row["table_name"]] = _text(error)
    bad |= _probe_all(frames)[1]
    return small_frame(spark, sorted(bad.items()), _UNREADABLE)
