"""Versioned parquet copies of tables and the commit log beside them.

A table's version N is the directory ``<root>/<catalog>/<schema>/<table>/v=N``; the
commits of a root are rows of ``<root>/_commits``. Data is written first and its
commit row afterwards, so a version without a commit row is never read, and writing
it again simply replaces it. The commit row also holds the version's schema and partition
columns, so that values are read back and copied as they were written. One writer per table.

A version may hold only what changed since an earlier version of the same root, which its
commit names along with the keys (see ``changesets``). Reading it gives the whole table.
"""

from __future__ import annotations

import json
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lockstep.functions.names import split_name
from lockstep.functions.pruning import about
from lockstep.model import CLONE, COMMITS
from lockstep.operators.changes import GONE, put_all
from lockstep.operators.history import as_of_time
from lockstep.operators.merge import newest, upsert, upsert_newest
from lockstep.operators.reconcile import diff
from lockstep.sources.logs import append_dealt, read_dealt, small_frame
from lockstep.sources.paths import size, version_dir


LAYOUT = "layout"

# Change sets of so many rows in all have their keys broadcast as they are.
FEW_ROWS = 10_000


def now_millis() -> int:
    return int(time.time() * 1000)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """The commits of a root, kept by day and by table."""
    return read_dealt(spark, f"{root}/_commits", COMMITS)


def commits_of(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The commits of one table; other parts of the log are not read."""
    return about(commits(spark, root), "table_name", table)


def commit_row(
    table: str,
    version: int,
    at_ms: int,
    operation: str,
    parameters: dict[str, str] | None = None,
    metrics: dict[str, str] | None = None,
) -> tuple:
    at = datetime.fromtimestamp(at_ms / 1000, tz=timezone.utc)
    return (table, version, at, operation, parameters or {}, metrics or {})


def commit(spark: SparkSession, root: str, rows: list[tuple]) -> None:
    """Make written versions visible, all rows in one append."""
    log = small_frame(spark, rows, COMMITS)
    append_dealt(log, f"{root}/_commits", F.unix_millis("ts"), F.col("table_name"))


def latest_version(spark: SparkSession, root: str, table: str) -> int | None:
    row = commits_of(spark, root, table).select("version").orderBy(F.desc("version")).first()
    return row["version"] if row else None


def next_version(spark: SparkSession, root: str, table: str) -> int:
    latest = latest_version(spark, root, table)
    return 0 if latest is None else latest + 1


def write_version(
    df: DataFrame,
    root: str,
    table: str,
    version: int,
    partition_by: list[str] | None = None,
    sized: bool = True,
) -> tuple[int, int | None, str]:
    """Write one version and return (rows, bytes, layout).

    Rows are counted while they are written; bytes come from the file listing, so
    neither needs a second pass over the data. Without ``sized`` bytes are not looked up. An empty text in a partition column, which
    a folder name can't tell from NULL, is an error and leaves the version uncommitted.
    """
    path, parts = version_dir(root, table, version), partition_by or []
    texts = [c for c in parts if df.schema[c].dataType == T.StringType()]
    seen = Observation()
    blank = [F.count_if(F.col(c) == "").alias(f"blank_{i}") for i, c in enumerate(texts)]
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows"), *blank).write.mode("overwrite")
    if parts:
        writer = writer.partitionBy(*parts)
    writer.parquet(path)
    if any(seen.get[f"blank_{i}"] for i in range(len(texts))):
        raise ValueError(f"{table} has empty text in a partition column of {texts}")
    layout = json.dumps({"schema": json.loads(df.schema.json()), "partition_by": parts})
    return seen.get["rows"], size(df.sparkSession, [path]) if sized else None, layout


def layout_of(spark: SparkSession, root: str, table: str, version: int) -> dict:
    """Schema and partition columns of a committed version; empty where its commit names none."""
    rows = _commit_of(spark, root, table, version).select(F.col("operation_parameters")[LAYOUT].alias(LAYOUT)).collect()
    return json.loads(rows[0][LAYOUT]) if rows and rows[0][LAYOUT] else {}


def _commit_of(spark: SparkSession, root: str, table: str, version: int) -> DataFrame:
    """The one commit of a version."""
    return commits_of(spark, root, table).filter(F.col("version") == version)


def row_count(spark: SparkSession, root: str, table: str, version: int) -> int | None:
    """Rows of a committed version as its commit counted them; None where it did not."""
    n = F.col("operation_metrics")["numOutputRows"].try_cast("bigint").alias("n")
    rows = _commit_of(spark, root, table, version).select(n).collect()
    return rows[0]["n"] if rows else None


def version_size(spark: SparkSession, root: str, table: str, version: int) -> int:
    """Total bytes of a version's files."""
    return size(spark, [version_dir(root, table, version)])


def publish(
    df: DataFrame,
    root: str,
    table: str,
    operation: str = "WRITE",
    at_ms: int | None = None,
    parameters: dict[str, str] | None = None,
    partition_by: list[str] | None = None,
    sized: bool = True,
    version: int | None = None,
) -> int:
    """Replace a table's contents by a new version; older versions stay readable.

    A caller that has just looked up the latest version, as the table's one writer, names the next one.
    """
    spark = df.sparkSession
    version = next_version(spark, root, table) if version is None else version
    rows, nbytes, layout = write_version(df, root, table, version, partition_by, sized)
    metrics = {"numOutputRows": str(rows)} | ({"numOutputBytes": str(nbytes)} if sized else {})
    at = now_millis() if at_ms is None else at_ms
    parameters = {**(parameters or {}), LAYOUT: layout}
    commit(spark, root, [commit_row(table, version, at, operation, parameters, metrics)])
    return version


def ensure(
    spark: SparkSession, root: str, table: str, schema: T.StructType, at_ms: int | None = None
) -> int:
    """Create an empty table with the given schema unless it exists."""
    latest = latest_version(spark, root, table)
    if latest is not None:
        return latest
    return publish(spark.createDataFrame([], schema), root, table, "CREATE", at_ms, version=0)


def resolve(
    spark: SparkSession,
    root: str,
    table: str,
    version: int | None = None,
    as_of_ms: int | None = None,
) -> int:
    """The version a read should use; an unknown version or time is an error."""
    if version is not None:
        found = None if _commit_of(spark, root, table, version).isEmpty() else version
    elif as_of_ms is not None:
        row = as_of_time(commits_of(spark, root, table), as_of_ms).first()
        found = row["version"] if row else None
    else:
        found = latest_version(spark, root, table)
    if found is None:
        raise LookupError(f"no such version of {table} in {root}: {version=}, {as_of_ms=}")
    return found


def read(
    spark: SparkSession,
    root: str,
    table: str,
    version: int | None = None,
    as_of_ms: int | None = None,
) -> DataFrame:
    """A table at a version, at a time, or as of its latest commit."""
    return read_version(spark, root, table, resolve(spark, root, table, version, as_of_ms))


def read_version(spark: SparkSession, root: str, table: str, version: int) -> DataFrame:
    """A committed version, with the column types and order it was written with."""
    return _read(spark, root, table, version, layout_of(spark, root, table, version))


def _read(spark: SparkSession, root: str, table: str, version: int, layout: dict) -> DataFrame:
    steps = []
    while "base" in layout:
        steps.insert(0, (version, layout))
        version = layout["base"]
        layout = layout_of(spark, root, table, version)
    if steps:
        return apply_changes(spark, _read(spark, root, table, version, layout), root, table, steps)
    path = version_dir(root, table, version)
    if not layout:
        return spark.read.parquet(path)
    schema = T.StructType.fromJson(layout["schema"])
    return spark.read.schema(schema).parquet(path).select(*[f"`{name}`" for name in schema.names])


def read_change(spark: SparkSession, root: str, table: str, version: int, layout: dict) -> DataFrame:
    """The rows and gone keys that a version holds which is a change set."""
    schema = T.StructType.fromJson(layout["schema"]).add(GONE, T.BooleanType())
    return spark.read.schema(schema).parquet(version_dir(root, table, version))


def apply_changes(
    spark: SparkSession, before: DataFrame, root: str, table: str, steps: list[tuple[int, dict]]
) -> DataFrame:
    """A table after a root's change sets, given as versions and layouts, the oldest first."""
    rows = [row_count(spark, root, table, version) for version, _ in steps]
    few = None not in rows and sum(rows) <= FEW_ROWS
    changes = [(read_change(spark, root, table, version, layout), layout["keys"]) for version, layout in steps]
    return put_all(before, changes, few)


def register(spark: SparkSession, root: str, table: str, version: int) -> str:
    """Point the session view ``<catalog>__<schema>.<table>`` at a version, replacing the old one.

    The session's own catalog has one level of schemas, so catalog and schema share a name.
    """
    catalog, schema, name = split_name(table)
    if "__" in catalog + "_" or schema.startswith("_"):
        raise ValueError(f"{table}: a view's schema joins catalog and schema by two underscores")
    read = layout_of(spark, root, table, version)
    if "base" in read:
        raise ValueError(f"{table}: version {version} is a change set; deliver it before it is registered")
    where = f"{catalog}__{schema}"
    path = version_dir(root, table, version).replace("`", "``")
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{where}`")
    columns = "*"
    if read:
        columns = ", ".join(
            f"cast(`{f.name}` as {f.dataType.simpleString()}) as `{f.name}`"
            for f in T.StructType.fromJson(read["schema"])
        )
    if read.get("partition_by"):
        # Folder names would be read as numbers; a table over the folder has the types.
        held = f"`{where}`.`_{name}_v{version}`"
        fields = T.StructType.fromJson(read["schema"])
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        by = ", ".join(f"`{c}`" for c in read["partition_by"])
        spark.sql(f"CREATE TABLE IF NOT EXISTS {held} ({ddl}) USING parquet PARTITIONED BY ({by}) LOCATION '{path}'")
        spark.sql(f"MSCK REPAIR TABLE {held}")
        source = held
    else:
        source = f"parquet.`{path}`"
    spark.sql(f"CREATE OR REPLACE VIEW `{where}`.`{name}` AS SELECT {columns} FROM {source}")
    return f"{where}.{name}"


def copy(
    spark: SparkSession,
    src_root: str,
    dst_root: str,
    table: str,
    version: int,
    dst_version: int,
) -> tuple[int, int, str]:
    """Write one source version into the destination without making it visible yet.

    A straight scan-to-write that keeps types and partitions: no shuffle, and the tasks are
    the source's file splits.
    """
    layout = layout_of(spark, src_root, table, version)
    df = _read(spark, src_root, table, version, layout)
    return write_version(df, dst_root, table, dst_version, layout.get("partition_by"))


def clone_row(
    table: str, version: int, at_ms: int, source_version: int, rows: int, nbytes: int, layout: str
) -> tuple:
    return commit_row(
        table,
        version,
        at_ms,
        CLONE,
        {"sourceVersion": str(source_version), LAYOUT: layout},
        {"sourceTableSize": str(nbytes), "numOutputRows": str(rows)},
    )


def clone(
    spark: SparkSession,
    src_root: str,
    dst_root: str,
    table: str,
    version: int | None = None,
    at_ms: int | None = None,
    changed_only: bool = False,
) -> int:
    """Copy a table at a version (latest by default), commit it and return its version.

    With ``changed_only`` a destination whose latest version already has the same rows is
    left as it is, and that version returned.
    """
    source_version = resolve(spark, src_root, table, version)
    dst_version = next_version(spark, dst_root, table)
    if changed_only and dst_version and _same(spark, src_root, source_version, dst_root, dst_version - 1, table):
        return dst_version - 1
    rows, nbytes, layout = copy(spark, src_root, dst_root, table, source_version, dst_version)
    at = now_millis() if at_ms is None else at_ms
    row = clone_row(table, dst_version, at, source_version, rows, nbytes, layout)
    commit(spark, dst_root, [row])
    return dst_version


def _same(spark, src_root, src_version, dst_root, dst_version, table) -> bool:
    """Do two versions have the same columns and, by digest, the same rows?"""
    src = read_version(spark, src_root, table, src_version)
    dst = read_version(spark, dst_root, table, dst_version)
    fields = [[(f.name, f.dataType) for f in df.schema] for df in (src, dst)]
    return fields[0] == fields[1] and diff(src, dst, src.columns).isEmpty()


def merge(
    source: DataFrame,
    root: str,
    table: str,
    keys: list[str],
    at_ms: int | None = None,
    parameters: dict[str, str] | None = None,
    sequence: str | None = None,
) -> int:
    """Upsert rows into a table by key and publish the result; a missing table is created.

    The new version keeps the table's types and partitions. Without ``sequence`` a key may come once; with it the row
    of the highest one wins, over the table's own as well.
    """
    spark = source.sparkSession
    previous = latest_version(spark, root, table)
    if previous is None:
        target, parts = spark.createDataFrame([], source.schema), None
    else:
        layout = layout_of(spark, root, table, previous)
        target = _read(spark, root, table, previous, layout)
        parts = layout.get("partition_by")
    source = source.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in target.schema])
    if sequence is None:
        result = upsert(target, source, keys)
    elif previous is None:
        result = newest(source, keys, sequence)
    else:
        result = upsert_newest(target, source, keys, sequence)
    version = 0 if previous is None else previous + 1
    return publish(result, root, table, "MERGE", at_ms, parameters, parts, version=version)
