"""Versions, releases and the control table for SQL text.

A table's versions are one external table, partitioned by version. A group's views choose the version
by a scalar subquery on the group's latest release, which prunes partitions when a query is planned:
the one release row that a sync appends switches all views of the group, and nothing is repointed.
Table functions, which SQL looks up in the current schema alone, read a table at a version or a time, and the
state of a group.

Views are named like those of ``snapshots.register``: ``<catalog>__<schema>.<table>``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lockstep.functions.names import split_name
from lockstep.functions.pruning import DAY, PART, part_of
from lockstep.model import RECEIVED, STATE
from lockstep.sources import releases, snapshots, state
from lockstep.sources.paths import table_dir, version_dir

# The partition column of a table over all versions, the name it has where the table has
# partitions itself (that of the folders, in which they are found), and the property that names its root.
VERSION, FOLDER, ROOT = "_version", "v", "lockstep.root"


def _text(value: str) -> str:
    """A value as an SQL text literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _path(path: str) -> str:
    return f"parquet.`{path.replace('`', '``')}`"


def _columns(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}`" for f in schema)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _part(spark: SparkSession, value: str) -> str:
    """The condition that leaves other parts of a log unread."""
    return f"{PART} = {spark.range(1).select(part_of(F.lit(value))).first()[0]}"


def _place(table: str) -> tuple[str, str, str]:
    """Session schema, quoted name of the table over all versions, and bare name."""
    catalog, schema, name = split_name(table)
    if "__" in catalog + "_" or schema.startswith("_"):
        raise ValueError(f"{table}: a view's schema joins catalog and schema by two underscores")
    where = f"{catalog}__{schema}"
    return where, f"`{where}`.`_{name}_versions`", name


def _by(layout: dict) -> str:
    return FOLDER if layout.get("partition_by") else VERSION


def add_version(spark: SparkSession, root: str, table: str, version: int, layout: dict) -> T.StructType:
    """Make a whole version, visible yet or not, part of the table over all versions; returns its schema.

    That table is made when it is missing, and made anew when a version has other columns or lies in another root.
    """
    if "base" in layout:
        raise ValueError(f"{table}: version {version} is a change set; deliver it before it is registered")
    where, versions, _ = _place(table)
    schema = T.StructType.fromJson(layout["schema"])
    by_version, parts = _by(layout), layout.get("partition_by") or []
    if by_version in schema.names:
        raise ValueError(f"{table}: a column named {by_version} would clash with the version")
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{where}`")
    wanted = [f for f in schema if f.name not in parts] + [T.StructField(by_version, T.LongType())] + [schema[p] for p in parts]
    if spark.catalog.tableExists(versions):
        known = [(f.name, f.dataType) for f in spark.table(versions).schema]
        at = spark.sql(f"SHOW TBLPROPERTIES {versions} ({_text(ROOT)})").first()["value"]
        if at != root or known != [(f.name, f.dataType) for f in wanted]:
            spark.sql(f"DROP TABLE {versions}")
    if not spark.catalog.tableExists(versions):
        by = ", ".join(f"`{c}`" for c in [by_version, *parts])
        location = _text(table_dir(root, table))
        columns = _ddl(T.StructType(wanted))
        spark.sql(
            f"CREATE TABLE {versions} ({columns}) USING parquet PARTITIONED BY ({by}) LOCATION {location} "
            f"TBLPROPERTIES ({_text(ROOT)} = {_text(root)})"
        )
    if parts:
        spark.sql(f"MSCK REPAIR TABLE {versions}")
    else:
        _add_partitions(spark, root, table, [version])
    return schema


def _add_partitions(spark: SparkSession, root: str, table: str, versions: list[int]) -> None:
    added = [f"PARTITION (`{VERSION}` = {v}) LOCATION {_text(version_dir(root, table, v))}" for v in versions]
    spark.sql(f"ALTER TABLE {_place(table)[1]} ADD IF NOT EXISTS {' '.join(added)}")


def released_view(
    spark: SparkSession, root: str, workspace_name: str, group_name: str, table: str, layout: dict
) -> str:
    """A view of a table as of its group's latest release, whenever it is read; returns its name."""
    where, versions, name = _place(table)
    columns = _columns(T.StructType.fromJson(layout["schema"]))
    chosen = (
        f"SELECT max_by(filter(members, m -> m.table_name = {_text(table)})[0].version, release_ms) "
        f"FROM {_path(root + '/_releases')} WHERE {_part(spark, group_name)} "
        f"AND workspace_name = {_text(workspace_name)} AND group_name = {_text(group_name)}"
    )
    spark.sql(
        f"CREATE OR REPLACE VIEW `{where}`.`{name}` AS SELECT {columns} FROM {versions} "
        f"WHERE `{_by(layout)}` = ({chosen})"
    )
    return f"{where}.{name}"


def register_group(spark: SparkSession, root: str, workspace_name: str, group_name: str) -> dict[str, str]:
    """Views of a released group's tables, by table. Later releases need no other call than ``add_version``."""
    views = {}
    for table, version in releases.members(spark, root, workspace_name, group_name).items():
        layout = snapshots.layout_of(spark, root, table, version)
        add_version(spark, root, table, version, layout)
        views[table] = released_view(spark, root, workspace_name, group_name, table, layout)
    return views


def register_time_travel(spark: SparkSession, root: str, table: str) -> tuple[str, str]:
    """Table functions ``<schema>__<table>_at(version)`` and ``<schema>__<table>_as_of(ms)``; returns their names.

    They know the versions committed so far, which have to be whole, with the columns of the latest; a column that
    an older one lacks is NULL. An unknown version or time gives no rows.
    """
    where, versions, name = _place(table)
    log = snapshots.commits_of(spark, root, table).select("version").distinct()
    known = sorted(r["version"] for r in log.collect())  # one table's versions
    layout = snapshots.layout_of(spark, root, table, known[-1])
    schema = add_version(spark, root, table, known[-1], layout)
    if not layout.get("partition_by"):
        _add_partitions(spark, root, table, known)
    columns, by = _columns(schema), _by(layout)
    commits = f"{_path(root + '/_commits')} WHERE {_part(spark, table)} AND table_name = {_text(table)}"
    at, as_of = f"`{where}__{name}_at`", f"`{where}__{name}_as_of`"
    bodies = {
        f"{at}(wanted BIGINT)": f"SELECT {columns} FROM {versions} WHERE `{by}` = wanted "
        f"AND `{by}` IN (SELECT version FROM {commits})",
        # A parameter is known in a joined relation, and not in a subquery of the condition.
        f"{as_of}(cutoff_ms BIGINT)": f"SELECT {columns} FROM {versions} JOIN ("
        f"SELECT max_by(version, struct(ts, version)) AS _chosen FROM {commits} "
        f"AND {DAY} <= date_from_unix_date(cast(floor(cutoff_ms / 86400000) AS int)) "
        f"AND ts <= timestamp_millis(cutoff_ms)) ON `{by}` = _chosen",
    }
    for function, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE FUNCTION {function} RETURNS TABLE ({_ddl(schema)}) RETURN {body}")
    return at.replace("`", ""), as_of.replace("`", "")


def register_state(spark: SparkSession, root: str, schema: str = "sync__meta") -> tuple[str, str]:
    """A view ``<schema>.state`` of the control table as it stands whenever it is read, and a table function
    ``<schema>__group_state(workspace, grp)``; returns their names."""
    state.create(spark, root)

    def latest(table: str) -> str:
        newest = (
            f"SELECT max(version) FROM {_path(root + '/_commits')} "
            f"WHERE {_part(spark, table)} AND table_name = {_text(table)}"
        )
        return f"(SELECT * FROM {_path(table_dir(root, table))} WHERE `{FOLDER}` = ({newest}))"

    values = ", ".join(
        f"coalesce(r.`{f.name}`, s.`{f.name}`) AS `{f.name}`" if f.name in RECEIVED else f"s.`{f.name}`" for f in STATE
    )
    declared = "xxhash64(" + ", ".join(f"isnull(s.{c}), s.{c}" for c in state.DECLARED) + ")"
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}`")
    spark.sql(
        f"CREATE OR REPLACE VIEW `{schema}`.`state` AS SELECT {values} FROM {latest(state.STATE_TABLE)} s "
        f"LEFT JOIN {latest(state.RECEIVED_TABLE)} r ON s.workspace_name = r.workspace_name "
        f"AND s.group_name = r.group_name AND {declared} = r.declaration"
    )
    spark.sql(
        f"CREATE OR REPLACE FUNCTION `{schema}__group_state`(workspace STRING, grp STRING) RETURNS TABLE ({_ddl(STATE)}) "
        f"RETURN SELECT {_columns(STATE)} FROM `{schema}`.`state` WHERE workspace_name = workspace AND group_name = grp"
    )
    return f"{schema}.state", f"{schema}__group_state"
