"""JSON codec of the per-table copy metrics kept in the control table.

The text is an array of one-key maps, ``[{"c.s.t": {"metrics": {...}}}]``. It is
always parsed with string values, because the version is a number on the source
side and text on the target side.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.model import GROUP_KEY, METRICS_TYPE

VALUES = ["sync_commit_timestamp", "sync_commit_version", "source_table_size"]


def encode_metrics(copies: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One JSON text per group from one row per (group, position, table).

    NULL values are left out, so a scheduled group carries only its size. The
    collected list is one group's declared tables, never data rows.
    """
    ordered = F.array_sort(
        F.collect_list(F.struct("position", "table_name", F.struct(*values).alias("m")))
    )
    as_maps = F.transform(
        ordered,
        lambda e: F.create_map(e["table_name"], F.struct(e["m"].alias("metrics"))),
    )
    return copies.groupBy(*GROUP_KEY).agg(F.to_json(as_maps).alias(column))


def entries(text: Column) -> Column:
    """Metrics text as an array of (key, value.metrics) structs."""
    return F.flatten(F.transform(F.from_json(text, METRICS_TYPE), F.map_entries))


def metric(entry: Column, name: str) -> Column:
    return entry["value"]["metrics"][name].try_cast("bigint")


def flatten_metrics(state: DataFrame, column: str) -> DataFrame:
    """One row per (group, table) found in a metrics column."""
    return (
        state.filter(F.col(column).isNotNull())
        .select(*GROUP_KEY, F.explode(entries(F.col(column))).alias("entry"))
        .select(
            *GROUP_KEY,
            F.col("entry.key").alias("table_name"),
            *[metric(F.col("entry"), v).alias(v) for v in VALUES],
        )
    )
