"""Read config documents and flatten them to workspaces and groups."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep import scratch
from lockstep.model import CONFIG


def load(
    spark: SparkSession, path: str, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Workspaces and groups of the JSON documents at ``path``.

    ``multi_line=False`` reads one document per line, which stays splittable.
    """
    return flatten(spark.read.schema(CONFIG).option("multiLine", multi_line).json(path))


def parse(texts: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Workspaces and groups of JSON documents held in a text column."""
    return flatten(texts.select(F.from_json(column, CONFIG).alias("doc")).select("doc.*"))


def flatten(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unnest workspaces, then groups; a workspace without groups keeps its row.

    The documents are read and parsed once, into the checkpoint folder, for both results.
    """
    scratch.checkpoint_root(documents.sparkSession)
    nested = documents.select("secret_scope", F.inline("workspaces")).checkpoint()
    workspaces = nested.drop("sync_groups")
    groups = nested.select("workspace_name", F.inline("sync_groups"))
    return workspaces, groups


def workspace(workspaces: DataFrame, name: str) -> DataFrame:
    """The one workspace of that name; empty when absent."""
    return workspaces.filter(F.col("workspace_name") == name)
