"""The sample pipelines: landed files and generated rows, each to a gold table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.functions.times import at_millis
from lockstep.model import GOLD
from lockstep.operators.generate import sample_rows
from lockstep.operators.merge import assign_counter, next_counter
from lockstep.sources import snapshots
from lockstep.sources.files import archive, has_files, ingest_files


def parse_files(bronze: DataFrame) -> DataFrame:
    """Silver: whole content as text, and the modification time to the second."""
    return bronze.select(
        "file_name",
        F.col("content").cast("string").alias("parsed_data"),
        F.date_trunc("second", "file_modified_time").alias("parsed_time"),
        "workspace_name",
    )


def merge_files(
    spark: SparkSession,
    root: str,
    table: str,
    silver: DataFrame,
    now_ms: int,
    parameters: dict[str, str] | None = None,
) -> int:
    """Gold: number the silver rows after the highest counter, then upsert by file name."""
    snapshots.ensure(spark, root, table, GOLD, now_ms)
    gold = snapshots.read(spark, root, table)
    start = next_counter(gold, "merge_counter")
    batch = assign_counter(silver, ["file_name"], start, "merge_counter").withColumn(
        "merge_time", at_millis(F.lit(now_ms))
    )
    return snapshots.merge(batch.select(*GOLD.names), root, table, ["file_name"], now_ms, parameters)


def run_files(
    spark: SparkSession,
    landing: str,
    root: str,
    tables: dict[str, str],
    workspace_name: str,
    now_ms: int | None = None,
    archive_dir: str | None = None,
) -> bool:
    """Landed files to bronze, silver and gold in one batch; False when none are waiting.

    Each step reads the published table of the one before, so all three agree on the
    same files even when more arrive meanwhile. With ``archive_dir`` the files of the bronze
    table move there once gold is published; later ones stay for the next run.
    """
    if not has_files(spark, landing):
        return False
    now = snapshots.now_millis() if now_ms is None else now_ms
    snapshots.publish(ingest_files(spark, landing, workspace_name), root, tables["bronze"], at_ms=now)
    bronze = snapshots.read(spark, root, tables["bronze"])
    snapshots.publish(parse_files(bronze), root, tables["silver"], at_ms=now)
    merge_files(spark, root, tables["gold"], snapshots.read(spark, root, tables["silver"]), now)
    if archive_dir is not None:
        archive(bronze, landing, archive_dir)
    return True


def to_silver(raw: DataFrame, column: str = "value", minimum: int = 50) -> DataFrame:
    """Rows whose value exceeds a threshold."""
    return raw.filter(F.col(column) > minimum)


def to_gold(silver: DataFrame, key: str = "name") -> DataFrame:
    """Rows per key."""
    return silver.groupBy(key).count()


def run_tables(ids: DataFrame, root: str, tables: dict[str, str], seed: int = 0) -> None:
    """Generated rows to raw, silver and gold tables, one row per given id."""
    spark = ids.sparkSession
    snapshots.publish(sample_rows(ids, seed), root, tables["raw"])
    snapshots.publish(to_silver(snapshots.read(spark, root, tables["raw"])), root, tables["silver"])
    snapshots.publish(to_gold(snapshots.read(spark, root, tables["silver"])), root, tables["gold"])
