"""Incremental file ingestion with archiving of what was committed."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lockstep.plans.medallion import merge_files, parse_files
from lockstep.sources import snapshots
from lockstep.sources.files import FILE_SCHEMA, with_file_columns


def landed(
    spark: SparkSession,
    landing: str,
    workspace_name: str,
    archive_dir: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Stream of landed files, each read once.

    With ``archive_dir`` a file is moved there after a later batch has committed, so
    only files that were ingested ever move; the last batch's files wait for the next
    run.
    """
    reader = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True)
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if archive_dir is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    return with_file_columns(reader.load(landing), workspace_name)


def ingest_stream(files: DataFrame, bronze_dir: str, checkpoint: str) -> DataFrame:
    """Append everything landed so far to a bronze folder, exactly once per file, and stop."""
    query = (
        files.writeStream.format("parquet")
        .option("path", bronze_dir)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return files.sparkSession.read.schema(files.schema).parquet(bronze_dir)


def marker(batch: DataFrame, batch_id: int) -> dict[str, str]:
    """What tells a batch apart: the id that Spark keeps in the stream's checkpoint, and its own.

    Two streams never share an id, nor do a stream and its successor with a new checkpoint.
    """
    stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return {"stream": stream, "batchId": str(batch_id)}


def applied(spark: SparkSession, root: str, table: str, mark: dict[str, str]) -> bool:
    """Has this table already committed this batch?"""
    log = snapshots.commits_of(spark, root, table)
    parameters = log["operation_parameters"]
    same = [parameters[key] == value for key, value in mark.items()]
    return not log.filter(same[0] & same[1]).isEmpty()


def run_batches(
    stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]
) -> None:
    """Hand every waiting micro-batch to ``handle`` and stop."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_files_stream(
    files: DataFrame,
    root: str,
    tables: dict[str, str],
    checkpoint: str,
    clock: Callable[[], int] = snapshots.now_millis,
) -> None:
    """Landed files to bronze, silver and gold, batch by batch.

    A batch replayed after a failure on the same checkpoint is recognised in the gold commit and not
    merged twice. Under a new checkpoint everything that has landed is merged again, by file name.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = marker(batch, batch_id)
        if applied(spark, root, tables["gold"], mark):
            return
        now = clock()
        snapshots.publish(batch, root, tables["bronze"], at_ms=now)
        bronze = snapshots.read(spark, root, tables["bronze"])
        snapshots.publish(parse_files(bronze), root, tables["silver"], at_ms=now)
        silver = snapshots.read(spark, root, tables["silver"])
        merge_files(spark, root, tables["gold"], silver, now, mark)

    run_batches(files, checkpoint, handle)
