"""Landing-zone files."""

import threading
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.sources.paths import any_file, move

# Columns of the built-in binaryFile source.
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def has_files(spark: SparkSession, directory: str) -> bool:
    """Is anything waiting? However many files are, only the first is looked at."""
    return any_file(spark, directory)


def with_file_columns(files: DataFrame, workspace_name: str) -> DataFrame:
    """Add modification time, file name and workspace to scanned files."""
    return files.withColumns(
        {
            "file_modified_time": F.col("modificationTime"),
            "file_name": F.col("_metadata.file_path"),
            "workspace_name": F.lit(workspace_name),
        }
    )


def ingest_files(spark: SparkSession, directory: str, workspace_name: str) -> DataFrame:
    """Every landed file as one row with its content and file metadata."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return with_file_columns(files, workspace_name)


# Renames under way at a time, and names that wait for one.
MOVERS = 32
WAITING = 1000


def archive(files: DataFrame, landing: str, archive_dir: str, movers: int = MOVERS) -> int:
    """Move ingested files (column file_name) to the archive, below the folders they had in the
    landing zone; returns how many. Renames touch no data and run ``movers`` at a time; names stream
    through the driver, of which it holds ``WAITING``. A file that is gone counts as moved before. A
    failed rename ends the call with its error, after those under way; a later call moves the rest."""
    spark = files.sparkSession
    room, failed = threading.Semaphore(WAITING), threading.Event()

    def names():
        for row in files.select("file_name").toLocalIterator():
            room.acquire()
            if failed.is_set():
                return
            yield row["file_name"]

    def one(name: str) -> int | Exception:
        try:
            return 0 if failed.is_set() else move(spark, name, landing, archive_dir)
        except Exception as error:
            failed.set()
            room.release(WAITING)  # so that no name waits on
            return error
        finally:
            room.release()

    moved, errors = 0, []
    with ThreadPool(movers) as pool:
        for done in pool.imap_unordered(one, names()):
            if isinstance(done, Exception):
                errors.append(done)
            else:
                moved += done
    if errors:
        raise errors[0]
    return moved
