"""Where things lie, and questions about paths that a scan would answer too slowly."""

from pyspark.sql import SparkSession

from lockstep.functions.names import split_name


def table_dir(root: str, table: str) -> str:
    return "/".join([root.rstrip("/"), *split_name(table)])


def version_dir(root: str, table: str, version: int) -> str:
    return f"{table_dir(root, table)}/v={version}"


def _locate(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _locate(spark, path)
    return fs.exists(where)


def any_file(spark: SparkSession, directory: str) -> bool:
    """Is there a visible file below a directory? Stops listing at the first one."""
    fs, where = _locate(spark, directory)
    listing = fs.listFiles(where, True)
    while listing.hasNext():
        if not listing.next().getPath().getName().startswith(("_", ".")):
            return True
    return False


def size(spark: SparkSession, paths: list[str]) -> int:
    """Total bytes of the data files below some paths, from file metadata alone."""
    total = 0
    for path in paths:
        fs, where = _locate(spark, path)
        listing = fs.listFiles(where, True)
        while listing.hasNext():
            file = listing.next()
            if file.getPath().getName().endswith(".parquet"):
                total += file.getLen()
    return total


def move(spark: SparkSession, file: str, below: str, to: str) -> int:
    """Move a file from below one folder to the same place below another; 1 if it was there."""
    fs, source = _locate(spark, file)
    root = fs.makeQualified(_locate(spark, below)[1]).toUri().getPath()
    target = _locate(spark, f"{to}/{source.toUri().getPath()[len(root):].lstrip('/')}")[1]
    if not fs.exists(source):
        return 0
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"could not move {file} to {target}")
    return 1
