"""Append-only parquet logs of control rows."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from lockstep.functions.pruning import DAY, LOG_COLUMNS, PART, dealt
from lockstep.model import INT, LONG, MEMBERS, STRING, STRING_MAP, TIME
from lockstep.sources.paths import exists

_ARROW = {
    STRING: pa.string(),
    LONG: pa.int64(),
    INT: pa.int32(),
    TIME: pa.timestamp("us", tz="UTC"),
    STRING_MAP: pa.map_(pa.string(), pa.string()),
    MEMBERS: pa.list_(pa.struct([("table_name", pa.string()), ("version", pa.int64())])),
}


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a log; none when nothing was written yet."""
    if exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def append_log(df: DataFrame, path: str) -> None:
    """Append a small batch as one file, which makes it visible in one rename."""
    df.coalesce(1).write.mode("append").parquet(path)


def read_dealt(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a log that ``append_dealt`` wrote, with its partition columns."""
    return read_log(spark, path, T.StructType([*schema, *T.StructType.fromDDL(LOG_COLUMNS)]))


def append_dealt(df: DataFrame, path: str, ms: Column, about: Column, small: bool = True) -> None:
    """Append rows by day and by what they are about: one file per day and part, if the batch is small.

    Each file becomes visible in one rename; files of one batch one after the other.
    """
    rows = dealt(df, ms, about)
    rows = rows.coalesce(1) if small else rows.repartition(DAY, PART)
    rows.write.mode("append").partitionBy(DAY, PART).parquet(path)


def small_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """Control rows held by the driver as a DataFrame, handed over as Arrow columns."""
    columns = []
    for i, field in enumerate(schema):
        values = [row[i] for row in rows]
        if isinstance(field.dataType, T.MapType):
            values = [None if v is None else list(v.items()) for v in values]
        columns.append(pa.array(values, _ARROW[field.dataType]))
    return spark.createDataFrame(pa.table(columns, names=schema.names), schema)
