"""Reproducible sample rows."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The characters of a generated name and its length.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
NAME_LENGTH = 10


def _digits(text: Column, start: int, length: int) -> Column:
    """A slice of an md5 text as a number."""
    return F.conv(F.substring(F.md5(text), start, length), 16, 10).cast("bigint")


def sample_rows(ids: DataFrame, seed: int = 0, id_col: str = "id") -> DataFrame:
    """``(id, name, value)`` for every id: ten random alphanumerics and 1..100.

    Values come from a digest of seed and id, so a retried task, another
    partitioning or another cluster produces the same rows.
    """
    key = F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))
    letters = [
        F.substring(F.lit(ALPHABET), (_digits(key, 1 + 3 * i, 3) % len(ALPHABET) + 1).cast("int"), 1)
        for i in range(NAME_LENGTH)
    ]
    value = _digits(F.concat(key, F.lit(":value")), 1, 8) % 100 + 1
    return ids.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.concat(*letters).alias("name"),
        value.alias("value"),
    )


def generate_raw(spark: SparkSession, n: int = 100, seed: int = 0) -> DataFrame:
    return sample_rows(spark.range(n), seed)
