"""Three-part table names."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_name(table: str) -> tuple[str, str, str]:
    parts = table.split(".")
    if len(parts) != 3 or not all(parts):
        raise ValueError(f"table name must be catalog.schema.table: {table!r}")
    return parts[0], parts[1], parts[2]


def is_qualified(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[^.]+\.[^.]+\.[^.]+$"), F.lit(False))


def qualify(df: DataFrame, name: str = "table_name", location: str = "") -> DataFrame:
    """Add ``catalog``, ``schema``, ``table`` and the storage ``path`` of each name.

    A name without exactly three parts fails the query instead of yielding NULLs.
    """
    parts = F.when(is_qualified(F.col(name)), F.split(F.col(name), r"\.")).otherwise(
        F.raise_error(
            F.concat(
                F.lit("table name must be catalog.schema.table: "),
                F.coalesce(F.col(name), F.lit("NULL")),
            )
        ).cast("array<string>")
    )
    return (
        df.withColumn("_parts", parts)
        .withColumns(
            {
                "catalog": F.element_at("_parts", 1),
                "schema": F.element_at("_parts", 2),
                "table": F.element_at("_parts", 3),
                "path": F.concat_ws("/", F.lit(location), F.concat_ws("/", F.col("_parts"))),
            }
        )
        .drop("_parts")
    )
