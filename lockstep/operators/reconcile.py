"""Compare two copies of a table by bucket digest, then by key."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.functions.digest import DIGEST, digest_aggregates, row_hash

MAX_BUCKETS = 65_536


def bucket_of(df: DataFrame, keys: list[str], buckets: int) -> Column:
    return F.pmod(row_hash(df, keys), F.lit(buckets)).cast("int")


def bucket_digests(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Row count and digest per bucket: one pass, partially aggregated."""
    if not 1 <= buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be between 1 and {MAX_BUCKETS}")
    return (
        df.select(bucket_of(df, keys, buckets).alias("bucket"), row_hash(df).alias("_h"))
        .groupBy("bucket")
        .agg(*digest_aggregates("_h"))
    )


def unequal(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests disagree or exist on one side only; NULL keys compare equal."""
    a = left.select(*keys, F.struct(*DIGEST).alias("src")).alias("a")
    b = right.select(*keys, F.struct(*DIGEST).alias("dst")).alias("b")
    pairs = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    return pairs.filter(~F.col("src").eqNullSafe(F.col("dst"))).select(
        *[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys],
        F.coalesce("src.n", F.lit(0)).alias("src_rows"),
        F.coalesce("dst.n", F.lit(0)).alias("dst_rows"),
    )


def diff(src: DataFrame, dst: DataFrame, keys: list[str], buckets: int = 1024) -> DataFrame:
    """Buckets whose contents differ, with the row count on each side."""
    return unequal(
        bucket_digests(src, keys, buckets), bucket_digests(dst, keys, buckets), ["bucket"]
    )


def diff_keys(src: DataFrame, dst: DataFrame, keys: list[str], buckets: int = 1024) -> DataFrame:
    """Keys whose rows differ, looking only inside differing buckets.

    Key digests are taken as a bag of rows, so repeated keys are compared whole.
    The list of differing buckets has at most ``buckets`` rows (limited by
    ``MAX_BUCKETS``), which bounds its broadcast.
    """
    suspects = F.broadcast(diff(src, dst, keys, buckets).select("bucket"))

    def by_key(df: DataFrame) -> DataFrame:
        hashed = df.select(
            *keys, bucket_of(df, keys, buckets).alias("bucket"), row_hash(df).alias("_h")
        )
        narrowed = hashed.join(suspects, "bucket", "left_semi")
        return narrowed.groupBy(*keys).agg(*digest_aggregates("_h"))

    return unequal(by_key(src), by_key(dst), keys)
