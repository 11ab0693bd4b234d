"""Row digests that agree exactly when rows agree, NULLs and nesting included."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _hashable(col: Column, dtype: T.DataType) -> Column:
    """Rewrite a value so that hashing sees its NULLs and its maps.

    xxhash64 skips NULLs, which makes (NULL, 'a') and ('a', NULL) collide, and it
    rejects maps. Every nullable level gets an is-null flag; maps become sorted
    entry arrays.
    """
    flag = F.isnull(col)
    if isinstance(dtype, T.StructType):
        fields = [_hashable(col[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(dtype)]
        return F.struct(flag.alias("n"), *fields)
    if isinstance(dtype, T.ArrayType):
        items = F.transform(col, lambda x: _hashable(x, dtype.elementType))
        return F.struct(flag.alias("n"), F.size(col).alias("s"), items.alias("v"))
    if isinstance(dtype, T.MapType):
        entry = T.StructType(
            [T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)]
        )
        items = F.transform(F.map_entries(col), lambda e: _hashable(e, entry))
        return F.struct(flag.alias("n"), F.size(col).alias("s"), F.array_sort(items).alias("v"))
    return F.struct(flag.alias("n"), col.alias("v"))


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """64-bit digest of the given columns (all columns, in name order, by default)."""
    names = sorted(df.columns) if columns is None else columns
    flat: list[Column] = []
    for name in names:
        dtype = df.schema[name].dataType
        if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
            flat.append(_hashable(F.col(name), dtype))
        else:
            flat += [F.isnull(F.col(name)), F.col(name)]
    return F.xxhash64(*flat)


DIGEST = ["n", "hx", "s0", "s1", "s2"]


def digest_aggregates(hash_col: str) -> list[Column]:
    """Count, xor and sums of row digests, all in 64-bit hash-aggregate buffers.

    xor alone cancels equal pairs, so the digest's low 60 bits are also summed, in
    three 20-bit slices: a slice sum stays exact up to 2**43 rows per group.
    """
    h = F.col(hash_col)
    return [
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(h).alias("hx"),
        *[F.sum(s).alias(f"s{i}") for i, s in enumerate(_slices(h))],
    ]


def _slices(h: Column) -> list[Column]:
    mask = F.lit((1 << 20) - 1).cast("bigint")
    return [F.shiftright(h, 20 * i).bitwiseAND(mask) for i in range(3)]


def digests_differ(hash_col: str, src: Column) -> Column:
    """As an aggregate over the rows of two sides: do the digests of those with ``src`` and of the others differ?"""
    h = F.col(hash_col)
    apart = [F.sum(F.when(src, s).otherwise(-s)) != 0 for s in _slices(h)]
    return (F.count_if(src) != F.count_if(~src)) | (F.bit_xor(h) != 0) | apart[0] | apart[1] | apart[2]
