"""Which rows can meet a list of keys at all, told by a bitmap of key hashes before any row moves.

A key's place is made of the first BITS bits of its hash. The bitmap of a list of keys has a bit for every place;
all of it takes 16 MB and is broadcast, however long the list. A row whose bit is not set meets none of the
keys; one whose bit is set may, which an exact join of these rows alone decides. With 0.05 keys per place one
row in twenty is joined in vain; the more keys, the more rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.functions.digest import row_hash

# Bits of a hash that make a place; bits of a word; words in one row of a bitmap.
BITS = 27
WORD = 64
WORDS = 64


def usable(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """Do equal keys of two sides have equal hashes? Not where types differ or a collation ignores differences."""
    kinds = [[df.schema[k].dataType.json() for k in keys] for df in (a, b)]
    return kinds[0] == kinds[1] and not any("collate" in df.schema[k].dataType.simpleString() for df in (a, b) for k in keys)


def place(df: DataFrame, keys: list[str]) -> Column:
    return F.shiftrightunsigned(row_hash(df, sorted(keys)), 64 - BITS)


def bitmap(places: DataFrame) -> DataFrame:
    """The bitmap of all values of the column ``place``."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("place") % WORD).cast("int"))
    words = places.groupBy(F.expr(f"place div {WORD}").alias("word")).agg(F.bit_or(bit).alias("bits"))
    entry = F.struct((F.col("word") % WORDS).cast("int").alias("i"), "bits")
    rows = words.groupBy(F.expr(f"word div {WORDS}").alias("_marks_row")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("held")
    )
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(WORDS - 1)),
        lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("bigint")),
    )
    return rows.select("_marks_row", filled.alias("_marks_words"))


def bitmap_of(named: DataFrame, keys: list[str]) -> DataFrame:
    return bitmap(named.select(place(named, keys).alias("place")))


def _set(df: DataFrame, keys: list[str]) -> Column:
    at = place(df, keys)
    word = F.col("_marks_words")[(F.shiftright(at, 6) % WORDS).cast("int")]
    return (F.shiftright(at, 12) == F.col("_marks_row")) & (F.getbit(word, (at % WORD).cast("int")) == 1)


def hit(df: DataFrame, keys: list[str], marks: DataFrame) -> DataFrame:
    """The rows whose key may be among those of a bitmap."""
    return df.join(F.broadcast(marks), _set(df, keys), "left_semi")


def missed(df: DataFrame, keys: list[str], marks: DataFrame) -> DataFrame:
    """The rows whose key is not among those of a bitmap: all that ``hit`` leaves out."""
    return df.join(F.broadcast(marks), _set(df, keys), "left_anti")
