"""Mixing sources to target weights.

Tokens are summed per source, targets and from them repetition rates derived, and each document is
taken floor(rate) times plus once more if a number drawn from a hash of its id falls below
the fraction. The draw needs no state, so a rerun takes the same copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.llm.common import WORD, as_key, hexdraw, hexdraw_sql, settle, shielded, small, table

MOST = 3
WEIGHTS = (5, 2, 1)
SEED = "mix"
# The rates are broadcast up to this many sources, and joined by shuffling beyond.
RATE_ROWS = 50_000


def n_words(text="text"):
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def weights_in_order(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources with a weight each, repeating in code point order, null last.

    Ranks come from ordered ranges that are numbered apart and shifted by what lies before them.
    """
    last = F.col("source").isNull()
    ranges = settle(
        sources.repartitionByRange(last, F.col("source"))
        .sortWithinPartitions(last, F.col("source"))
        .select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i"))
    )
    counts = {r["__p"]: r["n"] for r in ranges.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    starts, before = {}, 0
    for p in sorted(counts):
        starts[p], before = before, before + counts[p]
    inside = F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    start = F.lit(0).cast("bigint")
    for p, s in starts.items():
        start = F.when(F.col("__p") == p, F.lit(s)).otherwise(start)
    weight = F.element_at(
        F.array(*map(F.lit, weights)), ((start + inside) % len(weights) + 1).cast("int")
    )
    return ranges.select(*sources.columns, weight.cast("bigint").alias("weight"))


def rates(sources: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target, rate; sources: source, source_size, weight, one row each.

    A target is the source's share by weight of all sizes, but at most `most` times its size;
    the excess is shared again by weight among the others until none is above. Only sums over
    the sources reach the driver, one row per round.
    """
    wide = "decimal(38,0)"
    cap = (F.col("source_size") * most).cast(wide)
    total, weight = sources.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))
    ).first()
    rest, open_weight, stopped = total, weight, -1
    while True:
        above = F.lit(rest).cast(wide) * F.col("weight") > cap * F.lit(open_weight).cast("decimal(19,0)")
        n, size, used = sources.where(above).agg(
            F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))
        ).first()
        if n == stopped or used == weight:
            break
        stopped, rest, open_weight = n, total - most * size, weight - used
    shared = (F.lit(rest) * F.col("weight")).cast("double") / F.lit(float(open_weight or 1))
    target = F.when(above, cap.cast("double")).otherwise(shared)
    return sources.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def source_rates(light: DataFrame, most: int = MOST) -> DataFrame:
    """rates() for rows of source and size, with the weights that repeat in order."""
    sources = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    return small(settle(rates(settle(weights_in_order(sources)), most)), RATE_ROWS)


def _joined(rows: DataFrame, rated: DataFrame) -> DataFrame:
    named = rated.select(
        F.col("source").alias("__source"), F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"), F.col("rate").alias("__rate"),
    )
    return rows.join(named, F.col("source").eqNullSafe(F.col("__source")))


def _copies(*key):
    draw = hexdraw(SEED, *key)
    return F.floor("__rate") + F.when(draw < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)


def take(light: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for rows of doc_id, source and size.

    A null source is a source of its own, a null doc_id an id like any other. Rows alike in all
    three are counted together and draw as first, second, ... of their kind. No rows give no rows.
    """
    rated = source_rates(light)
    alike = light.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    each = alike.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("nth")).drop("n")
    copies = _copies(as_key(F.col("doc_id")), F.col("nth").cast("string"))
    return _joined(each, rated).select(
        "doc_id", "size", F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("size") * copies).cast("bigint").alias("taken"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, text and any others) with each row as often as its rate says.

    The columns stay as they are, whatever the names of the others. Rows with the same doc_id draw the same number.
    """
    docs, back = shielded(docs, ["doc_id", "source", "text"])
    light = docs.select("source", n_words().alias("size"))
    copies = _copies(as_key(F.col("doc_id")), "1")
    repeated = _joined(docs, source_rates(light)).withColumn("__copies", copies.cast("int"))
    repeated = repeated.where("__copies > 0").select(
        *docs.columns, F.explode(F.sequence(F.lit(1), "__copies")).alias("__copy")
    )
    return back(repeated.drop("__copy"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes from each, in words."""
    docs = table(spark, sf_dir, "documents")
    return take(docs.select("doc_id", "source", n_words().alias("size")))


# --- the same in SQL -------------------------------------------------------------------


def rates_sql(light: str) -> str:
    """DuckDB's form of source_rates, as a list of common table expressions; the last is rated."""
    return f"""
sources as (select source, sum(size)::HUGEINT as source_size from {light} group by source),
ranked as (select *, row_number() over (order by source nulls last) - 1 as pos from sources),
weighted as (select *, case pos % 3 when 0 then 5 when 1 then 2 else 1 end::HUGEINT as weight from ranked),
filled as (
  select *, sum(source_size) over () as total, sum(weight) over () as weights,
    coalesce(sum({MOST} * source_size) over (order by {MOST}.0 * source_size / weight, pos
      rows between unbounded preceding and 1 preceding), 0) as caps,
    coalesce(sum(weight) over (order by {MOST}.0 * source_size / weight, pos
      rows between unbounded preceding and 1 preceding), 0) as used
  from weighted),
level as (
  select (total - caps)::HUGEINT as rest, (weights - used)::HUGEINT as open_weight from filled
  where (total - caps) * weight <= {MOST} * source_size * (weights - used)
  order by used limit 1),
rated as (
  select source, source_size::BIGINT as source_size, case when rest * weight > {MOST} * source_size * open_weight
    then ({MOST} * source_size)::DOUBLE else (rest * weight)::DOUBLE / open_weight::DOUBLE end as target,
    case when source_size > 0 then (case when rest * weight > {MOST} * source_size * open_weight
    then ({MOST} * source_size)::DOUBLE else (rest * weight)::DOUBLE / open_weight::DOUBLE end)
      / source_size::DOUBLE else 0 end as rate
  from weighted, level)"""


def words_sql(text: str = "text") -> str:
    return f"coalesce(len(regexp_extract_all({text}, '{WORD}')), 0)"


def copies_sql(nth: str = "1") -> str:
    drawn = hexdraw_sql(f"'{SEED}/' || coalesce(doc_id::varchar, 'null') || '/' || {nth}")
    return f"floor(rate)::BIGINT + case when {drawn} < rate - floor(rate) then 1 else 0 end"


ORACLE = f"""
with light as (select doc_id, source, {words_sql()}::BIGINT as size from documents),
{rates_sql("light")},
each as (select *, row_number() over (partition by doc_id, source, size) as nth from light)
select doc_id, size, source_size, target, (size * ({copies_sql("nth")}))::BIGINT as taken
from each join rated on each.source is not distinct from rated.source"""
