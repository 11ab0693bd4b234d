"""Sharding by a hierarchical weighted hash tree.

A row descends from the root to a region, a rack and a shard. At each node it draws one
number u per child from a hash of its key and the child's path, and takes the child with the
least -ln(u) / weight, so that children are taken in proportion to their weights. A child's
draw depends on nothing but the key, its own path and its own weight: rows move only
out of or into subtrees whose weights change, and stay where they are in all others.

A shard that is added as a region of its own takes rows only into itself, since no other weight
changes. That is what grow() does, and why the law of the query is `key`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockstep.llm.common import as_key, hexdraw, hexdraw_sql, settle, small, table

# Rows of a shard are numbered in this many parts, so that no task sees a whole shard.
SLICES = 256
SHARDS, RACKS, SHARDS_PER_RACK = 24, 3, 2
# Counts of (shard, slice) are broadcast up to this many rows.
OFFSET_ROWS = 100_000


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int = SHARDS, racks: int = RACKS, per_rack: int = SHARDS_PER_RACK) -> list[Leaf]:
    """Shards numbered from 0, filled into racks and regions in order."""
    return [Leaf(s // (racks * per_rack), s // per_rack % racks, s) for s in range(shards)]


def grow(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, as a region of its own."""
    region = max((leaf.region for leaf in leaves), default=-1) + 1
    return [*leaves, Leaf(region, 0, max((leaf.shard for leaf in leaves), default=-1) + 1, weight)]


def _levels(leaves: list[Leaf]) -> tuple[dict, dict, dict]:
    """Weights of regions, of the racks in each and of the shards in each rack."""
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    shards: dict[tuple[int, int], dict[int, float]] = {}
    for leaf in leaves:
        if leaf.weight <= 0:
            continue
        regions[leaf.region] = regions.get(leaf.region, 0.0) + leaf.weight
        at = racks.setdefault(leaf.region, {})
        at[leaf.rack] = at.get(leaf.rack, 0.0) + leaf.weight
        shards.setdefault((leaf.region, leaf.rack), {})[leaf.shard] = leaf.weight
    return regions, racks, shards


def _draw(key: Column, path: str, children: dict[int, float]) -> Column:
    if len(children) == 1:
        return F.lit(next(iter(children)))
    costs = [
        F.struct(-F.log(hexdraw(key, f"{path}{child}")) / F.lit(weight), F.lit(child).alias("child"))
        for child, weight in children.items()
    ]
    return F.array_min(F.array(*costs))["child"]


def _choice(cases: list[tuple[Column, Column]]) -> Column:
    chosen = F.lit(None).cast("int")
    for condition, value in reversed(cases):
        chosen = F.when(condition, value).otherwise(chosen)
    return chosen


def assign(rows: DataFrame, key: str, leaves: list[Leaf], out: str = "shard") -> DataFrame:
    """rows with one more column, the shard that the key column's value descends to.

    A null key is a key like any other. Rows with equal keys share a shard. The column that
    is added replaces one of the same name.
    """
    regions, racks, shards = _levels(leaves)
    k, region, rack = as_key(F.col(key)), "__region", "__rack"
    rows = rows.withColumn(region, _draw(k, "g", regions))
    rows = rows.withColumn(
        rack, _choice([(F.col(region) == g, _draw(k, f"g{g}r", at)) for g, at in racks.items()])
    )
    by_shard = [
        ((F.col(region) == g) & (F.col(rack) == r), _draw(k, f"g{g}r{r}s", at))
        for (g, r), at in shards.items()
    ]
    return rows.withColumn(out, _choice(by_shard)).drop(region, rack)


def number(rows: DataFrame) -> DataFrame:
    """slot: position in the shard, gapless from 0, in the order of slice, key and the rest.

    rows has shard, a doc_id and columns size, text_crc32. Equal rows are first counted
    together, so that a key that a third of all rows hold is one row here; slices of a shard are
    numbered apart and shifted by the counts of the slices before.
    """
    ids = ["doc_id", "size", "text_crc32"]
    others = [c for c in rows.columns if c not in ids and c != "shard"]
    digits = F.md5(F.concat_ws("/", as_key(F.col("doc_id")), F.lit("slot")).cast("binary"))
    rows = rows.withColumn("slice", F.conv(F.substring(digits, 1, 2), 16, 10).cast("int"))
    equal = settle(rows.groupBy("shard", "slice", *ids, *others).agg(F.count("*").alias("n")))
    sizes = settle(equal.groupBy("shard", "slice").agg(F.sum("n").alias("total")))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "shard", "slice", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start")
    )
    inside = (
        Window.partitionBy("shard", "slice").orderBy(*ids).rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = equal.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    placed = placed.join(small(settle(starts), OFFSET_ROWS), ["shard", "slice"])
    first = F.col("start") + F.col("ahead")
    slots = F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot")
    return placed.select(*ids, "shard", *others, slots)


def shard(docs: DataFrame, leaves: list[Leaf]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs.

    docs: doc_id and text; other columns are ignored, whatever their names. A null text counts
    as empty (size 8, crc 0), a null doc_id as one more key. Repeated rows share a shard and
    get a slot each. No rows give no rows.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select(
        "doc_id",
        (F.octet_length(body) + 8).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    placed = assign(assign(light, "doc_id", leaves), "doc_id", grow(leaves), "grown_shard")
    return number(placed.withColumn("law", F.lit("key"))).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place among 24 shards, and with one shard more."""
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"), tree())


# --- the same in SQL -------------------------------------------------------------------


def _draw_sql(path: str, children: dict[int, float]) -> str:
    if len(children) == 1:
        return str(next(iter(children)))
    draws = ", ".join(
        f"{{'c': -ln({hexdraw_sql(f"k || '/{path}{child}'")}) / {weight}, 'child': {child}}}"
        for child, weight in children.items()
    )
    return f"list_min([{draws}]).child"


def _levels_sql(leaves: list[Leaf], region: str, rack: str, out: str) -> tuple[str, str, str]:
    regions, racks, shards = _levels(leaves)
    in_region = " ".join(f"when {region} = {g} then {_draw_sql(f'g{g}r', at)}" for g, at in racks.items())
    in_rack = " ".join(
        f"when {region} = {g} and {rack} = {r} then {_draw_sql(f'g{g}r{r}s', at)}"
        for (g, r), at in shards.items()
    )
    return f"{_draw_sql('g', regions)} as {region}", f"case {in_region} end as {rack}", f"case {in_rack} end as {out}"


def shard_sql(source: str, leaves: list[Leaf]) -> str:
    """DuckDB's form of shard(); source: a table with doc_id and text."""
    a, b = _levels_sql(leaves, "ga", "ra", "shard"), _levels_sql(grow(leaves), "gb", "rb", "grown_shard")
    crc_table = (
        "list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], "
        "lambda c, i: xor(c >> 1, 3988292384 * (c & 1))))"
    )
    return f"""
with docs as (
  select doc_id, coalesce(text, '') as body, coalesce(doc_id::varchar, 'null') as k from {source}),
bytes as (
  select *, hex(encode(body)) as h, {crc_table} as crcs from docs),
checked as (
  select doc_id, k, strlen(body) + 8 as size,
    xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(body)),
          lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
        lambda c, x: xor(c >> 8, crcs[xor(c & 255, x) + 1])), 4294967295) as text_crc32
  from bytes),
l1 as (select *, {a[0]}, {b[0]} from checked),
l2 as (select *, {a[1]}, {b[1]} from l1),
l3 as (select *, {a[2]}, {b[2]}, ('0x' || substr(md5(k || '/slot'), 1, 2))::BIGINT as slice from l2)
select doc_id, size::BIGINT as size, text_crc32::BIGINT as text_crc32, 'key' as law, shard,
  row_number() over (partition by shard order by slice, doc_id nulls first, size, text_crc32) - 1 as slot,
  grown_shard
from l3"""


ORACLE = shard_sql("documents", tree())
