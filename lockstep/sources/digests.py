"""Digest trees of table versions, kept beside the table.

A row falls into a node of level k by the first k hexadecimal digits of its keys' hash. A tree has one
digest for every node from the root down to leaves of about LEAF_ROWS rows, so leaves stay
small at any size of the table. The tree of a version is built in one pass when it is first
asked for; versions don't change, so later comparisons read the tree in place of the table. Trees
of any depth compare on the levels that both have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.functions.digest import DIGEST, digest_aggregates, digests_differ, row_hash
from lockstep.operators import marks
from lockstep.operators.reconcile import unequal
from lockstep.operators.skew import BROADCAST_ROWS
from lockstep.sources import snapshots
from lockstep.sources.paths import exists, table_dir

LEAF_ROWS = 4096
# Rows are matched in tasks of about so many, unless one leaf holds more, as it does where a key has very many rows.
MATCH_ROWS = 2_500_000
# Fixed value: digits of a 64-bit hash that a level may use.
MAX_LEVEL = 15

TREE = "level int, node bigint, n bigint, hx bigint, s0 bigint, s1 bigint, s2 bigint"


def node_of(key_hash: Column, level: int) -> Column:
    """The node of a level that a key hash falls into; the root is node 0."""
    if level == 0:
        return F.lit(0).cast("bigint")
    return F.shiftrightunsigned(key_hash, 64 - 4 * level)


def _depth(rows: int, leaf_rows: int) -> int:
    depth = 0
    while depth < MAX_LEVEL and rows > leaf_rows * 16**depth:
        depth += 1
    return depth


def build(df: DataFrame, keys: list[str], rows: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """level, node and digest of all nodes with rows, in one pass; rows: about how many df has."""
    depth = _depth(rows, leaf_rows)
    leaves = (
        df.select(node_of(row_hash(df, keys), depth).alias("leaf"), row_hash(df).alias("_h"))
        .groupBy("leaf")
        .agg(*digest_aggregates("_h"))
    )
    levels = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    node = F.expr(f"shiftrightunsigned(leaf, 4 * ({depth} - level))")
    sums = [F.sum(c).alias(c) for c in ("n", "s0", "s1", "s2")]
    nodes = levels.groupBy("level", node.alias("node")).agg(F.bit_xor("hx").alias("hx"), *sums)
    return nodes.select("level", "node", *DIGEST)


def _tree_dir(root: str, table: str, version: int, keys: list[str]) -> str:
    return f"{table_dir(root, table)}/_digests/{'+'.join(sorted(keys))}/version-{version}"


def tree(
    spark: SparkSession, root: str, table: str, version: int, keys: list[str], leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """The kept tree of a version; built and kept if this is the first time.

    A half-written tree has no success marker and is replaced.
    """
    path = _tree_dir(root, table, version, keys)
    if not exists(spark, f"{path}/_SUCCESS"):
        df = snapshots.read_version(spark, root, table, version)
        rows = snapshots.row_count(spark, root, table, version)
        found = build(df, sorted(keys), df.count() if rows is None else rows, leaf_rows)
        found.write.mode("overwrite").partitionBy("level").parquet(path)
    return spark.read.schema(TREE).parquet(path)


def _depth_of(kept: DataFrame) -> int:
    return kept.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]


def differing(src: DataFrame, dst: DataFrame) -> tuple[int, DataFrame]:
    """The deepest level that two trees share, and its nodes whose digests differ (node, src_rows, dst_rows).

    Level by level, only nodes below a differing one are compared.
    """
    depth = min(_depth_of(src), _depth_of(dst))

    def at(kept: DataFrame, level: int) -> DataFrame:
        return kept.filter(F.col("level") == level).select("node", *DIGEST)

    found = unequal(at(src, 0), at(dst, 0), ["node"])
    for level in range(1, depth + 1):
        above = found.select(F.col("node").alias("_above"))
        below = [
            at(kept, level).join(above, F.shiftrightunsigned("node", 4) == F.col("_above"), "left_semi")
            for kept in (src, dst)
        ]
        found = unequal(*below, ["node"])
    return depth, found


def diff_versions(
    spark: SparkSession,
    src: tuple[str, str, int],
    dst: tuple[str, str, int],
    keys: list[str],
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Keys whose rows differ between two versions, each a (root, table, version), with rows on both sides.

    Rows of a key are compared as a bag, NULL keys are equal. Neither table is read where the kept
    trees agree. Otherwise the rows in differing leaves are matched by key place and digest, which moves two numbers of a
    row, and only rows of places that then differ are grouped by key.
    """
    trees = [tree(spark, *side, keys, leaf_rows) for side in (src, dst)]
    depth, leaves = differing(*trees)
    leaves = leaves.select("node", (F.col("src_rows") + F.col("dst_rows")).alias("rows")).checkpoint()
    tables = [snapshots.read_version(spark, *side) for side in (src, dst)]
    n, rows, most = leaves.agg(F.count(F.lit(1)), F.sum("rows"), F.max("rows")).first()
    if n == 0:
        return _unequal_keys([df.limit(0) for df in tables], keys)
    if n <= BROADCAST_ROWS:
        tables = [_inside(df, keys, depth, leaves) for df in tables]
    else:
        rows = sum(kept.filter("level = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for kept in trees)
    if marks.usable(*tables, keys):
        tasks = -(-rows // MATCH_ROWS) if most <= MATCH_ROWS else 1
        suspects = marks.bitmap(_unequal_places(tables, keys, tasks)).checkpoint()
        tables = [marks.hit(snapshots.read_version(spark, *side), keys, suspects) for side in (src, dst)]
    return _unequal_keys(tables, keys)


def _inside(df: DataFrame, keys: list[str], depth: int, leaves: DataFrame) -> DataFrame:
    """The rows in some leaves."""
    marked = df.withColumn("_node", node_of(row_hash(df, sorted(keys)), depth))
    return marked.join(F.broadcast(leaves.select("node")), marked["_node"] == leaves["node"], "left_semi").drop("_node")


def _unequal_places(sides: list[DataFrame], keys: list[str], tasks: int) -> DataFrame:
    """Places of keys with a row digest that the two sides don't have equally often.

    With several tasks, rows are dealt to them before they are counted: few equal ones meet where they are read, and
    counting them there takes memory for all rows of a file. With one, copies are counted first, so that they don't move.
    """
    src, dst = [
        df.select(marks.place(df, keys).alias("place"), row_hash(df).alias("_h"), F.lit(n).cast("bigint").alias("_n"))
        for df, n in zip(sides, (1, -1))
    ]
    rows = src.union(dst)
    dealt = rows.repartition(tasks, "place", "_h") if tasks > 1 else rows
    counted = dealt.groupBy("place", "_h").agg(F.sum("_n").alias("_n"))
    return counted.filter(F.col("_n") != 0).select("place")


def _unequal_keys(sides: list[DataFrame], keys: list[str]) -> DataFrame:
    """As ``reconcile.unequal`` of both sides' digests by key, in one grouping."""
    src, dst = [df.select(*keys, row_hash(df).alias("_h"), F.lit(at).alias("_src")) for df, at in zip(sides, (True, False))]
    found = src.union(dst).groupBy(*keys).agg(
        F.count_if("_src").alias("src_rows"),
        F.count_if(~F.col("_src")).alias("dst_rows"),
        digests_differ("_h", F.col("_src")).alias("_differ"),
    )
    return found.filter("_differ").drop("_differ")
