"""A Merkle manifest of a table, with a proof of membership for every row (operator 13).

A row's leaf is the hash of its fields, each `-` if null, else its UTF-8 byte count, `:` and its value.  Leaves of one
group ascend by id; every two consecutive nodes become the hash of their digests (a last lone one, of its own) until one
remains, the group's subroot; subroots by group (null first) likewise give the root.

1. One pass over the table makes the leaves; all later work is on some hundred bytes a row.
2. A range partition by (group, id, leaf, row number) and the counts of its partitions give every leaf its position
   within its group.  The row number makes that key unique, so neither a hot group nor equal rows fill one task.
3. Blocks of 2 ** height leaves at aligned positions are walked in postorder, one task call a block: the recursion returns a
   subtree's digest and, while it unwinds, appends the siblings to the leaves contained.  Block roots are the nodes of
   the next traversal, a thousandth as many, until each group has one; subroots go the same way.
4. Paths are joined downwards from the smallest traversal by (group, block), at most a block's rows a key.

A step of a path is one byte for the sibling's side (`L`, `R`, or `N` for a lone node) and the sibling's digest.

Edge cases: null fields, ids and groups are values of their own (nulls first); rows of one id ascend by leaf, repeated
rows are a leaf each; one row is its group's subroot, and of a single group the root; an empty table gives no rows;
texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import Stages

#: Levels of a block: 1024 leaves.
HEIGHT = 10
#: Rows that a range partition is planned for, where that asks for more than spark.sql.shuffle.partitions.
PART_ROWS = 2_000_000


def leaf_of(*fields: Column) -> Column:
    def framed(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.sha2(F.concat(*map(framed, fields)), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def walk(leaves: list[str], paths: list[list[bytes]], lo: int, height: int) -> str:
    """Digest of the subtree of 2 ** height positions from lo; its leaves' paths get their siblings on the way up."""
    if not height:
        return leaves[lo]
    mid, hi = lo + (1 << height - 1), min(lo + (1 << height), len(leaves))
    left = walk(leaves, paths, lo, height - 1)
    if mid >= hi:
        for path in paths[lo:hi]:
            path.append(b"N")
        return digest(left)
    right = walk(leaves, paths, mid, height - 1)
    on_right, on_left = b"R" + bytes.fromhex(right), b"L" + bytes.fromhex(left)
    for path in paths[lo:mid]:
        path.append(on_right)
    for path in paths[mid:hi]:
        path.append(on_left)
    return digest(left + right)


def _traversed(nodes: DataFrame, height: int) -> DataFrame:
    """nodes (g, pos, size, digest, ...) with block, the path within it and the block's digest, top."""
    schema = T.StructType([*nodes.schema, T.StructField("block", T.LongType()), T.StructField("path", T.ArrayType(T.BinaryType())), T.StructField("top", T.StringType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        leaves = table.column("digest").to_pylist()
        paths: list[list[bytes]] = [[] for _ in leaves]
        # all levels of a block, unless it is its group's only one
        top = walk(leaves, paths, 0, min(height, (table.column("size")[0].as_py() - 1).bit_length()))
        return table.append_column("path", pa.array(paths, pa.list_(pa.binary()))).append_column("top", pa.array([top] * len(leaves), pa.string()))

    return nodes.withColumn("block", F.shiftright("pos", height)).groupBy("g", "block").applyInArrow(run, schema)


def climb(nodes: DataFrame, stages: Stages, height: int) -> list[DataFrame]:
    """The traversals from nodes (g, pos, size, digest, ...) up to one block a group, each written."""
    levels: list[DataFrame] = []
    while True:
        levels.append(stages.write(_traversed(nodes, height), "blocks"))
        most = levels[-1].agg(F.max("size")).first()[0]
        if most is None or most <= 1 << height:
            return levels
        # a block's root is node number `block` of the next traversal; one row of each block carries it
        nodes = levels[-1].where(F.col("pos") == F.shiftleft("block", height)).select("g", F.col("block").alias("pos"), (F.shiftright(F.col("size") - 1, height) + 1).alias("size"), F.col("top").alias("digest"))


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the lowest traversal with their whole path; above: (g, path above the group's root, ...)."""
    more = [c for c in above.columns if c not in ("g", "path")]
    rest = above.withColumnRenamed("path", "rest").withColumn("block", F.lit(0).cast("long"))
    for k, level in enumerate(reversed(levels), 1):
        out = level.join(rest, ["g", "block"]).withColumn("path", F.concat("path", "rest"))
        rest = out.select("g", F.col("pos").alias("block"), F.col("path").alias("rest"), *more) if k < len(levels) else out
    return rest.drop("block", "rest", "top")


def positioned_by(df: DataFrame, by: list[str], stages: Stages) -> DataFrame:
    """df (g, ...) with pos, a row's place among those of its g in the order of by (which are unique), and size."""
    order = [F.col(c).asc_nulls_first() for c in ("g", *by)]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART_ROWS))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = stages.write(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ordered")
    runs = dealt.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("g").orderBy("part")) - F.col("n")
    runs = stages.write(runs.select("g", "part", (F.col("first") - before).alias("shift"), F.sum("n").over(W.partitionBy("g")).alias("size")), "runs")
    return dealt.join(runs, ["g", "part"]).withColumn("pos", F.col("at") - F.col("shift")).drop("part", "at", "shift")


def manifest(df: DataFrame, id: str, group: str, leaf: Column, forged: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """(id, leaf, forged, subroot, root, path) for each row of df.

    leaf: the hash of a row (leaf_of); forged: that of the row to be checked, null where it's the same.
    """
    stages = Stages(df.sparkSession, "merkle")
    # null, and '=' before any other group, so that null is first and no group is null
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    fake = F.lit(None).cast("string") if forged is None else forged
    leaves = stages.write(df.select(g.alias("g"), F.col(id).alias("id"), leaf.alias("digest"), fake.alias("forged"), F.monotonically_increasing_id().alias("row")), "leaves")
    levels = climb(positioned_by(leaves, ["id", "digest", "row"], stages).drop("row"), stages, height)
    tops = levels[-1].where("pos = 0").select(F.lit("").alias("g"), F.col("g").alias("own"), F.col("top").alias("digest"))
    over = climb(positioned_by(tops, ["own"], stages), stages, height)
    root = over[-1].where("pos = 0").select("g", F.array().cast("array<binary>").alias("path"), F.col("top").alias("root"))
    above = descend(over, root).select(F.col("own").alias("g"), "path", F.col("digest").alias("subroot"), "root")
    above = stages.write(above, "above")
    return descend(levels, above).select(F.col("id").alias(id), F.col("digest").alias("leaf"), "forged", "subroot", "root", "path")


def _hex(step: Column) -> Column:
    return F.lower(F.hex(F.substring(step, 2, 32)))


def _side(step: Column) -> Column:
    return F.substring(step, 1, 1).cast("string")


def proof_digest(path: Column) -> Column:
    """Hash of the siblings in the order of the path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.when(_side(s) == "N", F.lit("")).otherwise(_hex(s))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""

    def up(node: Column, step: Column) -> Column:
        return F.sha2(F.when(_side(step) == "L", F.concat(_hex(step), node)).when(_side(step) == "R", F.concat(node, _hex(step))).otherwise(node), 256)

    return F.aggregate(path, leaf, up)
