"""Reproducible shuffle into shards (operator 10), in DataFrame functions only.

Rows get global numbers 0 to N-1 without a global sort: rows are counted by bucket, the buckets' running sum is
each bucket's first number (a table of `buckets` rows, whatever the input), and rows are numbered within buckets.
A Feistel network over a * b >= N, walked until it falls below N, permutes the numbers.  Number p goes to shard
p mod shards, slot p div shards, so counts differ by one at most and slots have no gap; shard and slot of a row
number follow from the number, N and the seed alone (`place`).

Equal rows are counted before they are dealt and numbered by explode, so a row that makes up a third of the table
is one record until then, and comes out in parts that are dealt to all tasks.

Edge cases: null keys or texts are values like any other; an empty table gives an empty result; equal rows get
different places; fewer rows than shards leave shards empty; columns named like the outputs are replaced, keys too;
maps are compared by their sorted entries, which must have an order (no maps within).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import fresh, replaced

ROUNDS, WALK = 8, 64


def _step(x: Column, a: Column, b: Column, seed: int) -> Column:
    """One pass of the network: halves l < a and r < b take turns at adding a keyed hash of the other."""

    def turn(state: Column, k: Column) -> Column:
        left, right = state["l"], state["r"]
        even = k % 2 == 0
        return F.struct(
            F.when(even, (left + F.pmod(F.xxhash64(F.lit(seed), k, right), a)) % a).otherwise(left).alias("l"),
            F.when(even, right).otherwise((right + F.pmod(F.xxhash64(F.lit(seed), k, left), b)) % b).alias("r"),
        )

    start = F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def permute(number: Column, total: Column, seed: int) -> Column:
    """A permutation of 0..total-1.

    a = ceil(sqrt(total)), b = ceil(total / a), so fewer than a of the a * b numbers lie outside and a walk leaves
    them after few steps: with total <= 1024 fewer than 64 lie outside, and a walk can't visit one twice; with more,
    64 steps outside in a row have a chance below total ** -31, and are reported as an error rather than let pass.
    """
    a = F.ceil(F.sqrt(total.cast("double"))).cast("long")
    b = F.ceil(total / a).cast("long")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _step(number, a, b, seed), lambda x, _: F.when(x >= total, _step(x, a, b, seed)).otherwise(x))
    return F.when(walked < total, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def place(number: Column, total: Column, shards: int, seed: int) -> tuple[Column, Column]:
    """Shard and slot of a row number."""
    p = permute(number, total, seed)
    return (p % shards).cast("int"), ((p - p % shards) / shards).cast("long")


def numbered(df: DataFrame, keys: list[str], number: str = "row_number", total: str = "total", buckets: int = 4096, most: int = 100_000) -> DataFrame:
    """df with number (0..N-1, the same on each run) and total (N).  keys: columns that spread rows.  No column is a map.

    Copies of a row come out in parts of `most`, dealt to all tasks, so that none makes a hot row's copies alone.
    """
    own = {n: fresh(n, *df.columns, number, total) for n in ("copies", "bucket", "n", "first", "upto", "part")}
    copies, bucket, n, first, upto, part = (own[k] for k in ("copies", "bucket", "n", "first", "upto", "part"))
    cols = list(df.columns)
    at = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias(copies)).withColumn(bucket, at)
    sums = counted.groupBy(bucket).agg(F.sum(copies).alias(n))
    firsts = sums.select(bucket, (F.sum(n).over(W.orderBy(bucket)) - F.col(n)).alias(first), F.sum(n).over(W.partitionBy()).alias(total))
    before = F.sum(copies).over(W.partitionBy(bucket).orderBy(*keys, F.xxhash64(*cols), *cols).rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = counted.withColumn(upto, before).join(F.broadcast(firsts), bucket)
    start = F.col(first) + F.col(upto) - F.col(copies)
    ends = F.least(start + (F.col(part) + 1) * most, start + F.col(copies)) - 1
    few = placed.where(F.col(copies) <= most).withColumn(part, F.lit(0).cast("long"))
    many = placed.where(F.col(copies) > most).withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / most).cast("long"))))
    many = many.repartition(F.xxhash64(part, *keys))
    return few.unionByName(many).withColumn(number, F.explode(F.sequence(start + F.col(part) * most, ends))).select(*cols, number, total)


def shard(df: DataFrame, keys: list[str], shards: int = 8, seed: int = 20240229, buckets: int = 4096, most: int = 100_000) -> DataFrame:
    """df's rows with shard and slot, dealt evenly by rows."""
    base, own = replaced(df, ["shard", "slot"], *keys)
    maps = [f.name for f in base.schema.fields if isinstance(f.dataType, T.MapType)]
    base = base.withColumns({m: F.array_sort(F.map_entries(m)) for m in maps})
    number, total = (fresh(n, *base.columns, "shard", "slot") for n in ("row_number", "total"))
    s, t = place(F.col(number), F.col(total), shards, seed)
    out = numbered(base, own, number, total, buckets, most).withColumns({m: F.map_from_entries(m) for m in maps})
    return out.withColumn("shard", s).withColumn("slot", t).drop(number, total, *[a for a, b in zip(own, keys, strict=True) if a != b])
