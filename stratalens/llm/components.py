"""Connected components by contraction, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages


def components(edges: DataFrame, stages: Stages) -> DataFrame:
    """(v, comp) for each vertex of edges (a, b: of one ordered type); comp is one vertex of its component.

    Each round points every vertex to its least neighbour (or itself), follows pointers to their ends by doubling and
    contracts the edges; at least half of the vertices that still have edges go in a round.  All state is in written
    tables; nothing is collected.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct()
    left = stages.write(both, "edges")
    whole: DataFrame | None = None
    while not left.isEmpty():
        point = stages.write(left.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p")), "point")
        while True:
            to = point.select(F.col("v").alias("p"), F.col("p").alias("q"))
            jumped = stages.write(point.join(to, "p").select("v", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "jump")
            moved = not jumped.where("moved").isEmpty()
            stages.drop(point)
            point = jumped.select("v", "p")
            point.stage_path = jumped.stage_path
            if not moved:
                break
        ends = left.join(point.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(point.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        less = stages.write(ends.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
        stages.drop(left)
        left = less
        if whole is None:
            whole = point
        else:
            then = point.select(F.col("v").alias("p"), F.col("p").alias("q"))
            was = whole
            whole = stages.write(was.join(then, "p", "left").select("v", F.coalesce("q", "p").alias("p")), "whole")
            stages.drop(was, point)
    if whole is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("comp")).limit(0)
    return whole.select("v", F.col("p").alias("comp"))
