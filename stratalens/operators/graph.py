"""Graph operators: traversals, closures, components, PageRank, communities, simulation.

A traversal is a loop over a frontier: one join of the frontier with the edges a level, grouped to the best arrival, less
what was seen.  State is written between levels (the shared folder in spark.checkpoint.dir), so plans stay short and a
lost executor costs a reread.  Each level's cost follows its frontier.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType
from pyspark.storagelevel import StorageLevel

from ..plans.projection import frame, with_


#: Written state of so many bytes goes to all executors when it is joined; what is larger is never collected.
SENT = 2 << 20


def _held_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory."""
    plain = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema if isinstance(f.dataType, (StringType, BinaryType))]
    nested = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in df.schema if isinstance(f.dataType, (ArrayType, MapType, StructType))]
    return reduce(lambda a, b: a + b, [*plain, *nested], F.lit(16 + 8 * len(df.schema))).cast("long")


class Rounds:
    """Written state of a loop, in the folder that all executors share; a local one only on a local master."""

    def __init__(self, spark: SparkSession, name: str):
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_stratalens_root", None)
        if not root and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not root:
            root = spark._stratalens_root = "file://" + tempfile.mkdtemp(prefix="stratalens-")
        self.spark, self.base, self.n = spark, f"{root.rstrip('/')}/stratalens/{name}-{uuid.uuid4().hex}", itertools.count(1)

    def write(self, df: DataFrame) -> DataFrame:
        """df as written.  Equal values take next to no room in a file, so what is joined is told by rows as they are in memory."""
        path = f"{self.base}/{next(self.n):04d}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(_held_bytes(df)).alias("bytes")).write.option("compression", "zstd").parquet(path)
        plain = self.spark.read.schema(df.schema).parquet(path)
        back = F.broadcast(plain) if (seen.get.get("bytes") or 0) <= SENT else plain.hint("merge")
        # plain: without a hint; shuffled: never sent to all, as a table hashed by names or by two columns takes a page of 64 MB
        back.rounds_path, back.rows, back.plain, back.shuffled = path, seen.get.get("rows") or 0, plain, plain.hint("merge")
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Delete written state that no later plan reads."""
        for f in frames:
            if hasattr(f, "rounds_path"):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f.rounds_path)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: A walk's levels are put together in one table each time there are so many.
COMPACT = 4


def numbers(ids: DataFrame, rounds: Rounds) -> DataFrame:
    """(id, n) of ids (id), each once, from 1 up in their order, so that a least number is that of the least name.

    Loops join and group by numbers: these take a third of a name's room in a shuffle, and next to none where few are sent
    to all.  No step goes through one task but a row a partition.
    """
    order = rounds.write(ids.select("id").where("id IS NOT NULL").distinct().orderBy("id").withColumn("m", F.monotonically_increasing_id()).withColumn("p", F.spark_partition_id())).plain
    counts = order.groupBy("p").agg(F.count(F.lit(1)).alias("c"), F.min("m").alias("lo"))
    before = counts.select("p", "lo", (F.sum("c").over(W.orderBy("p")) - F.col("c")).alias("before"))
    return rounds.write(order.join(F.broadcast(before), "p").select("id", (F.col("m") - F.col("lo") + F.col("before") + 1).alias("n")))


def renamed(df: DataFrame, names: DataFrame, *columns: str, back: bool = False) -> DataFrame:
    """df with the numbers of names (id, n) in place of columns of names, or the other way; rows without one are left out."""
    a, b = ("n", "id") if back else ("id", "n")
    for c in columns:
        df = df.withColumnRenamed(c, "renamed_").join(names.select(F.col(a).alias("renamed_"), F.col(b).alias(c)).hint("merge"), "renamed_").drop("renamed_")
    return df


def best_edges(edges: DataFrame) -> DataFrame:
    """One edge of each pair: parallel edges give their best confidence, and are for review if that one is."""
    return edges.groupBy("source_id", "target_id").agg(F.max(F.struct("confidence", (F.col("status") == "confirmed").alias("sure"))).alias("b")).select("source_id", "target_id", F.col("b.confidence").alias("confidence"), (~F.col("b.sure")).alias("review"))


def bfs(edges: DataFrame, seeds: DataFrame, reverse: bool = False, depth: int | None = None) -> DataFrame:
    """(root, id, dist, confidence, review) for what each seed (id) reaches, itself at 0.

    Among shortest paths the one whose weakest edge is strongest counts (of equal ones, one without edges for review);
    confidence and review are both of that path.
    """
    rounds = Rounds(edges.sparkSession, "bfs")
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    named = rounds.write(edges.select(F.col(a).alias("id"), F.col(b).alias("to"), F.col("confidence").alias("c"), F.col("review").alias("v"))).plain
    names = numbers(named.select("id").union(named.select("to")).union(seeds.select("id")), rounds)
    steps = rounds.write(renamed(named, names, "id", "to"))
    start = renamed(seeds.select("id").distinct(), names, "id").select(F.col("id").alias("root"), "id", F.lit(0).alias("dist"), F.lit(1.0).alias("confidence"), F.lit(False).alias("review"))
    front = rounds.write(start)
    parts, level = [front], 0
    while depth is None or level < depth:
        level += 1
        path = F.struct(F.least("confidence", "c").alias("confidence"), (~F.col("review") & ~F.col("v")).alias("sure"))
        found = front.join(steps, "id").groupBy("root", F.col("to").alias("id")).agg(F.max(path).alias("p"))
        found = found.select("root", "id", F.lit(level).alias("dist"), "p.confidence", (~F.col("p.sure")).alias("review"))
        for seen in parts:
            found = found.join(seen.shuffled.select("root", "id"), ["root", "id"], "left_anti")
        front = rounds.write(found)
        if not front.rows:
            break
        parts.append(front)
        if len(parts) > COMPACT:
            whole = rounds.write(reduce(DataFrame.unionByName, [p.plain for p in parts]))
            rounds.drop(*parts[:-1])
            parts = [whole]
    whole = renamed(reduce(DataFrame.unionByName, [p.plain for p in parts]), names, "root", "id", back=True)
    return whole.select("root", "id", "dist", "confidence", "review")


def reached(edges: DataFrame, seeds: DataFrame, reverse: bool = False, depth: int | None = None, both: bool = False, held: bool = False) -> DataFrame:
    """(id, dist): the least distance from any of the seeds (id), themselves at 0.  One row a vertex, however many seeds.

    both: edges are taken in either direction.  held: edges are written already, so each level reads them where they are.
    """
    rounds = Rounds(edges.sparkSession, "reached")
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    # parallel edges are put together in each level, where few are left
    steps = edges.select(F.col(a).alias("id"), F.col(b).alias("to"))
    steps = steps if held else rounds.write(steps).plain
    ways = [steps, steps.select(F.col("to").alias("id"), F.col("id").alias("to"))] if both else [steps]
    front = rounds.write(seeds.select("id", F.lit(0).alias("dist")).distinct())
    parts, level = [front], 0
    while depth is None or level < depth:
        level += 1
        found = reduce(DataFrame.union, [w.join(front.select("id"), "id", "left_semi").select(F.col("to").alias("id")) for w in ways]).distinct()
        for seen in parts:
            found = found.join(seen.shuffled.select("id"), "id", "left_anti")
        front = rounds.write(found.select("id", F.lit(level).alias("dist")))
        if not front.rows:
            break
        parts.append(front)
        if len(parts) > COMPACT:
            whole = rounds.write(reduce(DataFrame.unionByName, [p.plain for p in parts]))
            rounds.drop(*parts[:-1])
            parts = [whole]
    return reduce(DataFrame.unionByName, parts)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least vertex of each weakly connected component.

    In a turn each vertex goes to the least next to it and on to where that went, and edges are drawn between what they went
    to, each pair once: so what is left shrinks from turn to turn, and only labels keep a row a vertex.
    """
    rounds = Rounds(edges.sparkSession, "components")
    rest = edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    label = None
    while True:
        near = rest.select("u", "v").union(rest.select("v", "u")).groupBy("u").agg(F.least("u", F.min("v")).alias("up"))
        near = rounds.write(near)
        if not near.rows:
            # without any edge no vertex has a component
            return label if label is not None else near.plain.select(F.col("u").alias("id"), F.col("up").alias("component"))
        for _ in range(2):
            far = near.shuffled.select(F.col("u").alias("up"), F.col("up").alias("far"))
            near = rounds.write(near.shuffled.join(far, "up").select("u", F.col("far").alias("up")))
        of = lambda end: near.shuffled.select(F.col("u").alias(end), F.col("up").alias(f"{end}_up"))
        drawn = rest.join(of("u"), "u").join(of("v"), "v").select(F.least("u_up", "v_up").alias("u"), F.greatest("u_up", "v_up").alias("v")).where("u <> v").distinct()
        rest = rounds.write(drawn).shuffled
        first = near.shuffled.select(F.col("u").alias("id"), F.col("up").alias("component"))
        if label is None:
            label = rounds.write(first)
        else:
            label = rounds.write(label.shuffled.join(near.shuffled.select(F.col("u").alias("component"), "up"), "component", "left").select("id", F.coalesce("up", "component").alias("component")))


def pagerank(edges: DataFrame, turns: int = 50, damping: float = 0.85) -> DataFrame:
    """(id, rank): parallel edges count each, dangling mass goes to all evenly.

    Edges and vertices lie by their source's number for all turns, so a turn shuffles what vertices get and nothing else.
    """
    rounds = Rounds(edges.sparkSession, "pagerank")
    n_parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rounds.write(edges.groupBy(F.col("source_id").alias("id"), F.col("target_id").alias("to")).agg(F.count(F.lit(1)).alias("k"))).plain
    names = numbers(named.select("id").union(named.select("to")), rounds)
    steps = rounds.write(renamed(named, names, "id", "to")).plain.repartition(n_parts, "id").sortWithinPartitions("id").persist(StorageLevel.DISK_ONLY)
    out = steps.groupBy("id").agg(F.sum("k").alias("out"))
    nodes = names.plain.select(F.col("n").alias("id")).join(out, "id", "left").repartition(n_parts, "id").sortWithinPartitions("id").persist(StorageLevel.DISK_ONLY)
    n = max(names.rows, 1)
    rank = nodes.select("id", "out", F.lit(1.0 / n).alias("rank"))
    lost = rank.where("out IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
    for _ in range(turns):
        got = steps.hint("merge").join(rank, "id").groupBy(F.col("to").alias("id")).agg(F.sum(F.col("rank") * F.col("k") / F.col("out")).alias("got"))
        now = nodes.hint("merge").join(got, "id", "left").select("id", "out", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("rank"))
        # what has no way on is summed while ranks are written
        seen, last = Observation(), rank
        rank = rounds.write(now.observe(seen, F.sum(F.when(F.col("out").isNull(), F.col("rank"))).alias("lost")))
        lost = seen.get.get("lost") or 0.0
        rounds.drop(last)
        rank, path = rank.plain, rank.rounds_path
        rank.rounds_path = path
    steps.unpersist()
    nodes.unpersist()
    return renamed(rank.select("id", "rank"), names.plain, "id", back=True).select("id", "rank")


def _in_order(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Places of rows by v, then c, neither below 0: as one number with the place behind, where that has room, as numbers sort fastest."""
    bits = [int(x.max(initial=0)).bit_length() for x in (c, np.array([len(c)]))]
    if not len(v) or int(v.max()).bit_length() + sum(bits) > 63 or c.min() < 0:
        return np.lexsort((c, v))
    key = (((v.astype(np.int64) << bits[0]) | c) << bits[1]) | np.arange(len(c))
    key.sort()
    return key & ((1 << bits[1]) - 1)


def _best_moves(total: float):
    """A task's function over rows (id, k, home, size, f, far, cs, ins, ss) that lie by id: (id, new) of those that gain by a move.

    A row adds f * ins to its vertex' weight to each of the communities cs, whose sizes are ss; far rows say nothing of home.
    """

    def moved(t: pa.Table) -> pa.RecordBatch:
        col = lambda c: t[c].combine_chunks().to_numpy(zero_copy_only=False)
        flat = lambda c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(len(t)), t["cs"].combine_chunks().value_lengths().to_numpy())
        home, c = col("home"), flat("cs")
        w, size, kept = col("f")[at] * flat("ins"), flat("ss"), ~(col("far")[at] & (c == home[at]))
        ids, first, of = np.unique(col("id"), return_index=True, return_inverse=True)
        v, c, w, size = of[at][kept], c[kept], w[kept], size[kept]
        order = _in_order(v, c)
        v, c, w, size = v[order], c[order], w[order], size[order]
        starts = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (c[1:] != c[:-1])]) if len(v) else np.zeros(0, np.int64)
        v, c, size = v[starts], c[starts], size[starts]
        to = np.add.reduceat(w, starts) if len(starts) else w
        home, k, home_size = home[first], col("k")[first], col("size")[first]
        g = to - k[v] * np.where(c == home[v], size - k[v], size) / (2 * total)
        stay = -k * (home_size - k) / (2 * total)
        here = c == home[v]
        stay[v[here]] = g[here]
        # of the greatest gains the greatest community
        top, last = np.full(len(ids), -np.inf), np.full(len(ids), -1)
        np.maximum.at(top, v, g)
        most = np.flatnonzero(g == top[v])
        last[v[most]] = most
        last = last[last >= 0]
        goes = last[g[last] > stay[v[last]] + 1e-12]
        return pa.RecordBatch.from_arrays([pa.array(ids[v[goes]].astype(np.int64)), pa.array(c[goes].astype(np.int64))], names=["id", "new"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            ids = t["id"].to_numpy()
            # the last vertex may go on in the next batch
            whole = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
            if whole:
                yield moved(t.slice(0, whole))
            held = t.slice(whole)
        if held is not None and len(held):
            yield moved(held)

    return run


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, k, home, size, resource, f, c, w, s, cs, ins, ss) that lie by id as rows of _best_moves.

    Rows of id -1 come first and give the candidates cs of resource, how much they use it and their sizes; the others add w
    to the community c and, if they name a resource, f times what its candidates but home use it.
    """
    held: list[tuple[np.ndarray, ...]] = []
    names = starts = counts = None
    lists: tuple[np.ndarray, ...] = ()
    for batch in batches:
        n = int(np.searchsorted(batch["id"].to_numpy(), 0))
        if n:
            b = batch.slice(0, n)
            held.append((b["resource"].to_numpy(zero_copy_only=False).astype(np.int64), b["cs"].value_lengths().to_numpy(), *(b[c].flatten().to_numpy(zero_copy_only=False) for c in ("cs", "ins", "ss"))))
            batch = batch.slice(n)
        if not batch.num_rows:
            continue
        if names is None:
            none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
            names, counts, *lists = (np.concatenate(x) for x in zip(none, *held))
            held, order = [], np.argsort(names)
            starts = (np.cumsum(counts) - counts)[order]
            names, counts = names[order], counts[order].astype(np.int64)
        rows = batch.num_rows
        col = lambda c: batch[c].to_numpy(zero_copy_only=False)  # noqa: E731, B023
        thing = batch["resource"].fill_null(-1).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(names, thing), max(len(names) - 1, 0))
        found = names[at] == thing if len(names) else np.zeros(rows, bool)
        far = np.where(found, counts[at], 0) if len(names) else np.zeros(rows, np.int64)
        ends = np.cumsum(far + 1)
        first = ends - far - 1
        cs, ins, ss = np.empty(ends[-1], np.int64), np.empty(ends[-1]), np.empty(ends[-1])
        cs[first], ins[first], ss[first] = col("c"), col("w"), col("s")
        # the places after a row's first are those of its thing's candidates
        of = np.repeat(np.arange(rows), far)
        if len(of):
            k = np.arange(len(of)) - np.repeat(np.cumsum(far) - far, far)
            to, source = first[of] + 1 + k, starts[at][of] + k
            home = col("home")
            cs[to], ss[to] = lists[0][source], lists[2][source]
            f = batch["f"].fill_null(0.0).to_numpy(zero_copy_only=False)
            # what is at home by a thing came with the row itself
            ins[to] = np.where(cs[to] == home[of], 0.0, f[of] * lists[1][source])
        offsets = pa.array(np.r_[0, ends].astype(np.int32))
        listed = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x))  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["k"], batch["home"], batch["size"], pa.array(np.ones(rows)), pa.array(np.zeros(rows, bool)), listed(cs), listed(ins), listed(ss)],
            names=["id", "k", "home", "size", "f", "far", "cs", "ins", "ss"],
        )


def communities(weights: DataFrame, nodes: DataFrame, passes: int = 5, turns: int = 12, uses: DataFrame | None = None, shared: float = 1.0, candidates: int = 64) -> DataFrame:
    """(id, community) by modularity: local moves, then the same again between communities (Louvain's method in turns).

    weights (a, b, w) is undirected, a pair may come in many rows; nodes (id) without an edge are communities of their
    own.  In a turn half of the vertices (by hash) may move to the neighbouring community of the greatest gain, if that
    is above none; moves at once can spoil each other, so a turn that lowers modularity is taken back and ends the pass.

    uses (id, resource): two vertices that use one thing hang together by `shared` for it.  Their pairs are never formed:
    a vertex's weight to a community is the sum, over what it uses, of how many there use it too, and these counts are
    kept by resource and community.  Of a resource that more than `candidates` communities use, those that use it most
    are moved to through it; degrees, what a vertex has at home and modularity are exact all the same.

    Vertices and resources go by numbers.  A resource's candidates go to each task once, where they meet what the task's
    vertices use, and gains are summed by vertex; counts and sizes are written once for each labelling.  So a task holds the
    candidates of all resources, 24 bytes each.
    """
    rounds = Rounds(weights.sparkSession, "communities")
    n_parts = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = weights.sparkSession.sparkContext.defaultParallelism
    given = rounds.write(weights.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(F.col("w").cast("double")).alias("w"))).plain
    nodes = rounds.write(nodes.select("id").distinct()).plain
    used = None if uses is None else rounds.write(uses.select("id", "resource").distinct()).plain
    every = given.select(F.col("a").alias("id")).union(given.select("b")).union(nodes)
    names = numbers(every if used is None else every.union(used.select("id")), rounds).plain
    level = rounds.write(renamed(given, names, "a", "b")).shuffled
    if used is not None:
        things = numbers(used.select(F.col("resource").alias("id")), rounds).plain
        used = rounds.write(renamed(renamed(used, names, "id"), things, "resource").withColumn("m", F.lit(1.0))).shuffled
        users = rounds.write(used.groupBy("resource").agg(F.sum("m").alias("n")))
    total = level.agg(F.sum("w")).first()[0] or 0.0
    if used is not None:
        total += shared * (users.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0.0)
    if not total:
        return nodes.withColumn("community", F.col("id"))
    label = rounds.write(renamed(nodes, names, "id").withColumn("community", F.col("id"))).shuffled
    for turn_of in range(passes):
        both = rounds.write(level.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(level.where("a <> b").select(F.col("b").alias("u"), F.col("a").alias("v"), "w"))).shuffled
        loops = level.where("a = b").select(F.col("a").alias("id"), (2 * F.col("w")).alias("d"))
        ends = both.select(F.col("u").alias("id"), F.col("w").alias("d")).unionByName(loops)
        if used is not None:
            ends = ends.unionByName(used.join(users.shuffled, "resource").select("id", (shared * F.col("m") * (F.col("n") - 1)).alias("d")))
        degree = ends.groupBy("id").agg(F.sum("d").alias("k"))
        degree = rounds.write(degree.join(names.select(F.col("n").alias("id"), F.col("id").alias("name")).hint("merge"), "id")).shuffled
        # what vertices use lies by vertex for all turns of the pass
        lying = None if used is None else used.select("id", "resource", "m").repartition(n_parts, "id").sortWithinPartitions("id").persist(StorageLevel.DISK_ONLY)

        def held(labels: DataFrame) -> tuple[DataFrame, DataFrame | None, float]:
            """Sizes of communities, how many members of each use each resource, and modularity."""
            la, lb = labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), labels.select(F.col("id").alias("b"), F.col("community").alias("cb"))
            within = level.join(la, "a").join(lb, "b").where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0)))
            # sums are taken while rows are written; none of the three waits for another
            pairs, squares, counts = Observation(), Observation(), None
            with ThreadPoolExecutor(3) as pool:
                inside = pool.submit(within.first)
                if used is not None:
                    each = lying.hint("merge").join(labels, "id").groupBy("resource", "community").agg(F.sum("m").alias("in"))
                    counts = pool.submit(rounds.write, each.observe(pairs, F.sum(F.col("in") * (F.col("in") - 1) / 2).alias("n")))
                each = degree.join(labels, "id").groupBy("community").agg(F.sum("k").alias("size"))
                sizes = pool.submit(rounds.write, each.observe(squares, F.sum(F.col("size") * F.col("size")).alias("n"))).result().shuffled
                inside, counts = inside.result()[0], counts and counts.result().shuffled
            if used is not None:
                inside += shared * (pairs.get.get("n") or 0.0)
            square = squares.get.get("n") or 0.0
            return sizes, counts, inside / total - square / (4 * total * total)

        def weighed(turn: int, own: DataFrame, sizes: DataFrame, counts: DataFrame | None) -> DataFrame:
            """Rows of _expanded for the vertices that may move in this turn, dealt by vertex and put in order."""
            may = F.pmod(F.xxhash64("name", F.lit(turn), F.lit(turn_of)), F.lit(2)) == 0
            mine = rounds.write(degree.where(may).select("id", "k").join(own, "id").join(sizes, "community").select("id", "k", F.col("community").alias("home"), "size")).shuffled
            part = F.pmod(F.xxhash64("id"), F.lit(dealt)).cast("int").alias("p")
            none = lambda *shapes: [F.lit(None).cast(x) for x in shapes]
            # lists without a value cost a batch the square of its rows on the way to Python, empty ones don't
            empty = [F.array().cast(x) for x in ("array<bigint>", "array<double>", "array<double>")]
            row = lambda df, *more: df.select(part, "id", "k", "home", "size", *[c.alias(n) for n, c in zip(("resource", "f", "c", "w", "s", "cs", "ins", "ss"), (*more, *empty))])
            near = both.select(F.col("u").alias("id"), F.col("v"), "w").join(mine, "id").join(own.select(F.col("id").alias("v"), "community"), "v").join(sizes.withColumnRenamed("size", "s"), "community")
            rows = row(near, *none("bigint", "double"), F.col("community"), F.col("w"), F.col("s"))
            if used is not None:
                # a row for a vertex and a thing that it uses, with what it has at home by it
                at_home = lying.hint("merge").join(mine, "id").join(counts.withColumnRenamed("community", "home"), ["resource", "home"])
                rows = rows.unionByName(row(at_home, F.col("resource"), shared * F.col("m"), F.col("home"), shared * F.col("m") * (F.col("in") - F.col("m")), F.col("size")))
                rank = F.row_number().over(W.partitionBy("resource").orderBy(F.desc("in"), "community"))
                most = counts.withColumn("rank", rank).where(F.col("rank") <= candidates).join(sizes.withColumnRenamed("size", "s"), "community")
                most = most.groupBy("resource").agg(F.collect_list(F.struct("community", "in", "s")).alias("l")).select("resource", F.col("l.community").alias("cs"), F.col("l.in").alias("ins"), F.col("l.s").alias("ss"))
                # a thing's candidates go to each task once, not to each vertex that uses it
                each = most.select(F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))).alias("p"), F.lit(-1).cast("bigint").alias("id"), *[x.alias(n) for n, x in zip(("k", "home", "size"), none("double", "bigint", "double"))], "resource", *[x.alias(n) for n, x in zip(("f", "c", "w", "s"), none("double", "bigint", "double", "double"))], "cs", "ins", "ss")
                rows = rows.unionByName(each)
            return rows.repartitionById(dealt, F.col("p")).sortWithinPartitions("id").drop("p")

        own = rounds.write(degree.select("id", F.col("id").alias("community"))).shuffled
        sizes, counts, best = held(own)
        start = best
        for turn in range(turns):
            moves = _best_moves(total)
            goes = rounds.write(weighed(turn, own, sizes, counts).mapInArrow(lambda batches: moves(_expanded(batches)), "id bigint, new bigint"))  # noqa: B023
            moved = rounds.write(own.join(goes.shuffled, "id", "left").select("id", F.coalesce("new", "community").alias("community"))).shuffled if goes.rows else own
            now = held(moved) if goes.rows else (sizes, counts, best)
            if now[2] <= best + 1e-12:
                if turn % 2:
                    break
                continue
            own, (sizes, counts, best) = moved, now
        if lying is not None:
            lying.unpersist()
        if best <= start + 1e-12:
            break
        up = own.select(F.col("id").alias("community"), F.col("community").alias("up"))
        label = rounds.write(label.join(up, "community", "left").select("id", F.coalesce("up", "community").alias("community"))).shuffled
        la, lb = own.select(F.col("id").alias("a"), F.col("community").alias("ca")), own.select(F.col("id").alias("b"), F.col("community").alias("cb"))
        level = rounds.write(level.join(la, "a").join(lb, "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))).shuffled
        if used is not None:
            used = rounds.write(used.join(own, "id").groupBy(F.col("community").alias("id"), "resource").agg(F.sum("m").alias("m"))).shuffled
    return renamed(label, names, "id", "community", back=True).select("id", "community")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (q): modularity of labels (id, community) over undirected weighted edges."""
    w = edges.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("w")).where("a <> b")
    m = w.agg(F.sum("w").alias("m"))
    la, lb = labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), labels.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    ends = w.join(la, "a").join(lb, "b")
    inner = ends.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("w").alias("inside"))
    degree = ends.select(F.col("ca").alias("community"), "w").union(ends.select("cb", "w")).groupBy("community").agg(F.sum("w").alias("d"))
    return degree.join(inner, "community", "left").crossJoin(F.broadcast(m)).agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - (F.col("d") / (2 * F.col("m"))) * (F.col("d") / (2 * F.col("m")))).alias("q"))


def _edges(spark, sf_dir, where: str = "true") -> DataFrame:
    return frame(spark, sf_dir, f"SELECT source_id, target_id, rel_type, confidence, status FROM edge WHERE {where}")


def _ids(spark, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "id string")


ANY = "true"
CONTROL = "rel_type IN ('CALLS', 'EXECUTES')"


def dead_code(spark, sf_dir):
    """2.5-1, 2.5-2: programs that no job reaches over confirmed calls and executions."""
    sure = best_edges(_edges(spark, sf_dir, f"{CONTROL} AND status = 'confirmed'"))
    jobs = _edges(spark, sf_dir, "rel_type = 'EXECUTES'").select(F.col("source_id").alias("id")).distinct()
    live = bfs(sure, jobs).select(F.col("id").alias("program_id")).distinct()
    return frame(spark, sf_dir, "SELECT program_id FROM program").join(live, "program_id", "left_anti")


def capabilities(spark, sf_dir):
    """2.5-4: what each job's closure holds."""
    jobs = _edges(spark, sf_dir, "rel_type = 'EXECUTES'").select(F.col("source_id").alias("id")).distinct()
    reach = bfs(best_edges(_edges(spark, sf_dir, f"({CONTROL} AND status = 'confirmed') OR (rel_type IN ('READS', 'WRITES'))")), jobs)
    return reach.groupBy("root").agg(F.count_if(F.col("id").startswith("P")).alias("programs"), F.count_if(F.col("id").startswith("T")).alias("tables"), F.max("dist").alias("depth"))


def executing_jobs(spark, sf_dir):
    """2.5-5: jobs that execute a program or its callers, however far up: one walk down from the few jobs."""
    e = _edges(spark, sf_dir, CONTROL)
    down = bfs(best_edges(e), e.where("rel_type = 'EXECUTES'").select(F.col("source_id").alias("id")).distinct())
    return down.where("dist > 0").select(F.col("id").alias("program_id"), F.col("root").alias("job_id"), "dist")


def trace_down(spark, sf_dir):
    """2.5-6: the flat trace: programs called within 8 levels, and the data they use as leaves."""
    reach = bfs(best_edges(_edges(spark, sf_dir, "rel_type = 'CALLS'")), _ids(spark, "P1"), depth=8)
    data = _edges(spark, sf_dir, "rel_type IN ('READS', 'WRITES')").select(F.col("source_id").alias("id"), "rel_type", F.col("target_id").alias("leaf")).distinct()
    return reach.select("id", F.lit("PROGRAM").alias("kind"), "dist").union(reach.join(data, "id").groupBy(F.col("leaf").alias("id")).agg(F.lit("TABLE").alias("kind"), (F.min("dist") + 1).alias("dist")))


def blast_radius(spark, sf_dir):
    """2.5-8, 2.5-25: everything that depends on a table, with distance, weakest link and need of review."""
    up = bfs(best_edges(_edges(spark, sf_dir, ANY)), _ids(spark, "T1"), reverse=True)
    return up.where("dist > 0").select("id", "dist", "confidence")


def impact(spark, sf_dir):
    """Dependents to depth 8, counted by kind and depth."""
    up = bfs(best_edges(_edges(spark, sf_dir, ANY)), _ids(spark, "T2"), reverse=True, depth=8).where("dist > 0")
    return up.groupBy(F.substring("id", 1, 1).alias("kind"), "dist").agg(F.count(F.lit(1)).alias("n"))


def lineage(spark, sf_dir):
    """2.5-13: shortest distances downstream, any edge type."""
    return bfs(best_edges(_edges(spark, sf_dir, ANY)), _ids(spark, "J1"), depth=6).select("id", "dist")


def graph_slice(spark, sf_dir):
    """A slice of both directions to depth 2 above a confidence, the nearest first, cut at a limit."""
    e = best_edges(_edges(spark, sf_dir, "confidence >= 0.7E0"))
    both = bfs(e, _ids(spark, "P5"), depth=2).unionByName(bfs(e, _ids(spark, "P5"), reverse=True, depth=2))
    return both.groupBy("id").agg(F.min("dist").alias("dist")).orderBy("dist", "id").limit(100)


def expand_neighbors(spark, sf_dir):
    """Undirected distance to the nearest of several seeds, to 3."""
    e = best_edges(_edges(spark, sf_dir, "rel_type = 'CALLS'"))
    flip = e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "confidence", "review")
    return bfs(e.unionByName(flip), _ids(spark, "P1", "P9"), depth=3).groupBy("id").agg(F.min("dist").alias("dist"))


def weak_components(spark, sf_dir):
    """2.5-14: components of the call graph, with sizes."""
    return components(_edges(spark, sf_dir, "rel_type = 'CALLS'")).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def root_summary(spark, sf_dir):
    """2.5-19: for each job: what it reaches, what of that is unresolved, and its risk."""
    e = _edges(spark, sf_dir, CONTROL)
    jobs = e.where("rel_type = 'EXECUTES'").select(F.col("source_id").alias("id")).distinct()
    reach = bfs(best_edges(e), jobs)
    return reach.groupBy("root").agg(F.count(F.lit(1)).alias("reached"), F.count_if(F.col("confidence") < 0.5).alias("unresolved")).withColumn("risk", F.least(F.lit(1.0), F.col("unresolved") * 0.08 + F.col("reached") / 3000.0))


def centrality(spark, sf_dir):
    """2.5-9: PageRank of programs over calls and executions, 50 turns (rounded to compare)."""
    got = pagerank(_edges(spark, sf_dir, "rel_type IN ('CALLS', 'EXECUTES')"))
    return got.where(F.col("id").startswith("P")).select("id", F.round("rank", 9).alias("rank"))


def call_communities(spark, sf_dir):
    """2.5-10: communities of the call graph."""
    e = _edges(spark, sf_dir, "rel_type = 'CALLS'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.lit(1).alias("w"))
    return communities(e, e.select(F.col("a").alias("id")).union(e.select("b")))


def shard_modularity(spark, sf_dir):
    """2.5-10: modularity of a given labelling."""
    labels = frame(spark, sf_dir, "SELECT DISTINCT prog AS id, CAST(shard AS STRING) AS community FROM seen")
    return modularity(_edges(spark, sf_dir, "rel_type = 'CALLS'"), labels).select(F.round("q", 9).alias("q"))


def degree_centrality(spark, sf_dir):
    """2.5-14: degree over n - 1 in the simple digraph, the top 20."""
    e = _edges(spark, sf_dir, ANY).select("source_id", "target_id").distinct()
    d = e.select(F.col("source_id").alias("id")).union(e.select("target_id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    n = d.agg(F.count(F.lit(1)).alias("n"))
    return d.crossJoin(F.broadcast(n)).select("id", (F.col("degree") / (F.col("n") - 1)).alias("centrality")).orderBy(F.desc("centrality"), "id").limit(20)


#: How much each scenario adds to risk for a dependent, and takes from readiness.
SCENARIOS = {"rename": 1, "replace": 3, "retire": 5}


def simulate(spark, sf_dir):
    """2.5-24: scenarios of change on a table, compared by readiness less risk."""
    up = bfs(best_edges(_edges(spark, sf_dir, ANY)), _ids(spark, "T3"), reverse=True, depth=3).where("dist > 0")
    base = up.agg(F.count(F.lit(1)).alias("dependents"), F.count_if(F.col("confidence") < 1).alias("unsure"))
    plans = spark.createDataFrame(list(SCENARIOS.items()), "scenario string, weight int")
    risk = F.least(F.lit(100), F.col("dependents") * F.col("weight"))
    return plans.crossJoin(F.broadcast(base)).select("scenario", risk.cast("long").alias("risk"), F.greatest(F.lit(0), 100 - F.col("unsure") * F.col("weight")).cast("long").alias("readiness"))


_OWN = (dead_code, capabilities, executing_jobs, trace_down, blast_radius, impact, lineage, graph_slice, expand_neighbors, weak_components, root_summary, centrality, call_communities, shard_modularity, degree_centrality, simulate)


def queries() -> dict:
    return {f.__name__: f for f in _OWN}


def _reach(edge_where: str, seeds: str, reverse: bool, depth: int | None, tail: str) -> str:
    """Oracle: shortest distances by levels, then the best weakest link among shortest paths."""
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    cap = f"AND w.dist < {depth}" if depth else "AND w.dist < 60"
    return with_(
        f"""WITH hop AS (SELECT {a} AS x, {b} AS y, max(confidence) AS c FROM edge WHERE {edge_where} GROUP BY 1, 2),
        walk AS (SELECT root, id, 0 AS dist, 1.0E0 AS c FROM ({seeds}) s
          UNION SELECT w.root, h.y, w.dist + 1, least(w.c, h.c) FROM walk w JOIN hop h ON h.x = w.id WHERE true {cap}),
        best AS (SELECT root, id, min(dist) AS dist FROM walk GROUP BY root, id),
        reach AS (SELECT b.root, b.id, b.dist, max(w.c) AS confidence FROM best b JOIN walk w ON w.root = b.root AND w.id = b.id AND w.dist = b.dist GROUP BY b.root, b.id, b.dist) {tail}""",
        recursive=True,
    )


def _seed(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS root, '{n}' AS id" for n in names)


_JOBS = "SELECT DISTINCT source_id AS root, source_id AS id FROM edge WHERE rel_type = 'EXECUTES'"


def _rank_sql(count: int, edge: str = "edge") -> str:
    """Oracle: PageRank by so many turns, each a table of its own."""
    turns = ["r0 AS MATERIALIZED (SELECT id, o, 1.0E0 / n AS r FROM node, total)"]
    for k in range(count):
        turns.append(
            f"r{k + 1} AS MATERIALIZED (SELECT node.id, node.o, 0.15E0 / n + 0.85E0 * (coalesce(g.got, 0) + lost / n) AS r FROM node CROSS JOIN total CROSS JOIN (SELECT coalesce(sum(r), 0) AS lost FROM r{k} WHERE o IS NULL) l LEFT JOIN (SELECT s.y AS id, sum(p.r * s.k / p.o) AS got FROM s JOIN r{k} p ON p.id = s.x GROUP BY s.y) g ON g.id = node.id)"
        )
    return f"""WITH s AS MATERIALIZED (SELECT source_id AS x, target_id AS y, count(*) AS k FROM {edge} WHERE rel_type IN ('CALLS', 'EXECUTES') GROUP BY 1, 2), outs AS (SELECT x, sum(k) AS o FROM s GROUP BY x),
        node AS MATERIALIZED (SELECT v.id, outs.o FROM (SELECT x AS id FROM s UNION SELECT y FROM s) v LEFT JOIN outs ON outs.x = v.id), total AS (SELECT count(*) AS n FROM node), {", ".join(turns)} SELECT id, round(r, 9) AS rank FROM r{count} WHERE id LIKE 'P%'"""


def oracle_sql() -> dict[str, str]:
    flat = "SELECT id, dist FROM reach"
    return {
        "dead_code": _reach(f"{CONTROL} AND status = 'confirmed'", _JOBS, False, 24, "SELECT program_id FROM program WHERE program_id NOT IN (SELECT id FROM reach)"),
        "executing_jobs": _reach(CONTROL, _JOBS, False, 24, "SELECT id AS program_id, root AS job_id, dist FROM reach WHERE dist > 0"),
        "capabilities": _reach(f"(({CONTROL} AND status = 'confirmed') OR rel_type IN ('READS', 'WRITES'))", _JOBS, False, 24, "SELECT root, count(*) FILTER (WHERE id LIKE 'P%') AS programs, count(*) FILTER (WHERE id LIKE 'T%') AS tables, max(dist) AS depth FROM reach GROUP BY root"),
        "trace_down": _reach("rel_type = 'CALLS'", _seed("P1"), False, 8, "SELECT id, 'PROGRAM' AS kind, dist FROM reach UNION ALL SELECT e.target_id, 'TABLE', min(r.dist) + 1 FROM reach r JOIN edge e ON e.source_id = r.id AND e.rel_type IN ('READS', 'WRITES') GROUP BY e.target_id"),
        "graph_slice": with_("WITH e AS (SELECT DISTINCT source_id AS x, target_id AS y FROM edge WHERE confidence >= 0.7), w AS (SELECT 'P5' AS id, 0 AS dist UNION SELECT y, 1 FROM e WHERE x = 'P5' UNION SELECT b.y, 2 FROM e a JOIN e b ON b.x = a.y WHERE a.x = 'P5' UNION SELECT x, 1 FROM e WHERE y = 'P5' UNION SELECT b.x, 2 FROM e a JOIN e b ON b.y = a.x WHERE a.y = 'P5') SELECT id, min(dist) AS dist FROM w GROUP BY id ORDER BY min(dist), id LIMIT 100"),
        "expand_neighbors": with_("WITH e AS (SELECT source_id AS x, target_id AS y FROM edge WHERE rel_type = 'CALLS' UNION SELECT target_id, source_id FROM edge WHERE rel_type = 'CALLS'), w AS (SELECT id, 0 AS dist FROM (VALUES ('P1'), ('P9')) v(id) UNION SELECT e.y, w.dist + 1 FROM w JOIN e ON e.x = w.id WHERE w.dist < 3) SELECT id, min(dist) AS dist FROM w GROUP BY id", recursive=True),
        "blast_radius": _reach(ANY, _seed("T1"), True, 24, "SELECT id, dist, confidence FROM reach WHERE dist > 0"),
        "impact": _reach(ANY, _seed("T2"), True, 8, "SELECT substr(id, 1, 1) AS kind, dist, count(*) AS n FROM reach WHERE dist > 0 GROUP BY 1, 2"),
        "lineage": _reach(ANY, _seed("J1"), False, 6, flat),
        "root_summary": _reach(CONTROL, _JOBS, False, 24, "SELECT root, count(*) AS reached, count(*) FILTER (WHERE confidence < 0.5) AS unresolved, least(1.0E0, count(*) FILTER (WHERE confidence < 0.5) * 0.08E0 + count(*) / 3000.0E0) AS risk FROM reach GROUP BY root"),
        "simulate": _reach(ANY, _seed("T3"), True, 3, "SELECT scenario, CAST(least(100, d * w) AS BIGINT) AS risk, CAST(greatest(0, 100 - u * w) AS BIGINT) AS readiness FROM (VALUES ('rename', 1), ('replace', 3), ('retire', 5)) v(scenario, w), (SELECT count(*) AS d, count(*) FILTER (WHERE confidence < 1) AS u FROM reach WHERE dist > 0) x"),
        "weak_components": with_("WITH e AS (SELECT source_id AS x, target_id AS y FROM edge WHERE rel_type = 'CALLS' UNION SELECT target_id, source_id FROM edge WHERE rel_type = 'CALLS'), w AS (SELECT x AS id, x AS seen FROM e UNION SELECT w.id, e.y FROM w JOIN e ON e.x = w.seen) SELECT component, count(*) AS n FROM (SELECT id, min(seen) AS component FROM w GROUP BY id) c GROUP BY component", recursive=True),
        "centrality": with_(_rank_sql(50)),
        "degree_centrality": with_("WITH e AS (SELECT DISTINCT source_id, target_id FROM edge), d AS (SELECT id, count(*) AS g FROM (SELECT source_id AS id FROM e UNION ALL SELECT target_id FROM e) x GROUP BY id) SELECT id, CAST(g AS DOUBLE) / ((SELECT count(*) FROM d) - 1) AS centrality FROM d ORDER BY centrality DESC, id LIMIT 20"),
        "shard_modularity": with_("WITH w AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, CAST(count(*) AS DOUBLE) AS w FROM edge WHERE rel_type = 'CALLS' GROUP BY 1, 2), l AS (SELECT DISTINCT prog AS id, shard FROM seen), e AS (SELECT x.shard AS ca, y.shard AS cb, w FROM w JOIN l x ON x.id = a JOIN l y ON y.id = b WHERE a <> b), m AS (SELECT sum(w) AS m FROM e), i AS (SELECT ca AS c, sum(w) AS inside FROM e WHERE ca = cb GROUP BY ca), d AS (SELECT c, sum(w) AS d FROM (SELECT ca AS c, w FROM e UNION ALL SELECT cb, w FROM e) z GROUP BY c) SELECT round(sum(coalesce(inside, 0) / m - (d / (2 * m)) * (d / (2 * m))), 9) AS q FROM d LEFT JOIN i ON i.c = d.c, m"),
    }
