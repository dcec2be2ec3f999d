"""Exact Jaccard join of word n-gram sets with a count-vector R-tree (operator 5).

A document's set is the 64-bit hashes of its distinct n-word shingles; two sets link when
den * |A & B| >= num * |A | B|.  The result is each document's component under links.

1. One pass over the texts makes sets, a 64-bit signature of each set, and the set's least hashes (its prefix).
   Documents of one signature are one set from here on.  With threshold t and a slack of l more hashes, two linked
   sets share at least l hashes of their prefixes of n - ceil(t n) + l (prefix filtering).
2. Prefix hashes meet by value.  Sets with fewer than l hashes that any other set has can't link and are done.  Of the
   others only all but the l - 1 most frequent of their shared hashes are kept: linked sets still share one.
3. Sets that share a kept hash are blocks.  Tokens are hashed into groups, a set's counts by group are a point, points
   are kept in an R-tree; the sum of the coordinate minima of a point and a node's upper corner bounds the overlap.
   First, each set goes to one block's centre, where surviving pairs are verified at once and united, and again to
   centres of other components as long as that unites many; so a group of near copies, of any size, costs in
   proportion to its size.
4. Sets that still share a kept hash with another component mostly share a common passage.  All their hashes meet by
   value: only those that two components hold count.  A set with fewer of them than a link needs is done; of the
   others the most frequent are left out as in 2, now by frequency and without slack, so a passage makes no block
   unless a set consists of passages.  These blocks are joined by R-tree across components and by finer
   points (the same bound with 65536 groups), pairs are verified, and components follow from all links.

Blocks over CHUNK sets are cut into chunks (with the centre in each) or joined by pairs of chunks, so no task gets an
unbounded group.

Edge cases: a null or empty text has an empty set and links with nothing; fewer than n words are one shingle; repeated
rows and ids are one row each in the result; rows with a null id get the least id of their component, null if
there is none; equal similarity to the threshold links; texts of any length are taken whole, and a set of any size is
one record; an empty table gives an empty result; extra columns of any name are left out of the join and pass through
drop_near_duplicates().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import Stages, WordHashes, positioned, shingle_hashes, small_batches
from .components import components

CHUNK = 512
GROUPS = 64
LEAF = 32
#: An id list of up to so many rows (16 MB) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rounds of uniting by centres at most; blocks that are mixed after them are joined whole.
ROUNDS = 4


def signature(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) >> 1


class CountTree:
    """A bulk-loaded R-tree over count vectors."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.counts, self.sizes = counts, sizes
        self.nodes: list[tuple] = []  # upper corner, least size, left, right, members
        self.root = self._build(np.arange(len(sizes))) if len(sizes) else -1

    def _build(self, members: np.ndarray) -> int:
        own = self.counts[members]
        at = len(self.nodes)
        self.nodes.append(())
        left = right = -1
        if len(members) > LEAF:
            spread = own.max(0) - own.min(0)
            by = self.sizes[members] if np.ptp(self.sizes[members]) > spread.max() else own[:, spread.argmax()]
            order = members[np.argsort(by, kind="stable")]
            left, right = self._build(order[: len(order) // 2]), self._build(order[len(order) // 2 :])
        self.nodes[at] = (own.max(0), int(self.sizes[members].min()), left, right, members)
        return at

    def near(self, point: np.ndarray, size: int, num: int, den: int, skip=None) -> np.ndarray:
        """Members whose overlap with the point may reach what a link needs.  skip(members): True to pass over them."""
        out, todo = [], [self.root] if self.root >= 0 else []
        while todo:
            upper, least, left, right, members = self.nodes[todo.pop()]
            if int(np.minimum(point, upper).sum()) * (num + den) < num * (size + least):
                continue
            if skip is not None and skip(members):
                continue
            if left >= 0:
                todo += [left, right]
                continue
            bound = np.minimum(point, self.counts[members]).sum(1)
            out.append(members[bound * (num + den) >= num * (size + self.sizes[members])])
        return np.concatenate(out) if out else np.empty(0, int)


    def join(self, num: int, den: int, skip=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members that may link, by pairs of leaves whose corners' bound allows it.

        skip(members, members): True to pass over a pair of leaves.
        """
        leaves = [n for n in self.nodes if n[2] < 0]
        upper, least = np.stack([n[0] for n in leaves]), np.array([n[1] for n in leaves])
        for i, (_, _, _, _, a) in enumerate(leaves):
            bound = np.minimum(upper[i], upper[i:]).sum(1)
            for j in (np.flatnonzero(bound * (num + den) >= num * (least[i] + least[i:])) + i).tolist():
                b = leaves[j][4]
                if skip is not None and skip(a, b):
                    continue
                both = np.minimum(self.counts[a][:, None], self.counts[b][None]).sum(2) * (num + den)
                ok = both >= num * (self.sizes[a][:, None] + self.sizes[b][None])
                x, y = np.nonzero(np.triu(ok, 1) if i == j else ok)
                if len(x):
                    yield a[x], b[y]


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted distinct sets link."""
    if min(len(a), len(b)) * den < num * max(len(a), len(b)) or not len(a):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(a) + len(b) - common)


def forest(sets: list[np.ndarray], counts: np.ndarray, comps: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join what all links join beyond the components given; what is joined already is passed over."""
    parent = list(range(len(sets)))
    first: dict[int, int] = {}
    for i, c in enumerate(comps):
        parent[i] = first.setdefault(c, i)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def joined(a: np.ndarray, b: np.ndarray) -> bool:
        root = find(int(a[0]))
        return all(find(x) == root for x in a.tolist()) and all(find(x) == root for x in b.tolist())

    links = []
    for a, b in CountTree(counts, np.array([len(s) for s in sets])).join(num, den, joined):
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if (p := find(i)) != (q := find(j)) and linked(sets[i], sets[j], num, den):
                parent[max(p, q)] = min(p, q)
                links.append((i, j))
    return links


def count_vector(hashes: np.ndarray) -> np.ndarray:
    return np.bincount((hashes & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def least_overlap(n, num: int, den: int):
    """ceil(t n): the least overlap with which a set of n can link."""
    return -(-n * num // den)


def slack(n, part: int):
    """The number of hashes beyond the plain prefix: n / part, 1 at least; does not fall as n grows."""
    return n // part + 1


def _scan(df: DataFrame, text: str, n: int, num: int, den: int, part: int) -> DataFrame:
    """id, size, sig and the prefix; the prefix is left out where this task has seen the signature already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = WordHashes(), set()
        for batch in batches:
            sizes, sigs, keys = [], [], []
            for t in batch.column(1).to_pylist():
                h = shingle_hashes(t, n, cache)
                sig = signature(h)
                sizes.append(len(h))
                sigs.append(sig)
                if len(h) and sig not in seen:
                    seen.add(sig)
                    keys.append(h[: len(h) - least_overlap(len(h), num, den) + slack(len(h), part)].view(np.int64))
                else:
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "size", "sig", "keys"])

    return df.select(F.col("id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "id long, size long, sig long, keys array<long>")


def _sets(df: DataFrame, n: int) -> DataFrame:
    """sig, size, set (bytes of the sorted hashes) and counts (bytes of the point)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            got = [shingle_hashes(t, n, cache) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([signature(h) for h in got], pa.int64()), pa.array([len(h) for h in got], pa.int64()), pa.array([h.tobytes() for h in got], pa.binary()), pa.array([count_vector(h).tobytes() for h in got], pa.binary())],
                names=["sig", "size", "set", "counts"],
            )

    return df.select(F.col("text").cast("binary").alias("t")).mapInArrow(run, "sig long, size long, set binary, counts binary")


def checked(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """small, with a broadcast hint if it has been counted to stay under the limit."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def _chunked(df: DataFrame, by: str, salt: str) -> DataFrame:
    """df with chunks (how many by is cut into) and chunk."""
    n = df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    return df.join(n, by).withColumn("chunk", F.pmod(F.xxhash64(F.lit(salt), "sig"), F.col("chunks")).cast("int"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (rows of one value in column 0, which come together)."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = len(key)
        while cut and key[cut - 1] == key[-1]:
            cut -= 1
        if rest and cut == 0 and rest[-1].column(0)[0].as_py() == key[-1]:
            rest.append(batch)
            continue
        if rest and rest[-1].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        if cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def _spans(key: np.ndarray) -> Iterator[tuple[int, int]]:
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    yield from zip(at[:-1].tolist(), at[1:].tolist(), strict=True)


def _leaves(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the groups that fit into one leaf, for all groups of a size at once."""
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    first, size = at[:-1], np.diff(at)
    for m in range(2, LEAF + 1):
        starts = first[size == m]
        if len(starts):
            i, j = np.triu_indices(m, 1)
            yield (starts[:, None] + i).ravel(), (starts[:, None] + j).ravel()


def _points(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, GROUPS)


def _star_links(stars: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that unite what is linked within each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _groups(batches):
            a, b = [], []
            key, sig = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            comp, points = whole.column(4).to_numpy(), _points(whole.column(3))
            for i, j in _spans(key):
                if j - i > 1:
                    sets = [np.frombuffer(x, np.uint64) for x in whole.column(2).slice(i, j - i).to_pylist()]
                    for x, y in forest(sets, points[i:j], comp[i:j].tolist(), num, den):
                        a.append(int(sig[i + x]))
                        b.append(int(sig[i + y]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return stars.repartition("g").sortWithinPartitions("g").select("g", "sig", "set", "counts", "comp").mapInArrow(run, "a long, b long")


def fine_overlaps(points: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Summed coordinate minima of all pairs of fine points (sorted group numbers, one for each token)."""
    flat = np.concatenate(points).astype(np.int64)
    row = np.repeat(np.arange(len(points)), [len(p) for p in points])
    new = np.concatenate([[True], (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])])
    at = np.arange(len(flat))
    again = at - np.maximum.accumulate(np.where(new, at, 0))  # 0 for a group's first token, 1 for its second
    _, column, count = np.unique(flat << 32 | again, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    row, column = row[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(points), len(points)), np.float32)
    for low in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(points), width), np.float32)
        part[row[i:j], column[i:j] - low] = 1
        out += part @ part.T
    return out


def _block_pairs(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs of two components whose bounds in the block leave a link possible: by R-tree, then by fine points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _groups(batches):
            a, b = [], []
            key, sig, comp, size, side = (whole.column(k).to_numpy() for k in range(5))
            points, fine = _points(whole.column(5)), whole.column(6)
            span = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            near: list[tuple[np.ndarray, np.ndarray]] = []
            for x, y in _leaves(key):
                ok = (comp[x] != comp[y]) & ((side[x] != side[y]) | (side[x] == 0)) & (np.minimum(size[x], size[y]) * den >= num * np.maximum(size[x], size[y]))
                x, y = x[ok], y[ok]
                ok = np.minimum(points[x], points[y]).sum(1) * (num + den) >= num * (size[x] + size[y])
                near.append((x[ok], y[ok]))
            for i, j in _spans(key):
                if j - i <= LEAF:
                    continue
                # both sides are 0 in a chunk by itself; in a pair of chunks only pairs across count
                one = lambda m, n, c=comp[i:j], s=side[i:j]: (c[m] == c[m[0]]).all() and (c[n] == c[m[0]]).all() or (s[m[0]] > 0 and (s[m] == s[m[0]]).all() and (s[n] == s[m[0]]).all())
                for x, y in CountTree(points[i:j], size[i:j]).join(num, den, one):
                    x, y = x + i, y + i
                    ok = (comp[x] != comp[y]) & ((side[x] != side[y]) | (side[x] == 0))
                    near.append((x[ok], y[ok]))
            x, y = (np.concatenate(c) if c else np.empty(0, int) for c in (zip(*near, strict=True) if near else ((), ())))
            order = np.argsort(span[x], kind="stable")
            x, y = x[order], y[order]
            for i, j in _spans(span[x]) if len(x) else ():
                used, at = np.unique(np.concatenate([x[i:j], y[i:j]]), return_inverse=True)
                both = fine_overlaps([np.frombuffer(f, np.uint16) for f in fine.take(pa.array(used)).to_pylist()])[at[: j - i], at[j - i :]]
                ok = np.flatnonzero(both * (num + den) >= num * (size[x[i:j]] + size[y[i:j]])) + i
                a += np.minimum(sig[x[ok]], sig[y[ok]]).tolist()
                b += np.maximum(sig[x[ok]], sig[y[ok]]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocks.repartition("g").sortWithinPartitions("g").select("g", "sig", "comp", "size", "side", "counts", "fine").mapInArrow(run, "a long, b long")


def _fine(sets: DataFrame) -> DataFrame:
    """sig, size, counts and fine: the point in 65536 groups, as the sorted numbers of its tokens' groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [np.sort((np.frombuffer(x, np.uint64) >> np.uint64(16)).astype(np.uint16)).tobytes() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fine, pa.binary())], names=["sig", "size", "counts", "fine"])

    return sets.select("sig", "size", "counts", "set").mapInArrow(run, "sig long, size long, counts binary, fine binary")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    need = checked(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct())
    sets = sets.join(need, "sig", "left_semi")
    one, two = sets.select(F.col("sig").alias("a"), F.col("set").alias("sa")), sets.select(F.col("sig").alias("b"), F.col("set").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _stars(centre: DataFrame, sets: DataFrame, comp: DataFrame | None, stages: Stages) -> DataFrame:
    """Groups (g) of the sets of each centre, cut into chunks with the centre in each; with components so far.

    The groups (three numbers a row) meet the sets by broadcast if they are few enough, so sets move once, to their group.
    """
    own = centre.where("sig <> centre")
    own = _chunked(own, "centre", "star")
    hubs = own.groupBy("centre").agg(F.first("chunks").alias("chunks")).select("centre", F.col("centre").alias("sig"), "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    out = own.unionByName(hubs).withColumn("g", F.xxhash64("centre", "chunk")).select("g", "sig")
    out = out.withColumn("comp", F.col("sig")) if comp is None else out.join(comp.withColumnRenamed("v", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    return sets.join(checked(stages.write(out, "stars")), "sig")


def _hashes(sets: DataFrame) -> DataFrame:
    """(sig, comp, key) for each hash of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x) // 8 for x in batch.column(2).to_pylist()]
            key = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            sig, comp = (np.repeat(batch.column(k).to_numpy(), sizes) for k in (0, 1))
            for at in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (sig, comp, key)], names=["sig", "comp", "key"])

    return sets.select("sig", "comp", "set").mapInArrow(run, "sig long, comp long, key long")


def _narrowed(sets: DataFrame, num: int, den: int, stages: Stages) -> DataFrame:
    """(key, sig, comp): blocks in which all that links across the components of sets meets; see 4 above.

    Every set that may link across components must be in sets, with sig, comp, size and set.
    """
    by, own = W.partitionBy("key"), W.partitionBy("sig")
    met = _hashes(sets).repartition("key").withColumn("lo", F.min("comp").over(by)).withColumn("hi", F.max("comp").over(by)).withColumn("df", F.count(F.lit(1)).over(by))
    met = stages.write(met.where("lo <> hi").select("sig", "comp", "key", "df"), "met")
    enough = met.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).join(sets.select("sig", "size"), "sig")
    enough = enough.withColumn("spare", F.col("c") - F.expr(f"(size * {num} + {den - 1}) div {den}")).where("spare >= 0")
    left = met.join(checked(stages.write(enough.select("sig", "spare"), "enough")), "sig")
    left = left.withColumn("k", F.row_number().over(own.orderBy("df", "key"))).where("k <= spare + 1")
    left = left.withColumn("lo", F.min("comp").over(by)).withColumn("hi", F.max("comp").over(by))
    return stages.write(left.where("lo <> hi").select("key", "sig", "comp"), "narrow")


def _mixed(blocks: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of blocks that hold two components or more, with their components."""
    now = blocks.join(comp.withColumnRenamed("v", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    by = W.partitionBy("key")
    return now.withColumn("lo", F.min("comp").over(by)).withColumn("hi", F.max("comp").over(by)).where("lo <> hi").select("key", "sig", "comp")


def _rooted(df: DataFrame, id: str, text: str, n: int, num: int, den: int, part: int) -> DataFrame:
    """(id, size, sig, comp) for each row of df."""
    spark = df.sparkSession
    small_batches(spark)
    stages = Stages(spark, "jaccard")
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    scan = stages.write(_scan(rows, "text", n, num, den, part), "scan")
    least = F.expr(f"(size * {num} + {den - 1}) div {den}")  # least_overlap() of size, and slack() of that
    shared = F.floor(least / part) + 1

    keys = scan.where("keys is not null").select("sig", "size", F.explode("keys").alias("key"))
    met = keys.repartition("key").groupBy("key", "sig").agg(F.first("size").alias("size"))
    met = met.withColumn("df", F.count(F.lit(1)).over(W.partitionBy("key"))).where("df > 1")
    own = W.partitionBy("sig")
    kept = met.withColumn("c", F.count(F.lit(1)).over(own)).withColumn("need", shared).where("c >= need")
    kept = kept.withColumn("k", F.row_number().over(own.orderBy("df", "key"))).where("k <= c - need + 1")
    blocks = stages.write(kept.select("key", "sig"), "blocks")

    centre = blocks.withColumn("m", F.min("sig").over(W.partitionBy("key"))).groupBy("sig").agg(F.min("m").alias("centre"))
    centre = stages.write(centre, "centre")
    slim = stages.write(scan.select("id", "size", "sig"), "rows")
    stages.drop(scan)
    first = slim.groupBy("sig").agg(F.min("id").alias("id"))
    wanted = first.join(centre.select("sig"), "sig", "left_semi").select(F.col("id").alias("w"))
    wanted = checked(stages.write(wanted.distinct(), "wanted"))
    texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("w")), "left_semi")
    sets = _sets(texts, n).dropDuplicates(["sig"])
    sets = bare = stages.write(sets.join(checked(centre.select("sig")), "sig", "left_semi"), "sets")

    links = stages.write(_star_links(_stars(centre, bare, None, stages), num, den), "links")
    comp = components(links, stages)
    for turn in range(ROUNDS):
        mixed = stages.write(_mixed(blocks, comp), "mixed")
        if turn == ROUNDS - 1:
            break
        by = W.partitionBy("key")
        # each set's centre: of its blocks' sets in other components, the first in this turn's order
        one = F.struct(F.xxhash64(F.lit(turn), "sig").alias("h"), "sig", "comp")
        ranked = mixed.withColumn("m", F.min(one).over(by)).withColumn("n", F.min(F.when(F.col("comp") != F.col("m.comp"), one)).over(by))
        to = ranked.withColumn("to", F.when(F.col("comp") != F.col("m.comp"), F.col("m")).otherwise(F.col("n"))).groupBy("sig").agg(F.min("to").alias("to"))
        turned = stages.write(to.select("sig", F.col("to.sig").alias("centre")), "turned")
        more = stages.write(_star_links(_stars(turned, bare, comp, stages), num, den), "links")
        found = more.count()
        if not found:
            break
        links = links.union(more)
        comp = components(links, stages)
        if found * 50 < turned.count():
            mixed = stages.write(_mixed(blocks, comp), "mixed")
            break

    again = checked(stages.write(mixed.select("sig", "comp").distinct(), "again"))
    mixed = _chunked(_narrowed(sets.join(again, "sig"), num, den, stages), "key", "block")
    whole = mixed.where("chunks = 1").withColumn("g", F.xxhash64("key")).withColumn("side", F.lit(0))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    cut = mixed.where("chunks > 1").withColumn("o", other)
    lo, hi = F.least("chunk", "o"), F.greatest("chunk", "o")
    cut = cut.withColumn("g", F.xxhash64("key", lo, hi)).withColumn("side", F.when(F.col("chunk") == F.col("o"), 0).when(F.col("chunk") < F.col("o"), 1).otherwise(2)).drop("o")
    points = stages.write(_fine(sets.join(checked(stages.write(mixed.select("sig").distinct(), "last")), "sig")), "points")
    pairs = _block_pairs(whole.unionByName(cut).join(points, "sig"), num, den)
    pairs = stages.write(pairs.distinct(), "pairs")
    more = stages.write(_verified(pairs, sets, num, den), "more")
    final = components(links.union(more), stages)

    rooted = slim.join(final.withColumnRenamed("v", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    return stages.write(rooted, "rooted")


def similarity_components(df: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100, part: int = 16) -> DataFrame:
    """(id, n_shingles, component_id) for each row of df: sets link at num / den; part: see slack()."""
    rooted = _rooted(df, id, text, n, num, den, part)
    many = rooted.where("size > 0").groupBy("comp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    out = rooted.join(checked(Stages(df.sparkSession, "components").write(many.select("comp", "least"), "many")), "comp", "left")
    return out.select(F.col("id").alias(id), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.coalesce("least", "id")).otherwise(F.col("id")).alias("component_id"))


def _signed(df: DataFrame, text: str, n: int) -> DataFrame:
    """df with __sig and __size of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            got = [shingle_hashes(t, n, cache) for t in batch.column(0).to_pylist()]
            more = [pa.array([signature(h) for h in got], pa.int64()), pa.array([len(h) for h in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *more], names=[*batch.schema.names[1:], "__sig", "__size"])

    schema = T.StructType([*df.schema.fields, T.StructField("__sig", T.LongType()), T.StructField("__size", T.LongType())])
    return df.select(F.col(text).cast("binary").alias("__t"), *df.columns).mapInArrow(run, schema)


def drop_near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """df with one row of each component: the least id's (null last), of its rows in the component the least signature's.

    Rows are told apart by id and signature, so other texts of a shared or null id stay or go by their own components; of
    rows equal in both, one stays.  Rows with no words all stay.  Only rows whose id is null or shared are signed anew.
    """
    names = df.columns
    df, (id, text) = positioned(df, id, text)
    stages = Stages(df.sparkSession, "dedup")
    small_batches(df.sparkSession)
    rooted = _rooted(df, id, text, n, num, den, 16).where("size > 0")
    keep = rooted.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sig")).alias("k")).select("comp", "k.id", "k.sig")
    odd = checked(stages.write(df.groupBy(F.col(id).cast("long").alias("__odd")).count().where("count > 1 OR __odd IS NULL").select("__odd"), "odd"))
    other = rooted.join(keep.withColumnRenamed("id", "kid").withColumnRenamed("sig", "ksig"), "comp").where(~(F.col("id").eqNullSafe(F.col("kid")) & (F.col("sig") == F.col("ksig"))))
    gone = stages.write(other.select(F.col("id").alias("__gone"), F.col("sig").alias("__gsig")).distinct(), "gone")
    mine = F.col(id).cast("long")
    alone = df.join(odd, mine.eqNullSafe(F.col("__odd")), "left_anti").join(checked(gone.select("__gone")), mine == F.col("__gone"), "left_anti")
    signed = _signed(df.join(odd, mine.eqNullSafe(F.col("__odd")), "left_semi"), text, n)
    left = signed.where("__size > 0").join(checked(gone), mine.eqNullSafe(F.col("__gone")) & (F.col("__sig") == F.col("__gsig")), "left_anti")
    one = left.withColumn("__id", mine).dropDuplicates(["__id", "__sig"])
    return alone.unionByName(one.select(*df.columns)).unionByName(signed.where("__size = 0").select(*df.columns)).toDF(*names)
