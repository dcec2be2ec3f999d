"""Ranked lexical search with integer scores: windowed bucket scoring (operator 12).

Terms are runs of letters and digits of ASCII and of all characters beyond it, A-Z folded.  With N documents that have a
term, L terms in all, n terms in a document, df documents that hold a term and tf occurrences in one, a term weighs
w = floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m is 100 - B + B n N div L, and its score is the sum over the
item's terms (repeats counted) of w ((1000000000 tf) div (1000 tf + 8 m)).

1. One pass over the texts writes the postings of the items' terms (document, n, terms, tf), without a shuffle.
   N, L, df and the range of ids are sums over that table.
2. Each task sorts its postings by id and goes through them in fixed windows of the id range, wide enough to hold about
   8192 documents on average and cut at so many.  A window's postings are dealt by term.  An item's terms are
   scattered and added into an array of one number a document, which stays in the processor's cache, and the terms'
   bitsets of documents are united; the documents of that bitset are harvested into the item's heap and cleared.
3. A task returns its heaps, k rows an item at most; rows are ranked by parts, then by item.

Scores are of single documents, so windows may be split between tasks, and a hot or repeated id needs no care.  Items
are read in blocks of some million characters; each is a pass over the documents.

Edge cases: null and empty texts have no terms and count in no sum; items without terms, or whose terms no document
holds or all do (w = 0), give no rows; equal scores rank by id, null ids last; repeated documents are documents each,
and repeated items are ranked each (their rows are told apart by item row); texts of any length are read whole; extra
columns don't enter.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Stages, small_batches
from .decontam import item_blocks

#: Documents of a window: 64 KB of scores.
WINDOW = 8192
#: First ranking: parts of an item's rows.
PARTS = 64
#: Weight of a document's length, in hundredths.
LENGTH = 75

_FOLD = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def postings(docs: DataFrame, id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tf) of each document with a term; terms: numbers of those in the vocabulary, tf: how often each."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = held.value.get
        for batch in batches:
            n, found, times = [], [], []
            for t in batch.column(1).to_pylist():
                words = terms(t)
                known = np.array([x for x in map(get, words) if x is not None], np.int32)
                own, often = np.unique(known, return_counts=True)
                n.append(len(words))
                found.append(own)
                times.append(often)
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), _lists(found, np.int32), _lists(times, np.int64)], names=["id", "n", "terms", "tf"])
            yield out.filter(pc.greater(out.column(1), 0))

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "id long, n long, terms array<int>, tf array<long>")


def _lists(rows: list[np.ndarray], kind: type) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind)))


def windows(batches: Iterator[pa.RecordBatch], span: int, window: int = WINDOW) -> Iterator[list[pa.RecordBatch]]:
    """Slices of the batches (in order of column 0) by windows of span ids, window rows at most."""
    held: list[pa.RecordBatch] = []
    have, now = 0, None
    for batch in batches:
        ids = batch.column(0)
        key = ids.fill_null(0).to_numpy() // span
        key = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).max, key)
        start = 0
        for end in [*(np.flatnonzero(np.diff(key)) + 1).tolist(), *([len(key)] if len(key) else [])]:
            while start < end:
                if have and (key[start] != now or have == window):
                    yield held
                    held, have = [], 0
                take = min(end - start, window - have)
                held.append(batch.slice(start, take))
                have, now, start = have + take, key[start], start + take
    if have:
        yield held


class Scorer:
    """Heaps of the k best documents of each item."""

    def __init__(self, items: list[Counter], weights: np.ndarray, n_docs: int, n_terms: int, k: int, window: int = WINDOW):
        self.items, self.weights, self.n_docs, self.n_terms, self.k = items, weights, n_docs, n_terms, k
        self.heaps: list[list[tuple]] = [[] for _ in items]
        self.scores = np.zeros(-(-window // 8) * 8, np.int64)

    def add(self, window: pa.Table) -> None:
        ids, n = window.column(0).to_pylist(), window.column(1).to_numpy()
        lists = window.column(2).combine_chunks()
        found = pc.list_flatten(lists).to_numpy()
        tf = pc.list_flatten(window.column(3).combine_chunks()).to_numpy()
        slot = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy())
        m = (100 - LENGTH) + LENGTH * n * self.n_docs // self.n_terms
        gain = self.weights[found] * (1_000_000_000 * tf // (1000 * tf + 8 * m[slot]))
        order = np.argsort(found, kind="stable")
        found, slot, gain = found[order], slot[order], gain[order]
        cuts = [0, *(np.flatnonzero(np.diff(found)) + 1).tolist(), len(found)] if len(found) else [0]
        lists_of = {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            bits = np.zeros(len(self.scores), bool)
            bits[slot[a:b]] = True
            lists_of[int(found[a])] = slot[a:b], gain[a:b], np.packbits(bits)
        for item, heap in zip(self.items, self.heaps, strict=True):
            self._harvest(heap, self._scatter(item, lists_of), ids)

    def _scatter(self, item: Counter, lists_of: dict) -> np.ndarray:
        occupied = np.zeros(len(self.scores) // 8, np.uint8)
        for term, times in item.items():
            if term in lists_of:
                slots, gain, bits = lists_of[term]
                self.scores[slots] += gain if times == 1 else times * gain
                occupied |= bits
        return occupied

    def _harvest(self, heap: list[tuple], occupied: np.ndarray, ids: list) -> None:
        slots = np.flatnonzero(np.unpackbits(occupied))
        got = self.scores[slots]
        self.scores[slots] = 0
        enough = got >= (heap[0][0] if len(heap) == self.k else 1)
        slots, got = slots[enough], got[enough]
        if len(got) > self.k:
            near = got >= np.partition(got, len(got) - self.k)[len(got) - self.k]
            slots, got = slots[near], got[near]
            best = np.lexsort((slots, -got))[: self.k]
            slots, got = slots[best], got[best]
        for s, score in zip(slots.tolist(), got.tolist(), strict=True):
            i = ids[s]
            entry = (score, i is not None, 0 if i is None else -i)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def _best(rows: DataFrame, k: int) -> DataFrame:
    """rows (q, id, score) with rank, the k best of each q."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    parted = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    first = parted.withColumn("rank", F.row_number().over(W.partitionBy("q", "part").orderBy(*order))).where(F.col("rank") <= k).drop("part")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def _search(docs: DataFrame, id: str, text: str, block: tuple, k: int, stages: Stages, width: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    wanted = [Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms(own.encode())) for _, own in block]
    table = stages.write(postings(docs, id, text, vocabulary), "postings")
    n_docs, n_terms, low, high = table.agg(F.count(F.lit(1)), F.sum("n"), F.min("id"), F.max("id")).first()
    df = dict(table.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = np.array([weight(n_docs, df.get(x, 0)) for x in range(len(vocabulary))], np.int64)
    span = max(width, -(-(high - low + 1) * width // n_docs)) if low is not None else width
    held = spark.sparkContext.broadcast((wanted, weights))
    names = [i for i, _ in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, own = held.value
        scorer = Scorer(items, own, n_docs, n_terms or 1, k, width)
        for window in windows(batches, min(span, 1 << 62), width):
            scorer.add(pa.Table.from_batches(window))
        rows = [(q, names[q], -i if known else None, score) for q, heap in enumerate(scorer.heaps) for score, known, i in heap]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["q", "item", "id", "score"])

    return _best(table.sortWithinPartitions(F.col("id").asc_nulls_last()).mapInArrow(run, "q long, item long, id long, score long"), k)


def top_documents(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 10, window: int = WINDOW) -> DataFrame:
    """(item_id, rank, doc_id, score, item_row): the k best documents of each item, under these names."""
    spark = docs.sparkSession
    small_batches(spark)
    stages = Stages(spark, "search")
    out, before = None, 0
    for block in item_blocks(items, item, item_text):
        found = _search(docs, id, text, block, k, stages, window).withColumn("item_row", F.col("q") + before)
        out = found if out is None else out.unionByName(found)
        before += len(block)
    if out is None:
        out = spark.createDataFrame([], "item long, id long, score long, rank int, item_row long")
    return out.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score", "item_row")
