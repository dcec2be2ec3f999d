"""Benchmark decontamination by pigeonhole edit matching (operator 8).

A test item of m characters is leaked by a document that holds a passage within k = m * percent / 100 edits of it.  Cut into k + 1 pieces, at least one piece of the item is in the passage unchanged, so pieces are found by
one Aho-Corasick pass over each whole text, and around each hit the least distance of the whole item is worked out
with Myers' bit-parallel algorithm.  Texts and items are compared in lower case with runs of white space as one space.

Items are handed to tasks in blocks of bounded size (BLOCK_CHARS); more items make more passes over the documents, not
larger automata.

An item too short for an edit (k = 0: under 20 characters at 5 percent) is one piece, found where it begins and ends at
word boundaries.

Edge cases: null or empty texts and items leak nothing; equal items are each reported; repeated documents each report;
of two passages equally near the first is reported; an empty table on either side gives an empty result; texts of any
length are searched whole; extra columns of any name are left out by find_leaks() and pass through without_leaks().
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small_batches

#: Characters of benchmark items that one pass over the documents looks for.
BLOCK_CHARS = 4_000_000


def fold(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(m: int, percent: int) -> int:
    """The edits allowed for an item of m characters: they grow with its length alone."""
    return m * percent // 100


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of near equal length with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def within_word(a: str, b: str) -> bool:
    """Whether a word goes on from character a to b.  Scripts that put no spaces between words have a boundary anywhere."""
    return all(c.isalnum() and not ("\u0e00" <= c <= "\u0eff" or "\u1000" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff" or c >= "\u2e80") for c in (a, b))


def myers_best(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of a pattern of length m to any substring of text, and where the first such one ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    get = masks.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, at = score, i
    return best, at


class EditMatcher:
    def __init__(self, items: list[tuple[int, str]], percent: int = 5):
        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            t = fold(text)
            if not t:
                continue
            k = budget(len(t), percent)
            if not k:
                found.setdefault(t, []).append((len(self.items), 0))
                self.items.append((item, len(t), 0, None))
                continue
            masks: dict[str, int] = {}
            for i, c in enumerate(t):
                masks[c] = masks.get(c, 0) | 1 << i
            for at, piece in pieces(t, k):
                found.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item, len(t), k, masks))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def leaks(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, distance, where its passage ends in the folded text), the nearest passage of each item."""
        if not self.items or not text:
            return []
        t = fold(text)
        tried: dict[int, list[int]] = {}
        best: dict[int, tuple[int, int]] = {}
        for end, (length, where) in self.automaton.iter(t):
            for x, at in where:
                start = end + 1 - length - at
                item, m, k, masks = self.items[x]
                if masks is None:
                    if x not in best and not (start and within_word(t[start - 1], t[start])) and not (end + 1 < len(t) and within_word(t[end], t[end + 1])):
                        best[x] = (0, end + 1)
                    continue
                if best.get(x, (1, 0))[0] == 0 or any(abs(start - s) <= k // 2 for s in tried.get(x, ())):
                    continue
                tried.setdefault(x, []).append(start)
                # each window holds all passages whose start is within k // 2 of this one, and k edits more
                low = max(0, start - k - k // 2)
                d, e = myers_best(masks, m, t[low : start + m + k + k // 2])
                if d <= k and (x not in best or d < best[x][0]):
                    best[x] = (d, low + e)
        return [(self.items[x][0], d, e) for x, (d, e) in sorted(best.items())]


_matchers: dict[tuple, EditMatcher] = {}


def _matcher(items: tuple, percent: int) -> EditMatcher:
    key = (items, percent)
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = EditMatcher(list(items), percent)
    return _matchers[key]


def item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[tuple]:
    """The items in blocks of BLOCK_CHARS at most (or one longer item), read one block at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).orderBy("i", "t").toLocalIterator():
        if block and size + len(row.t) > BLOCK_CHARS:
            yield tuple(block)
            block, size = [], 0
        block.append((row.i, row.t))
        size += len(row.t)
    if block:
        yield tuple(block)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", percent: int = 5) -> DataFrame:
    """(id, item_id, distance, end_at) for each item and row of docs that holds it.

    If the documents' id has one of the other names, the column of that name gets underscores after it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = None
    names = [id, *(fresh(n, id) for n in ("item_id", "distance", "end_at"))]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, (T.LongType(), T.LongType(), T.IntegerType(), T.LongType()), strict=True)])
    for block in item_blocks(benchmark, item, item_text):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = _matcher(held.value, percent)
            for batch in batches:
                got = [(i, *x) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in own.leaks(t)]
                cols = list(zip(*got, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=names)

        found = docs.select(F.col(id).cast("long").alias(id), text).mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without the rows that hold an item; rows are judged in place, so no join is needed."""
    spark = docs.sparkSession
    small_batches(spark)
    for block in item_blocks(benchmark, options.get("item", "item_id"), options.get("item_text", "text")):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = _matcher(held.value, options.get("percent", 5))
            for batch in batches:
                keep = np.array([not own.leaks(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], bool)
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
