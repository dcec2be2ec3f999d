"""Toxicity by a weighted lexicon (operator 3).

Texts are folded (compatibility forms, look-alike letters, digits and signs that stand for letters within words, lower
case) and matched by Aho-Corasick against whole words and word beginnings, each with a weight learned from labelled
rows: the log odds of documents that hold it.  A match within an exception phrase doesn't count.  The summed weight is
normalised by the text's length, and a logistic curve fitted to the labelled rows turns it into a score.

Learning: lexicon and curve are fitted on at most FIT_ROWS labelled rows, taken by hash of the id; features are counted
by grouped aggregation, and at most MAX_TERMS enter the lexicon.  Rows with crc32(id) mod 5 = 0 are held out.

Edge cases: null and empty texts match nothing and get the score of no match; rows labelled twice count twice, and so do
repeated documents; null labels and labels without a document are left out; without labels of both classes every score
is 0.0; of terms of one weight the later in the alphabet is chosen first; a score of one half predicts 1; a text of any
length, and a word of any length, is matched whole; an empty table gives an empty result; columns named like the outputs
are replaced, the text's own too, others pass through whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import replaced, small_batches
from .jaccard import checked

MAX_TERMS, FIT_ROWS = 2_000, 20_000
#: Word beginnings of these lengths are candidates for the lexicon.
SHORTEST, LONGEST = 3, 9

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
# Digits and signs that stand for letters.
STANDINS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
# Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "stupid question", "sore loser", "pond scum")

_LOOK = str.maketrans(LOOKALIKES)
_STAND = str.maketrans(STANDINS)
#: A stand-in counts between letters, or before one (`$cum`); a `!` at a word's end is punctuation.
_INNER = re.compile(r"[^\W\d_][013457@$!8]+(?=[^\W\d_])|(?<!\w)[013457@$8](?=[^\W\d_])|(?<=[^\W\d_])[013457@$8](?![\w$])")
_INVISIBLE = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))
_BREAKS = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Folded words parted by one space, with a space at both ends."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_INVISIBLE)
    text = text.lower()
    if not text.isascii():
        text = text.translate(_LOOK)
    text = _INNER.sub(lambda m: m[0].translate(_STAND), text)
    return f" {_BREAKS.sub(' ', text).strip()} " if text.strip() else " "


def features(folded: str) -> set[str]:
    """The distinct candidates of a text: ` word ` for whole words, ` begin` for word beginnings."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(" " + w[:k] for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))
    return out


class Lexicon:
    def __init__(self, terms: dict[str, float], exceptions=EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        for t, w in terms.items():
            self.automaton.add_word(t, (len(t), w))
        for phrase in exceptions:
            p = f" {phrase} "
            self.automaton.add_word(p, (len(p), 0.0))
        self.automaton.make_automaton()

    def weigh(self, text: str | None) -> tuple[float, int, int]:
        """The summed weight of matches, the number of words that match, and the number of words.

        A word counts once, with its heaviest match; none within an exception phrase.
        """
        t = fold(text)
        n = t.count(" ") - 1 if len(t) > 1 else 0
        heavy: dict[int, float] = {}
        shut: list[tuple[int, int]] = []
        for end, (length, w) in self.automaton.iter(t):
            start = end + 1 - length
            if w == 0.0:
                shut.append((start, end))
            elif w > heavy.get(start, 0.0):
                heavy[start] = w
        if shut:
            heavy = {s: w for s, w in heavy.items() if not any(a <= s < b for a, b in shut)}
        return sum(heavy.values()), len(heavy), n


def shape(weight: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the curve sees: a constant, the weight by words, the weight itself damped, and whether anything matched."""
    n = np.maximum(words, 1)
    return np.stack([np.ones(len(n)), np.minimum(weight * 100 / n, 40) / 10, np.log1p(weight), hits > 0], 1).astype(float)


def fit_curve(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; times: how often each row counts."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (times * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (times * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def choose_terms(counted: list[tuple[str, int, int]], toxic: int, clean: int, least: int = 5, odds: float = 3.0) -> dict[str, float]:
    """Terms with their log odds.  A longer term is left out where a shorter beginning is chosen that says as much."""
    scored = []
    for term, a, b in counted:
        w = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        if a >= least and w >= odds:
            scored.append((w * math.sqrt(a), w, term))
    out: dict[str, float] = {}
    for _, w, term in sorted(scored, reverse=True)[: 4 * MAX_TERMS]:
        body = term.rstrip(" ")
        if not any(body[:k] in out and out[body[:k]] >= w - 1 for k in range(2, len(body) + 1)) and len(out) < MAX_TERMS:
            out[term] = min(w, 8.0)
    return out


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[dict[str, float], list[float]]:
    """The lexicon and the curve, from labelled rows that aren't held out."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col(id))).select(F.col(id).alias("__id"), F.col(label).cast("int").alias("__y"))
    total = known.count()
    if total > FIT_ROWS:
        known = known.where(F.pmod(F.xxhash64(F.lit("fit"), "__id"), F.lit(1 << 20)) < int(FIT_ROWS / total * 0.95 * (1 << 20)))
    # FIT_ROWS ids or so, but rows may be labelled many times: counted before they are broadcast
    known = checked(known.groupBy("__id", "__y").count().select("__id", "__y", F.col("count").alias("__n")))
    rows = docs.select(F.col(id).alias("__id"), F.col(text).alias("__t")).join(known, "__id").select("__id", "__t", "__y", "__n")
    n = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.sum("__n").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return {}, []

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, list[int]] = {}
            for t, y, k in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                for f in features(fold(t)):
                    sums.setdefault(f, [0, 0])[y == 1] += k
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v[1] for v in sums.values()], pa.int64()), pa.array([v[0] for v in sums.values()], pa.int64())], names=["f", "a", "b"])

    counted = rows.mapInArrow(spread, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n[1] + 1)) - F.log((F.col("b") + 0.5) / (n[0] + 1))
    best = counted.where(F.col("a") >= 5).withColumn("o", odds * F.sqrt("a")).where(odds >= 3.0).orderBy(F.desc("o"), "f").limit(4 * MAX_TERMS)
    terms = choose_terms([(r.f, r.a, r.b) for r in best.collect()], n[1], n[0])

    # FIT_ROWS documents at most: more than that only where ids are repeated in docs, and then the same ones each time
    got = _weighed(rows, "__t", terms).orderBy(F.xxhash64(F.lit("curve"), "__id"), "__id", "__y", "weight", "hits", "words").limit(FIT_ROWS).collect()
    x = shape(*(np.array([r[k] for r in got], float) for k in ("weight", "hits", "words")))
    return terms, fit_curve(x, np.array([r["__y"] == 1 for r in got], float), np.array([r["__n"] for r in got], float)).tolist()


_lexicons: dict[str, Lexicon] = {}


def _weighed(df: DataFrame, text: str, terms: dict[str, float]) -> DataFrame:
    """df without the text, with weight, hits and words."""
    spark = df.sparkSession
    held, key = spark.sparkContext.broadcast(terms), uuid.uuid4().hex  # MAX_TERMS entries at most
    others = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _lexicons:
            _lexicons.clear()
            _lexicons[key] = Lexicon(held.value)
        own = _lexicons[key]
        for batch in batches:
            got = [own.weigh(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], names=[*others, "weight", "hits", "words"])

    more = [T.StructField(n, k) for n, k in (("weight", T.DoubleType()), ("hits", T.LongType()), ("words", T.LongType()))]
    return df.mapInArrow(run, T.StructType([*(f for f in df.schema.fields if f.name != text), *more]))


def score(df: DataFrame, terms: dict[str, float], curve: list[float], text: str = "text") -> DataFrame:
    """df without the text, with weight, hits, words and score."""
    small_batches(df.sparkSession)
    keep, (own,) = replaced(df, ["weight", "hits", "words", "score"], text)
    got = _weighed(keep, own, terms)
    if not curve:
        return got.withColumn("score", F.lit(0.0))
    n = F.greatest(F.col("words"), F.lit(1))
    z = F.lit(curve[0]) + curve[1] * F.least(F.col("weight") * 100 / n, F.lit(40.0)) / 10 + curve[2] * F.log1p("weight") + F.when(F.col("hits") > 0, curve[3]).otherwise(0.0)
    return got.withColumn("score", 1 / (1 + F.exp(-z)))
