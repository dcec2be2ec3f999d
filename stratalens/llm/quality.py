"""Quality rules as weak supervision (operator 9).

Each rule votes good (1) or bad (-1) or abstains (0) on a document's measures.  Votes are counted by pattern (at most
3 ** rules patterns, whatever the input), expectation-maximisation on those counts estimates each rule's accuracy
and how often each class occurs, and each pattern gets the posterior probability that its documents are good.

Edge cases: a null or empty text has no words and fails the base rules; ties at a posterior of one half keep the
document; an empty table gives an empty result; repeated rows are judged alike; a text of any length is measured whole;
extra columns pass through, and columns named like the outputs are replaced, the text's own too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import replaced, small_batches

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouted", "n_same_as_last", "n_lines", "n_stops")


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES.

    n_shouted: words with an upper-case letter and no lower-case one, of two characters at least; n_same_as_last:
    words equal to the one before; n_lines: lines with a word; n_stops: full stops and like marks at word ends.
    """
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode().split()
    n = len(words)
    if not n:
        return (0,) * len(MEASURES)
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    repeats = 0
    if n >= 3:
        with np.errstate(over="ignore"):
            a = (h[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[:-2] >> np.uint64(31))
            b = ((a + h[1:-1]) * np.uint64(0xBF58476D1CE4E5B9)) ^ (h[1:-1] >> np.uint64(29))
            g = (b + h[2:]) * np.uint64(0x94D049BB133111EB)
        _, back, count = np.unique(g, return_inverse=True, return_counts=True)
        hit = count[back] > 1
        if hit.any():
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k : n - 2 + k] |= hit
            repeats = int(cover.sum())
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    shouted = sum(len(w) > 1 and w.isupper() for w in words)
    stops = sum(w[-1] in b".!?" for w in words)
    chars = len(text) - sum(map(text.count, SPACES))
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeats, shouted, int((h[1:] == h[:-1]).sum()), lines, stops


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the measures of its whole texts."""
    small_batches(df.sparkSession)
    keep, (own,) = replaced(df, MEASURES, text)
    schema = T.StructType([*keep.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([measure(t) for t in batch.column(own).to_pylist()], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[:, k]) for k in range(len(MEASURES)))], names=[*batch.schema.names, *MEASURES])

    out = keep.mapInArrow(run, schema)
    return out if own == text else out.drop(own)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The rules' votes as expressions over the measures."""
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.col
    mean = c("word_chars") / n
    return {
        "word_length": _vote((mean >= 2.5) & (mean <= 9), (mean < 2) | (mean > 14)),
        "symbols": _vote(c("n_symbols") * 100 <= n, c("n_symbols") * 10 >= n),
        "lines": _vote(c("n_dup_lines") == 0, (c("n_dup_lines") >= 2) & (c("n_dup_lines") * 2 >= c("n_lines"))),
        "repeats": _vote(c("n_repeat_words") * 10 <= n, c("n_repeat_words") * 10 >= n * 4),
        "stutter": _vote(c("n_same_as_last") * 20 <= n, c("n_same_as_last") * 5 >= n),
        "shouting": _vote(c("n_shouted") * 20 <= n, c("n_shouted") * 10 >= n * 3),
        "sentences": _vote((c("n_stops") * 50 >= n) & (c("n_stops") * 2 <= n), (c("n_stops") * 400 < n) | (c("n_stops") * 10 > n * 8)),
        "length": _vote((n >= 80) & (n <= 50_000), n < 20),
    }


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 0.8, strength: float = 20.0) -> tuple[np.ndarray, dict]:
    """Posterior of good for each pattern of votes, by expectation-maximisation.

    Documents are good, or bad in one of as many kinds as there are rules, each kind the one that a rule is made for;
    given the kind, rules vote independently, and whether a rule votes at all doesn't depend on the kind.  (With one
    bad class, the commonest kind takes it, and rules for rarer kinds seem worthless.)  Beta priors of `strength` votes
    start from, and draw to: a bad vote from 0.01 of good documents, 0.9 of the rule's own kind, 0.1 of other kinds.
    A rule calls 2 in 100 good documents bad at most and sees half of its own kind at least, which fixes the kinds.
    """
    k = patterns.shape[1]
    good, bad = (patterns == 1).astype(float), (patterns == -1).astype(float)
    start = np.full((k + 1, k), 0.1)  # [kind, rule]: how likely a vote is bad; kind 0 is good
    start[0] = 0.01
    start[np.arange(1, k + 1), np.arange(k)] = 0.9
    says_bad, share = start.copy(), np.array([prior, *[(1 - prior) / k] * k])
    first = share.copy()
    post = np.zeros((len(patterns), k + 1))
    for _ in range(rounds):
        log = np.log(share) + bad @ np.log(says_bad).T + good @ np.log(1 - says_bad).T
        new = np.exp(log - log.max(1, keepdims=True)) if len(log) else log
        new /= new.sum(1, keepdims=True)
        done = len(new) == 0 or np.abs(new - post).max() < 1e-9
        post = new
        w = counts[:, None] * post
        says_bad = (w.T @ bad + start * strength) / (w.T @ (good + bad) + strength)
        says_bad = np.clip(says_bad, 0.001, 0.98)
        says_bad[0] = np.minimum(says_bad[0], 0.02)
        own = (np.arange(1, k + 1), np.arange(k))
        says_bad[own] = np.maximum(says_bad[own], 0.5)
        share = (w.sum(0) + first * strength) / (counts.sum() + strength)
        if done:
            break
    return post[:, 0], {"bad_votes_on_good": says_bad[0].tolist(), "bad_votes_on_own_kind": says_bad[own].tolist(), "share_good": float(share[0])}


OUTPUTS = ("votes", "base_failed", "quality", "kept")


def judge_measured(measured: DataFrame, threshold: float = 0.5, least_words: int = 50, most_repeats: int = 50) -> DataFrame:
    """A frame that has the measures, with votes, base_failed, quality (posterior) and kept."""
    named = rules()
    voted = measured.drop(*[c for c in measured.columns if c in OUTPUTS]).withColumn("votes", F.concat_ws(",", *[v.cast("string") for v in named.values()]))
    # at most 3 ** len(rules) rows, whatever the input
    rows = voted.groupBy("votes").count().collect()
    patterns = np.array([[int(v) for v in r.votes.split(",")] for r in rows], int).reshape(-1, len(named))
    post, _ = fit_votes(patterns, np.array([r["count"] for r in rows], float))
    by = measured.sparkSession.createDataFrame([(r.votes, float(p)) for r, p in zip(rows, post, strict=True)], "votes string, quality double")
    base = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeats)
    return voted.join(F.broadcast(by), "votes", "left").withColumn("base_failed", base).withColumn("kept", ~base & (F.col("quality") >= threshold))


def judge(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """df with its measures and what judge_measured() adds.  Measures are worked out twice, so as not to write texts."""
    return judge_measured(with_measures(df, text), **options)


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that judge() keeps, with df's columns."""
    own = [f"__{k}" for k in range(len(df.columns))]  # df may have columns named like the measures
    named = df.toDF(*own)
    kept = judge(named, own[df.columns.index(text)]).where("kept")
    return kept.select(*[F.col(a).alias(b) for a, b in zip(own, df.columns, strict=True)])
