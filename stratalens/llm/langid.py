"""Language identification by Bayesian evidence fusion (operator 2).

For each language l, log posterior = tempered log likelihood of the text's character trigrams
  + log P(declared markup language | l) + log P(address suffix | l) + log prior(l | host).

Trigram models are fitted on at most TRAIN_ROWS rows a language, taken by hash of the id.  P(declared | l) and host
priors come from grouped aggregation of the text posteriors over all rows.  A host's prior is smoothed with its domain's
(the last two names, or three below names such as co.uk), that with the corpus's, by pseudo-counts; a row's own share is taken out of its host's counts.

Edge cases: without text, markup, suffix and host the corpus prior decides; null parts are no evidence; ties go to
the first language by name; an empty table gives an empty result; repeated rows are rows of their own; texts and words
of any length are read whole; columns named like the outputs are replaced, others pass through whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Generations
from .common import Stages, positioned, small_batches
from .jaccard import BROADCAST_ROWS

TRAIN_ROWS, MAX_GRAMS = 2_000, 60_000
#: A text counts as so many independent trigrams at most.
EFFECTIVE = 60.0
DOMAIN_COUNT, CORPUS_COUNT = 5.0, 5.0

# Languages that a country's suffix speaks for, and how often a site of the language has it.
SUFFIXES = {"de": "de", "at": "de", "ch": "de", "fr": "fr", "be": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl"}
SUFFIX_ODDS = 20.0


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


class TrigramModel:
    """Log probabilities of trigrams by language, and of unseen ones."""

    def __init__(self, languages: list[str], table: dict[str, list[float]], unseen: list[float]):
        self.languages, self.table, self.unseen = languages, table, unseen
        self.words = Generations(self._word, 150_000)

    def _word(self, word: str) -> tuple[float, ...]:
        got = [self.table.get(g, self.unseen) for g in grams(word.lower())]
        return (*map(sum, zip(*got, strict=True)), float(len(got)))

    def _of(self, words: list[str]) -> list[tuple[float, ...]]:
        """Each word's sums; long words hardly come again, so they aren't kept."""
        if max(map(len, words)) <= 64:
            return list(map(self.words.__getitem__, words))
        return [self.words[w] if len(w) <= 64 else self._word(w) for w in words]

    def tempered(self, text: str | None) -> list[float]:
        """Log likelihoods, scaled to EFFECTIVE trigrams where the text has more."""
        words = (text or "").split()
        if not words:
            return [0.0] * len(self.languages)
        total = np.fromiter((x for w in self._of(words) for x in w), float, len(words) * (len(self.languages) + 1)).reshape(len(words), -1).sum(0)
        return (total[:-1] * min(1.0, EFFECTIVE / total[-1])).tolist()


def fit(labelled: DataFrame, id: str, text: str, label: str, languages: list[str]) -> TrigramModel:
    """A model from TRAIN_ROWS rows a language at most, by hash of the id."""
    n = {r[label]: r["count"] for r in labelled.where(F.col(label).isin(languages)).groupBy(label).count().collect()}
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col(label) == lang, min(1.0, 0.9 * TRAIN_ROWS / max(1, n.get(lang, 0)))).otherwise(share)
    some = labelled.where(F.pmod(F.xxhash64(F.lit("train"), id), F.lit(1 << 20)) < share * (1 << 20)).select(F.col(label).alias("l"), F.col(text).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], int] = {}
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in (t or "").lower().split():
                    for g in grams(w):
                        sums[lang, g] = sums.get((lang, g), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["l", "g", "n"])

    by = some.mapInArrow(count, "l string, g string, n long").groupBy("g")
    rows = by.agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("l") == lang, F.col("n")).otherwise(0)).alias(f"n{k}") for k, lang in enumerate(languages)]).orderBy(F.desc("n"), "g").limit(MAX_GRAMS).collect()
    totals = [sum(r[f"n{k}"] for r in rows) + 0.5 * (len(rows) + 1) for k in range(len(languages))]
    table = {r.g: [math.log((r[f"n{k}"] + 0.5) / totals[k]) for k in range(len(languages))] for r in rows}
    return TrigramModel(languages, table, [math.log(0.5 / t) for t in totals])


_models: dict[str, TrigramModel] = {}


def _likelihoods(df: DataFrame, model: TrigramModel, text: str) -> DataFrame:
    """df without the text, with ll (array of double)."""
    held, key = df.sparkSession.sparkContext.broadcast((model.languages, model.table, model.unseen)), uuid.uuid4().hex  # MAX_GRAMS entries at most
    others = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _models:
            _models.clear()
            _models[key] = TrigramModel(*held.value)
        own = _models[key]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array([own.tempered(t) for t in batch.column(text).to_pylist()], pa.list_(pa.float64()))], names=[*others, "ll"])

    return df.mapInArrow(run, T.StructType([*(f for f in df.schema.fields if f.name != text), T.StructField("ll", T.ArrayType(T.DoubleType()))]))


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    parts = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))


def _summed(by: DataFrame, key: str, k: int, name: str) -> DataFrame:
    return by.groupBy(key).agg(F.array(*[F.sum(F.col("post")[i]) for i in range(k)]).alias(name), F.count(F.lit(1)).alias("n"))


def with_sums(rows: DataFrame, sums: DataFrame, key: str, name: str, hot: int = 1_000_000, limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows with the sums of their key (null for a null key).

    A table of few keys is broadcast.  Of one of many, the keys of over `hot` rows (one in `hot` of all rows at most) are
    broadcast, and the rest is joined by shuffle, in which rows of hot keys and of none are spread.
    """
    if sums.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(sums.drop("n")), key, "left")
    often = F.broadcast(sums.where(F.col("n") > hot).select(F.col(key).alias("__k"), F.col(name).alias("__often")))
    rest = sums.where(F.col("n") <= hot).select(F.col(key).alias("__k"), F.col(name).alias("__rest"))
    first = rows.join(often, F.col(key) == F.col("__k"), "left").drop("__k")
    spread = F.when(F.col(key).isNotNull() & F.col("__often").isNull(), F.col(key)).otherwise(F.concat(F.lit("\0"), F.xxhash64("__row").cast("string")))
    joined = first.withColumn("__at", spread).join(rest, F.col("__at") == F.col("__k"), "left")
    return joined.withColumn(name, F.coalesce("__often", "__rest")).drop("__k", "__at", "__often", "__rest")


#: Names before a country's suffix under which sites are named, as in example.co.uk.
SECOND = ("co", "com", "org", "net", "ac", "gov", "edu", "or", "ne", "go", "gob", "nom")
DOMAIN = rf"((?:[^.]+\.)?(?:{'|'.join(SECOND)})\.[a-z]{{2}}|[^.]+\.[^.]+)$"


def identify(df: DataFrame, model: TrigramModel, text: str = "text", host: str = "host", declared: str = "declared") -> DataFrame:
    """df without the text, with language, confidence and the posteriors.  host and declared may be null."""
    spark = df.sparkSession
    small_batches(spark)
    stages, langs = Stages(spark, "langid"), model.languages
    k = len(langs)
    names = F.array(*[F.lit(x) for x in langs])
    kept = [c for c in df.columns if c not in (text, "language", "confidence", "post")]
    df, (text, host, declared, *out) = positioned(df, text, host, declared, *kept)
    h = F.lower(F.col(host))
    said = F.lower(F.regexp_extract(F.col(declared), r"^\s*([A-Za-z]{2,3})", 1))
    base = df.withColumn("__row", F.xxhash64(text, host, declared)).withColumn("__host", F.when(h != "", h)).withColumn("__said", F.when(said.isin(langs), said)).withColumn("__suffix", F.when(F.col("__host").contains("."), F.substring_index("__host", ".", -1))).withColumn("__domain", F.coalesce(F.regexp_extract("__host", DOMAIN, 1), F.lit("")))
    rows = stages.write(_likelihoods(base, model, text).withColumn("post", _softmax(F.col("ll"))), "likelihoods")

    # the corpus's and the declared languages' sums: a row a language
    total = rows.agg(*[F.coalesce(F.sum(F.col("post")[i]), F.lit(0.0)) for i in range(k)]).first()
    corpus = [(x + 1) / (sum(total) + k) for x in total]
    heard = {r["__said"]: r["s"] for r in _summed(rows.where("__said is not null"), "__said", k, "s").collect()}
    each = [sum(heard.get(a, [0.0] * k)[i] for a in langs) for i in range(k)]
    says = {a: [math.log((heard.get(a, [0.0] * k)[i] + (2.0 if a == langs[i] else 0.2)) / (each[i] + 2.0 + 0.2 * (k - 1))) for i in range(k)] for a in langs}
    ends = {s: [math.log(SUFFIX_ODDS if lang == x else 1.0) for x in langs] for s, lang in SUFFIXES.items() if lang in langs}

    def looked_up(table: dict[str, list[float]], key: str) -> Column:
        out = F.array(*[F.lit(0.0)] * k)
        for a, v in table.items():
            out = F.when(F.col(key) == a, F.array(*map(F.lit, v))).otherwise(out)
        return out

    hosts = _summed(rows.where("__host is not null"), "__host", k, "hs")
    domains = _summed(rows.where("__host is not null"), "__domain", k, "ds")
    joined = with_sums(with_sums(rows, stages.write(hosts, "hosts"), "__host", "hs"), stages.write(domains, "domains"), "__domain", "ds")
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    zero = F.array(*[F.lit(0.0)] * k)
    less = lambda c: F.when(F.col(c).isNotNull(), F.zip_with(F.col(c), F.col("post"), lambda x, y: F.greatest(x - y, F.lit(0.0)))).otherwise(zero)
    mass = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    joined = joined.withColumn("hs", less("hs")).withColumn("ds", less("ds"))
    joined = joined.withColumn("dp", F.transform(plus(F.col("ds"), F.array(*[F.lit(CORPUS_COUNT * p) for p in corpus])), lambda x: x / (mass(F.col("ds")) + CORPUS_COUNT)))
    joined = joined.withColumn("hp", F.transform(F.zip_with("hs", "dp", lambda x, p: x + p * DOMAIN_COUNT), lambda x: F.log(x / (mass(F.col("hs")) + DOMAIN_COUNT))))
    logs = plus(plus(F.col("ll"), F.col("hp")), plus(looked_up(says, "__said"), looked_up(ends, "__suffix")))
    fused = joined.withColumn("post", _softmax(logs)).withColumn("confidence", F.array_max("post")).withColumn("language", F.element_at(names, F.array_position("post", F.col("confidence")).cast("int")))
    return fused.select(*[F.col(a).alias(b) for a, b in zip(out, kept, strict=True)], "language", "confidence", "post")
