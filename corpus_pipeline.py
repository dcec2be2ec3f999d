"""A corpus pipeline of five operators: quality rules, near duplicates, decontamination, pseudonyms, tokens.

For all stages: a null text counts as an empty one, ids and other columns may be null, an empty table gives an empty
one, texts of any length are taken whole, and extra columns pass through whatever their names (the last stage puts its
own in place of columns named token_ids, decoded, round_trip and n_tokens).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import bpe, decontam, jaccard, pii, quality
from stratalens.llm.common import Stages
from stratalens.llm.queries import PII_KEY

#: EM over rule votes and exact set joins aren't SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: equal texts are judged alike, a posterior of one half keeps."""
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: five-word shingles, 0.8 or more.

    The least id stays (one without an id last, of rows equal in id and text one); texts without words all stay.
    """
    return jaccard.drop_near_duplicates(docs, n=5, num=80, den=100)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; repeated documents go or stay together, an item without text is none."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data, the same for equal values in all documents; a null text stays null."""
    out = pii.pseudonymise(docs, PII_KEY).drop("found")
    # the text's length may not be what n_chars says any more where formats of dates differ in length
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it; a null text has none and decodes to nothing."""
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.withColumn("round_trip", exact).withColumn("n_tokens", F.size("token_ids").cast("long")).drop("decoded", "text")


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", unseen), ("pseudonyms", private), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = Stages(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = stages.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
