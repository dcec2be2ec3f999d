"""Inputs that are named like the outputs are read, then replaced; map columns are sharded."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stratalens.llm import bpe, quality, sharding, toxicity

TEXTS = [(1, "One two three, vile word."), (2, None), (3, "")]
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def frames(spark, name):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return df, df.withColumnRenamed("text", name).withColumn("extra", F.lit("e"))


@pytest.mark.parametrize("name", ["token_ids", "decoded", "Token_Ids"])
def test_bpe(spark, name):
    plain, odd = frames(spark, name)
    a = bpe.encode_decode(plain, RANKS, public_tokenizers.PATTERN).select("doc_id", "token_ids", "decoded")
    b = bpe.encode_decode(odd, RANKS, public_tokenizers.PATTERN, text=name)
    assert sorted(b.columns) == ["decoded", "doc_id", "extra", "token_ids"]
    assert sorted(b.select(*a.columns).collect()) == sorted(a.collect())


def test_bpe_decodes_ids_named_decoded(spark):
    df = spark.createDataFrame([(1, [72, 73]), (2, None)], "doc_id long, decoded array<int>")
    got = bpe.decode(df, RANKS, public_tokenizers.PATTERN, ids="decoded")
    same = bpe.decode(df.withColumnRenamed("decoded", "ids"), RANKS, public_tokenizers.PATTERN, ids="ids")
    assert got.columns == ["doc_id", "decoded"] and sorted(got.collect()) == sorted(same.select("doc_id", "decoded").collect())


@pytest.mark.parametrize("name", ["words", "hits", "weight", "score"])
def test_toxicity(spark, name):
    plain, odd = frames(spark, name)
    curve = [-2.0, 0.5, 0.5, 1.0]
    a = toxicity.score(plain, {"vile": 4.0}, curve).select("doc_id", "weight", "hits", "words", "score")
    b = toxicity.score(odd, {"vile": 4.0}, curve, text=name)
    assert sorted(b.columns) == ["doc_id", "extra", "hits", "score", "weight", "words"]
    assert sorted(b.select(*a.columns).collect()) == sorted(a.collect())
    assert a.where("hits > 0").count() == 1


def test_quality(spark):
    plain, odd = frames(spark, "n_words")
    a = quality.judge(plain).select("doc_id", *quality.MEASURES, "kept")
    b = quality.judge(odd, text="n_words")
    assert sorted(b.select(*a.columns).collect()) == sorted(a.collect()) and b.columns.count("n_words") == 1 and "extra" in b.columns


def test_sharding(spark):
    df = spark.range(40).select("id", F.when(F.col("id") % 3 > 0, F.create_map(F.lit("b"), F.col("id"), F.lit("a"), F.lit(1).cast("long"))).alias("m"))
    by_id = {r.id: (r.shard, r.slot, r.m) for r in sharding.shard(df, ["id"]).collect()}
    assert len(by_id) == 40 and by_id[1][2] == {"a": 1, "b": 1} and by_id[3][2] is None
    assert sorted(v[:2] for v in by_id.values()) == [(s, t) for s in range(8) for t in range(5)]
    odd = sharding.shard(df.select(F.col("id").alias("slot"), "m", F.lit("x").alias("Shard")), ["slot"])
    assert sorted(odd.columns) == ["m", "shard", "slot"]
    assert sorted((r.shard, r.slot) for r in odd.collect()) == sorted(v[:2] for v in by_id.values())
