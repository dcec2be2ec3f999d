"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, jaccard, langid, merkle, pii, quality, search, sharding, tokenbin, toxicity, urls
from .common import Stages, table
from .oracles import oracle_sql  # noqa: F401

LANGUAGES = ["de", "en", "es", "fr"]
PII_KEY = "stratalens-demo-key"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(coded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (host: their source) and pages (host and suffix from the address, declared language from the markup)."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = langid.fit(docs.select("doc_id", "text", "lang"), "doc_id", "text", "lang", LANGUAGES)
    a = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.col("source").alias("host"), F.lit(None).cast("string").alias("declared"))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<nav.*?</nav>", " "), r"<[^>]*>|&[a-z#0-9]+;", " ")
    b = pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", bare.alias("text"), F.regexp_extract("url", r"^[a-z]+://([^/:?#]*)", 1).alias("host"), F.regexp_extract("html", r"(?i)<html[^>]*\slang=[\"']?([A-Za-z-]+)", 1).alias("declared"))
    out = langid.identify(a.unionByName(b), model)
    return out.select("doc_id", "page_id", "language", F.round("confidence", 6).alias("confidence"), (F.col("confidence") >= 0.5).alias("kept"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    terms, curve = toxicity.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, terms, curve)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymise(docs, PII_KEY)
    return out.select("doc_id", "text", F.size("found").alias("n_found"), F.array_join(F.transform("found", lambda f: f["kind"]), ",").alias("kinds"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, num=90, den=100, part=10)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest, folder = tokenbin.token_shards(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenbin.read_shards(manifest, folder).withColumnRenamed("id", "doc_id")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], rows.schema)
    return chat.read_back(chat.format_conversations(rows.unionByName(more)))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that it leaks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = Stages(spark, "quality").write(quality.with_measures(docs).drop("text"), "measures")
    out = quality.judge_measured(measured)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.shard(rows, ["doc_id", "text_crc32"], shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Host, path and action of the rules that op11_urls applies.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urls.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the id's crc32, the row checked has one more in n_chars."""
    docs = table(spark, sf_dir, "documents")
    leaf = merkle.leaf_of(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text")))
    fake = merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.try_add(F.col("n_chars"), F.lit(1)), F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    m = merkle.manifest(docs, "doc_id", "lang", leaf, F.when(tampered, fake))
    root = merkle.folded(F.coalesce("forged", "leaf"), F.col("path"))
    return m.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict:
    import corpus_pipeline

    own = (op1_bpe, op2_language_id, op3_toxicity, op4_pii, op5_jaccard, op6_token_ids, op7_chat, op8_decontamination, op9_quality, op10_sharding, op11_urls, op12_search, op13_merkle)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}
