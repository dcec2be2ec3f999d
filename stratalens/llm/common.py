"""Shared plumbing of the training-data operators: stage tables in the shared folder, word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to Python in Arrow batches of so many rows and so many bytes (or one longer row), so that a batch of
#: long texts stays small.  The same for all operators, as plans are worked out later than they are made.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20


def fresh(name: str, *taken: str) -> str:
    """name, with underscores after it until no column has it; columns' names differ by more than case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def replaced(df: DataFrame, outputs: tuple[str, ...] | list[str], *inputs: str) -> tuple[DataFrame, list[str]]:
    """df without columns named like outputs, and what its columns named inputs are called in it.

    An input that is named like an output stays, by another name; that column is to be dropped when it was read.
    """
    taken, names = {o.lower() for o in outputs}, []
    for name in inputs:
        own = fresh(name, *df.columns, *outputs) if name.lower() in taken else name
        if own != name:
            df = df.withColumn(own, F.col(name))
        names.append(own)
    return df.drop(*[c for c in df.columns if c.lower() in taken]), names


def positioned(df: DataFrame, *named: str) -> tuple[DataFrame, list[str]]:
    """df with its columns renamed c0, c1, ... so that no name can clash; and the new names of the columns named."""
    own = [f"c{k}" for k in range(len(df.columns))]
    return df.toDF(*own), [own[df.columns.index(n)] for n in named]


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  On a local master (tests) that may be unset; else it's an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_stratalens_root", None)
    if not root and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="stratalens-")
        spark._stratalens_root = root
    return root.rstrip("/")


class Stages:
    """Written tables that cut lineage.  Each is whole on shared storage, so a lost executor costs a reread only."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/stratalens/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """Write df and read it back.  The frame returned has a `path` usable with drop()."""
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{label}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.stage_path = path
        return back

    def folder(self, label: str) -> str:
        self.count += 1
        return f"{self.base}/{self.count:03d}-{label}"

    def drop(self, *frames: DataFrame) -> None:
        """Delete stage tables that no later plan reads."""
        jvm = self.spark._jvm
        for f in frames:
            path = jvm.org.apache.hadoop.fs.Path(f.stage_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python; texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, the same in every process; forgets all when it grows past `limit` entries."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(text: bytes | None, n: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; A-Z folded; ASCII white space parts words.

    Fewer than n words make one shingle of the whole sequence; no words or null make an empty set.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    k = min(n, len(words))
    h = cache.of(words)
    with np.errstate(over="ignore"):
        out = np.full(len(words) - k + 1, np.uint64(k))
        for i in range(k):
            out = (out + h[i : len(words) - k + 1 + i]) * _MUL
            out ^= out >> np.uint64(29)
        return np.unique(mix64(out))


WORD = re.compile(r"[^\x20\x09-\x0D]+")
