"""The runtime feed as a stream or a table: the same functions take either.

Tumbling, sliding and session windows keep one state row per key and window and let it go behind the watermark.
accumulate() keeps counts and the first and last sight in order of import, as sums of small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def feed(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Runtime events as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _late(events: DataFrame, lateness: str) -> DataFrame:
    return events.withWatermark("ts", lateness) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    return _late(events, lateness).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", every: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    return _late(events, lateness).groupBy(F.window("ts", width, every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    return _late(events, lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def accumulate(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Observations (source, target, n, first_seen, last_seen, seq) merged: counts add up, sights go by order of import."""
    rows = new if old is None else old.unionByName(new)
    sight = lambda c, f: f(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c]
    return rows.groupBy("source", "target").agg(F.sum("n").alias("n"), sight("first_seen", F.min).alias("first_seen"), sight("last_seen", F.max).alias("last_seen"), F.max("seq").alias("seq"))


def keep_accumulated(observations: DataFrame, table: str, checkpoint: str):
    """Keep a stream of observations as sums of its batches, in the Parquet folders table/00000, table/00001, ...

    A batch writes what it adds, in proportion to its own size; one that runs again overwrites its own folder, so it
    counts once.  accumulated() puts them together.
    """

    def keep(batch: DataFrame, k: int) -> None:
        accumulate(None, batch).write.mode("overwrite").parquet(f"{table}/{k:05d}")

    return observations.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulated(spark: SparkSession, table: str) -> DataFrame:
    """All observations that keep_accumulated() has kept."""
    return accumulate(None, spark.read.parquet(f"{table}/*"))


def compact(spark: SparkSession, table: str, into: str) -> None:
    """accumulated() as one folder, into/00000: to be read in table's place."""
    accumulated(spark, table).write.mode("overwrite").parquet(f"{into}/00000")
