"""Members as they arrive: each change of a member is read once, replaces what the member said before, and is reported.

A batch writes the states and facts of its own members under its number, in proportion to its size, and one that runs
again overwrites its own folders.  What holds is what a member's latest batch said, so nothing is rewritten: facts of an
earlier text are left behind by a join with the latest state, and gone members by a row that says so.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions import text as T

STATE = "path string, sha string, state string, batch bigint, facts bigint, updated timestamp"
PROGRESS = "query string, batch bigint, phase string, ms bigint, rows bigint, at string"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, modified, content) of members as files come or change in a folder, at any depth; files without a byte bring no row."""
    shape = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(shape).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "content")


def latest(rows: DataFrame) -> DataFrame:
    """The latest of the states of each member."""
    return rows.groupBy("path").agg(F.max_by(F.struct("sha", "state", "batch", "facts", "updated"), F.struct("batch", F.col("state") != "gone")).alias("s")).select("path", "s.*")


def _held(spark: SparkSession, table: str, kind: str, shape: str) -> DataFrame:
    """Rows of all batches; a folder that isn't there yet has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{kind}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(f"{table}/{kind}/*")


def states(spark: SparkSession, table: str) -> DataFrame:
    return latest(_held(spark, table, "states", STATE))


def facts(spark: SparkSession, table: str, shape: str) -> DataFrame:
    """Facts that hold: those of the batch that materialised a member's latest text."""
    kept = states(spark, table).where("state = 'materialized'").select("path", "batch")
    return _held(spark, table, "facts", f"{shape}, batch bigint").join(kept, ["path", "batch"], "left_semi").drop("batch")


def merge(batch: DataFrame, number: int, table: str, extract: Callable[[DataFrame], DataFrame], shape: str) -> None:
    """One batch of members (path, modified, content) into table: those whose text is new or changed are extracted.

    extract: (path, text) to facts with a path, of the given shape; a member whose text is binary is unsupported.
    """
    spark = batch.sparkSession
    # this batch's own rows don't count as held when it runs again
    held = latest(_held(spark, table, "states", STATE).where((F.col("batch") < number) | (F.col("state") == "gone"))).select("path", F.col("sha").alias("was"), F.col("state").alias("was_state"))
    one = batch.groupBy("path").agg(F.max_by("content", "modified").alias("content"))
    raw = F.col("content")
    binary = T.has_nul(raw) | (T.non_text_ratio(raw) > 0.3)
    text = F.when(~binary, F.coalesce(F.try_validate_utf8(raw.cast("string")), T.latin(raw)))
    now = one.select("path", F.sha2("content", 256).alias("sha"), text.alias("text")).join(held, "path", "left")
    now = now.where("was IS NULL OR was <> sha OR was_state = 'gone'")
    now.select("path", "sha", "text").write.mode("overwrite").parquet(f"{table}/members/{number:06d}")
    fresh = spark.read.parquet(f"{table}/members/{number:06d}")
    found = extract(fresh.where("text IS NOT NULL").select("path", "text"))
    found.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{table}/facts/{number:06d}")
    n = _held(spark, table, "facts", f"{shape}, batch bigint").where(F.col("batch") == number).groupBy("path").agg(F.count(F.lit(1)).alias("facts"))
    state = F.when(F.col("text").isNull(), "unsupported").otherwise("materialized")
    out = fresh.join(n, "path", "left").select("path", "sha", state.alias("state"), F.lit(number).cast("long").alias("batch"), F.coalesce("facts", F.lit(0)).cast("long").alias("facts"), F.current_timestamp().alias("updated"))
    out.write.mode("overwrite").parquet(f"{table}/states/{number:06d}")


def keep(members: DataFrame, table: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], shape: str):
    """Keep a stream of members as states and facts under table; the query ends when all that has arrived is read."""
    return members.writeStream.foreachBatch(lambda b, k: merge(b, k, table, extract, shape)).option("checkpointLocation", checkpoint).queryName("rescan").trigger(availableNow=True).start()


def purge(spark: SparkSession, table: str, present: DataFrame) -> int:
    """Mark members that are not among present (path) as gone, so that their facts hold no more; how many went.

    They are told gone under the number of the next batch, which may bring them back.
    """
    gone = states(spark, table).where("state <> 'gone'").join(present.select("path").distinct(), "path", "left_anti")
    last = _held(spark, table, "states", STATE).where("state <> 'gone'").agg(F.max("batch")).first()[0]
    if last is None:
        return 0
    path = f"{table}/states/gone-{uuid.uuid4().hex}"
    gone.select("path", "sha", F.lit("gone").alias("state"), F.lit(last + 1).cast("long").alias("batch"), F.lit(0).cast("long").alias("facts"), F.current_timestamp().alias("updated")).write.parquet(path)
    return spark.read.schema(STATE).parquet(path).count()


class Progress(StreamingQueryListener):
    """Writes a row for each phase of each batch to a folder of JSON: what took how long, over how many rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def onQueryStarted(self, event) -> None:
        self._write([(event.name, -1, "started", 0, 0, str(event.timestamp))])

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._write([(p.name, p.batchId, phase, int(ms), int(p.numInputRows), p.timestamp) for phase, ms in sorted(p.durationMs.items())])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._write([("rescan", -1, "failed" if event.exception else "ended", 0, 0, "")])

    def _write(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").json(self.folder)


def progress(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PROGRESS).json(folder)
