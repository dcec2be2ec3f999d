"""What a capability is for: names by weighted evidence, from patterns given as a table.

patterns: (label, domain, service, signal, token, boost): a capability's label, and a word that one kind of signal shows
for it.  Each root's signals (names of what it reaches, by kind) are cut into words and runs of words, which meet the
patterns' tokens by equality: an inverted index on both sides, so no pattern is tried on each name.  A token counts once
for a root and kind of signal, by the kind's weight; the best label wins, and its margin over the next one sets how sure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .graph import Rounds

# Weight of a token by the kind of signal that shows it, and what a path that writes adds.
WEIGHTS = {
    "driver": 5.0, "program": 3.5, "table_written": 5.5, "table_read": 3.0, "table": 2.2, "field": 2.6, "copybook": 2.0, "job": 2.2,
    "transaction": 3.0, "dataset": 2.0, "queue": 2.0, "paragraph": 1.8, "relationship": 1.3,
}
WRITE_PATH = 2.0
# Stems that count wherever they stand in a name; other tokens are whole words.
STEMS = ("CARD", "CRD", "AUTH", "PAY", "PMT", "STMT", "BAL", "ACCT", "CUST", "INT")
BY_TYPE = {"PROGRAM": "program", "JOB": "job", "TRANSACTION": "transaction", "COPYBOOK": "copybook", "TABLE": "table", "IMS_SEGMENT": "table", "DATASET": "dataset", "FILE": "dataset", "MQ_QUEUE": "queue", "FIELD": "field", "PARAGRAPH": "paragraph"}


def signals(e, reached: DataFrame, once: bool = True) -> DataFrame:
    """(root, signal, value) of what each root reaches (root, id): assets by type, tables by access, kinds of relationship.

    scored() counts a token once however often it is shown, so rows for it need not be told apart before (once=False).
    """
    kinds = F.create_map(*[F.lit(x) for kv in BY_TYPE.items() for x in kv])
    bare = lambda c: F.substring_index(F.substring_index(c, ":", -1), ".", -1)
    near = reached.select("root", "id").distinct()
    own = near.select("root", kinds[F.substring_index("id", ":", 1)].alias("signal"), bare("id").alias("value")).where("signal IS NOT NULL")
    driver = near.where("root = id").select("root", F.lit("driver").alias("signal"), bare("id").alias("value"))
    out = near.join(e.relationships.select(F.col("source_id").alias("id"), "rel_type", "target_id"), "id")
    table = F.substring_index("target_id", ":", 1) == "TABLE"
    access = out.where(table & F.col("rel_type").isin("READS", "READS_TABLE", "WRITES", "WRITES_TABLE")).select("root", F.when(F.col("rel_type").startswith("WRITES"), "table_written").otherwise("table_read").alias("signal"), bare("target_id").alias("value"))
    into = out.select("root", kinds[F.substring_index("target_id", ":", 1)].alias("signal"), bare("target_id").alias("value")).where("signal IS NOT NULL")
    shown = own.union(driver).union(access).union(into).union(out.select("root", F.lit("relationship"), F.col("rel_type")))
    return shown.distinct() if once else shown


def parts(value: Column, longest: int) -> Column:
    """Words of a name and runs of up to `longest` of them, and the stems that stand anywhere in it."""
    words = F.filter(F.split(F.upper(value), "[^A-Z0-9]+"), lambda w: w != "")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: i + n <= F.size(words)), lambda i: F.array_join(F.slice(words, i + 1, n), "_"))))
    stems = F.filter(F.array(*map(F.lit, STEMS)), lambda x: F.contains(F.upper(value), x))
    return F.array_distinct(F.concat(runs, stems))


def scored(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """(root, label, domain, service, score, kinds, matched) of each label that a root shows any token of."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    p = patterns.select("label", "domain", "service", "signal", F.upper(F.regexp_replace("token", "[^A-Za-z0-9]+", "_")).alias("token"))
    # as written, patterns that are few go to where the signals are
    p = Rounds(patterns.sparkSession, "patterns").write(p)
    boost = patterns.groupBy("label").agg(F.max(F.coalesce("boost", F.lit(0.0))).alias("boost"), F.max(F.col("signal") == "table_written").alias("writes"))
    # a row: how many words the longest token has
    longest = p.agg(F.max(F.size(F.split("token", "_")))).first()[0] or 1
    shown = found.join(p.select("signal").distinct(), "signal", "left_semi").select("root", "signal", "value", F.explode(parts(F.col("value"), longest)).alias("token"))
    hit = shown.join(p, ["signal", "token"]).groupBy("root", "label", "domain", "service", "signal", "token").agg(F.min("value").alias("value"))
    wrote = found.where("signal = 'table_written'").select("root").distinct().withColumn("wrote", F.lit(True))
    by = hit.groupBy("root", "label", "domain", "service").agg(F.sum(weight[F.col("signal")]).alias("score"), F.count_distinct("signal").alias("kinds"), F.sort_array(F.collect_list(F.struct("signal", "value", "token"))).alias("matched"))
    full = by.join(boost, "label").join(wrote, "root", "left")
    crud = F.col("writes") & F.coalesce("wrote", F.lit(False))
    return full.select("root", "label", "domain", "service", F.round(F.col("score") + F.col("boost") + F.when(crud, WRITE_PATH).otherwise(0.0), 3).alias("score"), (F.col("kinds") + crud.cast("int")).alias("kinds"), "matched")


def named(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """(root, label, domain, service, score, margin, confidence, status, matched): the best label of each root."""
    order = W.partitionBy("root").orderBy(F.desc("score"), "label")
    ranked = scored(found, patterns).withColumn("next", F.lead("score").over(order)).withColumn("place", F.row_number().over(order)).where("place = 1")
    margin = F.col("score") - F.coalesce("next", F.lit(0.0))
    sure = F.least(F.lit(0.96), 0.45 + F.col("score") / 38.0 + F.least(margin, F.lit(10.0)) / 55.0) + F.least("kinds", F.lit(5)) * 0.025
    sure = F.least(sure, F.lit(0.97))
    sure = F.round(F.when((margin < 2.0) & F.col("next").isNotNull(), F.least(sure, F.lit(0.74))).otherwise(sure), 3)
    return ranked.select("root", "label", "domain", "service", "score", F.round(margin, 3).alias("margin"), sure.alias("confidence"), F.when(sure >= 0.65, "inferred").otherwise("needs_review").alias("status"), "matched")
