"""What people corrected, applied to members, assets and relationships; the newest correction that fits wins.

Corrections: (correction_id, entity_kind, selector, action, corrected_type, corrected_name, corrected_confidence,
corrected_status, created, run_id).  One without a run holds for all runs.  Selectors are met by equality, whatever their
case: each thing states the selectors that could name it, and these are joined, so no correction is tried on each thing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .estate_graph import Estate

FIELDS = ("correction_id", "action", "corrected_type", "corrected_name", "corrected_confidence", "corrected_status")
# Actions that change a member, an asset; any other action than SUPPRESS changes a relationship.
MEMBER_ACTIONS = ("OVERRIDE_TYPE", "OVERRIDE", "CLASSIFY_AS")
ASSET_ACTIONS = ("OVERRIDE", "OVERRIDE_TYPE", "RENAME")


def chosen(things: DataFrame, key: str, selectors: Column, corrections: DataFrame, kind: str, run_id: str | None = None) -> DataFrame:
    """things with c: the newest correction of that kind that one of its selectors names, or null; key tells things apart."""
    c = corrections.where(F.upper("entity_kind") == kind).where(F.col("run_id").isNull() | (F.col("run_id") == F.lit(run_id)))
    c = c.select(F.upper("selector").alias("selector"), F.struct(F.col("created"), F.col("correction_id").alias("n"), F.struct(F.upper("action").alias("action"), *[f for f in FIELDS if f != "action"]).alias("c")).alias("x"))
    c = c.where("selector IS NOT NULL").groupBy("selector").agg(F.max("x").alias("x"))
    met = things.select(key, F.explode(F.array_distinct(F.transform(F.array_compact(selectors), F.upper))).alias("selector")).join(c, "selector")
    best = met.groupBy(key).agg(F.max("x").alias("x")).select(key, F.col("x.c").alias("c"))
    return things.join(best, key, "left")


def _held(name: str, old: Column | str, upper: bool = False) -> Column:
    new = F.col("c")[name]
    return F.coalesce(F.upper(new) if upper else new, F.col(old) if isinstance(old, str) else old)


def _noted() -> Column:
    note = F.create_map(F.lit("correction_id"), F.col("c.correction_id").cast("string"), F.lit("correction_action"), F.col("c.action"))
    base = F.map_filter(F.coalesce("attributes", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("correction_id", "correction_action"))
    return F.map_concat(base, note)


def corrected_members(members: DataFrame, corrections: DataFrame, run_id: str | None = None) -> DataFrame:
    """members (path, member, artifact_type, ...) with corrected types, found by path or member name."""
    got = chosen(members, "path", F.array("path", "member"), corrections, "MEMBER", run_id)
    hit = F.col("c.action").isin(*MEMBER_ACTIONS) & F.col("c.corrected_type").isNotNull()
    return got.withColumn("artifact_type", F.when(hit, F.lower(F.col("c.corrected_type"))).otherwise(F.col("artifact_type"))).withColumn("classification_basis", F.when(hit, F.concat(F.lit("correction:"), F.col("c.correction_id").cast("string")))).drop("c")


def corrected(e: Estate, corrections: DataFrame, run_id: str | None = None) -> Estate:
    """The estate with corrected assets and relationships; suppressed relationships are gone, ids stay as they were."""
    a = chosen(e.assets, "asset_id", F.array("asset_id", "name"), corrections, "ASSET", run_id)
    hit = F.col("c.action").isin(*ASSET_ACTIONS)
    put = lambda df, name, new: df.withColumn(name, F.when(hit, new).otherwise(F.col(name)))
    a = put(a, "asset_type", _held("corrected_type", "asset_type", True))
    a = put(a, "name", _held("corrected_name", "name", True))
    a = put(a, "confidence", _held("corrected_confidence", "confidence"))
    a = put(a, "status", _held("corrected_status", "status"))
    a = put(a, "attributes", _noted()).drop("c")
    names = e.assets.select("asset_id", F.col("name").alias("n"))
    r = e.relationships.join(names.select(F.col("asset_id").alias("source_id"), F.col("n").alias("sn")), "source_id", "left").join(names.select(F.col("asset_id").alias("target_id"), F.col("n").alias("tn")), "target_id", "left")
    s, t = F.coalesce("sn", "source_id"), F.coalesce("tn", "target_id")
    said = F.array(F.col("rel_type"), F.concat_ws("|", s, "rel_type", t), F.concat_ws("->", s, "rel_type", t), F.concat_ws("|", "source_id", "rel_type", "target_id"))
    r = chosen(r, "relationship_id", said, corrections, "RELATIONSHIP", run_id).where("c IS NULL OR c.action <> 'SUPPRESS'")
    on = F.col("c").isNotNull()
    put = lambda df, name, new: df.withColumn(name, F.when(on, new).otherwise(F.col(name)))
    # another name for the target is another asset of its type
    target = F.when(F.col("c.corrected_name").isNotNull(), F.concat_ws(":", F.substring_index("target_id", ":", 1), F.upper(F.col("c.corrected_name")))).otherwise(F.col("target_id"))
    r = put(r, "rel_type", _held("corrected_type", "rel_type", True))
    r = put(r, "target_id", target)
    r = put(r, "confidence", _held("corrected_confidence", "confidence"))
    r = put(r, "status", _held("corrected_status", "status"))
    r = put(r, "method", F.lit("corrected"))
    r = put(r, "attributes", _noted())
    return Estate(a.select(*e.assets.columns), r.select(*e.relationships.columns), e.evidence, e.members)
