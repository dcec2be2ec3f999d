"""Exports of assets (asset_id, asset_type, name) and relationships (source_id, rel_type, target_id, confidence, ...), and keyed writes.

Each format is a frame of lines or records that Spark writes in parallel; orders of lines are a column, not a collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(x: Column) -> Column:
    """x for XML: the five marks as entities."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(mark), F.lit(entity))
    return x


def _stack(*parts: DataFrame) -> DataFrame:
    """Frames of (k, line), in this order, as (section, k, line)."""
    out = None
    for n, p in enumerate(parts):
        p = p.select(F.lit(n).alias("section"), "k", "line")
        out = p if out is None else out.unionByName(p)
    return out


def _one(df: DataFrame, *lines: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(f"{n:03d}", x) for n, x in enumerate(lines)], "k string, line string")


def graphml(assets: DataFrame, relationships: DataFrame) -> DataFrame:
    """GraphML as (section, k, line)."""
    x = lambda c: escaped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    nodes = assets.select(F.col("asset_id").alias("k"), F.concat(F.lit('<node id="'), x("asset_id"), F.lit('"><data key="type">'), x("asset_type"), F.lit('</data><data key="name">'), x("name"), F.lit("</data></node>")).alias("line"))
    edges = relationships.select(F.concat_ws("|", "source_id", "rel_type", "target_id").alias("k"), F.concat(F.lit('<edge source="'), x("source_id"), F.lit('" target="'), x("target_id"), F.lit('"><data key="rel">'), x("rel_type"), F.lit('</data><data key="confidence">'), x("confidence"), F.lit("</data></edge>")).alias("line"))
    keys = [f'<key id="{i}" for="{f}" attr.name="{i}" attr.type="{t}"/>' for i, f, t in (("type", "node", "string"), ("name", "node", "string"), ("rel", "edge", "string"), ("confidence", "edge", "double"))]
    return _stack(_one(assets, '<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="directed">'), nodes, edges, _one(assets, "</graph>", "</graphml>"))


def cytoscape(assets: DataFrame, relationships: DataFrame) -> DataFrame:
    """One element a row: (group, data as JSON)."""
    n = assets.select(F.lit("nodes").alias("group"), F.to_json(F.struct(F.col("asset_id").alias("id"), F.col("asset_type").alias("type"), F.col("name").alias("label"))).alias("data"))
    e = relationships.select(F.lit("edges").alias("group"), F.to_json(F.struct(F.concat_ws("|", "source_id", "rel_type", "target_id").alias("id"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("rel_type").alias("label"), "confidence")).alias("data"))
    return n.unionByName(e)


def sectioned_csv(assets: DataFrame, relationships: DataFrame) -> DataFrame:
    """Assets, then relationships, each with its header, as (section, k, line)."""
    field = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    body = lambda df, cols: df.select(F.concat_ws("|", *cols[:3]).alias("k"), F.concat_ws(",", *map(field, cols)).alias("line"))
    a, r = ["asset_id", "asset_type", "name"], ["source_id", "rel_type", "target_id", "confidence"]
    return _stack(_one(assets, ",".join(a)), body(assets, a), _one(assets, ",".join(r)), body(relationships, r))


def json_bundle(summary: DataFrame, programs: DataFrame, edges: DataFrame) -> DataFrame:
    """A summary row, programs and edges as one JSON document's lines (section, k, line): an array a section."""
    part = lambda df: df.select(F.to_json(F.struct(*df.columns)).alias("j"))
    rows = lambda df: part(df).select(F.concat(F.lit("b"), F.col("j")).alias("k"), F.concat(F.col("j"), F.lit(",")).alias("line"))
    return _stack(_one(programs, "{"), part(summary).select(F.lit("").alias("k"), F.concat(F.lit('"summary": '), F.col("j"), F.lit(",")).alias("line")), _one(programs, '"programs": ['), rows(programs), _one(programs, "null],", '"edges": ['), rows(edges), _one(programs, "null]}"))


def write_tables(folder: str, **frames: DataFrame) -> None:
    """Each frame as CSV with a header under folder/name, rows in order of all columns (files by range, no single task)."""
    for name, df in frames.items():
        df.orderBy(*df.columns).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def pipe_index(df: DataFrame, *columns: str) -> DataFrame:
    """Rows as one pipe-delimited line each; pipes inside become slashes."""
    return df.select(F.concat_ws("|", *[F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("/")) for c in columns]).alias("line"))


def mermaid(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """A flowchart as (section, k, line); nodes (id, number) give the short names."""
    short = nodes.select("id", F.concat(F.lit("N"), F.col("number")).alias("n"), F.col("number").cast("string").alias("k"))
    label = F.replace(F.col("id"), F.lit('"'), F.lit("'"))
    boxes = short.select("k", F.concat(F.lit("    "), F.col("n"), F.lit('["'), label, F.lit('"]')).alias("line"))
    s, t = short.select(F.col("id").alias("source_id"), F.col("n").alias("a")), short.select(F.col("id").alias("target_id"), F.col("n").alias("b"))
    arrows = relationships.join(s, "source_id").join(t, "target_id").select(F.concat_ws("|", "source_id", "rel_type", "target_id").alias("k"), F.concat(F.lit("    "), F.col("a"), F.lit(" -->|"), F.col("rel_type"), F.lit("| "), F.col("b")).alias("line"))
    return _stack(_one(relationships, "flowchart LR"), boxes, arrows)


def sequence_diagram(events: DataFrame) -> DataFrame:
    """(path, diagram) from a program's events (path, line, source, target, rel_type): participants by first use, arrows by line."""
    e = F.sort_array(F.collect_list(F.struct("line", "source", "target", "rel_type")))
    people = F.array_distinct(F.flatten(F.transform("e", lambda x: F.array(x["source"], x["target"]))))
    text = F.concat_ws("\n", F.lit("sequenceDiagram"), F.transform(people, lambda p: F.concat(F.lit("    participant "), p)), F.transform("e", lambda x: F.concat(F.lit("    "), x["source"], F.lit("->>"), x["target"], F.lit(": "), x["rel_type"])))
    return events.groupBy("path").agg(e.alias("e")).select("path", text.alias("diagram"))


def export_manifest(df: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """(total, exported, truncated, checksum) of an export; the checksum is of all rows' digests, whatever their order.

    Digests are summed over four 32-bit parts, so no task holds more than a row and the order of rows doesn't matter.
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    part = df.orderBy(*keys).limit(limit) if limit is not None else df
    digest = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(df.columns)])), 256)
    sums = [F.coalesce(F.sum(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for k in range(4)]
    got = part.agg(F.count(F.lit(1)).alias("exported"), F.sha2(F.concat_ws(",", *sums), 256).alias("checksum"))
    return total.crossJoin(F.broadcast(got)).select("total", "exported", (F.col("total") > F.col("exported")).alias("truncated"), "checksum")


def scenarios(rules: DataFrame, smoke: bool = False) -> DataFrame:
    """Two test scenarios of each rule (rule_id, condition): one where it holds, one where it doesn't.

    smoke: without rules there is one scenario, that the program runs at all.
    """
    both = F.explode(F.array(F.struct(F.lit("T").alias("branch"), F.lit("holds").alias("said")), F.struct(F.lit("F").alias("branch"), F.lit("does not hold").alias("said"))))
    found = rules.select("rule_id", "condition", both.alias("s")).select(F.concat_ws("-", "rule_id", "s.branch").alias("scenario_id"), F.concat_ws(" ", "condition", "s.said").alias("given"))
    if not smoke:
        return found
    none = rules.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("SMOKE").alias("scenario_id"), F.lit("the program runs").alias("given"))
    return found.unionByName(none)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old with new's rows in place of those with equal keys; within new the greatest order wins.  One shuffle by key."""
    values = [c for c in old.columns if c not in keys]
    newer = new.select(*old.columns, F.lit(1).alias("_new"), F.col(order).alias("_order"))
    rows = old.withColumn("_new", F.lit(0)).unionByName(newer, allowMissingColumns=True)
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("_new", "_order")).alias("_b"))
    return best.select(*[c if c in keys else F.col("_b")[c].alias(c) for c in old.columns])


def write_run(df: DataFrame, path: str, run_id: str, column: str = "run_id") -> None:
    """df as one run's rows: earlier rows of that run go, other runs stay."""
    df.withColumn(column, F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """(section, k, line) as text files whose names follow the order of the lines: a range sort, no single task."""
    lines.orderBy("section", "k", "line").select("line").write.mode("overwrite").text(path)


def log_answer(spark, path: str, question: str, intent: str, rows: int) -> None:
    spark.range(1).select(F.current_timestamp().alias("asked"), F.lit(question).alias("question"), F.lit(intent).alias("intent"), F.lit(rows).alias("rows")).write.mode("append").json(path)


def recent_answers(spark, path: str, limit: int = 20) -> DataFrame:
    return spark.read.schema("asked timestamp, question string, intent string, rows bigint").json(path).orderBy(F.desc("asked"), "question").limit(limit)
