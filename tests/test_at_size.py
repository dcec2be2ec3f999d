"""What made queries fail on larger tables: one task that reads all, rows read to Python again for each join, rows sent to the driver."""

import pytest
from pyspark.sql import functions as F

from stratalens.operators import assemble, deep_queries, estate_queries, extraction, semantics, sqlmodel
from stratalens.operators.estate_graph import Estate
from stratalens.operators.graph import Rounds


@pytest.fixture
def orders(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 50).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.concat((1 + F.col("id") % 5).cast("string"), F.lit("-X")).alias("o_orderpriority"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_members_of_one_row_group_are_dealt_over_all_cores(spark, orders):
    held = deep_queries.programs(spark, orders).groupBy(F.spark_partition_id()).count().collect()
    assert len(held) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in held) < 1000


def test_events_and_line_items_are_dealt_over_all_cores(spark):
    for made in (extraction.programs, extraction.jobs):
        held = made(spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().collect()
        assert len(held) >= spark.sparkContext.defaultParallelism


def test_written_rows_are_broadcast_by_their_size_in_memory(spark):
    # a file of a few kilobytes holds 400,000 equal values
    large = Rounds(spark, "t").write(spark.range(400_000).select((F.col("id") % 7).alias("k"), F.lit("the same in every row").alias("v")))
    small = Rounds(spark, "t").write(spark.range(7).select(F.col("id").alias("k")))
    left = spark.range(400_000).select(F.col("id").alias("k"))
    assert "Broadcast" not in _plan(left.join(large, "k"))
    assert "BroadcastHashJoin" in _plan(large.join(small, "k"))
    assert large.join(small, "k").count() == 400_000


def test_parsed_rows_are_read_to_python_once(spark, orders):
    p = deep_queries.programs(spark, orders)
    for df in (semantics.nested(p), sqlmodel.columns(sqlmodel.statements(p)), deep_queries.storage_aliases(spark, orders)):
        assert "MapInPandas" not in _plan(df)


def _oracle(name: str, edges: list[tuple], assets: list[tuple]) -> list[tuple]:
    """An oracle's rows over a code graph given as rows, in place of the projection."""
    import duckdb

    sql = estate_queries.ORACLE[name]
    c = duckdb.connect()
    c.execute("CREATE TABLE code_rel (source_id VARCHAR, rel_type VARCHAR, target_id VARCHAR, confidence DOUBLE, status VARCHAR, method VARCHAR, line BIGINT)")
    c.execute("CREATE TABLE code_asset (asset_id VARCHAR, asset_type VARCHAR)")
    c.executemany("INSERT INTO code_rel VALUES (?, ?, ?, ?, 'confirmed', 'static', 1)", edges)
    c.executemany("INSERT INTO code_asset VALUES (?, ?)", assets)
    # the projection's own tables aren't read
    for k in ("code_line", "code_rel", "code_asset"):
        start = sql.find(f"{k} AS (")
        if start >= 0:
            at, deep = start + len(k) + 5, 1
            while deep:
                deep += (sql[at] == "(") - (sql[at] == ")")
                at += 1
            sql = sql[:start] + sql[at:].lstrip(", ")
    return sorted(c.execute(sql).fetchall())


def test_oracles_of_walks_have_no_depth_that_fits_small_data_only():
    # a chain of 60 calls, entered at its head, above a table; a ring at its end
    chain = [(f"PROGRAM:P{k:02d}", "CALLS", f"PROGRAM:P{k + 1:02d}", 0.9, ) for k in range(60)]
    edges = [("JOB:J", "EXECUTES", "PROGRAM:P00", 1.0), *chain, ("PROGRAM:P60", "READS", "TABLE:T1", 1.0), ("PROGRAM:P60", "CALLS", "PROGRAM:P59", 0.5)]
    got = _oracle("estate_blast_radius", edges, [("TABLE:T1", "TABLE")])
    assert len(got) == 62 and max(r[2] for r in got) == 62
    assert ("impacted", "PROGRAM:P60", 1, 1.0, False) in got and ("impacted", "PROGRAM:P00", 61, 0.9, True) in got
    edges += [(f"PROGRAM:Q{k:02d}", "CALLS", f"PROGRAM:Q{k + 1:02d}", 1.0) for k in range(60)] + [("PROGRAM:Q60", "CALLS", "PROGRAM:AAA", 1.0), ("PROGRAM:AAA", "CALLS", "PROGRAM:Q60", 1.0), ("JOB:K", "EXECUTES", "PROGRAM:Q00", 1.0), ("PROGRAM:P00", "CALLS", "PROGRAM:Q60", 1.0)]
    assert _oracle("estate_executing_jobs", edges, [("TABLE:T1", "TABLE")]) == [("JOB:J",), ("JOB:K",)]


def test_required_files_are_not_cut(spark):
    n = 12_000
    ids = spark.range(n).select(F.concat(F.lit("PROGRAM:P"), "id").alias("asset_id"))
    a = ids.select("asset_id", F.lit("PROGRAM").alias("asset_type"), F.substring("asset_id", 9, 9).alias("name"), F.lit("confirmed").alias("status"), F.col("asset_id").alias("path"))
    r = ids.where("asset_id <> 'PROGRAM:P0'").select(F.col("asset_id").alias("relationship_id"), F.lit("PROGRAM:P0").alias("source_id"), F.lit("CALLS").alias("rel_type"), F.col("asset_id").alias("target_id"), F.lit(1.0).alias("confidence"), F.lit("confirmed").alias("status"))
    e = Estate(a, r)
    files, _, _, stats = e.required_files("PROGRAM:P0", depth=2, limit=None)
    assert files.count() == n and stats.first()["truncated"] is False
    assert e.required_files("PROGRAM:P0", depth=2, limit=50)[0].count() == 50


def test_lines_of_the_code_graph_are_put_in_order_once(spark, monkeypatch):
    plans, write = [], Rounds.write
    monkeypatch.setattr(Rounds, "write", lambda self, df: plans.append(_plan(df).split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1]) or write(self, df))
    e = estate_queries.estate(spark, "/root/testdata/sf0.001", detailed=True)
    assert sum(p.count("Window [") for p in plans) == 1
    assert e.relationships.where("rel_type = 'READS_TABLE'").count() and e.assets.where("asset_type = 'TABLE'").count()


def test_tables_of_statements_need_no_join(spark, orders):
    found = sqlmodel.sql_facts(deep_queries.programs(spark, orders))
    assert "Join" not in _plan(found) and found.count() == 3600


def test_assets_are_put_together_when_they_are_asked_for(spark):
    rows = [("JCL/A", "//A JOB\n//S EXEC PGM=P\n//D DD DSN=X.Y,DISP=SHR", "jcl"), ("JCL/B", "//S EXEC PGM=Q\n//D DD DSN=X.Z", "jcl")]
    e = assemble.build(spark.createDataFrame(rows, "path string, text string, artifact_type string"))
    assert callable(e._assets) and callable(e._evidence)
    assert {(r.source_id, r.target_id) for r in e.relationships.collect()} >= {("JOB:A", "PROGRAM:P"), ("JOB:A", "DATASET:X.Y")}
    assert e.relationships.where("target_id = 'DATASET:X.Z'").isEmpty()
    assert {"JOB:A", "PROGRAM:P", "DATASET:X.Y"} <= {r.asset_id for r in e.assets.collect()} and not e.evidence.isEmpty()


def test_facts_are_written_when_assets_ask_for_them(spark, monkeypatch):
    shapes, write = [], Rounds.write
    monkeypatch.setattr(Rounds, "write", lambda self, df: shapes.append(tuple(df.columns)) or write(self, df))
    rows = [("JCL/A", "//A JOB\n//S EXEC PGM=P\n//D DD DSN=X.Y,DISP=SHR", "jcl")]
    e = assemble.build(spark.createDataFrame(rows, "path string, text string, artifact_type string"))
    assert e.relationships.count() == 2 and assemble.SHAPE not in shapes
    assert e.assets.count() == 3 and e.evidence.where("entity_kind = 'RELATIONSHIP'").count() == 2 and shapes.count(assemble.SHAPE) == 1
