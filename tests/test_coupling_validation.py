"""Coupling by blocks of programs and validation in one reading hold the rows of their SQL, and form no pair twice."""

import duckdb
import pytest
from pyspark.sql import functions as F

from stratalens.operators import relational


@pytest.fixture
def small(spark, tmp_path):
    """Events of 90 users over 3 tables, and dangling, null and odd rows of an estate."""
    e = spark.range(1200).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), ((F.col("id") * 37) % 90).alias("user_id"),
        F.element_at(F.array(*map(F.lit, ("click", "purchase", "view", "error"))), (F.col("id") % 4 + 1).cast("int")).alias("event_type"), F.lit(1.0).alias("value"), F.concat(F.lit('{"k": '), (F.col("id") % 3).cast("string"), F.lit("}")).alias("props"))
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    one = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    one([(0, "R")], "r_regionkey int, r_name string", "region")
    one([(0, "N", 0), (1, "M", 7)], "n_nationkey int, n_name string, n_regionkey int", "nation")
    one([(1, "C", 0), (2, "D", 9)], "c_custkey long, c_name string, c_nationkey int", "customer")
    one([(1, "S", 1)], "s_suppkey long, s_name string, s_nationkey int", "supplier")
    one([(1, "P")], "p_partkey long, p_name string", "part")
    one([(1, 1), (2, None), (3, 5)], "o_orderkey long, o_custkey long", "orders")
    one([(1, 1, 1, "R", 1), (1, 2, 1, "N", -1), (9, 1, 3, "A", None), (3, None, 1, None, 2)], "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_linenumber int", "lineitem")
    return str(tmp_path)


def _oracle(name, folder):
    c = duckdb.connect()
    for t in ("events", "region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(c.execute(relational.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("block", [1024, 20])
def test_coupling_by_blocks_is_that_of_its_sql(spark, small, monkeypatch, block):
    monkeypatch.setattr(relational, "BLOCK", block)
    monkeypatch.setattr(relational, "THINGS", 2)
    got = relational.queries()["coupling"](spark, small)
    assert got.columns == ["a", "b", "weight"] and sorted(map(tuple, got.collect())) == _oracle("coupling", small)


def test_no_pair_of_programs_is_joined_or_shuffled(spark, small):
    plan = relational.queries()["coupling"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsIn" in plan


def test_validation_counts_dangling_and_null_ends_in_one_reading(spark, small):
    got = relational.queries()["validation_checks"](spark, small)
    assert sorted(map(tuple, got.collect())) == _oracle("validation_checks", small)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_program_is_sent_once_to_a_group(spark, small, monkeypatch):
    # 5,000 blocks' programs go to 313 groups, not to 5,000 blocks; few programs still give each task a pair
    assert relational._groups(5000 * relational.BLOCK, 12) == 313 and relational._groups(3 * relational.BLOCK, 12) == 3 and relational._groups(0, 12) == 1
    monkeypatch.setattr(relational, "BLOCK", 10)
    monkeypatch.setattr(relational, "GROUP", 3)
    monkeypatch.setattr(relational, "_groups", lambda programs, tasks: -(-programs // (relational.GROUP * relational.BLOCK)))
    got = relational.queries()["coupling"](spark, small)
    assert sorted(map(tuple, got.collect())) == _oracle("coupling", small)
