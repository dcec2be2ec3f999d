"""Each registered SQL query against its oracle on the smallest tables."""

import glob
import os

import pytest

from stratalens.operators import graph, relational

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: v if v is None or isinstance(v, (str, bool)) or hasattr(v, "year") else round(float(v), 9)
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(relational.Q))
def test_relational(spark, oracle, name):
    got = relational.queries()[name](spark, DATA)
    want = oracle.sql(relational.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["blast_radius", "impact", "weak_components", "centrality", "shard_modularity"])
def test_graph(spark, oracle, name):
    got = graph.queries()[name](spark, DATA)
    want = oracle.sql(graph.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_bfs_takes_the_strongest_of_the_shortest_paths(spark):
    e = spark.createDataFrame([("a", "b", 0.3, "needs_review"), ("a", "b", 0.7, "inferred"), ("a", "c", 1.0, "confirmed"), ("b", "d", 1.0, "confirmed"), ("c", "d", 0.9, "confirmed"), ("d", "a", 1.0, "confirmed")], "source_id string, target_id string, confidence double, status string")
    got = {r.id: (r.dist, r.confidence) for r in graph.bfs(graph.best_edges(e), spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {"a": (0, 1.0), "b": (1, 0.7), "c": (1, 1.0), "d": (2, 0.9)}
