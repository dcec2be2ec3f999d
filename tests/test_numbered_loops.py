"""Loops over the graph go by numbers, and projections are read in one pass: same rows, and few of them sent to all."""

import pytest
from pyspark.sql import functions as F

from stratalens.operators import condense, estate_queries
from stratalens.operators import graph as G
from stratalens.plans.projection import frame

SMALL = "/root/testdata/sf0.001"


def _edges(spark, rows):
    return spark.createDataFrame(rows, "source_id string, target_id string")


@pytest.fixture
def sent(monkeypatch):
    """Every frame that is given for sending to all, by its columns."""
    seen, real = [], G.F.broadcast
    monkeypatch.setattr(G.F, "broadcast", lambda df: seen.append(df.columns) or real(df))
    return seen


def test_relationships_in_one_pass_are_those_of_the_projection(spark):
    want = frame(spark, SMALL, "SELECT source_id, rel_type, target_id, confidence, status, method, line FROM code_rel")
    got = estate_queries.code_relationships(spark, SMALL)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    assert "Union" in got._jdf.queryExecution().optimizedPlan().toString() and got._jdf.queryExecution().optimizedPlan().toString().count("lineitem.parquet") <= 1


def test_derived_columns_and_assets_are_not_written(spark):
    e = estate_queries.estate(spark, SMALL)
    assert callable(e._assets) and callable(e._evidence)
    assert "Project" in e.relationships.select("relationship_id")._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_follow_the_order_of_names(spark):
    rounds = G.Rounds(spark, "t")
    got = {r["id"]: r["n"] for r in G.numbers(spark.createDataFrame([(x,) for x in ("b", "a", "c10", "c9", "b", None)], "id string"), rounds).collect()}
    assert got == {"a": 1, "b": 2, "c10": 3, "c9": 4}


def test_loops_send_no_names_to_all(spark, sent):
    rows = [(f"P{i}", f"P{i + 1}") for i in range(12)] + [("P12", "P3"), ("X", "Y")]
    at = {r["id"]: r["component"] for r in condense.strong_components(_edges(spark, rows)).collect()}
    ring = {f"P{i}" for i in range(3, 13)}
    assert {k for k, v in at.items() if v == min(ring)} == ring and at["X"] == "X"
    looped = [c for c in sent if "colour" in c]
    assert looped
    plans = G.bfs(_edges(spark, rows).withColumn("confidence", F.lit(1.0)).withColumn("review", F.lit(False)), spark.createDataFrame([("P0",), ("X",)], "id string"))
    assert {(r["root"], r["id"], r["dist"]) for r in plans.where("dist >= 11").collect()} == {("P0", "P11", 11), ("P0", "P12", 12)}


def test_components_of_a_long_chain_and_of_stars(spark):
    chain = [(f"V{i * 7919 % 400:03d}", f"V{(i + 1) * 7919 % 400:03d}") for i in range(399)]
    star = [(f"W{i}", "ZHUB") for i in range(50)] + [("Q", "Q"), (None, "Q")]
    got = {r["id"]: r["component"] for r in G.components(_edges(spark, chain + star)).collect()}
    assert {got[f"V{i:03d}"] for i in range(400)} == {"V000"}
    assert {v for k, v in got.items() if k[0] in "WZ"} == {"W0"} and got["Q"] == "Q" and None not in got


def test_reached_takes_edges_in_both_directions_without_a_copy(spark):
    rows = [("a", "b"), ("c", "b"), ("c", "d")]
    got = {(r["id"], r["dist"]) for r in G.reached(_edges(spark, rows), spark.createDataFrame([("a",)], "id string"), both=True, held=True).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_sets_of_few_things_take_few_rows(spark, monkeypatch):
    held = spark.createDataFrame([(f"P{i}", "tables", f"T{(i * 37 + j * 991) % 5000}") for i in range(40) for j in range(5)], "id string, kind string, item string")
    rows = [(f"P{i}", f"P{i + 1}") for i in range(0, 38, 2)]
    made, real = [], G.Rounds.write

    def write(self, df):
        back = real(self, df)
        if "bits" in df.columns:
            made.append(df.schema["bits"].dataType.simpleString())
        return back

    monkeypatch.setattr(G.Rounds, "write", write)
    got = {(r["root"], r["n"]) for r in condense.reach_counts(_edges(spark, rows), held, spark.createDataFrame([("P0",), ("P39",), ("none",)], "id string")).collect()}
    want = lambda *ids: len({(i * 37 + j * 991) % 5000 for i in ids for j in range(5)})
    assert got == {("P0", want(0, 1)), ("P39", want(39))} and set(made) == {"bigint"}


def test_ranks_are_those_of_plain_turns(spark):
    rows = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("c", "e")]
    ids = sorted({x for r in rows for x in r})
    want = {i: 1 / len(ids) for i in ids}
    out = {i: sum(r[0] == i for r in rows) for i in ids}
    for _ in range(4):
        lost = sum(want[i] for i in ids if not out[i])
        want = {i: 0.15 / len(ids) + 0.85 * (sum(want[x] / out[x] for x, y in rows if y == i) + lost / len(ids)) for i in ids}
    got = {r["id"]: r["rank"] for r in G.pagerank(_edges(spark, rows), turns=4).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in ids)
