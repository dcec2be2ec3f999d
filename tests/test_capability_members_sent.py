"""Capability members: programs of roots and without one are written once, and never sent to all by their names."""

from stratalens.operators import graph as G
from stratalens.operators.estate_graph import Estate


def test_names_of_members_are_joined_by_shuffles(spark, monkeypatch):
    rows = [("JOB:J", "EXECUTES", "PROGRAM:A"), ("PROGRAM:A", "CALLS", "PROGRAM:B"), ("PROGRAM:X", "CALLS", "PROGRAM:Y"), ("PROGRAM:Y", "CALLS", "PROGRAM:X")]
    r = spark.createDataFrame([(*x, 1.0, "confirmed", "static") for x in rows], "source_id string, rel_type string, target_id string, confidence double, status string, method string")
    a = spark.createDataFrame([(f"PROGRAM:{n}", "PROGRAM", "OBSERVED") for n in "ABXYZ"], "asset_id string, asset_type string, state string")
    made, write = [], G.Rounds.write
    monkeypatch.setattr(G.Rounds, "write", lambda self, df: made.append((self.base.split("/")[-1].split("-")[0], df.columns)) or write(self, df))
    got = Estate(a, r).capability_members()
    assert [c for n, c in made if n == "led"] == [["root", "id"], ["id"]]
    assert {tuple(x) for x in got.collect()} == {("PROGRAM:A", "PROGRAM:A", False), ("PROGRAM:A", "PROGRAM:B", False), ("PROGRAM:X", "PROGRAM:X", True), ("PROGRAM:X", "PROGRAM:Y", True), ("PROGRAM:Z", "PROGRAM:Z", True)}
