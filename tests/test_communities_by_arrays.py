"""Turns of communities: a resource's candidates come to a vertex as one row, gains are summed within a task."""

import random

import pyarrow as pa

from stratalens.operators import graph as G


def test_gains_are_those_of_plain_sums_wherever_batches_end():
    deal, total = random.Random(3), 500.0
    size = {c: float(deal.randrange(5, 60)) for c in range(12)}
    rows, want = [], {}
    for v in range(40):
        k, home, to = float(deal.randrange(1, 9)), deal.randrange(12), {}
        for _ in range(deal.randrange(1, 7)):
            far, f, cs = deal.random() < 0.6, float(deal.randrange(1, 4)), deal.sample(range(12), deal.randrange(1, 6))
            ins = [float(deal.randrange(0, 5)) for _ in cs]
            rows.append({"id": v, "k": k, "home": home, "size": size[home], "f": f, "far": far, "cs": cs, "ins": ins, "ss": [size[c] for c in cs]})
            for c, n in zip(cs, ins):
                if not (far and c == home):
                    to[c] = to.get(c, 0.0) + f * n
        gain = {c: w - k * (size[c] - k if c == home else size[c]) / (2 * total) for c, w in to.items()}
        best = max(gain, key=lambda c: (gain[c], c), default=home)
        if best in gain and gain[best] > gain.get(home, -k * (size[home] - k) / (2 * total)) + 1e-12:
            want[v] = best
    shape = pa.schema([("id", pa.int64()), ("k", pa.float64()), ("home", pa.int64()), ("size", pa.float64()), ("f", pa.float64()), ("far", pa.bool_()), ("cs", pa.list_(pa.int64())), ("ins", pa.list_(pa.float64())), ("ss", pa.list_(pa.float64()))])
    for most in (1, 3, 1000):
        batches = (pa.RecordBatch.from_pylist(rows[k : k + most], schema=shape) for k in range(0, len(rows), most))
        got = {r["id"]: r["new"] for b in G._best_moves(total)(batches) for r in b.to_pylist()}
        assert got == want and want


def test_shared_things_weigh_as_their_pairs_do(spark, monkeypatch):
    deal = random.Random(5)
    uses = {(f"P{deal.randrange(30):02d}", f"T{deal.randrange(9)}") for _ in range(60)}
    calls = [(f"P{a:02d}", f"P{b:02d}", 2) for a, b in ((deal.randrange(30), deal.randrange(30)) for _ in range(25)) if a < b]
    pairs = [(x, y, 1) for x, t in uses for y, u in uses if t == u and x < y]
    nodes = spark.createDataFrame([(f"P{i:02d}",) for i in range(32)], "id string")
    plans, write = [], G.Rounds.write
    monkeypatch.setattr(G.Rounds, "write", lambda self, df: plans.append(df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]) or write(self, df))
    frame = lambda rows: spark.createDataFrame(rows, "a string, b string, w int")
    how = {"passes": 2, "turns": 3}
    got = G.communities(frame(calls), nodes, uses=spark.createDataFrame(sorted(uses), "id string, resource string"), **how)
    # a row for each vertex, thing and candidate was put in order by its names
    assert not any("SortAggregate" in p for p in plans)
    want = G.communities(frame(calls + pairs), nodes, **how)
    assert sorted(got.collect()) == sorted(want.collect()) and 1 < want.select("community").distinct().count() < 32


def test_candidates_of_a_thing_come_once_to_a_task():
    # two vertices use thing 7, whose candidates are 3 (home of the first) and 9; the second also calls into 3
    none = {c: None for c in ("k", "home", "size", "resource", "f", "c", "w", "s", "cs", "ins", "ss")}
    rows = [{**none, "id": -1, "resource": 7, "cs": [9, 3], "ins": [5.0, 2.0], "ss": [20.0, 10.0]}]
    rows += [{**none, "id": 1, "k": 2.0, "home": 3, "size": 10.0, "resource": 7, "f": 2.0, "c": 3, "w": 1.0, "s": 10.0}]
    rows += [{**none, "id": 2, "k": 2.0, "home": 4, "size": 6.0, "resource": 7, "f": 1.0, "c": 4, "w": 0.0, "s": 6.0}, {**none, "id": 2, "k": 2.0, "home": 4, "size": 6.0, "c": 3, "w": 4.0, "s": 10.0}]
    number, listed = pa.float64(), pa.list_(pa.float64())
    shape = pa.schema([("id", pa.int64()), ("k", number), ("home", pa.int64()), ("size", number), ("resource", pa.int64()), ("f", number), ("c", pa.int64()), ("w", number), ("s", number), ("cs", pa.list_(pa.int64())), ("ins", listed), ("ss", listed)])
    for most in (1, 2, 10):
        batches = (pa.RecordBatch.from_pylist(rows[k : k + most], schema=shape) for k in range(0, len(rows), most))
        got = [(r["id"], sorted((c, w, s) for c, w, s in zip(r["cs"], r["ins"], r["ss"]) if w)) for b in G._expanded(batches) for r in b.to_pylist()]
        assert got == [(1, [(3, 1.0, 10.0), (9, 10.0, 20.0)]), (2, [(3, 2.0, 10.0), (9, 5.0, 20.0)]), (2, [(3, 4.0, 10.0)])]
