"""Strong components and counts of what is reached, against plain versions on small random graphs."""

import random

import pytest

from stratalens.operators import condense
from stratalens.operators.estate_graph import Estate

EDGE = "source_id string, target_id string"


def reach(edges, start):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for x, y in edges:
            if x == at and y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def graph(seed, n, m):
    r = random.Random(seed)
    return [(f"v{r.randrange(n):02d}", f"v{r.randrange(n):02d}") for _ in range(m)]


@pytest.mark.parametrize("seed,n,m", [(1, 14, 17)])
def test_components_and_counts(spark, seed, n, m):
    edges = graph(seed, n, m)
    held = [(v, k, f"{k}{random.Random(f'{v}{k}{j}').randrange(12)}") for v in {x for e in edges for x in e} | {"alone"} for k in ("t", "c") for j in range(2)]
    roots = ["v00", "v05", "v11", "alone", "nothing"]
    e = spark.createDataFrame([*edges, edges[0], (None, "v01"), ("v01", None)], EDGE)
    got = {r.id: r.component for r in condense.strong_components(e).collect()}
    ids = {x for pair in edges for x in pair}
    assert set(got) == ids
    sets = {v: reach(edges, v) for v in ids}
    assert all(got[v] == min(w for w in sets[v] if v in sets[w]) for v in ids)

    h = spark.createDataFrame([*held, held[0], (None, "t", "t0"), ("v00", "t", None)], "id string, kind string, item string")
    counts = {(r.root, r.kind): r.n for r in condense.reach_counts(e, h, spark.createDataFrame([(r,) for r in [*roots, roots[0], None]], "id string")).collect()}
    plain = {}
    for root in roots:
        for k in ("t", "c"):
            things = {i for v, kind, i in held if kind == k and v in reach(edges, root)}
            if things:
                plain[root, k] = len(things)
    assert counts == plain


def test_long_ways_and_many_rings(spark):
    """A way of single steps between rings, rings within reach of each other, a ring of one."""
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "f"), ("h", "h"), ("g", "z")]
    e = spark.createDataFrame(edges, EDGE)
    got = {r.id: r.component for r in condense.strong_components(e).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f", "g": "f", "h": "h", "z": "z"}
    links = condense.condensed(e, condense.strong_components(e))
    assert {(r.x, r.y) for r in links.collect()} == {("a", "d"), ("d", "e"), ("e", "f"), ("f", "z")}
    assert {r.id: r.layer for r in condense.layers(links).collect()} == {"z": 0, "f": 1, "e": 2, "d": 3, "a": 4}


def test_empty(spark):
    none = spark.createDataFrame([], EDGE)
    assert condense.strong_components(none).count() == 0
    held = spark.createDataFrame([("x", "k", "i")], "id string, kind string, item string")
    got = condense.reach_counts(none, held, spark.createDataFrame([("x",), ("y",)], "id string")).collect()
    assert [(r.root, r.kind, r.n) for r in got] == [("x", "k", 1)]
    assert condense.reach_counts(none, held.limit(0), spark.createDataFrame([], "id string")).count() == 0


def test_sizes_are_those_of_the_members(spark):
    """capability_sizes() counts what capability_members() lists."""
    r = random.Random(3)
    assets = [(f"PROGRAM:P{k}", "PROGRAM", f"P{k}", "UNRESOLVED" if k % 9 == 0 else "OBSERVED", 1.0, "confirmed", None, {}) for k in range(30)] + [("JOB:J1", "JOB", "J1", "OBSERVED", 1.0, "confirmed", None, {})]
    rels = [(f"PROGRAM:P{r.randrange(30)}", "CALLS", f"PROGRAM:P{r.randrange(4, 30)}", "confirmed" if k % 5 else "inferred") for k in range(45)]
    rels += [("JOB:J1", "EXECUTES", f"PROGRAM:P{k}", "confirmed") for k in range(5)]
    rels += [(f"PROGRAM:P{r.randrange(30)}", r.choice(["READS", "WRITES"]), f"TABLE:T{r.randrange(8)}", "confirmed") for _ in range(25)]
    a = spark.createDataFrame(assets, "asset_id string, asset_type string, name string, state string, confidence double, status string, path string, attributes map<string,string>")
    b = spark.createDataFrame([(f"r{k}", s, t, d, 1.0, u, "static", "p", 1, {}) for k, (s, t, d, u) in enumerate(rels)], "relationship_id string, source_id string, rel_type string, target_id string, confidence double, status string, method string, path string, line long, attributes map<string,string>")
    e = Estate(a, b)
    wanted = {}
    for row in e.capabilities().where("NOT rootless").collect():
        wanted[row.root] = (len(row.programs), len(row.tables), len(row.copybooks))
    assert {row.root: (row.programs, row.tables, row.copybooks) for row in e.capability_sizes().collect()} == wanted
    assert wanted
