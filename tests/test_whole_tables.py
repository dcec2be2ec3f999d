"""Queries that once read a part of their rows, on small tables where the rest of the rows decides."""

import datetime

import pytest

from stratalens.operators import graph, relational

HOUR = datetime.datetime(2024, 1, 1)


@pytest.fixture
def estate(spark, tmp_path):
    """Writes the named tables (events: user, type, seconds, table) to a folder."""

    def made(events=(), parts=()):
        at = lambda s: HOUR + datetime.timedelta(seconds=s)
        rows = {
            "events": ([(k, at(s), u, t, 1.0, f'{{"k": {x}}}') for k, (u, t, s, x) in enumerate(events)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
            "part": (list(parts), "p_partkey long, p_name string, p_brand string"),
            "region": ([], "r_regionkey long, r_name string"),
            "nation": ([], "n_nationkey long, n_name string, n_regionkey long"),
            "customer": ([], "c_custkey long, c_name string, c_nationkey long, c_acctbal double"),
            "supplier": ([], "s_suppkey long, s_name string, s_nationkey long"),
            "orders": ([], "o_orderkey long, o_custkey long"),
        }
        for name, (data, schema) in rows.items():
            spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return made


def test_codebase_profile_counts_every_event(spark, estate):
    folder = estate([(1, "purchase", 0, 7), (1, "purchase", 1, 8), (1, "click", 2, 9), (2, "purchase", 3, 5)])
    got = {r.program_id: (r.written, r.n_reads, r.n_writes) for r in relational.queries()["codebase_profile"](spark, folder).collect()}
    assert got == {"P1": ("T7,T8", 1, 2), "P2": ("T5", 0, 1)}


def test_capability_score_takes_key_words_of_every_part(spark, estate):
    folder = estate(parts=[(1, "blue anvil", "B1"), (900, "zincate bolts", "B2"), (901, "zinc anvil", "B2"), (902, "bol", "B3"), (903, "bold%", "B3")])
    got = {r.asset_id: r.score for r in relational.queries()["capability_score"](spark, folder).collect()}
    # key words blue, zinc, bol and bold; bolts begins with bol alone, bol itself begins bold too, bold begins with both
    assert got == {"PART:1": 10, "PART:900": 20, "PART:901": 10, "PART:902": 20, "PART:903": 20}


def test_roots_are_called_by_no_program_at_all(spark, estate):
    # P9 calls P2 within the hour, P5 is alone in its own, P9 comes first; P7 is called by P9 and by no P3
    folder = estate([(9, "signup", 0, 1), (2, "signup", 1, 1), (9, "view", 2, 1), (7, "purchase", 3, 1), (5, "signup", 7200, 1), (8, "purchase", 14400, 1)])
    found = lambda name: {r.program_id for r in relational.queries()[name](spark, folder).collect()}
    assert found("roots_set_algebra") == {"P5", "P8"}
    assert found("root_programs") == {"P5", "P8"}
    got = {r.bucket: r.n for r in relational.queries()["runtime_reconcile"](spark, folder).collect()}
    # P9 and P7 are called and seen; P2 is called and not seen; P8 is seen and has no caller; P5 is neither
    assert got == {"agrees": 2, "called_not_seen": 1, "dead_but_executed": 1, "unknown": 1}


def test_centrality_takes_fifty_turns(spark, estate):
    users = [1, 2, 3, 1, 2, 4, 2, 5, 2, 3, 1, 5]
    folder = estate([(u, "signup" if k == 0 else "view", k, 1) for k, u in enumerate(users)])
    edges = graph._edges(spark, folder, "rel_type IN ('CALLS', 'EXECUTES')")
    plain = [(r.source_id, r.target_id) for r in edges.collect()]
    nodes = sorted({x for e in plain for x in e})
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    out = {x: sum(a == x for a, _ in plain) for x in nodes}
    for turn in range(50):
        lost = sum(rank[x] for x in nodes if not out[x])
        rank = {x: 0.15 / len(nodes) + 0.85 * (sum(rank[a] / out[a] for a, b in plain if b == x) + lost / len(nodes)) for x in nodes}
        if turn == 4:
            five = {x: round(v, 9) for x, v in rank.items() if x[0] == "P"}
    got = {r.id: r.rank for r in graph.queries()["centrality"](spark, folder).collect()}
    assert got == pytest.approx({x: v for x, v in rank.items() if x[0] == "P"}, abs=2e-9) and got != pytest.approx(five, abs=2e-9)
