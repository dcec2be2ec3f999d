"""Corrections by selector and capability names by weighted evidence, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from stratalens.operators import corrections as X
from stratalens.operators import naming
from stratalens.operators.estate_graph import Estate

ASSET = "asset_id string, asset_type string, name string, state string, confidence double, status string, path string, attributes map<string,string>"
REL = "relationship_id string, source_id string, rel_type string, target_id string, confidence double, status string, method string, path string, line int, attributes map<string,string>"
CORRECTION = "correction_id int, entity_kind string, selector string, action string, corrected_type string, corrected_name string, corrected_confidence double, corrected_status string, created int, run_id string"


@pytest.fixture(scope="module")
def estate(spark):
    names = ["PROGRAM:A", "PROGRAM:B", "PROGRAM:C", "TABLE:T"]
    assets = spark.createDataFrame([(n, n.split(":")[0], n.split(":")[1], "OBSERVED", 1.0, "confirmed", None, None if n == "TABLE:T" else {"k": "v"}) for n in names], ASSET)
    rels = [("r1", "PROGRAM:A", "CALLS", "PROGRAM:B"), ("r2", "PROGRAM:B", "CALLS", "PROGRAM:C"), ("r3", "PROGRAM:A", "READS", "TABLE:T"), ("r4", "PROGRAM:A", "WRITES", "TABLE:GONE"), ("r5", "PROGRAM:C", "CALLS", "PROGRAM:A")]
    return Estate(assets, spark.createDataFrame([(*r, 0.7, "inferred", "static", "p", 1, {}) for r in rels], REL))


def _said(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], CORRECTION)


def test_corrections_by_each_selector(spark, estate):
    c = _said(
        spark,
        ("RELATIONSHIP", "calls", "OVERRIDE", None, None, 0.9, "confirmed", 1, None),  # by kind, the oldest
        ("relationship", "A|CALLS|B", "SUPPRESS", None, None, None, None, 2, None),
        ("RELATIONSHIP", "b->calls->c", "OVERRIDE", "XCTL", "NEW", None, None, 3, None),
        ("RELATIONSHIP", "PROGRAM:A|READS|TABLE:T", "OVERRIDE", None, "real", 0.5, None, 1, "run1"),
        ("RELATIONSHIP", "PROGRAM:A|WRITES|TABLE:GONE", "SUPPRESS", None, None, None, None, 1, "other run"),
        ("ASSET", "a", "RENAME", None, "alpha", None, None, 1, None),
        ("ASSET", "PROGRAM:A", "OVERRIDE", "batch", "beta", 0.4, "inferred", 2, None),  # newer: the older rename is out
        ("ASSET", "TABLE:T", "NOTE", "view", "x", None, None, 1, None),  # no action on assets
        ("ASSET", None, "OVERRIDE", "view", None, None, None, 9, None),
    )
    e = X.corrected(estate, c, "run1")
    got = {r.relationship_id: r for r in e.relationships.collect()}
    assert set(got) == {"r2", "r3", "r4", "r5"}
    assert (got["r2"].rel_type, got["r2"].target_id, got["r2"].confidence, got["r2"].method) == ("XCTL", "PROGRAM:NEW", 0.7, "corrected")
    assert (got["r3"].target_id, got["r3"].confidence, got["r3"].attributes) == ("TABLE:REAL", 0.5, {"correction_id": "3", "correction_action": "OVERRIDE"})
    assert (got["r4"].method, got["r5"].confidence, got["r5"].status) == ("static", 0.9, "confirmed")
    a = {r.asset_id: r for r in e.assets.collect()}
    assert (a["PROGRAM:A"].asset_type, a["PROGRAM:A"].name, a["PROGRAM:A"].confidence, a["PROGRAM:A"].attributes["correction_id"]) == ("BATCH", "BETA", 0.4, "6")
    assert (a["TABLE:T"].asset_type, a["TABLE:T"].attributes) == ("TABLE", None) and a["PROGRAM:B"].attributes == {"k": "v"}
    members = spark.createDataFrame([("x/a", "A", "unknown"), ("x/b", "B", "cobol")], "path string, member string, artifact_type string")
    m = X.corrected_members(members, _said(spark, ("MEMBER", "b", "CLASSIFY_AS", "JCL", None, None, None, 1, None), ("MEMBER", "X/A", "IGNORE", "JCL", None, None, None, 1, None)))
    assert {(r.path, r.artifact_type, r.classification_basis) for r in m.collect()} == {("x/a", "unknown", None), ("x/b", "jcl", "correction:0")}


def test_no_corrections_change_nothing(spark, estate):
    e = X.corrected(estate, _said(spark, ("ASSET", "A", "RENAME", None, "Q", None, None, 1, "z")).limit(0))
    assert sorted(e.relationships.collect(), key=str) == sorted(estate.relationships.collect(), key=str) and e.assets.count() == 4


PATTERNS = [
    ("Authorization", "Cards", "AuthService", "driver", "AUTH", 2.0), ("Authorization", "Cards", "AuthService", "table_read", "CARD_MASTER", 2.0), ("Authorization", "Cards", "AuthService", "field", "LIMIT", 2.0),
    ("Posting", "Cards", "PostService", "program", "POST", None), ("Posting", "Cards", "PostService", "table_written", "LEDGER", None), ("Posting", "Cards", "PostService", "driver", "POSTDRV", None),
    ("Billing", "Cards", "BillService", "copybook", "BILLREC", 1.0),
]


def plain_names(found, patterns):
    import re

    stem = set(naming.STEMS)
    out = {}
    for root in {r for r, _, _ in found}:
        rows = []
        for label in sorted({p[0] for p in patterns}):
            score, kinds = 0.0, set()
            for lab, _, _, signal, token, _ in patterns:
                hits = [v for r, s, v in found if r == root and s == signal and (re.search(rf"(?<![A-Z0-9]){token}(?![A-Z0-9])", v) or (token in stem and token in v))]
                if lab == label and hits:
                    score += naming.WEIGHTS[signal]
                    kinds.add(signal)
            if kinds:
                crud = any(p[0] == label and p[3] == "table_written" for p in patterns) and any(r == root and s == "table_written" for r, s, _ in found)
                rows.append((-(score + max(p[5] or 0.0 for p in patterns if p[0] == label) + 2.0 * crud), label, len(kinds) + crud))
        if rows:
            rows.sort()
            score, margin = -rows[0][0], -rows[0][0] + (rows[1][0] if len(rows) > 1 else 0.0)
            sure = min(0.97, min(0.96, 0.45 + score / 38 + min(margin, 10) / 55) + min(rows[0][2], 5) * 0.025)
            out[root] = (rows[0][1], round(score, 3), round(min(sure, 0.74) if margin < 2 and len(rows) > 1 else sure, 3))
    return out


def test_names_by_evidence(spark):
    rng = random.Random(6)
    values = ["AUTHTRAN", "POST", "POSTDRV", "CARD_MASTER", "MY_CARD_MASTER_X", "LEDGER", "GL-LEDGER", "BILLREC", "WS-LIMIT", "LIMITS", "XPOSTX", "OTHER"]
    found = sorted({(f"R{rng.randrange(40)}", rng.choice(list(naming.WEIGHTS)), rng.choice(values)) for _ in range(400)})
    patterns = spark.createDataFrame(PATTERNS, "label string, domain string, service string, signal string, token string, boost double")
    got = {r.root: (r.label, r.score, r.confidence) for r in naming.named(spark.createDataFrame(found, "root string, signal string, value string"), patterns).collect()}
    want = plain_names(found, PATTERNS)
    assert set(got) == set(want)
    for root in want:
        assert got[root][:2] == want[root][:2] and abs(got[root][2] - want[root][2]) < 0.0015, (root, got[root], want[root])


def test_signals_of_roots(spark, estate):
    reached = spark.createDataFrame([("PROGRAM:A", "PROGRAM:A"), ("PROGRAM:A", "PROGRAM:B")], "root string, id string")
    got = {(r.signal, r.value) for r in naming.signals(estate, reached).collect()}
    assert got == {("driver", "A"), ("program", "A"), ("program", "B"), ("program", "C"), ("table_read", "T"), ("table", "T"), ("table_written", "GONE"), ("table", "GONE"), ("relationship", "CALLS"), ("relationship", "READS"), ("relationship", "WRITES")}
    assert naming.named(naming.signals(estate, reached).limit(0), spark.createDataFrame(PATTERNS, "label string, domain string, service string, signal string, token string, boost double")).count() == 0
