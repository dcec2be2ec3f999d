"""A small estate from its members to its answers, and graph parts against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from stratalens.operators import assemble, estate_graph, graph, lines, members, sqlmodel
from stratalens.operators.estate_graph import Estate

COBOL = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. {name}.
       ENVIRONMENT DIVISION.
       DATA DIVISION.
       FILE SECTION.
       FD  PAYFILE.
       01  PAY-REC PIC X(80).
       WORKING-STORAGE SECTION.
       01  WS-AREA.
           COPY {book}.
       01  WS-PGM PIC X(8).
       {using}
      * CALL 'NOBODY'.
       MAIN-PARA.
{body}
           GOBACK.
"""


def program(name, body, book="CARDREC", using="PROCEDURE DIVISION."):
    text = COBOL.format(name=name, book=book, using=using, body="\n".join("           " + x for x in body))
    return (f"COBOL/{name}", text, "cobol")


MEMBERS = [
    program("POSTDRV", ["CALL 'BALUPD' USING WS-PGM BY CONTENT WS-AREA.", "CALL 'AUDIT'.", "OPEN OUTPUT PAYFILE.", "WRITE PAY-REC."]),
    program("BALUPD", ["EXEC SQL SELECT BAL, LIM INTO :WS-BAL, :WS-LIM", "  FROM BANK.CARD_MASTER C, BANK.RATES R WHERE 1 = 1 END-EXEC.", "CALL 'AUDIT'."], using="PROCEDURE DIVISION USING LK-KEY LK-AREA."),
    program("AUDIT", ["MOVE 'BALUPD' TO WS-PGM.", "CALL WS-PGM."], book="NOBOOK"),
    program("AUTHTRN", ["EXEC CICS LINK PROGRAM('BALUPD') END-EXEC.", "CALL WS-PGM."]),
    program("STMTDRV", ["EXEC SQL UPDATE BANK.CARD_MASTER SET BAL = :WS-BAL END-EXEC.", "IF WS-BAL > 5 MOVE 1 TO WS-X."]),
    program("OLDPROG", ["EXEC SQL DELETE FROM BANK.CARD_MASTER WHERE 1 = 1 END-EXEC.", "CALL 'LOSTPGM'."]),
    ("JCL/DAILY", "//DAILY JOB (A),CLASS=A\n//S1 EXEC PGM=POSTDRV\n//D1 DD DSN=PROD.PAY(+1),DISP=(NEW,CATLG)\n//S2 EXEC PGM=STMTDRV\n//D2 DD DSN=PROD.PAY,DISP=SHR\n", "jcl"),
    ("COPY/CARDREC", "       01  CARD-REC.\n           05  CARD-NO PIC X(16).\n", "copybook"),
    ("DB2/TABLES", "CREATE TABLE BANK.CARD_MASTER (BAL DECIMAL(9,2));\n", "db2"),
    ("CICS/CSD", "DEFINE TRANSACTION(AUTH) GROUP(G) PROGRAM(AUTHTRN)\n", "cics"),
]


@pytest.fixture(scope="module")
def estate(spark):
    return assemble.build(spark.createDataFrame(MEMBERS, "path string, text string, artifact_type string").repartition(3))


@pytest.fixture(scope="module")
def fine(spark):
    return assemble.build(spark.createDataFrame(MEMBERS, "path string, text string, artifact_type string"), fine=True)


def ids(df, column="id"):
    return {r[column].split(":")[-1] for r in df.collect()}


def test_edges_of_the_estate(estate):
    got = {(r.source_id, r.rel_type, r.target_id, r.confidence, r.status, r.method) for r in estate.relationships.collect()}
    p, sure = "PROGRAM:", (1.0, "confirmed", "static")
    want = {
        (p + "POSTDRV", "CALLS", p + "BALUPD", *sure), (p + "POSTDRV", "CALLS", p + "AUDIT", *sure), (p + "BALUPD", "CALLS", p + "AUDIT", *sure),
        (p + "AUDIT", "CALLS", p + "BALUPD", 0.7, "inferred", "inference"), (p + "AUTHTRN", "CALLS", p + "BALUPD", 1.0, "confirmed", "cics"), (p + "AUTHTRN", "CALLS", p + "WS-PGM", 0.3, "needs_review", "dynamic"),
        (p + "OLDPROG", "CALLS", p + "LOSTPGM", *sure), (p + "BALUPD", "READS", "TABLE:BANK.CARD_MASTER", *sure), (p + "BALUPD", "READS", "TABLE:BANK.RATES", *sure),
        (p + "STMTDRV", "WRITES", "TABLE:BANK.CARD_MASTER", *sure), (p + "OLDPROG", "WRITES", "TABLE:BANK.CARD_MASTER", *sure), (p + "POSTDRV", "WRITES", "FILE:PAYFILE", 0.85, "inferred", "static"),
        ("JOB:DAILY", "EXECUTES", p + "POSTDRV", *sure), ("JOB:DAILY", "EXECUTES", p + "STMTDRV", *sure), ("JOB:DAILY", "READS", "DATASET:PROD.PAY", 0.92, "confirmed", "static"), ("JOB:DAILY", "WRITES", "DATASET:PROD.PAY", 0.92, "confirmed", "static"), ("TRANSACTION:AUTH", "STARTS", p + "AUTHTRN", *sure),
        *((p + x, "USES", "COPYBOOK:NOBOOK" if x == "AUDIT" else "COPYBOOK:CARDREC", *sure) for x in ("POSTDRV", "BALUPD", "AUDIT", "AUTHTRN", "STMTDRV", "OLDPROG")),
    }
    assert got == want


def test_placeholders_and_merge(estate):
    states = {r.asset_id: (r.state, r.status) for r in estate.assets.collect()}
    assert {k for k, v in states.items() if v[0] == "UNRESOLVED"} == {"PROGRAM:LOSTPGM", "PROGRAM:WS-PGM", "COPYBOOK:NOBOOK", "TABLE:BANK.RATES", "FILE:PAYFILE", "DATASET:PROD.PAY"}
    assert states["PROGRAM:BALUPD"] == ("OBSERVED", "confirmed")
    assert estate.resolve("balupd") == "PROGRAM:BALUPD"
    with pytest.raises(KeyError):
        estate.resolve("nothing")


def test_roots_and_dead_code(estate):
    assert ids(estate.roots()) == {"POSTDRV", "STMTDRV", "AUTHTRN"}
    assert ids(estate.dead_code()) == {"OLDPROG"}
    over = {r.program_id: (r.calls_out, r.called_by, r.is_root, r.is_dead) for r in estate.programs_overview().collect()}
    assert over["BALUPD"] == (1, 3, False, False) and over["POSTDRV"] == (2, 1, True, False) and over["OLDPROG"] == (1, 0, False, True)
    assert [[(s.step, s.program) for s in r.steps] for r in estate.jobs_overview().collect()] == [[("S1", "POSTDRV"), ("S2", "STMTDRV")]]
    one = estate.summary().first()
    assert (one.programs, one.jobs, one.steps, one.roots, one.dead_code, one.needs_review_edges, one.inferred_edges) == (6, 1, 2, 3, 1, 1, 2)


def test_capabilities_keep_orphans(estate):
    got = {r.root: r for r in estate.capabilities().collect()}
    assert set(got) == {"PROGRAM:POSTDRV", "PROGRAM:STMTDRV", "PROGRAM:AUTHTRN", "PROGRAM:OLDPROG"}
    assert got["PROGRAM:POSTDRV"].programs == ["PROGRAM:AUDIT", "PROGRAM:BALUPD", "PROGRAM:POSTDRV"] and got["PROGRAM:POSTDRV"].jobs == ["JOB:DAILY"]
    assert got["PROGRAM:OLDPROG"].rootless and got["PROGRAM:OLDPROG"].confidence == 0.3 and got["PROGRAM:POSTDRV"].capability == "Posting"
    detail = {(r.part, r.id): r.detail for r in estate.capability_detail("authtrn").collect()}
    assert detail["trigger", "TRANSACTION:AUTH"] == "online transaction (CICS)" and detail["table", "TABLE:BANK.CARD_MASTER"] == "READS"
    assert ids(estate.executing_jobs("AUDIT"), "job_id") == {"DAILY"}


def test_trace_both_ways_with_a_cycle(estate):
    t = estate.trace("BALUPD")
    got = {(r.direction, r.source_id.split(":")[1], r.rel_type, r.target_id.split(":")[1], r.dist, r.repeated) for r in t.collect()}
    assert ("down", "BALUPD", "CALLS", "AUDIT", 1, False) in got and ("down", "AUDIT", "CALLS", "BALUPD", 2, True) in got
    assert ("up", "AUTHTRN", "CALLS", "BALUPD", 1, False) in got and ("up", "DAILY", "EXECUTES", "POSTDRV", 2, False) in got and ("up", "AUTH", "STARTS", "AUTHTRN", 2, False) in got
    assert not any(r[2] in ("READS", "USES") and r[0] == "up" for r in got)
    shallow = estate.trace("POSTDRV", "down", depth=1, include_data=False)
    assert {r.target_id for r in shallow.collect()} == {"PROGRAM:BALUPD", "PROGRAM:AUDIT"}
    assert Estate.trace_stats(t).first().reads == ["TABLE:BANK.CARD_MASTER", "TABLE:BANK.RATES"]


def test_blast_radius_takes_confidence_and_review_of_one_path(spark):
    e = [("a", "b", 1.0, "confirmed"), ("b", "d", 0.7, "inferred"), ("a", "c", 1.0, "confirmed"), ("c", "d", 0.7, "confirmed"), ("x", "d", 0.7, "inferred")]
    frame = spark.createDataFrame(e, "source_id string, target_id string, confidence double, status string")
    got = {r.id: (r.dist, r.confidence, r.review) for r in graph.bfs(graph.best_edges(frame), spark.createDataFrame([("d",)], "id string"), reverse=True).collect()}
    # of a's two ways of one strength the one without review counts
    assert got == {"d": (0, 1.0, False), "b": (1, 0.7, True), "c": (1, 0.7, False), "x": (1, 0.7, True), "a": (2, 0.7, False)}


def test_impact_lineage_and_files(fine):
    assert {(r.id, r.dist) for r in fine.impact("BANK.CARD_MASTER").collect()} >= {("PROGRAM:STMTDRV", 1), ("PROGRAM:BALUPD", 1), ("JOB:DAILY", 2), ("PROGRAM:POSTDRV", 2)}
    assert ("TABLE:BANK.RATES", 3) in {(r.id, r.dist) for r in fine.lineage("DAILY").collect()}
    files, proof, kinds, stats = fine.required_files("PROGRAM:BALUPD", depth=1)
    assert {r.path for r in files.collect()} >= {"COBOL/BALUPD", "COBOL/POSTDRV", "COBOL/AUDIT", "COPY/CARDREC", "DB2/TABLES"}
    assert ("data_asset", "BANK.RATES") in {tuple(r) for r in kinds.collect()} and not stats.first().truncated and proof.count() > 0
    assert {r.name for r in kinds.where("kind = 'unresolved'").collect()} == {"BANK.RATES"}


def test_bounds_say_when_they_cut(fine):
    cut, whole = fine.required_files("PROGRAM:BALUPD", depth=1, evidence_limit=2), fine.required_files("PROGRAM:BALUPD", depth=1, evidence_limit=None)
    assert cut[1].count() == 2 < whole[1].count() and cut[3].first().evidence_truncated and not whole[3].first().evidence_truncated
    few, all_ = {r.root: r for r in fine.root_summary(depth=2, limit=1).collect()}, {r.root: r for r in fine.root_summary(depth=2, limit=None).collect()}
    assert {r.assets for r in few.values()} == {1} and all(few[k].truncated == (all_[k].assets > 1) for k in all_) and not any(r.truncated for r in all_.values())
    roots = fine._ids("PROGRAM:POSTDRV").withColumnRenamed("id", "asset_id")
    assert {r.truncated for r in fine.coverage(roots, limit=1).collect()} == {True} and {r.truncated for r in fine.coverage(roots, limit=None).collect()} == {False}


def test_slice_says_when_it_is_cut(fine):
    nodes, edges, stats = fine.slice("PROGRAM:BALUPD", depth=1, limit=3)
    assert nodes.count() == 3 and stats.first().truncated and nodes.orderBy("dist", "name").first().asset_id == "PROGRAM:BALUPD"
    assert edges.count() == stats.first().edge_count
    assert not fine.slice("PROGRAM:BALUPD", depth=0)[2].first().truncated
    assert fine.slice("PROGRAM:BALUPD", depth=99, limit=99_999)[2].first()["depth"] == 8


def test_scenarios_of_change(fine):
    got = {r.scenario: r for r in fine.compare("BALUPD").collect()}
    # dependents: four programs, a job, a transaction; dependencies: a program, a copybook, two tables and what they lead to
    assert got["RETIRE"].breakages == 3 and got["EXTRACT-SERVICE"].breakages == 7 and got["REPLATFORM"].breakages == 2
    assert got["MODIFY"].recommended and sum(r.recommended for r in got.values()) == 1
    up = {"PROGRAM": 3, "JOB": 1, "TRANSACTION": 1}
    assert got["MODIFY"].blast_radius == sum(up.values()) and got["MODIFY"].risk_score == min(100, 3 * 6 + 8 + 10 + 6 // 2 + 2 * (8 // 2) + 2 * 1)
    routes = {tuple(r.route) for r in fine.change_paths("BALUPD").collect()}
    assert ("PROGRAM:BALUPD", "PROGRAM:POSTDRV", "JOB:DAILY") in routes


def test_runtime_feed(spark, estate):
    feed = spark.createDataFrame([("program", "OLDPROG", 4), ("program", "BALUPD", 0), ("program", "WS-PGM", 9), ("program", "ELSEWHERE", 1), ("program", "AUDIT", None), ("job", "DAILY", 2)], "entity_type string, entity_id string, exec_count long").withColumn("last_run", F.lit("2026-05-01")).withColumn("avg_elapsed_ms", F.lit(1.0))
    got = {r.program: (r.bucket, r.known_target) for r in estate.reconcile(feed).collect()}
    assert got == {"OLDPROG": ("static-dead but ran", False), "BALUPD": ("cold-but-reachable", True), "WS-PGM": ("static-miss", True), "ELSEWHERE": ("static-miss", False)}
    seen = {r.id: (r.type, r.in_static, r.runtime_status, r.status) for r in estate.correlate(feed).collect()}
    assert seen["AUDIT"] == ("program", True, "unknown", "needs_review") and seen["POSTDRV"][2] == "unknown" and seen["AUTH"][0] == "transaction" and not seen["ELSEWHERE"][1]
    top = [r.program for r in estate.criticality(feed, top=2).collect()]
    assert top[0] == "BALUPD" or top[0] == "AUDIT"


def test_coverage_has_29_checks(fine):
    got = {r.check_name: (r.status, r.confidence) for r in fine.coverage(fine._ids("PROGRAM:POSTDRV").withColumnRenamed("id", "asset_id")).collect()}
    assert len(got) == 29 and got["call_contracts"] == ("captured", 0.9) and got["file_io_semantics"] == ("captured", 0.9) and got["db2_sql"] == ("not_observed", 0.5)
    assert {r.status for r in fine.validate().where("check_name = 'relationships_have_evidence'").collect()} == {"passed"}


def test_arguments_meet_linkage(spark):
    m = spark.createDataFrame(MEMBERS, "path string, text string, artifact_type string").where("artifact_type = 'cobol'")
    got = {(r.program, r.position, r.argument, r.parameter) for r in assemble.argument_linkage(m).collect()}
    assert got == {("BALUPD", 0, "WS-PGM", "LK-KEY"), ("BALUPD", 1, "WS-AREA", "LK-AREA")}


@pytest.mark.parametrize(
    "sql, want",
    [
        ("SELECT A FROM SCH.T3", {("READS", "SCH.T3")}),
        ("SELECT A FROM T1 X, T2 AS Y WHERE X.A = 'FROM T9'", {("READS", "T1"), ("READS", "T2")}),
        ("SELECT A INTO :H FROM T1 LEFT JOIN S.T2 ON 1 = 1", {("READS", "T1"), ("READS", "S.T2")}),
        ("MERGE INTO S.T1 USING T2 ON 1 = 1", {("WRITES", "S.T1"), ("READS", "T2")}),
        ("INSERT INTO T1 (A) SELECT A FROM T2", {("WRITES", "T1"), ("READS", "T2")}),
        ("DELETE FROM T1 WHERE A IN (SELECT A FROM T2)", {("WRITES", "T1"), ("READS", "T2")}),
        ("DECLARE C1 CURSOR FOR SELECT A FROM $T#1 FOR UPDATE OF A", {("READS", "$T#1")}),
        ("FETCH NEXT FROM C1 INTO :A", set()),
        ("UPDATE T1 SET A = :B", {("WRITES", "T1")}),
    ],
)
def test_tables_of_statements(spark, sql, want):
    got = sqlmodel.tables(sqlmodel.labelled(spark.createDataFrame([("p", "o", 1, sql)], "path string, own string, line int, body string")))
    assert {("WRITES" if r.writes else "READS", r.name) for r in got.collect()} == want


def test_paragraphs_behind_sequence_numbers():
    text = "000100 PROCEDURE DIVISION.\n000200 FIRST-PARA.\n000300     CALL 'A'.\n000400 LAST SECTION.\n000500     WRITE R.\n"
    assert [(f[1], f[2], f[3]) for f in members.cobol("000010 FD F1.\n000020 01 R PIC X.\n" + text)] == [("PARAGRAPH", "FIRST-PARA", "FIRST-PARA"), ("CALLS", "FIRST-PARA", "A"), ("SECTION", "LAST", "LAST"), ("WRITES", "LAST", "F1")]


def test_communities_against_the_best_partition(spark):
    """Two cliques on a bridge are found whole, and a random graph's modularity is near the best of many partitions."""
    def found(edges, nodes):
        w = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a string, b string, w double")
        return {r.id: r.community for r in graph.communities(w, spark.createDataFrame([(n,) for n in nodes], "id string")).collect()}

    def quality(edges, label):
        m = len(edges)
        degree = {n: sum((a == n) + (b == n) for a, b in edges) for n in label}
        held = {c: sum(degree[n] for n in label if label[n] == c) for c in set(label.values())}
        return sum(label[a] == label[b] for a, b in edges) / m - sum(k * k for k in held.values()) / (4 * m * m)

    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(5) for j in range(i + 1, 5)]
    two = clique("a") + clique("b") + [("a0", "b0")]
    label = found(two, [f"{p}{i}" for p in "ab" for i in range(5)] + ["lone"])
    assert label["lone"] == "lone" and len({label[f"a{i}"] for i in range(5)}) == 1 and label["a0"] != label["b0"] and len({label[f"b{i}"] for i in range(5)}) == 1
    rng = random.Random(3)
    nodes = [f"n{i:02d}" for i in range(24)]
    edges = sorted({tuple(sorted(rng.sample(nodes[6 * g : 6 * g + 6], 2))) for g in range(4) for _ in range(12)} | {tuple(sorted(rng.sample(nodes, 2))) for _ in range(10)})
    planted = {n: int(n[1:]) // 6 for n in nodes}
    assert quality(edges, found(edges, nodes)) >= 0.9 * quality(edges, planted)


def test_clusters_against_union_find(spark):
    rng = random.Random(5)
    names = [f"PROGRAM:P{i:02d}" for i in range(40)]
    folder = {n: f"dir{rng.randrange(25)}" if rng.random() < 0.5 else None for n in names}
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(12)]
    assets = spark.createDataFrame([(n, "PROGRAM", n[8:], "OBSERVED", 1.0, "confirmed", f"{folder[n]}/{n[8:]}" if folder[n] else None, {}) for n in names], "asset_id string, asset_type string, name string, state string, confidence double, status string, path string, attributes map<string,string>")
    rels = spark.createDataFrame([(f"r{k}", a, "CALLS", b, 1.0, "confirmed", "static", "p", k, {}) for k, (a, b) in enumerate(edges)], "relationship_id string, source_id string, rel_type string, target_id string, confidence double, status string, method string, path string, line int, attributes map<string,string>")
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges + [(a, b) for a in names for b in names if folder[a] and folder[a] == folder[b]]:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {}
    for n in names:
        want[find(n)] = want.get(find(n), 0) + 1
    got = {r.component: r.assets for r in Estate(assets, rels).clusters().collect()}
    assert got == want
    assert Estate(assets, rels).metrics().first().components == len({c for c in graph_parts(names, edges)})


def graph_parts(names, edges):
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {find(n) for n in names}


def test_labels(spark):
    one = lambda n: spark.range(1).select(estate_graph.name_words(F.lit(n)).alias("w")).first().w
    assert one("CRDPOST") == "Card Posting" and one("STMTGEN") == "Statement Generation" and one("ZZZ") == "ZZZ"
    got = {r.community: r.label for r in estate_graph.group_labels(spark.createDataFrame([("c", "AUTHVAL"), ("c", "AUTHTRN"), ("c", "PAYVAL"), ("d", "ZZ")], "community string, name string")).collect()}
    assert got == {"c": "Authorization / Validation", "d": "Unlabeled"}


def test_table_columns_and_keys(spark):
    text = "CREATE TABLE S.T1 (\n  A CHAR(4) NOT NULL, -- a, b\n  B DECIMAL(9, 2),\n  C INTEGER PRIMARY KEY,\n  CONSTRAINT PK PRIMARY KEY (A, B),\n  D VARCHAR(5) DEFAULT 'x,y');\nCREATE TABLE E ();"
    got = [tuple(r) for r in members.ddl_facts(spark.createDataFrame([("p", text), ("q", None)], "path string, text string")).orderBy("position").collect()]
    assert got == [("p", 2, "S.T1", 0, "A", "CHAR(4)", True, True), ("p", 3, "S.T1", 1, "B", "DECIMAL(9,2)", True, True), ("p", 4, "S.T1", 2, "C", "INTEGER", True, True), ("p", 6, "S.T1", 3, "D", "VARCHAR(5)", False, False)]


def test_items_stand_in_groups(spark):
    text = "000010 01  REC.\n000020     05  NAME-GROUP.\n           10 FIRST-NAME PICTURE IS X(4).\n       05 AMOUNT PIC S9(3)V99 COMP-3.\n       77 LONE PIC 9."
    items = lines.with_parents(lines.data_items(spark.createDataFrame([("p", text)], "path string, text string")))
    assert [(r.level, r.name, r.pic, r.parent) for r in items.orderBy("line").collect()] == [(1, "REC", None, None), (5, "NAME-GROUP", None, "REC"), (10, "FIRST-NAME", "X(4)", "NAME-GROUP"), (5, "AMOUNT", "S9(3)V99", "REC"), (77, "LONE", "9", None)]


def test_exports_states_and_insights(spark, estate, tmp_path):
    import json

    from stratalens.sources import estate as sources
    from stratalens.sources import sinks

    edges = estate.relationships.select("source_id", "rel_type", "target_id")
    lines_ = sinks.json_bundle(spark.range(1), estate.programs().select("name"), edges).orderBy("section", "k", "line").collect()
    whole = json.loads("\n".join(r.line for r in lines_))
    assert len(whole["programs"]) == 7 and whole["programs"][-1] is None and len(whole["edges"]) == edges.count() + 1
    sinks.write_tables(str(tmp_path), edges=edges)
    assert spark.read.option("header", True).csv(f"{tmp_path}/edges").count() == edges.count()
    assert [tuple(r) for r in sinks.scenarios(spark.createDataFrame([], "rule_id string, condition string"), smoke=True).collect()] == [("SMOKE", "the program runs")]
    held = spark.createDataFrame([("a", "1", "materialized"), ("b", "1", "failed")], "path string, sha string, state string")
    got = sources.enrichment_states(held, spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "path string, sha string"))
    assert {(r.path, r.state) for r in got.collect()} == {("a", "materialized"), ("b", "stale"), ("c", "pending")}
    assert [r.kind for r in estate.run_insights().collect()] == ["INVENTORY", "ROOT", "GAPS"]


def test_questions_of_an_estate(estate):
    from stratalens.operators.router import EstateRouter

    r = EstateRouter(estate)
    said = {q: r.ask(q)[1]["intent"] for q in ("Which programs are dead?", "show the entry points", "driver chain of POSTDRV", "capabilities", "rules for BALUPD", "statistics", "validate the run", "who calls BALUPD")}
    assert list(said.values()) == ["dead_code", "roots", "chain", "capability", "rules", "stats", "validate", "callers"]
    assert ids(r.ask("roots")[0]) == {"POSTDRV", "STMTDRV", "AUTHTRN"}


def test_folders_declare_types(spark):
    from stratalens.sources import estate as sources

    cases = [("x/app/cbl", "COBOL"), ("app/x/cbl", "UNKNOWN_TEXT"), ("ddl/dcl", "DCLGEN"), ("a/pl1/b", "PLI"), ("", "UNKNOWN_TEXT")]
    df = spark.createDataFrame([(f, "plain") for f, _ in cases], "folder string, text string")
    assert [r.t.type for r in df.select(sources.rule_type(F.col("text"), F.col("folder")).alias("t")).collect()] == [t for _, t in cases]
