"""Extraction, scans, exports, questions and streams on a small estate written here."""

import pytest
from pyspark.sql import functions as F

from stratalens.functions import text as T
from stratalens.operators import lines, members, sqlmodel
from stratalens.operators.router import Router
from stratalens.sources import estate, sinks
from stratalens.streaming import runtime

MAIN = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. PAYMAIN.
      * CALL 'GHOST'.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 WS-REC.
          05 WS-A PIC 9(4).
          05 WS-B PIC X(3).
       01 WS-PGM PIC X(8).
       PROCEDURE DIVISION USING LK-IN.
 MAIN-PARA.
           CALL 'STATIC1' USING BY CONTENT WS-A, WS-B.
           MOVE 'DYN1' TO WS-PGM.
           MOVE WS-PGM TO WS-NEXT.
           CALL WS-NEXT.
           MOVE 7 TO WS-PGM.
           CALL WS-PGM.
           MOVE WS-REC OF GRP (1) TO WS-OUT.
           ADD WS-A TO WS-T GIVING WS-SUM.
           COMPUTE WS-X ROUNDED = WS-A * (WS-B + 1).
           IF WS-A > 5 PERFORM SUB-PARA ELSE GO TO END-PARA.
           EXEC SQL SELECT C1, C2 INTO :H1, :H2 FROM TAB1 WHERE K = :HK
             END-EXEC.
           EXEC SQL INSERT INTO TAB2 (C1, C2) VALUES (:WS-A, :WS-B) END-EXEC.
           EXEC CICS LINK PROGRAM(WS-PGM) END-EXEC.
           EXEC CICS WRITEQ TS QUEUE('Q1') END-EXEC.
 SUB-PARA.
           OPEN INPUT INFILE OUTPUT OUTFILE.
           SORT SRT ON ASCENDING KEY K1 USING INFILE GIVING OUTFILE.
 END-PARA.
           GOBACK.
"""
JOB = """//PAYJOB JOB (A),CLASS=A
//INL PROC HLQ=OLD
//P1 EXEC PGM=INNER
//IN DD DSN=&HLQ..DATA(+1),DISP=SHR
// PEND
// SET HLQ=SETV
//S1 EXEC PGM=PAYMAIN,
//   COND=(4,LT)
//OUT DD DSN=A.B,DISP=(NEW,CATLG)
// IF (S1.RC = 0) THEN
//S2 EXEC INL,HLQ=GIVEN
// ENDIF
//S3 EXEC LIBPROC
//PX.IN DD DSN=OVER.RIDE,DISP=MOD
//S4 EXEC NOWHERE
"""


def frame(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def got(rows, *kinds):
    return {tuple(r[2:]) for r in rows if r[1] in kinds}


def test_procedure_facts():
    f = members.cobol(MAIN)
    calls = {(r[3], r[4], r[5], r[6]) for r in f if r[1] == "CALLS"}
    assert calls == {("STATIC1", "static", 1.0, "confirmed"), ("DYN1", "resolved", 0.7, "inferred"), ("WS-PGM", "dynamic", 0.3, "needs_review")}
    flows = {(r[2], r[3], r[4]) for r in f if r[1] == "FLOW"}
    assert flows == {("WS-PGM", "WS-NEXT", "move"), ("WS-REC", "WS-OUT", "move-group"), ("WS-A", "WS-SUM", "arith"), ("WS-T", "WS-SUM", "arith"), ("WS-A", "WS-X", "compute")}
    assert {(r[3], r[4]) for r in f if r[1] == "PASSES"} == {("WS-A", "0:CONTENT"), ("WS-B", "1:CONTENT")}
    assert [(r[2], r[3]) for r in f if r[1] in ("PERFORMS", "BRANCHES_TO")] == [("MAIN-PARA", "SUB-PARA"), ("MAIN-PARA", "END-PARA")]
    assert {(r[1], r[3]) for r in f if r[4] and r[4].startswith(("OPEN", "SORT"))} == {("READS", "INFILE"), ("WRITES", "OUTFILE")}
    assert [r[3] for r in f if r[1] == "SORTS"] == ["SRT"] and [r[3] for r in f if r[1] == "ACCEPTS"] == ["LK-IN"]
    assert members.cobol("") == []


def test_sql_and_commands(spark):
    m = frame(spark, **{"X/PAY.cbl": MAIN, "empty": "", "none": None})
    assert {(r.source, r.rel_type, r.target, r.line) for r in sqlmodel.sql_facts(m).collect()} == {("PAYMAIN", "READS", "TAB1", 22), ("PAYMAIN", "WRITES", "TAB2", 24)}
    assert {(r.source, r.target) for r in lines.sql_lineage(m).collect()} == {("TAB1.C1", "H1"), ("TAB1.C2", "H2"), ("WS-A", "TAB2.C1"), ("WS-B", "TAB2.C2")}
    assert {(r.rel_type, r.target, r.confidence) for r in lines.cics_facts(m).collect()} == {("CALLS", "WS-PGM", 0.3), ("WRITES", "Q1", 1.0)}


def test_cursors(spark):
    sql = ["DECLARE CUR1 CURSOR FOR SELECT A FROM T1 JOIN T2 ON X = Y", "OPEN CUR1", "FETCH CUR1 INTO :H1", "CLOSE CUR1", "COMMIT"]
    m = frame(spark, c="PROGRAM-ID. CP.\n" + "\n".join(f"    EXEC SQL {s} END-EXEC." for s in sql), none=None)
    got = {(r.source, r.rel_type, r.target, r.line) for r in sqlmodel.cursor_facts(m).collect()}
    assert got == {("CP", "DECLARES_CURSOR", "CUR1", 2), ("CUR1", "CURSOR_READS", "T1", 2), ("CUR1", "CURSOR_READS", "T2", 2), ("CP", "OPENS", "CUR1", 3), ("CP", "FETCHES", "CUR1", 4), ("CP", "CLOSES", "CUR1", 5)}


def test_csd_and_lines(spark):
    csd = frame(spark, c="* x\nDEFINE TRANSACTION(AB01) GROUP(G)\n  PROGRAM(AUTH)\nDEFINE PROGRAM(AUTH)\nDEFINE TRANSACTION(NOP)")
    assert [(r.source, r.target, r.line) for r in lines.csd_facts(csd).collect()] == [("AB01", "AUTH", 2)]
    cases = {
        "assembler": ("MYASM CSECT\n* CALL NO\n      CALL SUBA", {("MYASM", "CALLS", "SUBA")}),
        "pl1": ("MYPL: PROC OPTIONS(MAIN);\n CALL SUBB;\n %INCLUDE BOOK;", {("MYPL", "CALLS", "SUBB"), ("MYPL", "USES", "BOOK")}),
        "bms": ("SET1 DFHMSD TYPE=MAP\nMAP1 DFHMDI SIZE=(24,80)", {("SET1", "CONTAINS", "MAP1")}),
        "ims": ("DBD NAME=DB1\nSEGM NAME=ROOT\nSEGM NAME=LEAF,PARENT=ROOT", {("DB1", "CONTAINS", "ROOT"), ("DB1", "CONTAINS", "LEAF"), ("LEAF", "CHILD_OF", "ROOT")}),
        "mq": ("DEFINE QLOCAL('PAY.Q')\nCALL 'MQPUT' USING 'OUT.Q'", {("M", "DEFINES", "PAY.Q")}),
        "ddl": ("CREATE TABLE T1 (A INT REFERENCES T0)\nCREATE UNIQUE INDEX I1 ON T1 (A)\n-- CREATE TABLE NO", {("M", "DEFINES", "T1"), ("M", "REFERENCES", "T0"), ("I1", "INDEXES", "T1")}),
        "scheduler": ("JOBA|RUNS_BEFORE|JOBB", {("JOBA", "TRIGGERS", "JOBB")}),
    }
    for kind, (text, want) in cases.items():
        found = {(r.source, r.rel_type, r.target) for r in lines.line_facts(frame(spark, m=text), kind).collect()}
        assert want <= found, (kind, found)


def test_jobs_expand_procedures():
    f = members.jcl(JOB, {"LIBPROC": "//LP PROC\n//PX EXEC PGM=LIBPGM\n//IN DD DSN=X.Y,DISP=OLD\n//SX EXEC LIBPROC\n"})
    assert [(r[3], r[4]) for r in f if r[1] == "EXECUTES"] == [("PAYMAIN", "S1:1"), ("INNER", "S2.P1:2"), ("LIBPGM", "S3.PX:3")]
    assert {(r[1], r[2], r[3]) for r in f if r[1] in ("READS", "WRITES", "USES")} == {("WRITES", "S1", "A.B"), ("READS", "S2.P1", "GIVEN.DATA"), ("WRITES", "S3.PX", "OVER.RIDE")}
    assert {(r[2], r[3], r[4]) for r in f if r[1] == "CONDITION"} == {("S1", "(4,LT)", "COND"), ("S2", "S1.RC = 0", "IF")} | {("S2.P1", "S1.RC = 0", "IF")}
    assert [r[3] for r in f if r[1] == "ISSUE"] == ["LIBPROC", "NOWHERE"]
    assert [(r[2], r[3]) for r in f if r[1] == "EXECUTES_BEFORE"] == [("S1", "S2.P1"), ("S2.P1", "S3.PX")]


def test_copy_expansion(spark):
    books = {"B1": "01 :TAG:-REC.\n COPY B2.", "B2": "05 OLD-F PIC X. COPY B1.", "B3": "X"}
    m = frame(spark, p="COPY B1 REPLACING ==:TAG:== BY ==WS== OLD-F BY NEW-F.", q="no copy")
    lib = spark.createDataFrame([*books.items(), ("b2", "zz")][:3], "name string, text string")
    out = {r.path: r.text for r in members.expanded(m, lib).collect()}
    assert "01 WS-REC." in out["p"] and "NEW-F PIC X." in out["p"] and "COPY B1" in out["p"] and out["q"] == "no copy"


def test_scan_decode_classify(spark, tmp_path):
    for folder, name, data in [("COBOL", "A", MAIN.encode()), ("COBOL", "B", b"plain words"), ("LOAD", "C", b"x"), ("BIN", "D", b"a\0b"), ("COBOL", "E.jcl", b"hm"), (".git", "F", b"x"), ("SKIP", "G", b"x"), ("TXT", "H", "café DATA".encode())]:
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(data)
    m = estate.scan(spark, str(tmp_path), ("skip",))
    kinds = {r.path: r.artifact_type for r in estate.classified(estate.headers(m)).collect()}
    assert kinds == {"COBOL/A": "cobol", "COBOL/B": "unknown", "LOAD/C": "binary", "BIN/D": "binary", "COBOL/E.jcl": "jcl", "TXT/H": "unknown"}
    assert {r.path: r.status for r in estate.decoded(m).collect()}["BIN/D"] == "BINARY"
    assert [(r.folder, r.members) for r in estate.skipped(spark, str(tmp_path), ("skip",)).collect()] == [("SKIP", 1)]


def test_code_page(spark):
    df = spark.createDataFrame([(bytearray("HELLO World 12".encode("cp037")),)], "content binary")
    assert df.select(T.from_ebcdic(F.col("content"))).first()[0] == "HELLO World 12"
    assert estate.best_decoding(df).first().encoding == "cp037"


def test_lengths_and_lines(spark):
    cases = [("S9(7)V99", "COMP-3", 6), ("9(4)", "COMP", 2), ("S9(9)", "BINARY", 4), ("9(18)", "COMP", 8), ("X(10)", None, 10), ("ZZ9", None, 3), (None, None, 0), ("9", "COMP-2", 8)]
    df = spark.createDataFrame(cases, "p string, u string, want int")
    assert df.where(T.pic_length(F.col("p"), F.col("u")) != F.col("want")).collect() == []
    one = spark.createDataFrame([("a\nbb\nc", 3)], "t string, o int").select(T.line_of(F.col("t"), F.col("o")), T.snippet(F.col("t"), F.lit(2), 1), T.condition_statement(F.lit("WS-A >= 5"))).first()
    assert one[0] == 2 and [x.text for x in one[1]] == ["a", "bb", "c"] and one[2] == "WS-A is at least 5"


def test_exports(spark, tmp_path):
    a = spark.createDataFrame([("a", "P", "x<&\"y"), ("b", "P", None)], "asset_id string, asset_type string, name string")
    r = spark.createDataFrame([("a", "CALLS", "b", 0.5)], "source_id string, rel_type string, target_id string, confidence double")
    import xml.etree.ElementTree as ET

    body = "\n".join(x.line for x in sinks.graphml(a, r).orderBy("section", "k").collect())
    assert len(list(ET.fromstring(body).iter("{http://graphml.graphdrawing.org/xmlns}node"))) == 2
    assert sinks.cytoscape(a, r).count() == 3 and sinks.sectioned_csv(a, r).count() == 5
    one, two = sinks.export_manifest(a, ["asset_id"], 1).first(), sinks.export_manifest(a.orderBy(F.desc("asset_id")), ["asset_id"]).first()
    assert (one.total, one.exported, one.truncated, two.truncated) == (2, 1, True, False)
    assert two.checksum == sinks.export_manifest(a, ["asset_id"]).first().checksum != one.checksum
    d = sinks.sequence_diagram(spark.createDataFrame([("p", 2, "B", "C", "CALLS"), ("p", 1, "A", "B", "CALLS")], "path string, line int, source string, target string, rel_type string")).first().diagram
    assert d.splitlines()[1:3] == ["    participant A", "    participant B"]
    for run, n in (("r1", 2), ("r2", 1), ("r1", 1)):
        sinks.write_run(a.limit(n), str(tmp_path / "runs"), run)
    assert spark.read.parquet(str(tmp_path / "runs")).groupBy("run_id").count().count() == 2
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_questions(spark):
    e = spark.createDataFrame([("J", "EXECUTES", "A", 1.0, "confirmed"), ("A", "CALLS", "B", 1.0, "confirmed"), ("A", "CALLS", "C", 0.3, "needs_review"), ("B", "WRITES", "T1", 1.0, "confirmed")], "source_id string, rel_type string, target_id string, confidence double, status string")
    r = Router(spark.createDataFrame([("A",), ("B",), ("C",)], "program_id string"), e)
    answer, trace = r.ask("Which programs are dead?")
    assert [x.program_id for x in answer.collect()] == ["C"] and trace["intent"] == "dead_code"
    assert [x.source_id for x in r.ask("who calls b?")[0].collect()] == ["A"]
    answer, trace = r.ask("impact of T1")
    assert {x.id for x in answer.collect()} == {"A", "B", "J"} and trace["intent"] == "impact"
    assert r.ask("sing")[1]["intent"] == "unknown" and r.ask("sing")[0].count() == 0


def test_streams_give_what_tables_give(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    live = runtime.feed(spark, str(tmp_path / "in"), 1)
    # rows come in no order of time here, so nothing may count as late
    for name, of in (("tumbling", runtime.tumbling), ("sessions", runtime.sessions)):
        query = of(live, lateness="3650 days").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, of(events).collect()))


def test_accumulation_as_stream(spark, tmp_path):
    shape = "source string, target string, n bigint, first_seen string, last_seen string, seq bigint"
    rows = [("a", "b", 1, None, "x", 1), ("a", "b", 2, "f2", None, 2), ("a", "b", 3, "f1", "w", 3), ("c", "d", 0, None, None, 4)]
    spark.createDataFrame(rows, shape).repartition(4, "seq").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    runtime.keep_accumulated(s, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert {tuple(r)[:5] for r in runtime.accumulated(spark, str(tmp_path / "t")).collect()} == {("a", "b", 6, "f2", "w"), ("c", "d", 0, None, None)}
    assert {tuple(r)[:5] for r in runtime.accumulate(None, spark.createDataFrame(rows, shape)).collect()} == {("a", "b", 6, "f2", "w"), ("c", "d", 0, None, None)}


def test_feeds(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"window": "m", "source": "s", "entities": [{"id": " a ", "type": "Program", "exec_count": null}, {"id": "x", "type": "cat"}]}')
    got = estate.runtime_metrics(spark, str(tmp_path / "r.json")).collect()
    assert [(r.entity_id, r.entity_type, r.exec_count) for r in got] == [("A", "program", None)]
    (tmp_path / "s.txt").write_text("# x\nJOBA|RUNS_BEFORE|JOBB\njob=C predecessor=B\n")
    assert {(r.source, r.target) for r in estate.scheduler(spark, str(tmp_path / "s.txt")).collect()} == {("JOBA", "JOBB"), ("B", "C")}
    (tmp_path / "d.json").write_text('{"records": [{"dsn": "A"}, {"dsn": "B"}]}')
    assert estate.records(spark, str(tmp_path / "d.json")).count() == 2
    (tmp_path / "m.json").write_text('{"name": "n", "expected_nodes": [{"type": "p", "name": "a"}], "forbidden_edges": [{"type": "C", "source": "a", "target": "b"}]}')
    assert {(r.kind, r.expected, r.key) for r in estate.manifest(spark, str(tmp_path / "m.json")).collect()} == {("node", True, "P|A"), ("edge", False, "C|A|B")}


def test_changes_and_shards(spark):
    inv = lambda *x: spark.createDataFrame(list(x), "path string, sha string")
    assert {(r.path, r.change) for r in estate.changes(inv(("a", "1"), ("b", "2"), ("n", "1")), inv(("a", "1"), ("b", "1"), ("o", "1"))).collect()} == {("a", "same"), ("b", "changed"), ("n", "added"), ("o", "removed")}
    plan = estate.shard_plan(spark.range(100).selectExpr("id AS path", "id AS size_bytes"), 4)
    sizes = [r.s for r in plan.groupBy("shard").agg(F.sum("size_bytes").alias("s")).collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 99


@pytest.mark.parametrize("text", [None, "", "no code"])
def test_empty_members(spark, text):
    m = frame(spark, p=text)
    assert [f(m).count() for f in (sqlmodel.sql_facts, lines.cics_facts, lines.csd_facts, members.cobol_facts, members.jcl_facts, lines.data_items)] == [0] * 6
