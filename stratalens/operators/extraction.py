"""Queries of the extractors: each row of a plain table becomes a small source member, and the oracle gives its facts from the row.

So extraction is checked over whole tables by SQL that never sees the source text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import estate, sinks
from ..streaming import runtime
from . import lines, members, sqlmodel


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tab() -> F.Column:
    return F.concat(F.lit("T"), F.regexp_extract("props", "([0-9]+)", 1))


def programs(spark, sf_dir) -> DataFrame:
    """(path, text): a COBOL program for each event, whose one act follows the event's type."""
    call = F.concat(F.lit("P"), F.col("user_id"))
    act = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("    CALL '"), call, F.lit("'.")))
        .when(F.col("event_type") == "view", F.concat(F.lit("    MOVE '"), call, F.lit("' TO WS-PGM.\n    MOVE WS-PGM TO WS-NEXT.\n    CALL WS-NEXT USING BY CONTENT WS-A.")))
        .when(F.col("event_type") == "error", F.concat(F.lit("    MOVE '"), call, F.lit("' TO WS-PGM.\n    MOVE 5 TO WS-PGM.\n    CALL WS-PGM.")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("    EXEC SQL UPDATE "), _tab(), F.lit("\n      SET C1 = :WS-A WHERE C2 = 1 END-EXEC.")))
        .otherwise(F.concat(F.lit("    EXEC CICS READ FILE('"), _tab(), F.lit("') END-EXEC.\n    IF WS-A > 5 MOVE WS-A TO WS-B.")))
    )
    head = F.concat(F.lit("IDENTIFICATION DIVISION.\nPROGRAM-ID. E"), F.col("event_id"), F.lit(".\n      * CALL 'NOBODY'.\nPROCEDURE DIVISION.\nMAIN-PARA.\n"))
    return members.spread(_read(spark, sf_dir, "events"), "event_id").select(F.concat(F.lit("COBOL/E"), F.col("event_id")).alias("path"), F.concat(head, act).alias("text"))


def jobs(spark, sf_dir) -> DataFrame:
    """(path, text): a job for each line item; what is returned was written, what is open is symbolic."""
    c = F.col
    dsn = F.concat(F.lit("SUPP.D"), c("l_suppkey"), F.when(c("l_linestatus") == "O", F.lit(".&ENV")).otherwise(F.lit("(+1)")))
    disp = F.when(c("l_returnflag") == "R", "(NEW,CATLG)").when(c("l_returnflag") == "A", "SHR").otherwise("OLD")
    text = F.concat(F.lit("//J"), c("l_orderkey"), F.lit(" JOB (A),CLASS=A\n//S"), c("l_linenumber"), F.lit(" EXEC PGM=P"), c("l_partkey"), F.lit(",\n//   PARM='X'\n//D1 DD DSN="), dsn, F.lit(",DISP="), disp)
    return members.spread(_read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").select(F.concat_ws("/", F.lit("JCL"), c("l_orderkey"), c("l_linenumber")).alias("path"), text.alias("text"))


def extract_cobol(spark, sf_dir):
    """2.8-1 to 2.8-3, 2.8-7, 2.8-29, 2.8-31, 2.8-33, 2.8-37: the programs' facts, counted."""
    f = members.cobol_facts(programs(spark, sf_dir))
    return f.groupBy("kind", "target", "confidence", "status").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last_line"))


def extract_sql(spark, sf_dir):
    """2.8-4, 2.8-5, 2.8-38: tables and columns that embedded SQL meets."""
    p = programs(spark, sf_dir)
    tables = sqlmodel.sql_facts(p).select("source", "rel_type", "target", "line")
    return tables.unionByName(lines.sql_lineage(p).select("source", F.col("kind").alias("rel_type"), "target", "line"))


def extract_cics(spark, sf_dir):
    """2.8-6, 2.8-34: what commands do, from each program."""
    return lines.cics_facts(programs(spark, sf_dir)).select("source", "rel_type", "target_type", "target", "confidence", "line")


def extract_jcl(spark, sf_dir):
    """2.8-11, 2.8-18, 2.8-19, 2.8-42: programs that jobs execute, data sets by disposition."""
    f = members.jcl_facts(jobs(spark, sf_dir))
    return f.where("kind <> 'JOB'").groupBy("kind", "target", "confidence").agg(F.count(F.lit(1)).alias("n"))


def extract_jcl_lines(spark, sf_dir):
    """2.8-11: executions by one pattern a line, without state."""
    return lines.line_facts(jobs(spark, sf_dir), "jcl").select("source", "rel_type", "target", "line")


def dataset_identity(spark, sf_dir):
    """2.8-43, 2.3: canonical names of data sets."""
    dsn = F.concat(F.lit("supp.d"), F.col("l_suppkey"), F.when(F.col("l_linestatus") == "O", F.lit(".&env")).otherwise(F.lit("(+1)")))
    d = _read(spark, sf_dir, "lineitem").select(T.dataset_identity(dsn).alias("d"))
    return d.groupBy("d.canonical", "d.symbolic", "d.confidence", "d.status").agg(F.count(F.lit(1)).alias("n"))


def copybook_layout(spark, sf_dir):
    """2.8-8, 2.8-20: layouts' items and record lengths; a layout for each part."""
    c = F.col
    text = F.concat(F.lit("01 REC-"), c("p_partkey"), F.lit(".\n   05 A-NAME PIC X("), c("p_size"), F.lit(").\n   05 A-SUM PIC S9("), c("p_size"), F.lit(")V99 COMP-3.\n   05 A-NUM REDEFINES A-SUM PIC 9(4) COMP.\n   05 A-FLAG PIC XX."))
    m = _read(spark, sf_dir, "part").select(c("p_partkey").alias("path"), text.alias("text"))
    return lines.record_lengths(lines.data_items(m)).select(c("path").alias("p_partkey"), "bytes", "items")


# Fixed values of this check: one text a type.
_SHAPES = {"click": "IDENTIFICATION DIVISION. PROGRAM-ID. A.", "view": "//J1 JOB\n//S EXEC PGM=A", "error": "CREATE TABLE A (B INT)", "purchase": "DEFINE TRANSACTION(T) PROGRAM(P)", "signup": " 01 A PIC X."}
_TYPES = {"click": ("cobol", "COBOL"), "view": ("jcl", "JCL"), "error": ("db2", "SQL_DDL"), "purchase": ("cics", "UNKNOWN_TEXT"), "signup": ("copybook", "COPYBOOK")}


def classify_members(spark, sf_dir):
    """2.7-1, 2.7-4: content types by signature and by rule."""
    shapes = F.create_map(*[F.lit(x) for kv in _SHAPES.items() for x in kv])
    t = _read(spark, sf_dir, "events").select(shapes[F.col("event_type")].alias("text"))
    return t.select(estate.content_type(F.col("text")).alias("artifact_type"), estate.rule_type(F.col("text")).alias("r")).groupBy("artifact_type", F.col("r.type").alias("rule_type"), F.col("r.confidence").alias("confidence"), F.col("r.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def classify_documents(spark, sf_dir):
    """2.7-1: signatures over the whole texts of documents and pages."""
    t = _read(spark, sf_dir, "documents").select("text").unionAll(_read(spark, sf_dir, "pages").select(F.col("html").alias("text")))
    return t.groupBy(F.coalesce(estate.content_type(F.col("text")), F.lit("unknown")).alias("artifact_type")).agg(F.count(F.lit(1)).alias("n"))


def names_cased(spark, sf_dir):
    """2.9: names as labels."""
    n = F.col("n_name")
    return _read(spark, sf_dir, "nation").select("n_nationkey", T.slug(n).alias("slug"), T.pascal(n).alias("pascal"), T.camel(n).alias("camel"))


def pipe_export(spark, sf_dir):
    """2.2-11: a pipe-delimited index."""
    return sinks.pipe_index(_read(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", "o_orderpriority")


def xml_nodes(spark, sf_dir):
    """2.2-6, 2.2-7: GraphML's lines, counted by section."""
    a = _read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("asset_id"), F.lit("NATION").alias("asset_type"), F.col("n_name").alias("name"))
    r = _read(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("source_id"), F.lit("LOCATED_IN").alias("rel_type"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("target_id"), F.lit(1.0).alias("confidence"))
    return sinks.graphml(a, r).groupBy("section").agg(F.count(F.lit(1)).alias("n"))


def rule_scenarios(spark, sf_dir):
    """2.2-16: two scenarios of each rule."""
    return sinks.scenarios(_read(spark, sf_dir, "events").select(F.col("event_id").alias("rule_id"), F.col("event_type").alias("condition")))


def upsert_orders(spark, sf_dir):
    """2.2-2: keyed merge: line items' last status over orders' status."""
    old = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("state"))
    new = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("state"), F.struct("l_linenumber", "l_linestatus").alias("seq"))
    return sinks.upserted(old, new, ["key"], "seq")


def runtime_tumbling(spark, sf_dir):
    """2.10: windows over the runtime feed (an extension)."""
    return runtime.tumbling(_read(spark, sf_dir, "events"))


def runtime_sliding(spark, sf_dir):
    return runtime.sliding(_read(spark, sf_dir, "events"))


def runtime_sessions(spark, sf_dir):
    return runtime.sessions(_read(spark, sf_dir, "events"))


def runtime_accumulated(spark, sf_dir):
    """2.10: counts summed; first and last sight in order of import."""
    e = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("target"), F.lit(1).cast("bigint").alias("n"), F.when(F.col("value") > 10, F.col("ts")).alias("first_seen"), F.col("ts").alias("last_seen"), F.col("event_id").alias("seq"))
    return runtime.accumulate(None, e)


def shard_plan(spark, sf_dir):
    """2.1-15: shards of balanced size."""
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size_bytes"))
    return estate.shard_plan(d, 8).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("size_bytes"))


_OWN = (extract_cobol, extract_sql, extract_cics, extract_jcl, extract_jcl_lines, dataset_identity, copybook_layout, classify_members, classify_documents, names_cased, pipe_export, xml_nodes, rule_scenarios, upsert_orders, runtime_tumbling, runtime_sliding, runtime_sessions, runtime_accumulated, shard_plan)


def queries() -> dict:
    return {f.__name__: f for f in _OWN}


_TAB = "concat('T', regexp_extract(props, '([0-9]+)', 1))"
_CALLED = "concat('P', CAST(user_id AS VARCHAR))"
_SUPP = "concat('SUPP.D', CAST(l_suppkey AS VARCHAR), CASE WHEN l_linestatus = 'O' THEN '.&ENV' ELSE '' END)"


def oracle_sql() -> dict[str, str]:
    facts = " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, {target} AS target, {sure}::DOUBLE AS confidence, '{status}' AS status, {line} AS line FROM events{where}"
        for kind, target, sure, status, line, where in [
            ("ACCEPTS", "NULL", "0.84", "inferred", 4, " WHERE false"),
            ("PARAGRAPH", "'MAIN-PARA'", "1.0", "confirmed", 5, ""),
            ("CALLS", _CALLED, "1.0", "confirmed", 6, " WHERE event_type = 'click'"),
            ("FLOW", "'WS-NEXT'", "1.0", "confirmed", 7, " WHERE event_type = 'view'"),
            ("CALLS", _CALLED, "0.7", "inferred", 8, " WHERE event_type = 'view'"),
            ("PASSES", "'WS-A'", "0.78", "inferred", 8, " WHERE event_type = 'view'"),
            ("CALLS", "'WS-PGM'", "0.3", "needs_review", 8, " WHERE event_type = 'error'"),
            ("RULE", "'WS-A > 5'", "0.6", "inferred", 7, " WHERE event_type = 'signup'"),
            ("FLOW", "'WS-B'", "1.0", "confirmed", 7, " WHERE event_type = 'signup'"),
        ]
    )
    kinds = lambda k: "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{t[k]}'" for e, t in _TYPES.items()) + " END"
    sig = "CASE " + " ".join("WHEN " + " AND ".join(f"regexp_matches(text, '{rx}')" for rx in all_of) + f" THEN '{name}'" for name, all_of in estate.SIGNATURES) + " ELSE 'unknown' END"
    hour = "date_trunc('hour', ts)"
    return {
        "extract_cobol": f"SELECT kind, target, confidence, status, count(*) AS n, max(line) AS last_line FROM ({facts}) f GROUP BY kind, target, confidence, status",
        "extract_sql": f"SELECT concat('E', CAST(event_id AS VARCHAR)) AS source, 'WRITES' AS rel_type, {_TAB} AS target, 6 AS line FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'WS-A', 'sql-write', concat({_TAB}, '.C1'), 6 FROM events WHERE event_type = 'purchase'",
        "extract_cics": f"SELECT concat('E', CAST(event_id AS VARCHAR)) AS source, 'READS' AS rel_type, 'dataset' AS target_type, {_TAB} AS target, 1.0::DOUBLE AS confidence, 6 AS line FROM events WHERE event_type = 'signup'",
        "extract_jcl": f"SELECT kind, target, confidence, count(*) AS n FROM (SELECT 'EXECUTES' AS kind, concat('P', CAST(l_partkey AS VARCHAR)) AS target, 1.0::DOUBLE AS confidence FROM lineitem UNION ALL SELECT CASE l_returnflag WHEN 'R' THEN 'WRITES' WHEN 'A' THEN 'READS' ELSE 'USES' END, {_SUPP}, CASE WHEN l_linestatus = 'O' THEN 0.45 ELSE 0.92 END FROM lineitem) x GROUP BY kind, target, confidence",
        "extract_jcl_lines": "SELECT concat('J', CAST(l_orderkey AS VARCHAR)) AS source, 'EXECUTES' AS rel_type, concat('P', CAST(l_partkey AS VARCHAR)) AS target, 2 AS line FROM lineitem",
        "dataset_identity": f"SELECT {_SUPP} AS canonical, l_linestatus = 'O' AS symbolic, CASE WHEN l_linestatus = 'O' THEN 0.45 ELSE 0.86 END::DOUBLE AS confidence, CASE WHEN l_linestatus = 'O' THEN 'needs_review' ELSE 'inferred' END AS status, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4",
        "copybook_layout": "SELECT p_partkey, CAST(p_size + (p_size + 5) // 2 + 2 AS BIGINT) AS bytes, 5 AS items FROM part",
        "classify_members": f"SELECT {kinds(0)} AS artifact_type, {kinds(1)} AS rule_type, c::DOUBLE AS confidence, CASE WHEN c >= 0.9 THEN 'confirmed' WHEN c >= 0.5 THEN 'inferred' ELSE 'needs_review' END AS status, count(*) AS n FROM (SELECT event_type, CASE event_type WHEN 'click' THEN 0.9 WHEN 'view' THEN 0.85 WHEN 'error' THEN 0.9 WHEN 'purchase' THEN 0.35 ELSE 0.7 END AS c FROM events) e GROUP BY 1, 2, 3, 4",
        "classify_documents": f"SELECT {sig} AS artifact_type, count(*) AS n FROM (SELECT text FROM documents UNION ALL SELECT html FROM pages) d GROUP BY 1",
        "names_cased": "SELECT n_nationkey, replace(lower(n_name), '_', '-') AS slug, concat('Nation', split_part(n_name, '_', 2)) AS pascal, concat('nation', split_part(n_name, '_', 2)) AS camel FROM nation",
        "pipe_export": "SELECT concat_ws('|', o_orderkey, o_orderstatus, replace(o_orderpriority, '|', '/')) AS line FROM orders",
        "xml_nodes": "SELECT section, n FROM (VALUES (0, 7), (3, 2)) v(section, n) UNION ALL SELECT 1, count(*) FROM nation UNION ALL SELECT 2, count(*) FROM customer",
        "rule_scenarios": "SELECT concat(CAST(event_id AS VARCHAR), '-', b) AS scenario_id, concat(event_type, ' ', s) AS given FROM events, (VALUES ('T', 'holds'), ('F', 'does not hold')) v(b, s)",
        "upsert_orders": "SELECT o_orderkey AS key, coalesce(s, o_orderstatus) AS state FROM orders LEFT JOIN (SELECT l_orderkey, max(concat(CAST(l_linenumber AS VARCHAR), l_linestatus)) AS m, substr(max(concat(lpad(CAST(l_linenumber AS VARCHAR), 9, '0'), l_linestatus)), 10) AS s FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o_orderkey UNION ALL SELECT l_orderkey, substr(max(concat(lpad(CAST(l_linenumber AS VARCHAR), 9, '0'), l_linestatus)), 10) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey",
        "runtime_tumbling": f"SELECT {hour} AS start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18, 4))) AS total FROM events GROUP BY 1, 2",
        "runtime_sliding": f"SELECT {hour} - k * INTERVAL 1 HOUR AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2",
        "runtime_sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, s",
        "runtime_accumulated": "SELECT CAST(user_id AS VARCHAR) AS source, event_type AS target, count(*) AS n, arg_min(ts, event_id) FILTER (WHERE value > 10) AS first_seen, arg_max(ts, event_id) AS last_seen, max(event_id) AS seq FROM events GROUP BY 1, 2",
        # row numbers from the largest, in turns back and forth
        "shard_plan": "SELECT CAST(CASE WHEN (k // 8) % 2 = 0 THEN k % 8 ELSE 7 - k % 8 END AS INTEGER) AS shard, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size_bytes FROM (SELECT n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS k FROM documents) d GROUP BY 1",
    }
