"""Projections of plain tables into the estate's shapes: assets, relationships, programs, jobs, runtime feeds.

Each is a common table expression; with_(...) puts those that a query needs, and what they need, before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

CTES = {
    "asset": """
        SELECT concat('REGION:', CAST(r_regionkey AS STRING)) AS asset_id, 'REGION' AS asset_type, r_name AS name FROM region
        UNION ALL SELECT concat('NATION:', CAST(n_nationkey AS STRING)), 'NATION', n_name FROM nation
        UNION ALL SELECT concat('CUSTOMER:', CAST(c_custkey AS STRING)), 'CUSTOMER', c_name FROM customer
        UNION ALL SELECT concat('SUPPLIER:', CAST(s_suppkey AS STRING)), 'SUPPLIER', s_name FROM supplier
        UNION ALL SELECT concat('PART:', CAST(p_partkey AS STRING)), 'PART', p_name FROM part
        UNION ALL SELECT concat('ORDER:', CAST(o_orderkey AS STRING)), 'ORDER', CAST(o_orderkey AS STRING) FROM orders""",
    "relationship": """
        SELECT concat('CUSTOMER:', CAST(c_custkey AS STRING)) AS source_id, 'LOCATED_IN' AS rel_type, concat('NATION:', CAST(c_nationkey AS STRING)) AS target_id, 1.0E0 AS confidence, 'confirmed' AS status, 0 AS line FROM customer
        UNION ALL SELECT concat('SUPPLIER:', CAST(s_suppkey AS STRING)), 'LOCATED_IN', concat('NATION:', CAST(s_nationkey AS STRING)), 1.0E0, 'confirmed', 0 FROM supplier
        UNION ALL SELECT concat('NATION:', CAST(n_nationkey AS STRING)), 'PART_OF', concat('REGION:', CAST(n_regionkey AS STRING)), 1.0E0, 'confirmed', 0 FROM nation
        UNION ALL SELECT concat('ORDER:', CAST(o_orderkey AS STRING)), 'PLACED_BY', concat('CUSTOMER:', CAST(o_custkey AS STRING)), 1.0E0, 'confirmed', 0 FROM orders
        UNION ALL SELECT concat('ORDER:', CAST(l_orderkey AS STRING)), 'CONTAINS', concat('PART:', CAST(l_partkey AS STRING)), CASE l_returnflag WHEN 'R' THEN 1.0E0 WHEN 'A' THEN 0.7E0 ELSE 0.3E0 END, CASE l_returnflag WHEN 'R' THEN 'confirmed' WHEN 'A' THEN 'inferred' ELSE 'needs_review' END, l_linenumber FROM lineitem
        UNION ALL SELECT concat('ORDER:', CAST(l_orderkey AS STRING)), 'USES', concat('SUPPLIER:', CAST(l_suppkey AS STRING)), CASE l_returnflag WHEN 'R' THEN 1.0E0 WHEN 'A' THEN 0.7E0 ELSE 0.3E0 END, CASE l_returnflag WHEN 'R' THEN 'confirmed' WHEN 'A' THEN 'inferred' ELSE 'needs_review' END, l_linenumber FROM lineitem""",
    # users are programs; one user's event after another's is a call
    "seen": "SELECT event_id, ts, event_type, concat('P', CAST(user_id AS STRING)) AS prog, value, concat('T', regexp_extract(props, '([0-9]+)', 1)) AS tab, date_trunc('hour', ts) AS h, user_id % 5 AS shard FROM events",
    "call": "SELECT source_id, target_id, confidence, status, event_id FROM (SELECT lag(prog) OVER (PARTITION BY h ORDER BY ts, event_id) AS source_id, prog AS target_id, event_id, CASE WHEN event_type = 'click' THEN 1.0E0 WHEN event_type = 'error' THEN 0.3E0 ELSE 0.7E0 END AS confidence, CASE WHEN event_type = 'click' THEN 'confirmed' WHEN event_type = 'error' THEN 'needs_review' ELSE 'inferred' END AS status FROM seen) x WHERE source_id IS NOT NULL AND source_id <> target_id",
    "program": "SELECT DISTINCT prog AS program_id FROM seen",
    "step": "SELECT concat('J', CAST(CAST(event_id % 12 AS INTEGER) AS STRING)) AS job_id, prog AS program_id, event_id AS step_order FROM seen WHERE event_type = 'signup'",
    "access": "SELECT prog AS program_id, CASE WHEN event_type = 'purchase' THEN 'WRITES' ELSE 'READS' END AS rel_type, tab, event_id FROM seen WHERE event_type IN ('purchase', 'click')",
    "edge": """
        SELECT source_id, 'CALLS' AS rel_type, target_id, confidence, status, event_id AS line FROM call
        UNION ALL SELECT job_id, 'EXECUTES', program_id, 1.0E0, 'confirmed', step_order FROM step
        UNION ALL SELECT program_id, rel_type, tab, 1.0E0, 'confirmed', event_id FROM access""",
    "runtime": "SELECT concat('P', CAST(user_id AS STRING)) AS entity_id, count(*) AS exec_count, max(ts) AS last_run FROM events WHERE event_type IN ('purchase', 'view') GROUP BY 1",
    # parts are programs: lines of an order that follow each other call if much was ordered, first lines of little are entered,
    # all other lines access a supplier's table; every part uses its brand's copybook
    "code_line": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS before, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem",
    "code_rel": """
        SELECT concat('PROGRAM:P', CAST(before AS STRING)) AS source_id, 'CALLS' AS rel_type, concat('PROGRAM:P', CAST(l_partkey AS STRING)) AS target_id, CASE l_returnflag WHEN 'R' THEN 1.0E0 WHEN 'A' THEN 0.7E0 ELSE 0.3E0 END AS confidence, CASE l_returnflag WHEN 'R' THEN 'confirmed' WHEN 'A' THEN 'inferred' ELSE 'needs_review' END AS status, CASE WHEN l_quantity = 50 AND l_linestatus = 'O' THEN 'cics' ELSE 'static' END AS method, l_orderkey * 10 + k AS line FROM code_line WHERE before IS NOT NULL AND before <> l_partkey AND l_quantity >= 48
        UNION ALL SELECT concat('JOB:J', CAST(l_orderkey AS STRING)), 'EXECUTES', concat('PROGRAM:P', CAST(l_partkey AS STRING)), 1.0E0, 'confirmed', 'static', l_orderkey * 10 + k FROM code_line WHERE k = 1 AND l_quantity <= 2
        UNION ALL SELECT concat('TRANSACTION:X', CAST(l_suppkey AS STRING)), 'STARTS', concat('PROGRAM:P', CAST(l_partkey AS STRING)), 1.0E0, 'confirmed', 'static', l_orderkey * 10 + k FROM code_line WHERE k = 1 AND l_quantity = 3
        UNION ALL SELECT concat('PROGRAM:P', CAST(l_partkey AS STRING)), CASE l_linestatus WHEN 'O' THEN 'READS' ELSE 'WRITES' END, concat('TABLE:T', CAST(l_suppkey AS STRING)), 1.0E0, 'confirmed', 'static', l_orderkey * 10 + k FROM code_line WHERE NOT (before IS NOT NULL AND before <> l_partkey AND l_quantity >= 48) AND NOT (k = 1 AND l_quantity <= 3)
        UNION ALL SELECT concat('PROGRAM:P', CAST(p_partkey AS STRING)), 'USES', concat('COPYBOOK:', upper(p_brand)), 1.0E0, 'confirmed', 'static', 1 FROM part""",
    "code_asset": """
        SELECT concat('PROGRAM:P', CAST(p_partkey AS STRING)) AS asset_id, 'PROGRAM' AS asset_type, concat('P', CAST(p_partkey AS STRING)) AS name, CASE WHEN p_size >= 45 THEN 'UNRESOLVED' ELSE 'OBSERVED' END AS state, CASE WHEN p_size >= 45 THEN 0.5E0 ELSE 1.0E0 END AS confidence, CASE WHEN p_size >= 45 THEN 'needs_review' ELSE 'confirmed' END AS status, CASE WHEN p_size < 45 THEN concat(lower(p_type), '/P', CAST(p_partkey AS STRING)) END AS path, p_type AS language, p_size AS line_count FROM part
        UNION ALL SELECT DISTINCT source_id, 'JOB', substr(source_id, 5), 'OBSERVED', 1.0E0, 'confirmed', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS INTEGER) FROM code_rel WHERE rel_type = 'EXECUTES'
        UNION ALL SELECT DISTINCT source_id, 'TRANSACTION', substr(source_id, 13), 'OBSERVED', 1.0E0, 'confirmed', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS INTEGER) FROM code_rel WHERE rel_type = 'STARTS'
        UNION ALL SELECT DISTINCT target_id, 'TABLE', substr(target_id, 7), 'OBSERVED', 0.9E0, 'inferred', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS INTEGER) FROM code_rel WHERE rel_type IN ('READS', 'WRITES')
        UNION ALL SELECT DISTINCT target_id, 'COPYBOOK', substr(target_id, 10), 'OBSERVED', 1.0E0, 'confirmed', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS INTEGER) FROM code_rel WHERE rel_type = 'USES'""",
    "code_runtime": "SELECT 'program' AS entity_type, concat('P', CAST(user_id AS STRING)) AS entity_id, CASE WHEN user_id % 7 = 3 THEN NULL ELSE count(*) FILTER (WHERE event_type IN ('purchase', 'signup') AND user_id % 5 <> 2) END AS exec_count, CAST(max(ts) AS STRING) AS last_run, CAST(NULL AS DOUBLE) AS avg_elapsed_ms FROM events GROUP BY user_id",
    "older": "SELECT doc_id, substr(sha1(text), 1, 12) AS sha FROM documents WHERE source <> 'src3'",
    "newer": "SELECT doc_id, substr(sha1(CASE WHEN lang = 'es' THEN concat(text, '!') ELSE text END), 1, 12) AS sha FROM documents WHERE source <> 'src7'",
}
_NEEDS = {k: [n for n in CTES if n != k and re.search(rf"(?:FROM|JOIN)\s+{n}\b", sql)] for k, sql in CTES.items()}


def with_(sql: str, recursive: bool = False, given: Iterable[str] = ()) -> str:
    """sql with the projections it reads before it, but for those given.  A sql that starts with WITH goes on from them."""
    order: list[str] = []

    def add(k: str) -> None:
        if k in given:
            return
        for n in _NEEDS[k]:
            add(n)
        if k not in order:
            order.append(k)

    for k in CTES:
        if re.search(rf"(?:FROM|JOIN|,)\s+{k}\b", sql):
            add(k)
    own = ", ".join(f"{k} AS ({CTES[k]})" for k in order)
    head = "WITH RECURSIVE " if recursive else "WITH "
    if not own:
        return sql.lstrip().replace("WITH ", head, 1) if sql.lstrip().startswith("WITH ") else sql
    if sql.lstrip().startswith("WITH "):
        return f"{head}{own}, {sql.lstrip()[5:]}"
    return f"{head}{own} {sql}"


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def register(spark, sf_dir: str, sql: str) -> None:
    """Temporary views of the tables that sql names."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def frame(spark, sf_dir: str, sql: str, **given):
    """sql over the tables; given: projections that are written already, which would else be worked out wherever they are named."""
    full = with_(sql, given=given)
    register(spark, sf_dir, full)
    for name, df in given.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(full)
    finally:
        for name in given:
            spark.catalog.dropTempView(name)
