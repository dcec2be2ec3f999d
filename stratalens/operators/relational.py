"""Relational operators: lookups, joins, aggregates, set operations and validation over the projected estate.

Each entry is a function of the dialect that gives one SQL text; Catalyst plans it in Spark, and the same text in the
oracle's dialect checks it.  The comment before each names the rows of the inventory that it covers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dialect import Duck, Spark
from ..plans.projection import frame, with_

D = Spark
Q: dict = {}


def q(f):
    Q[f.__name__] = f
    return f


# 2.3-1, 2.3-13, 2.3-14: projections and point lookups
@q
def all_programs(d: D):
    return "SELECT program_id FROM program"


@q
def list_assets(d: D):
    return "SELECT a.asset_id, a.name, count(r.target_id) AS n_out FROM asset a LEFT JOIN relationship r ON r.source_id = a.asset_id WHERE a.asset_type = 'NATION' GROUP BY a.asset_id, a.name"


@q
def get_asset(d: D):
    return "SELECT asset_id, asset_type, name FROM asset WHERE asset_id = 'NATION:7'"


# 2.3-2, 2.4-8: jobs that execute a program, in one and two hops
@q
def jobs_executing(d: D):
    return "SELECT DISTINCT job_id, program_id FROM step"


@q
def jobs_executing_callers(d: D):
    return "SELECT DISTINCT c.target_id AS program_id, s.job_id FROM call c JOIN step s ON s.program_id = c.source_id"


# 2.3-3 to 2.3-5, 2.4-9: edges by direction
@q
def program_calls(d: D):
    return "SELECT source_id, target_id, count(*) AS n, max(confidence) AS confidence FROM call WHERE source_id = 'P3' GROUP BY source_id, target_id"


@q
def program_dependencies(d: D):
    return "SELECT rel_type, target_id, count(*) AS n FROM edge WHERE source_id = 'P3' GROUP BY rel_type, target_id"


@q
def callers(d: D):
    return "SELECT DISTINCT source_id, rel_type FROM edge WHERE target_id = 'P3' AND rel_type IN ('CALLS', 'EXECUTES')"


@q
def callees_semi(d: D):
    return "SELECT p.program_id FROM program p WHERE EXISTS (SELECT 1 FROM call c WHERE c.target_id = p.program_id AND c.source_id IN ('P1', 'P2'))"


# 2.3-6, 2.4-1: relationships of an asset, both ends joined, with all predicates
@q
def relationships_for_asset(d: D):
    return """SELECT r.source_id, r.rel_type, r.target_id, s.name AS source_name, t.name AS target_name, r.confidence, r.line
        FROM relationship r JOIN asset s ON s.asset_id = r.source_id JOIN asset t ON t.asset_id = r.target_id
        WHERE (r.source_id = 'SUPPLIER:3' OR r.target_id = 'SUPPLIER:3') AND r.confidence >= 0.5E0 AND r.rel_type IN ('USES', 'LOCATED_IN')"""


# 2.3-7: first evidence of each relationship
@q
def first_evidence(d: D):
    return "SELECT source_id, target_id, min(line) AS line_start, min_by(confidence, line * 10 + confidence) AS confidence FROM relationship WHERE rel_type = 'CONTAINS' GROUP BY source_id, target_id"


# 2.3-8, 2.3-9: case-insensitive lookup, observed before placeholder
@q
def find_assets(d: D):
    return "SELECT asset_id, asset_type, name FROM asset WHERE upper(name) = upper('nation_7')"


@q
def resolve_asset(d: D):
    return """SELECT name, asset_id FROM (SELECT upper(name) AS name, asset_id, row_number() OVER (PARTITION BY upper(name) ORDER BY CASE WHEN asset_type = 'NATION' THEN 0 ELSE 1 END, asset_id) AS k
        FROM asset WHERE asset_type IN ('NATION', 'REGION')) x WHERE k = 1"""


# 2.3-10, 2.3-11: search, exact first; ranked over kinds
@q
def search_assets(d: D):
    return "SELECT asset_id, name FROM asset WHERE contains(upper(name), 'ION_1') AND asset_type IN ('NATION', 'REGION') ORDER BY CASE WHEN upper(name) = 'NATION_1' THEN 0 ELSE 1 END, name, asset_id LIMIT 10 OFFSET 2"


@q
def search_ranked(d: D):
    return """SELECT kind, id, max(score) AS score FROM (
        SELECT asset_type AS kind, asset_id AS id, CASE WHEN upper(name) = 'ASIA' THEN 100 WHEN upper(name) LIKE 'ASIA%' THEN 50 WHEN upper(name) LIKE '%IA%' THEN 10 ELSE 0 END AS score FROM asset WHERE asset_type IN ('NATION', 'REGION')
        UNION ALL SELECT 'PROGRAM', program_id, CASE WHEN program_id = 'P1' THEN 100 WHEN program_id LIKE 'P1%' THEN 50 ELSE 0 END FROM program) x
        WHERE score > 0 GROUP BY kind, id ORDER BY score DESC, kind, id LIMIT 25"""


# 2.3-12: nodes by scope (roots, others), paged
@q
def nodes_scope_roots(d: D):
    return """SELECT p.program_id, CASE WHEN c.target_id IS NULL THEN 'root' ELSE 'normal' END AS scope FROM program p
        LEFT JOIN (SELECT DISTINCT target_id FROM call WHERE status = 'confirmed' AND confidence >= 1) c ON c.target_id = p.program_id ORDER BY scope DESC, p.program_id LIMIT 20 OFFSET 1"""


# 2.3-15, 2.3-16: null-scoped corrections; insights by type
@q
def list_corrections(d: D):
    return "SELECT doc_id, quality FROM labels WHERE (toxic IS NULL OR toxic = 1) AND quality IS NOT NULL"


@q
def list_insights(d: D):
    return "SELECT event_type AS insight_type, regexp_extract(props, '\"([a-z]+)\"', 1) AS attribute, count(*) AS n FROM events GROUP BY 1, 2"


# 2.3-17 to 2.3-19: clamped requests and table filters
@q
def request_clamp(d: D):
    return "SELECT event_id, least(greatest(CAST(event_id % 20 AS INTEGER) - 5, 0), 8) AS depth, least(greatest(value / 100, 0.0E0), 1.0E0) AS conf FROM events"


@q
def table_filter(d: D):
    return "SELECT source_id, rel_type, target_id FROM edge WHERE confidence >= 0.7E0 AND rel_type IN ('CALLS', 'EXECUTES') AND contains(source_id, '1')"


# 2.4-2, 2.4-3: programs with artifact and counts
@q
def programs_overview(d: D):
    return """SELECT p.program_id, coalesce(o.n, 0) AS calls_out, coalesce(i.n, 0) AS called_by, i.n IS NULL AS is_root, r.exec_count FROM program p
        LEFT JOIN (SELECT source_id, count(*) AS n FROM call GROUP BY source_id) o ON o.source_id = p.program_id
        LEFT JOIN (SELECT target_id, count(*) AS n FROM call GROUP BY target_id) i ON i.target_id = p.program_id
        LEFT JOIN runtime r ON r.entity_id = p.program_id"""


# 2.4-4: jobs with nested ordered steps (flattened to a string to compare)
@q
def jobs_overview(d: D):
    f = "string_agg" if d.name == "duck" else "listagg"
    order = "{0}(x, '>' ORDER BY step_order)" if d.name == "duck" else "{0}(x, '>') WITHIN GROUP (ORDER BY step_order)"
    return f"SELECT job_id, count(*) AS n_steps, {order.format(f)} AS steps FROM (SELECT job_id, step_order, program_id AS x FROM step) s GROUP BY job_id"


# 2.4-5 to 2.4-7: three definitions of a root
@q
def roots_confirmed(d: D):
    return """SELECT p.program_id FROM program p LEFT JOIN (SELECT target_id, count(*) AS n FROM call WHERE status = 'confirmed' GROUP BY target_id) c ON c.target_id = p.program_id
        LEFT JOIN (SELECT program_id, count(*) AS n FROM step GROUP BY program_id) e ON e.program_id = p.program_id WHERE coalesce(c.n, 0) = 0 AND coalesce(e.n, 0) > 0"""


@q
def roots_set_algebra(d: D):
    return "SELECT program_id FROM step UNION SELECT program_id FROM access WHERE rel_type = 'WRITES' EXCEPT SELECT target_id FROM call"


@q
def root_programs(d: D):
    return """SELECT p.program_id FROM program p WHERE NOT EXISTS (SELECT 1 FROM call c WHERE c.target_id = p.program_id)
        AND (EXISTS (SELECT 1 FROM step s WHERE s.program_id = p.program_id) OR NOT EXISTS (SELECT 1 FROM edge e WHERE e.target_id = p.program_id))"""


# 2.4-10: degrees
@q
def node_degree(d: D):
    return """SELECT a.asset_id, a.asset_type, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM asset a
        LEFT JOIN (SELECT target_id, count(*) AS n FROM relationship GROUP BY target_id) i ON i.target_id = a.asset_id
        LEFT JOIN (SELECT source_id, count(*) AS n FROM relationship GROUP BY source_id) o ON o.source_id = a.asset_id"""


# 2.4-11: heat map
@q
def heatmap(d: D):
    return """SELECT sn.name AS left_name, tn.name AS right_name, count(*) AS n FROM relationship r JOIN asset sn ON sn.asset_id = r.source_id JOIN asset tn ON tn.asset_id = r.target_id
        WHERE r.rel_type = 'LOCATED_IN' AND sn.asset_type = 'SUPPLIER' GROUP BY sn.name, tn.name ORDER BY n DESC, left_name, right_name LIMIT 5000"""


# 2.4-12 to 2.4-14: statistics
@q
def stats_by_type(d: D):
    return "SELECT 'asset' AS what, asset_type AS kind, count(*) AS n FROM asset GROUP BY asset_type UNION ALL SELECT 'relationship', rel_type, count(*) FROM relationship GROUP BY rel_type"


@q
def summary(d: D):
    return "SELECT count(*) AS n, count(*) FILTER (WHERE status = 'confirmed') AS confirmed, count(*) FILTER (WHERE status = 'needs_review') AS review, count(DISTINCT source_id) AS sources FROM relationship"


@q
def issue_buckets(d: D):
    return "SELECT concat(event_type, ':', CASE WHEN value > 50 THEN 'high' ELSE 'low' END) AS bucket, count(*) AS n FROM events GROUP BY 1"


# 2.4-15, 2.4-16: telemetry and external evidence
@q
def phase_telemetry(d: D):
    return "SELECT event_type AS phase, sum(CAST(value AS DECIMAL(18, 4))) AS total, max(value) AS slowest, count(*) AS n FROM events GROUP BY event_type"


@q
def external_evidence_summary(d: D):
    return "SELECT count(*) AS n, sum(exec_count) AS calls, count(DISTINCT entity_id) AS entities FROM runtime"


# 2.4-17: enrichment coverage
@q
def enrichment_coverage(d: D):
    return f"""SELECT coalesce(CASE WHEN l.quality = 1 THEN 'materialized' WHEN l.quality = 0 THEN 'failed' END, 'pending') AS state, count(*) AS n,
        {d.ratio('count(*)', '(SELECT count(*) FROM documents)')} AS share FROM documents x LEFT JOIN labels l ON l.doc_id = x.doc_id GROUP BY 1"""


# 2.4-18 to 2.4-21: validation, worst status, run counts
@q
def validation_checks(d: D):
    return """SELECT 'confidence_range' AS check_name, count(*) FILTER (WHERE confidence < 0 OR confidence > 1) AS failures FROM relationship
        UNION ALL SELECT 'status_enum', count(*) FILTER (WHERE status NOT IN ('confirmed', 'inferred', 'needs_review')) FROM relationship
        UNION ALL SELECT 'source_exists', count(*) FROM relationship r WHERE NOT EXISTS (SELECT 1 FROM asset a WHERE a.asset_id = r.source_id)
        UNION ALL SELECT 'target_exists', count(*) FROM relationship r WHERE NOT EXISTS (SELECT 1 FROM asset a WHERE a.asset_id = r.target_id)
        UNION ALL SELECT 'line_order', count(*) FILTER (WHERE line < 0) FROM relationship
        UNION ALL SELECT 'review_visible', count(*) FROM relationship WHERE status = 'needs_review'"""


@q
def validation_status(d: D):
    return """SELECT rel_type, CASE max(CASE WHEN status = 'needs_review' THEN 2 WHEN status = 'inferred' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS worst FROM relationship GROUP BY rel_type"""


@q
def run_counts(d: D):
    return "SELECT (SELECT count(*) FROM asset) AS assets, (SELECT count(*) FROM relationship) AS relationships, (SELECT count(*) FROM documents) AS members, (SELECT count(*) FROM events WHERE event_type = 'error') AS issues"


# 2.4-22, 2.4-23: runs
@q
def diff_runs(d: D):
    return """SELECT change, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN n.sha <> o.sha THEN 'changed' ELSE 'same' END AS change
        FROM newer n FULL OUTER JOIN older o ON o.doc_id = n.doc_id) x WHERE change <> 'same' GROUP BY change"""


@q
def latest_runs(d: D):
    return "SELECT h AS run, max(event_id) AS last_event, max_by(prog, event_id) AS last_program FROM seen GROUP BY h ORDER BY run DESC LIMIT 2"


# 2.4-24, 2.4-25: runtime correlation and reconciliation; null stays unknown
@q
def runtime_correlate(d: D):
    return """SELECT coalesce(p.program_id, r.entity_id) AS entity_id, p.program_id IS NOT NULL AS in_static, r.exec_count, CASE WHEN p.program_id IS NULL THEN 'runtime_only' WHEN r.entity_id IS NULL THEN 'unknown' WHEN r.exec_count > 0 THEN 'active' ELSE 'idle' END AS status,
        CASE WHEN r.entity_id IS NULL THEN 0.5E0 ELSE 0.95E0 END AS confidence FROM (SELECT concat('P', CAST(c_custkey AS STRING)) AS program_id FROM customer WHERE c_acctbal > 0) p FULL OUTER JOIN runtime r ON r.entity_id = p.program_id"""


@q
def runtime_reconcile(d: D):
    return """SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN c.target_id IS NULL AND r.exec_count > 0 THEN 'dead_but_executed' WHEN c.target_id IS NOT NULL AND r.entity_id IS NULL THEN 'called_not_seen' WHEN r.entity_id IS NULL THEN 'unknown' ELSE 'agrees' END AS bucket
        FROM program p LEFT JOIN runtime r ON r.entity_id = p.program_id LEFT JOIN (SELECT DISTINCT target_id FROM call) c ON c.target_id = p.program_id) x GROUP BY bucket"""


# 2.4-26, 2.4-27: criticality and most depended on
@q
def runtime_criticality(d: D):
    return """SELECT entity_id, 0.5E0 * coalesce(CAST(i.n AS DOUBLE) / nullif(mi.m, 0), 0.0E0) + 0.5E0 * coalesce(CAST(r.exec_count AS DOUBLE) / nullif(mr.m, 0), 0.0E0) AS score FROM runtime r
        LEFT JOIN (SELECT target_id, count(*) AS n FROM call GROUP BY target_id) i ON i.target_id = r.entity_id
        JOIN (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM call GROUP BY target_id) z) mi ON true JOIN (SELECT max(exec_count) AS m FROM runtime) mr ON true ORDER BY score DESC, entity_id LIMIT 20"""


@q
def most_depended_on(d: D):
    return "SELECT target_id, count(*) AS n FROM edge GROUP BY target_id ORDER BY n DESC, target_id LIMIT 5"


@q
def unconfirmed_edges(d: D):
    return "SELECT status, rel_type, count(*) AS n FROM edge WHERE status <> 'confirmed' GROUP BY status, rel_type"


# 2.4-28, 2.4-29: coupling by shared resources (theta join within a resource) and calls
@q
def coupling(d: D):
    return """SELECT a, b, sum(w) AS weight FROM (
        SELECT x.program_id AS a, y.program_id AS b, 1 AS w FROM (SELECT DISTINCT program_id, tab FROM access) x JOIN (SELECT DISTINCT program_id, tab FROM access) y ON y.tab = x.tab AND x.program_id < y.program_id
        UNION ALL SELECT least(source_id, target_id), greatest(source_id, target_id), 2 FROM (SELECT DISTINCT source_id, target_id FROM call) c) z GROUP BY a, b"""


# 2.4-30: service candidates: cohesion and coupling of communities (here: shards)
@q
def service_metrics(d: D):
    return """SELECT community, count(*) AS n_edges, count(*) FILTER (WHERE inside) AS internal, CAST(count(*) FILTER (WHERE inside) AS DOUBLE) / greatest(count(*), 1) AS cohesion FROM (
        SELECT s.shard AS community, s.shard = t.shard AS inside FROM call c JOIN (SELECT DISTINCT prog, shard FROM seen) s ON s.prog = c.source_id JOIN (SELECT DISTINCT prog, shard FROM seen) t ON t.prog = c.target_id) x GROUP BY community HAVING count(*) >= 2"""


# 2.4-31: event discovery: producers and consumers of what is written
@q
def event_discovery(d: D):
    # each side is grouped first, so writers and readers of one table never multiply
    return f"""SELECT w.event_name, w.tab, w.producers, coalesce(r.consumers, '') AS consumers FROM (SELECT concat(tab, 'Written') AS event_name, tab, count(DISTINCT program_id) AS producers FROM access WHERE rel_type = 'WRITES' GROUP BY tab) w
        LEFT JOIN (SELECT tab, {d.joined('program_id')} AS consumers FROM access WHERE rel_type = 'READS' GROUP BY tab) r ON r.tab = w.tab"""


# 2.4-32: domain discovery: weighted votes of name tokens
@q
def domain_tokens(d: D):
    return f"SELECT w AS token, sum(CASE WHEN asset_type = 'PART' THEN 3 ELSE 2 END) AS score, count(DISTINCT asset_type) AS kinds FROM asset, {d.words('name')} WHERE length(w) > 2 AND asset_type IN ('PART', 'NATION', 'REGION') GROUP BY w HAVING sum(CASE WHEN asset_type = 'PART' THEN 3 ELSE 2 END) >= 3"


# 2.4-33, 2.4-35: rules by kind, and their coverage
@q
def rule_catalog(d: D):
    return f"SELECT event_type AS rule_kind, tab AS rule_id, count(DISTINCT prog) AS programs, {d.joined('prog')} AS implemented_by FROM seen GROUP BY event_type, tab"


@q
def rule_coverage(d: D):
    return "SELECT prog AS program_id, count(*) FILTER (WHERE event_type = 'error') AS rules, count(*) AS statements FROM seen GROUP BY prog"


# 2.4-34, 2.6: decision tables: the latest EVALUATE (user turn) before each WHEN (assistant turn)
@q
def decision_table(d: D):
    return f"""SELECT conv_id, turn, opened FROM (SELECT conv_id, turn, role, {d.last("CASE WHEN role = 'user' THEN turn END")} OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opened
        FROM conversations) x WHERE role = 'assistant'"""


# 2.4-36: data roll-up with directions
@q
def capability_data(d: D):
    return f"SELECT program_id, count(DISTINCT tab) AS tables, {d.joined('rel_type', '/')} AS access FROM access GROUP BY program_id"


# 2.4-37: capability score: words that begin with a key word, or the other way; distinct words and key words meet by
# equal prefixes (key words have four letters at most)
@q
def capability_score(d: D):
    return f"""WITH word AS (SELECT DISTINCT asset_id, w FROM asset, {d.words('name')} WHERE asset_type = 'PART' AND length(w) > 2), keyword AS (SELECT DISTINCT lower(substr(p_name, 1, 4)) AS k FROM part),
        hit AS (SELECT x.w, b.k FROM (SELECT DISTINCT w, substr(w, 1, n) AS head FROM word CROSS JOIN (VALUES (0), (1), (2), (3), (4)) t(n)) x JOIN keyword b ON b.k = x.head
        UNION SELECT x.w, b.k FROM (SELECT DISTINCT w FROM word) x JOIN (SELECT DISTINCT k, substr(k, 1, n) AS head FROM keyword CROSS JOIN (VALUES (3), (4)) t(n)) b ON b.head = x.w)
        SELECT a.asset_id, least(count(DISTINCT h.k) * 10, 100) AS score FROM word a JOIN hit h ON h.w = a.w GROUP BY a.asset_id"""


# 2.4-38, 2.6: the best per key, the first on ties, and its margin over the next
@q
def aggregate_candidates(d: D):
    return """SELECT target_id, source_id, n, n - coalesce(next_n, 0) AS margin FROM (SELECT target_id, source_id, n, row_number() OVER (PARTITION BY target_id ORDER BY n DESC, source_id) AS k, lead(n) OVER (PARTITION BY target_id ORDER BY n DESC, source_id) AS next_n
        FROM (SELECT target_id, source_id, count(*) AS n FROM call GROUP BY target_id, source_id) c) x WHERE k = 1"""


# 2.4-39: candidates with exactly one end in a set
@q
def boundary_edges(d: D):
    return "SELECT source_id, target_id, count(*) AS n FROM call WHERE (source_id IN ('P1', 'P2', 'P3', 'P4')) <> (target_id IN ('P1', 'P2', 'P3', 'P4')) GROUP BY source_id, target_id ORDER BY n DESC, source_id, target_id LIMIT 25"


# 2.4-40: gates
@q
def decision_gates(d: D):
    return """SELECT program_id, bool_or(g = 'calls') AS has_calls, bool_or(g = 'data') AS has_data, bool_or(g = 'job') AS has_job, bool_or(g = 'calls') AND bool_or(g = 'data') AND bool_or(g = 'job') AS open FROM (
        SELECT source_id AS program_id, 'calls' AS g FROM call UNION ALL SELECT program_id, 'data' FROM access UNION ALL SELECT program_id, 'job' FROM step) x GROUP BY program_id"""


# 2.4-41: order of a roadmap
@q
def roadmap(d: D):
    return "SELECT row_number() OVER (ORDER BY n DESC, conf, target_id) AS seq, target_id, n FROM (SELECT target_id, count(*) AS n, min(confidence) AS conf FROM call GROUP BY target_id) x"


# 2.4-42: scorecard against labels
@q
def scorecard(d: D):
    return """SELECT count(*) FILTER (WHERE e AND o) AS true_positive, count(*) FILTER (WHERE o AND NOT e) AS false_positive, count(*) FILTER (WHERE e AND NOT o) AS missed, CAST(count(*) FILTER (WHERE e AND o) AS DOUBLE) / nullif(count(*) FILTER (WHERE o), 0) AS precision_,
        CAST(count(*) FILTER (WHERE e AND o) AS DOUBLE) / nullif(count(*) FILTER (WHERE e), 0) AS recall_ FROM (SELECT l.quality = 0 AS e, d.n_chars < 400 AS o FROM labels l JOIN documents d ON d.doc_id = l.doc_id) x"""


@q
def scorecard_sets(d: D):
    return "SELECT 'missing' AS what, doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM documents WHERE n_chars > 300) a UNION ALL SELECT 'both', doc_id FROM (SELECT doc_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'de') b"


# 2.4-43: freshness of named assets
@q
def glossary_freshness(d: D):
    return f"""SELECT item_id, CASE WHEN share >= 0.8E0 THEN 'relevant' WHEN share > 0 THEN 'stale' ELSE 'obsolete' END AS state FROM (SELECT item_id, avg(CASE WHEN k.w IS NULL THEN 0.0E0 ELSE 1.0E0 END) AS share FROM (SELECT item_id, w FROM benchmark, {d.words('text')} WHERE length(w) > 3 AND w = regexp_replace(w, '[^a-z]', '')) b
        LEFT JOIN (SELECT DISTINCT w FROM documents, {d.words('text')} WHERE lang = 'en') k ON k.w = b.w GROUP BY item_id) x"""


# 2.4-44: corrections: the newest that matches wins; SUPPRESS removes
@q
def apply_corrections(d: D):
    return """SELECT a.asset_id, coalesce(c.new_name, a.name) AS name FROM asset a LEFT JOIN (SELECT n_name, max_by(concat('RENAMED ', n_name), n_nationkey) AS new_name FROM nation WHERE n_regionkey = 1 GROUP BY n_name) c ON c.n_name = a.name
        WHERE a.asset_type = 'NATION' AND NOT EXISTS (SELECT 1 FROM nation s WHERE s.n_regionkey = 3 AND s.n_name = a.name)"""


# 1.3, 2.2-2, 2.4-45: identity merge, last wins; evidence counted
@q
def merge_relationships(d: D):
    return f"""SELECT substr({d.hex1("concat(source_id, '|', rel_type, '|', target_id)")}, 1, 12) AS rel_id, max_by(status, line) AS status, max(confidence) AS confidence, count(*) AS evidence FROM edge WHERE rel_type = 'CALLS' GROUP BY source_id, rel_type, target_id"""


# 2.4-46: coverage checks in one pass, then a row each
@q
def coverage_report(d: D):
    return """WITH c AS (SELECT count(*) FILTER (WHERE rel_type = 'CALLS') AS calls, count(*) FILTER (WHERE rel_type = 'READS') AS reads, count(*) FILTER (WHERE rel_type = 'WRITES') AS writes, count(*) FILTER (WHERE status = 'needs_review') AS review FROM edge)
        SELECT 'call_contracts' AS check_name, CASE WHEN review > 0 THEN 'partial' WHEN calls > 0 THEN 'captured' ELSE 'not_observed' END AS status, CASE WHEN review > 0 THEN 0.65E0 WHEN calls > 0 THEN 0.9E0 ELSE 0.5E0 END AS confidence FROM c
        UNION ALL SELECT 'db2_sql', CASE WHEN reads > 0 AND writes > 0 THEN 'captured' WHEN reads + writes > 0 THEN 'partial' ELSE 'not_observed' END, CASE WHEN reads > 0 AND writes > 0 THEN 0.9E0 WHEN reads + writes > 0 THEN 0.65E0 ELSE 0.5E0 END FROM c"""


# 2.4-48: set-valued signals by owner
@q
def codebase_profile(d: D):
    return f"SELECT prog AS program_id, {d.joined(chr(39).join(['CASE WHEN event_type = ', 'purchase', ' THEN tab END']))} AS written, count(*) FILTER (WHERE event_type = 'click') AS n_reads, count(*) FILTER (WHERE event_type = 'purchase') AS n_writes FROM seen GROUP BY prog"


# 2.4-49, 2.4-50: cluster confidence; the best root of a component by weighted degree
@q
def cluster_confidence(d: D):
    return """SELECT s.shard, least(0.35E0 + 0.35E0 * CAST(sum(CAST(confidence AS DECIMAL(18, 4))) AS DOUBLE) / count(*) + 0.2E0 * count(*) FILTER (WHERE status = 'confirmed') / count(*) + least(count(*), 25) / 250.0E0, 0.95E0) AS confidence FROM call c JOIN (SELECT DISTINCT prog, shard FROM seen) s ON s.prog = c.source_id GROUP BY s.shard"""


@q
def best_root(d: D):
    return """SELECT shard, prog, score FROM (SELECT s.shard, s.prog, coalesce(o.n, 0) * 2 + coalesce(i.n, 0) AS score, row_number() OVER (PARTITION BY s.shard ORDER BY coalesce(o.n, 0) * 2 + coalesce(i.n, 0) DESC, s.prog) AS k FROM (SELECT DISTINCT prog, shard FROM seen) s
        LEFT JOIN (SELECT source_id, count(*) AS n FROM call GROUP BY source_id) o ON o.source_id = s.prog LEFT JOIN (SELECT target_id, count(*) AS n FROM call GROUP BY target_id) i ON i.target_id = s.prog) x WHERE k = 1"""


# 2.4-51: arguments met with linkage by position
@q
def arguments_by_position(d: D):
    return "SELECT u.conv_id, u.k, u.turn AS argument, a.turn AS linkage FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user') u JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.k = u.k"


# 2.6: previous and next rows: execution order, levels, the current section
@q
def executes_before(d: D):
    return "SELECT job_id, prev AS first_program, program_id AS then_program FROM (SELECT job_id, program_id, lag(program_id) OVER (PARTITION BY job_id ORDER BY step_order) AS prev FROM step) x WHERE prev IS NOT NULL"


@q
def group_items(d: D):
    return "SELECT conv_id, turn, coalesce(lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) > length(text), false) AS is_group FROM conversations"


@q
def current_section(d: D):
    return f"SELECT event_id, {d.last("CASE WHEN event_type = 'signup' THEN event_id END")} OVER (PARTITION BY shard, h ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM seen"


@q
def bounded_projection(d: D):
    return "SELECT source_id, target_id, line FROM (SELECT source_id, target_id, line, row_number() OVER (PARTITION BY source_id ORDER BY line, target_id) AS k FROM relationship WHERE rel_type = 'CONTAINS') x WHERE k <= 3"


# 2.1-2: profile of folders; 2.1-10: ranked candidates of a name with conflicts; 2.1-16: cache probe
@q
def folder_profile(d: D):
    return """SELECT source AS folder, max_by(lang, n * 1000 - k) AS dominant, sum(n) AS members, CAST(max(n) AS DOUBLE) / sum(n) AS share FROM (SELECT source, lang, count(*) AS n, rank() OVER (PARTITION BY source ORDER BY min(doc_id)) AS k FROM documents GROUP BY source, lang) x GROUP BY source"""


@q
def copybook_index(d: D):
    return """SELECT name, doc_id, conflict FROM (SELECT lower(substr(text, 1, 6)) AS name, doc_id, row_number() OVER (PARTITION BY lower(substr(text, 1, 6)) ORDER BY n_chars DESC, doc_id) AS k, min(sha1(text)) OVER (PARTITION BY lower(substr(text, 1, 6))) <> max(sha1(text)) OVER (PARTITION BY lower(substr(text, 1, 6))) AS conflict FROM documents) x WHERE k = 1"""


@q
def cache_probe(d: D):
    return "SELECT CASE WHEN o.sha IS NULL THEN 'miss' ELSE 'hit' END AS probe, count(*) AS n FROM newer n LEFT JOIN older o ON o.doc_id = n.doc_id AND o.sha = n.sha GROUP BY 1"


# 2.7-1 to 2.7-3: classification by signatures, the first or the best that matches
@q
def classify_first_match(d: D):
    return "SELECT page_id, CASE WHEN regexp_like(html, '<script') AND regexp_like(html, 'var t') THEN 'JOB' WHEN regexp_like(html, '(?i)<table') THEN 'TABLE' ELSE 'TEXT' END AS kind FROM pages" if d.name == "spark" else "SELECT page_id, CASE WHEN regexp_matches(html, '<script') AND regexp_matches(html, 'var t') THEN 'JOB' WHEN regexp_matches(html, '(?i)<table') THEN 'TABLE' ELSE 'TEXT' END AS kind FROM pages"


@q
def classify_max_score(d: D):
    return "SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'UNKNOWN' WHEN a >= b AND a >= c THEN 'TABLE' WHEN b >= c THEN 'SHOUT' ELSE 'SYMBOL' END AS kind FROM (SELECT doc_id, CASE WHEN contains(text, ' | ') THEN 0.98E0 ELSE 0.0E0 END AS a, CASE WHEN contains(text, '!! ') THEN 0.78E0 ELSE 0.0E0 END AS b, CASE WHEN contains(text, '*** ') THEN 0.72E0 ELSE 0.0E0 END AS c FROM documents) x"


# 2.8, 2.9: names, hashes, line numbers
@q
def stable_ids(d: D):
    return f"SELECT asset_id, substr({d.hex1(chr(39).join(['concat(asset_type, ', '|', ', upper(trim(name)))']))}, 1, 16) AS stable_id FROM asset WHERE asset_type <> 'ORDER'"


@q
def line_of_match(d: D):
    return f"SELECT doc_id, length(substr(text, 1, {d.at('text', chr(39) + '. ' + chr(39))})) - length(replace(substr(text, 1, {d.at('text', chr(39) + '. ' + chr(39))}), chr(10), '')) + 1 AS line FROM documents WHERE {d.at('text', chr(39) + '. ' + chr(39))} > 0"


# 2.10: reporting windows of the runtime feed
@q
def runtime_windows(d: D):
    return f"SELECT {d.month('ts')} AS window_label, concat('P', CAST(user_id AS STRING)) AS entity_id, count(*) AS exec_count, max(event_id) AS last_event FROM events GROUP BY 1, 2"


# 2.11: priorities of the enrichment queue
@q
def enrichment_queue(d: D):
    return "SELECT p.program_id, coalesce(g.n, 0) + CASE WHEN s.program_id IS NOT NULL THEN 10000 ELSE 0 END AS priority FROM program p LEFT JOIN (SELECT target_id, count(*) AS n FROM edge GROUP BY target_id) g ON g.target_id = p.program_id LEFT JOIN (SELECT DISTINCT program_id FROM step) s ON s.program_id = p.program_id ORDER BY priority DESC, p.program_id LIMIT 50"


#: Programs are dealt over blocks of about so many; a task holds two blocks, and a square of numbers between them.
BLOCK = 1024
#: Things are taken in turns of so many, so that what a task holds doesn't grow with what two blocks use.
THINGS = 512


def _incidence(rows: np.ndarray, things: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """1 where a program (row) uses a thing (column)."""
    out = np.zeros(shape, dtype="float32")
    out[rows, things] = 1
    return out


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, weight) between two groups of programs, a < b: one for each thing that both use, and calls.

    Rows (i, j, side, program, tabs, other, w) of one pair of groups: uses of the first (side 0) and of the second (side 1),
    and calls from program to other (side 2), the lesser name first.  Pairs come out by two blocks of programs at a time.
    """
    rows = pa.Table.from_batches(list(batches))
    same, side = rows["i"][0] == rows["j"][0], rows["side"].to_numpy()
    calls = rows.filter(pa.array(side == 2))
    ends = [calls[c].to_numpy().astype(object) for c in ("program", "other")]

    def listed(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = rows.filter(pa.array(side == k))
        tabs = pa.chunked_array(own["tabs"].chunks, own["tabs"].type).combine_chunks()
        programs = own["program"].to_numpy().astype(object)
        return programs, np.repeat(programs, tabs.value_lengths().to_numpy().astype(np.int64)), tabs.flatten().to_numpy(zero_copy_only=False).astype(object)

    uses = [listed(0)] * 2 if same else [listed(0), listed(1)]
    # an end that uses nothing is in no pair but its calls' own
    of = [np.unique(np.concatenate([uses[k][0], *(ends if same else [ends[k]])])) for k in (0, 1)]
    shared = np.intersect1d(uses[0][2], uses[1][2])
    at = []
    for k in (0, 1):
        kept = np.isin(uses[k][2], shared)
        program = np.searchsorted(of[k], uses[k][1][kept])
        order = np.argsort(program, kind="stable")
        at.append((program[order], np.searchsorted(shared, uses[k][2][kept])[order]))
    p, o, w = np.searchsorted(of[0], ends[0]), np.searchsorted(of[1], ends[1]), calls["w"].to_numpy().astype("float32")

    def part(k: int, lo: int, thing: int) -> np.ndarray:
        first, last = np.searchsorted(at[k][0], (lo, lo + BLOCK))
        program, things = at[k][0][first:last] - lo, at[k][1][first:last] - thing
        kept = (things >= 0) & (things < THINGS)
        return _incidence(program[kept], things[kept], (min(BLOCK, len(of[k]) - lo), min(THINGS, len(shared) - thing)))

    for x in range(0, len(of[0]), BLOCK):
        for y in range(x if same else 0, len(of[1]), BLOCK):
            weight = np.zeros((min(BLOCK, len(of[0]) - x), min(BLOCK, len(of[1]) - y)), dtype="float32")
            for thing in range(0, len(shared), THINGS):
                weight += part(0, x, thing) @ part(1, y, thing).T
            if same and x == y:
                weight = np.triu(weight, 1)
            mine = (p >= x) & (p < x + BLOCK) & (o >= y) & (o < y + BLOCK)
            np.add.at(weight, (p[mine] - x, o[mine] - y), w[mine])
            r, c = np.nonzero(weight)
            # names are put in by Arrow from their places in order: a pair is three numbers until then
            blocks = of[0][x : x + BLOCK], of[1][y : y + BLOCK]
            names = np.unique(np.concatenate(blocks))
            a, b = (np.searchsorted(names, n)[k] for n, k in zip(blocks, (r, c)))
            named = pa.array(names, pa.string())
            yield pa.RecordBatch.from_arrays([named.take(pa.array(np.minimum(a, b))), named.take(pa.array(np.maximum(a, b))), pa.array(weight[r, c].astype("int64"))], names=["a", "b", "weight"])


#: Blocks of a group at most: two groups meet in a task, and a program is sent once for each group.
GROUP = 16


def _groups(programs: int, tasks: int) -> int:
    """Groups of programs: of GROUP blocks, or of fewer where that would leave tasks without a pair of them."""
    return max(1, -(-programs // (GROUP * BLOCK)), min(-(-programs // BLOCK), 2 * tasks))


def coupled(spark, sf_dir) -> DataFrame:
    """coupling by blocks of programs: pairs come out of a task with their whole weight, so none is shuffled or put together.

    The answer is a row for each pair that shares anything, which is quadratic in the programs that use one thing; a task
    holds what two groups of programs use, and two blocks' pairs at a time, whatever their number.  A program goes to each
    group once, as one row with all that it uses.
    """
    access = frame(spark, sf_dir, "SELECT DISTINCT program_id AS program, tab FROM access WHERE program_id IS NOT NULL AND tab IS NOT NULL")
    calls = frame(spark, sf_dir, "SELECT least(source_id, target_id) AS program, greatest(source_id, target_id) AS other, 2 * count(*) AS w FROM (SELECT DISTINCT source_id, target_id FROM call) c GROUP BY 1, 2")
    n = _groups(access.select(F.approx_count_distinct("program")).first()[0] or 0, spark.sparkContext.defaultParallelism)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    # no nulls: texts and lists without a value cost a batch the square of its rows on the way to Python
    text = F.lit("")
    # a group's uses go to each pair of groups that it is one of
    mine = access.groupBy("program").agg(F.collect_list("tab").alias("tabs")).withColumn("m", block("program")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    uses = mine.select(F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j"), (F.col("m") > F.col("o")).cast("int").alias("side"), "program", "tabs", text.alias("other"), F.lit(0).cast("long").alias("w"))
    c, d = block("program"), block("other")
    swap = c > d
    called = calls.select(F.least(c, d).alias("i"), F.greatest(c, d).alias("j"), F.lit(2).alias("side"), F.when(swap, F.col("other")).otherwise(F.col("program")).alias("program"), F.array().cast("array<string>").alias("tabs"), F.when(swap, F.col("program")).otherwise(F.col("other")).alias("other"), F.col("w").cast("long").alias("w"))
    return uses.unionByName(called).groupBy("i", "j").applyInArrow(_block_pairs, "a string, b string, weight long")


def validated(spark, sf_dir) -> DataFrame:
    """validation_checks by two readings of the relationships: what its SQL counts by six, and its assets looked up by a join each.

    An end's counts and whether it is an asset meet by its id, in one shuffle, and nothing is sent to all.
    """
    r = frame(spark, sf_dir, "SELECT source_id, target_id, confidence, status, line FROM relationship")
    own = {
        "confidence_range": (F.col("confidence") < 0) | (F.col("confidence") > 1),
        "status_enum": ~F.col("status").isin("confirmed", "inferred", "needs_review"),
        "line_order": F.col("line") < 0,
        "review_visible": F.col("status") == "needs_review",
    }
    at_once = r.agg(*[F.count_if(v).alias(k) for k, v in own.items()])
    end = lambda c, s, t: F.struct(F.col(c).alias("id"), F.lit(s).alias("s"), F.lit(t).alias("t"))
    ends = r.select(F.explode(F.array(end("source_id", 1, 0), end("target_id", 0, 1))).alias("e")).select("e.*", F.lit(0).alias("known"))
    assets = frame(spark, sf_dir, "SELECT asset_id AS id FROM asset").select("id", F.lit(0).alias("s"), F.lit(0).alias("t"), F.lit(1).alias("known"))
    by_id = ends.unionByName(assets).groupBy("id").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.max("known").alias("known"))
    # an id that is null is no asset's
    missing = by_id.where("known = 0 OR id IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for c, k in (("s", "source_exists"), ("t", "target_exists"))])
    listed = lambda df: F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(k).cast("long").alias("failures")) for k in df.columns])).alias("c")
    return at_once.select(listed(at_once)).unionByName(missing.select(listed(missing))).select("c.check_name", "c.failures")


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: frame(spark, sf_dir, f(Spark()))) for name, f in Q.items()} | {"validation_checks": validated, "coupling": coupled}


def oracle_sql() -> dict[str, str]:
    return {name: with_(f(Duck())) for name, f in Q.items()}
