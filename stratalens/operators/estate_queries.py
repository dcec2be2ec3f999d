"""The estate's questions as queries over the projected code graph; each oracle states the answer in SQL of its own.

Questions about one program ask about the root with the most calls, those about one table about the first table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import vocabulary as V
from ..plans.projection import frame, with_
from . import assemble, extraction
from . import graph as G
from .estate_graph import Estate, group_labels

#: Kinds of relationship of the detailed graph, from the core's and the target's type.
DETAILED = {"READS": "READS_TABLE", "WRITES": "WRITES_TABLE", "USES": "USES_COPYBOOK", "STARTS": "STARTS_PROGRAM"}


def code_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection's code_rel in one pass: its four kinds of line are apart from each other, so a line is one or none."""
    line = frame(spark, sf_dir, "SELECT * FROM code_line")
    c, text = F.col, lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    program, table, sure = text("PROGRAM:P", "l_partkey"), text("TABLE:T", "l_suppkey"), F.lit("confirmed")
    calls = c("before").isNotNull() & (c("before") != c("l_partkey")) & (c("l_quantity") >= 48)
    row = lambda source, kind, target, confidence=F.lit(1.0), status=sure, method=F.lit("static"): F.struct(source.alias("source_id"), kind.alias("rel_type"), target.alias("target_id"), confidence.alias("confidence"), status.alias("status"), method.alias("method"))
    flag = lambda r, a, other: F.when(c("l_returnflag") == "R", r).when(c("l_returnflag") == "A", a).otherwise(other)
    called = row(text("PROGRAM:P", "before"), F.lit("CALLS"), program, flag(1.0, 0.7, 0.3), flag("confirmed", "inferred", "needs_review"), F.when((c("l_quantity") == 50) & (c("l_linestatus") == "O"), "cics").otherwise("static"))
    first = c("k") == 1
    one = F.when(calls, called).when(first & (c("l_quantity") <= 2), row(text("JOB:J", "l_orderkey"), F.lit("EXECUTES"), program)).when(first & (c("l_quantity") == 3), row(text("TRANSACTION:X", "l_suppkey"), F.lit("STARTS"), program))
    one = one.when(~calls & ~(first & (c("l_quantity") <= 3)), row(program, F.when(c("l_linestatus") == "O", "READS").otherwise("WRITES"), table))
    books = spark.read.parquet(f"{sf_dir}/part.parquet").select(row(text("PROGRAM:P", "p_partkey"), F.lit("USES"), F.concat(F.lit("COPYBOOK:"), F.upper("p_brand"))).alias("one"), F.lit(1).cast("long").alias("line"))
    every = line.select(one.alias("one"), (c("l_orderkey") * 10 + c("k")).cast("long").alias("line")).where("one IS NOT NULL").unionByName(books)
    return every.select("one.source_id", "one.rel_type", "one.target_id", "one.confidence", "one.status", "one.method", "line")


def estate(spark: SparkSession, sf_dir: str, detailed: bool = False) -> Estate:
    rounds = G.Rounds(spark, "projected")  # every question asks for these more than once
    # what follows from other columns is put together where it is asked for, and assets and evidence when they are
    core = rounds.write(code_relationships(spark, sf_dir))
    r = core
    if detailed:
        named = F.create_map(*[F.lit(x) for kv in DETAILED.items() for x in kv])
        r = r.withColumn("rel_type", F.coalesce(named[F.col("rel_type")], "rel_type"))
    r = r.withColumn("relationship_id", F.concat_ws("|", "source_id", "rel_type", "target_id", "line")).withColumn("path", F.lit("lineitem"))
    step = F.when(F.col("rel_type") == "EXECUTES", F.create_map(F.lit("order"), F.lit("1"), F.lit("step"), F.concat(F.lit("S"), F.col("line")))).otherwise(F.create_map().cast("map<string,string>"))
    r = r.withColumn("attributes", step)

    def made() -> DataFrame:
        a = frame(spark, sf_dir, "SELECT * FROM code_asset", code_rel=core)
        held = F.map_filter(F.create_map(F.lit("language"), F.col("language"), F.lit("line_count"), F.col("line_count").cast("string")), lambda _, v: v.isNotNull())
        return rounds.write(a.withColumn("attributes", held).drop("language", "line_count"))

    e = Estate(made, r, members=frame(spark, sf_dir, "SELECT path, length(path) AS size_bytes FROM code_asset WHERE path IS NOT NULL", code_rel=core), written=True)

    def evidence() -> DataFrame:
        of = r.where("method = 'static'").select(F.lit("RELATIONSHIP").alias("entity_kind"), F.col("relationship_id").alias("entity_id"), "path", F.col("line").alias("line_start"), (F.col("line") + F.when(F.col("status") == "inferred", -1).otherwise(1)).alias("line_end"), "confidence", "status")
        proof = e.assets.where("path IS NOT NULL").select(F.lit("ASSET").alias("entity_kind"), F.col("asset_id").alias("entity_id"), "path", F.lit(1).cast("long").alias("line_start"), F.lit(1).cast("long").alias("line_end"), "confidence", "status")
        return of.unionByName(proof)

    e._evidence = evidence
    return e


def runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "SELECT * FROM code_runtime")


def first_root(e: Estate) -> str:
    calls = e._rel("CALLS").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return e.roots().join(calls, "id", "left").orderBy(F.desc(F.coalesce("n", F.lit(0))), "id").first()["id"].split(":")[1]


def first_table(e: Estate) -> str:
    return e.relationships.where(F.col("target_id").startswith("TABLE:")).agg(F.min("target_id")).first()[0]


# Parts of the oracles.
ENTERED = "entered AS (SELECT target_id AS id FROM code_rel WHERE rel_type IN ('EXECUTES', 'STARTS') UNION SELECT source_id FROM code_rel WHERE method = 'cics')"
ROOTS = f"{ENTERED}, roots AS (SELECT id FROM entered WHERE id NOT IN (SELECT target_id FROM code_rel WHERE rel_type = 'CALLS'))"
LIVE = f"{ROOTS}, live AS (SELECT id FROM roots UNION SELECT r.target_id FROM live l JOIN code_rel r ON r.source_id = l.id AND r.rel_type IN ('EXECUTES', 'CALLS') AND r.status = 'confirmed')"
PROGRAMS = "progs AS (SELECT asset_id AS id, name FROM code_asset WHERE asset_type = 'PROGRAM' AND state = 'OBSERVED')"
DEAD = f"{LIVE}, {PROGRAMS}, dead AS (SELECT id FROM progs WHERE id NOT IN (SELECT id FROM live))"
ME = "me AS (SELECT roots.id FROM roots LEFT JOIN code_rel ON source_id = roots.id AND rel_type = 'CALLS' GROUP BY roots.id ORDER BY count(source_id) DESC, roots.id LIMIT 1)"
FIRST = f"{ROOTS}, {ME}"
TABLE = "me AS (SELECT min(asset_id) AS id FROM code_asset WHERE asset_type = 'TABLE')"


def walk(name: str, seeds: str, steps: str, depth: int) -> str:
    """CTEs name_w and name(id, dist): distances from seeds (id) over steps (x, y)."""
    return f"{name}_e AS (SELECT DISTINCT x, y FROM ({steps}) s0), {name}_w AS (SELECT id, 0 AS dist FROM ({seeds}) s1 UNION SELECT e.y, w.dist + 1 FROM {name}_w w JOIN {name}_e e ON e.x = w.id WHERE w.dist < {depth}), {name} AS (SELECT id, min(dist) AS dist FROM {name}_w GROUP BY id)"


def rel(*types: str, back: bool = False, more: str = "") -> str:
    where = f"rel_type IN ({', '.join(repr(t) for t in types)})" if types else "true"
    x, y = ("target_id", "source_id") if back else ("source_id", "target_id")
    return f"SELECT {x} AS x, {y} AS y FROM code_rel WHERE {where} {more}"


Q: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None, recursive: bool = True):
    def add(f):
        Q[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = with_(oracle, recursive=recursive)
        return f

    return add


@query(f"WITH {ROOTS} SELECT id FROM roots")
def estate_roots(spark, sf_dir):
    """2.4-6."""
    return estate(spark, sf_dir).roots()


@query("WITH a AS (SELECT asset_id AS id FROM code_asset WHERE asset_type = 'PROGRAM') SELECT id FROM a WHERE id NOT IN (SELECT target_id FROM code_rel WHERE rel_type = 'CALLS') AND (id IN (SELECT target_id FROM code_rel WHERE rel_type IN ('EXECUTES', 'STARTS')) OR id NOT IN (SELECT target_id FROM code_rel))")
def estate_root_programs(spark, sf_dir):
    """2.4-7."""
    return estate(spark, sf_dir, detailed=True).root_programs()


@query("WITH a AS (SELECT asset_id AS id FROM code_asset WHERE asset_type = 'PROGRAM') SELECT id FROM a WHERE NOT EXISTS (SELECT 1 FROM code_rel r WHERE r.target_id = a.id AND r.rel_type = 'CALLS' AND r.status = 'confirmed') AND EXISTS (SELECT 1 FROM code_rel r WHERE r.target_id = a.id AND r.rel_type IN ('EXECUTES', 'STARTS'))")
def estate_entry_points(spark, sf_dir):
    """2.4-5."""
    return estate(spark, sf_dir, detailed=True).entry_points()


@query(f"WITH {DEAD} SELECT id FROM dead")
def estate_dead_code(spark, sf_dir):
    """2.5-1, 2.5-2."""
    return estate(spark, sf_dir).dead_code()


@query(f"""WITH {DEAD} SELECT a.name AS program_id, a.language, CAST(a.line_count AS BIGINT) AS line_count, a.path, (SELECT count(*) FROM code_rel r WHERE r.rel_type = 'CALLS' AND r.source_id = a.asset_id) AS calls_out,
    (SELECT count(*) FROM code_rel r WHERE r.rel_type IN ('CALLS', 'EXECUTES') AND r.target_id = a.asset_id) AS called_by, a.asset_id IN (SELECT id FROM roots) AS is_root, a.asset_id IN (SELECT id FROM dead) AS is_dead FROM code_asset a JOIN progs p ON p.id = a.asset_id""")
def estate_programs(spark, sf_dir):
    """2.4-2, 2.4-3."""
    return estate(spark, sf_dir).programs_overview()


@query("SELECT a.name AS job_id, count(*) AS n_steps, min(substr(r.target_id, 9)) AS first_program, concat('S', CAST(min(r.line) AS VARCHAR)) AS first_step FROM code_asset a JOIN code_rel r ON r.source_id = a.asset_id AND r.rel_type = 'EXECUTES' WHERE a.asset_type = 'JOB' GROUP BY a.name")
def estate_jobs(spark, sf_dir):
    """2.4-4."""
    j = estate(spark, sf_dir).jobs_overview()
    return j.select("job_id", F.size("steps").cast("long").alias("n_steps"), F.array_min(F.transform("steps", lambda x: x["program"])).alias("first_program"), F.col("steps")[0]["step"].alias("first_step"))


@query(f"WITH {DEAD}, n AS (SELECT id FROM progs UNION SELECT asset_id FROM code_asset WHERE asset_type = 'JOB' UNION SELECT target_id FROM code_rel WHERE rel_type IN ('CALLS', 'EXECUTES')) SELECT split_part(id, ':', 1) AS asset_type, id IN (SELECT id FROM roots) AS is_root, id IN (SELECT id FROM dead) AS is_dead, count(*) AS n FROM n GROUP BY 1, 2, 3")
def estate_call_graph(spark, sf_dir):
    """2.5-7: nodes by kind."""
    return estate(spark, sf_dir).call_graph()[0].groupBy("asset_type", "is_root", "is_dead").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DEAD} SELECT (SELECT count(*) FROM code_rel) AS edges, (SELECT count(*) FROM code_rel WHERE status = 'needs_review') AS needs_review_edges, (SELECT count(*) FROM code_rel WHERE status = 'inferred') AS inferred_edges, (SELECT count(*) FROM code_rel WHERE rel_type = 'EXECUTES') AS steps, (SELECT count(*) FROM progs) AS programs, (SELECT count(*) FROM code_asset WHERE asset_type = 'JOB') AS jobs, (SELECT count(*) FROM roots) AS roots, (SELECT count(*) FROM dead) AS dead_code")
def estate_summary(spark, sf_dir):
    """2.4-13."""
    e = estate(spark, sf_dir)
    e.members = None
    return e.summary()


CLOSURE = f"{ROOTS}, {PROGRAMS}, calls AS (SELECT DISTINCT source_id AS x, target_id AS y FROM code_rel WHERE rel_type = 'CALLS' AND status = 'confirmed'), led AS (SELECT id AS root, id FROM roots UNION SELECT l.root, c.y FROM led l JOIN calls c ON c.x = l.id), ledp AS (SELECT root, id FROM led WHERE id IN (SELECT id FROM progs)), orphan AS (SELECT id FROM progs WHERE id NOT IN (SELECT id FROM ledp)), near AS (SELECT source_id AS x, target_id AS y FROM code_rel WHERE rel_type = 'CALLS' AND source_id IN (SELECT id FROM orphan) AND target_id IN (SELECT id FROM orphan)), both_ AS (SELECT x, y FROM near UNION SELECT y, x FROM near), low_ AS (SELECT id, id AS seen FROM orphan UNION SELECT l.id, b.y FROM low_ l JOIN both_ b ON b.x = l.seen), member AS (SELECT root, id, false AS rootless FROM ledp UNION ALL SELECT min(seen), id, true FROM low_ GROUP BY id)"


@query(f"WITH {CLOSURE} SELECT root, id, rootless FROM member")
def estate_capability_members(spark, sf_dir):
    """2.5-3: members of each root's closure, and of groups without a root."""
    return estate(spark, sf_dir).capability_members()


@query(f"""WITH {ROOTS}, {PROGRAMS}, c AS (SELECT DISTINCT source_id AS x, target_id AS y FROM code_rel WHERE rel_type = 'CALLS' AND status = 'confirmed'),
    w AS (SELECT id AS root, id FROM roots UNION SELECT w.root, c.y FROM w JOIN c ON c.x = w.id), m AS (SELECT root, id FROM w WHERE id IN (SELECT id FROM progs)),
    u AS (SELECT DISTINCT m.root, r.rel_type = 'USES' AS book, r.target_id FROM m JOIN code_rel r ON r.source_id = m.id AND r.rel_type IN ('READS', 'WRITES', 'USES'))
    SELECT p.root, p.n AS programs, (SELECT count(*) FROM u WHERE u.root = p.root AND NOT book) AS tables, (SELECT count(*) FROM u WHERE u.root = p.root AND book) AS copybooks FROM (SELECT root, count(*) AS n FROM m GROUP BY root) p""")
def estate_capability_sizes(spark, sf_dir):
    """2.5-3 counted: sets over the condensed graph."""
    return estate(spark, sf_dir).capability_sizes()


@query("WITH c AS (SELECT DISTINCT source_id AS x, target_id AS y FROM code_rel WHERE rel_type = 'CALLS'), w AS (SELECT x, y FROM c UNION SELECT w.x, c.y FROM w JOIN c ON c.x = w.y), m AS (SELECT a.x AS id, a.y FROM w a JOIN w b ON a.x = b.y AND a.y = b.x), r AS (SELECT id, min(y) AS ring FROM m GROUP BY id) SELECT ring, id FROM r WHERE ring IN (SELECT ring FROM r GROUP BY ring HAVING count(*) > 1)")
def estate_rings(spark, sf_dir):
    """2.5-27: programs that call each other in rings."""
    return estate(spark, sf_dir).rings()


@query(f"WITH {CLOSURE} SELECT m.root, m.rootless, CASE WHEN m.rootless THEN 0.3E0 ELSE 0.5E0 END AS confidence, count(DISTINCT m.id) AS programs, count(DISTINCT CASE WHEN r.rel_type <> 'USES' THEN r.target_id END) AS tables, count(DISTINCT CASE WHEN r.rel_type = 'USES' THEN r.target_id END) AS copybooks, CASE WHEN m.rootless THEN 0 ELSE (SELECT count(DISTINCT source_id) FROM code_rel j WHERE j.rel_type = 'EXECUTES' AND j.target_id = m.root) END AS jobs FROM member m LEFT JOIN code_rel r ON r.source_id = m.id AND r.rel_type IN ('READS', 'WRITES', 'USES') GROUP BY m.root, m.rootless")
def estate_capabilities(spark, sf_dir):
    """2.5-3, 2.4-36."""
    size = lambda c: F.size(c).cast("long").alias(c)
    return estate(spark, sf_dir).capabilities().select("root", "rootless", "confidence", size("programs"), size("tables"), size("copybooks"), size("jobs"))


@query(f"""WITH {CLOSURE}, {ME}, mine AS (SELECT member.id FROM member, me WHERE NOT rootless AND root = me.id)
    SELECT 'trigger' AS part, source_id AS id, CASE rel_type WHEN 'EXECUTES' THEN 'batch job' ELSE 'online transaction (CICS)' END AS detail FROM code_rel, me WHERE rel_type IN ('EXECUTES', 'STARTS') AND target_id = me.id
    UNION ALL SELECT 'program', m.id, coalesce(string_agg(r.target_id, ',' ORDER BY r.target_id), '') FROM mine m LEFT JOIN code_rel r ON r.source_id = m.id AND r.rel_type = 'CALLS' GROUP BY m.id
    UNION ALL SELECT 'table', target_id, string_agg(DISTINCT rel_type, ',' ORDER BY rel_type) FROM code_rel WHERE rel_type IN ('READS', 'WRITES') AND source_id IN (SELECT id FROM mine) GROUP BY target_id
    UNION ALL SELECT DISTINCT 'copybook', target_id, '' FROM code_rel WHERE rel_type = 'USES' AND source_id IN (SELECT id FROM mine)""")
def estate_capability_detail(spark, sf_dir):
    """2.5-4."""
    e = estate(spark, sf_dir)
    return e.capability_detail(first_root(e))


@query(f"WITH {FIRST}, hit AS (SELECT max(target_id) AS id FROM code_rel, me WHERE rel_type = 'CALLS' AND source_id = me.id), up AS (SELECT id FROM hit UNION SELECT c.y FROM up JOIN ({rel('CALLS', back=True)}) c ON c.x = up.id) SELECT DISTINCT source_id AS job_id FROM code_rel JOIN up ON up.id = target_id WHERE rel_type = 'EXECUTES'")
def estate_executing_jobs(spark, sf_dir):
    """2.5-5: jobs that run, however far up, what the first root calls last by name."""
    e = estate(spark, sf_dir)
    called = e.program_calls(first_root(e)).agg(F.max("target_id")).first()[0]
    return e.executing_jobs((called or "PROGRAM:NONE").split(":")[1])


@query(f"""WITH {FIRST}, {walk('d', 'SELECT id FROM me', rel('CALLS'), 8)}, {walk('u', 'SELECT id FROM me', rel('CALLS', 'EXECUTES', 'STARTS', back=True, more="AND source_id LIKE 'PROGRAM:%'"), 8)}
    SELECT DISTINCT 'down' AS direction, source_id, rel_type, target_id, d.dist + 1 AS dist, coalesce(f.dist < d.dist + 1, false) AS repeated FROM code_rel JOIN d ON d.id = source_id AND d.dist < 8 LEFT JOIN d f ON f.id = target_id
    UNION ALL SELECT DISTINCT 'up', source_id, rel_type, target_id, u.dist + 1, coalesce(f.dist < u.dist + 1, false) FROM code_rel JOIN u ON u.id = target_id AND u.dist < 8 LEFT JOIN u f ON f.id = source_id WHERE rel_type IN ('CALLS', 'EXECUTES', 'STARTS')""")
def estate_trace(spark, sf_dir):
    """2.5-6, 2.5-26."""
    e = estate(spark, sf_dir)
    return e.trace(first_root(e)).select("direction", "source_id", "rel_type", "target_id", "dist", "repeated")


def _radius(back: bool) -> str:
    """CTEs i or o(id, dist, confidence): a vertex is taken once, when its first level comes, however far away."""
    n, (x, y) = ("i", ("target_id", "source_id")) if back else ("o", ("source_id", "target_id"))
    return f"{n}_e AS (SELECT {x} AS x, {y} AS y, max(confidence) AS c FROM code_rel GROUP BY 1, 2), {n}_w(id, dist, c) USING KEY (id) AS (SELECT id, 0, 1.0E0 FROM me UNION SELECT e.y, w.dist + 1, max(least(w.c, e.c)) FROM {n}_w w JOIN {n}_e e ON e.x = w.id LEFT JOIN recurring.{n}_w s ON s.id = e.y WHERE s.id IS NULL GROUP BY e.y, w.dist), {n} AS (SELECT id, dist, c AS confidence FROM {n}_w WHERE dist > 0)"


@query(f"WITH {TABLE}, {_radius(True)}, {_radius(False)} SELECT 'impacted' AS side, id, dist, confidence, confidence < 1 AS review FROM i UNION ALL SELECT 'depends_on', id, dist, confidence, confidence < 1 FROM o")
def estate_blast_radius(spark, sf_dir):
    """2.5-8, 2.5-25: only confirmed edges have a confidence of 1 here, so a path is for review if its weakest is below."""
    e = estate(spark, sf_dir)
    return e.blast_radius(first_table(e))


DET = "CASE rel_type WHEN 'READS' THEN 'READS_TABLE' WHEN 'WRITES' THEN 'WRITES_TABLE' WHEN 'USES' THEN 'USES_COPYBOOK' WHEN 'STARTS' THEN 'STARTS_PROGRAM' ELSE rel_type END"


@query(f"WITH {TABLE}, {walk('w', 'SELECT id FROM me', rel(back=True), 8)} SELECT id, dist FROM w WHERE dist > 0")
def estate_impact(spark, sf_dir):
    """2.5-12: every kind of relationship here is a dependency; the table has no steps."""
    e = estate(spark, sf_dir, detailed=True)
    return e.impact(first_table(e).split(":")[1], "TABLE")


@query(f"WITH {FIRST}, {walk('w', 'SELECT id FROM me', rel(), 6)} SELECT id, dist FROM w WHERE dist > 0")
def estate_lineage(spark, sf_dir):
    """2.5-13."""
    e = estate(spark, sf_dir)
    return e.lineage(first_root(e), max_depth=6)


@query("WITH b AS (SELECT source_id AS x, target_id AS y FROM code_rel UNION SELECT target_id, source_id FROM code_rel), w AS (SELECT asset_id AS id, 0 AS dist FROM (SELECT min(asset_id) AS asset_id FROM code_asset) z UNION SELECT b.y, 1 FROM w JOIN b ON b.x = w.id) SELECT (SELECT count(*) FROM code_asset) AS nodes, (SELECT count(*) FROM code_rel) AS edges, (SELECT count(DISTINCT id) FROM w) > 0 AS walked")
def estate_metrics(spark, sf_dir):
    """2.5-14: nodes and edges; components are held against a plain union in the tests."""
    return estate(spark, sf_dir).metrics().select("nodes", "edges", (F.col("components") > 0).alias("walked"))


@query(f"WITH {FIRST}, {walk('w', 'SELECT id FROM me', rel('CALLS', 'EXECUTES', 'READS', 'WRITES', 'USES'), 12)} SELECT r.source_id, {DET} AS rel_type, r.target_id, w.dist, count(*) AS n FROM code_rel r JOIN w ON w.id = r.source_id AND w.dist < 12 WHERE r.rel_type <> 'STARTS' GROUP BY 1, 2, 3, 4")
def estate_driver_chain(spark, sf_dir):
    """2.5-21."""
    e = estate(spark, sf_dir, detailed=True)
    at, edges = e.root_driver_chain(first_root(e))
    return edges.join(at.withColumnRenamed("id", "source_id"), "source_id").groupBy("source_id", "rel_type", "target_id", "dist").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FIRST}, {walk('w', 'SELECT id FROM roots', f'{rel()} UNION {rel(back=True)}', 4)} SELECT id, dist FROM w")
def estate_neighbors(spark, sf_dir):
    """2.5-22: undirected distance to the nearest root, to 4."""
    e = estate(spark, sf_dir)
    return e.neighbors(e.roots())


@query("WITH s AS (SELECT entity_id, exec_count, last_run FROM code_runtime), a AS (SELECT name AS id, 'program' AS type FROM code_asset WHERE asset_type = 'PROGRAM' AND state = 'OBSERVED' UNION ALL SELECT name, lower(asset_type) FROM code_asset WHERE asset_type IN ('JOB', 'TRANSACTION')) SELECT coalesce(a.type, 'program') AS type, coalesce(a.id, s.entity_id) AS id, a.id IS NOT NULL AS in_static, s.exec_count, CASE WHEN s.exec_count > 0 THEN 'confirmed-at-runtime' WHEN s.exec_count = 0 THEN 'cold' ELSE 'unknown' END AS runtime_status, CASE WHEN s.entity_id IS NULL THEN 0.0E0 ELSE 1.0E0 END AS confidence, CASE WHEN s.exec_count IS NULL THEN 'needs_review' ELSE 'confirmed' END AS status FROM a FULL OUTER JOIN s ON s.entity_id = a.id")
def estate_correlate(spark, sf_dir):
    """2.4-24."""
    return estate(spark, sf_dir).correlate(runtime(spark, sf_dir)).drop("last_run", "avg_elapsed_ms")


@query(f"""WITH {DEAD}, s AS (SELECT entity_id, exec_count FROM code_runtime), j AS (SELECT coalesce(p.name, s.entity_id) AS program, s.exec_count, p.name IS NOT NULL AS known, coalesce(p.id IN (SELECT id FROM dead), false) AS d FROM progs p FULL OUTER JOIN s ON s.entity_id = p.name),
    b AS (SELECT CASE WHEN known AND d AND exec_count > 0 THEN 'static-dead but ran' WHEN known AND d AND exec_count = 0 THEN 'confirmed-dead' WHEN known AND NOT d AND exec_count = 0 THEN 'cold-but-reachable' WHEN NOT known AND exec_count > 0 THEN 'static-miss' END AS bucket, program, exec_count FROM j)
    SELECT bucket, program, exec_count, CASE bucket WHEN 'confirmed-dead' THEN 0.85E0 WHEN 'cold-but-reachable' THEN 0.5E0 ELSE 0.9E0 END AS confidence, CASE bucket WHEN 'confirmed-dead' THEN 'inferred' ELSE 'needs_review' END AS status, concat('PROGRAM:', program) IN (SELECT target_id FROM code_rel) AS known_target FROM b WHERE bucket IS NOT NULL""")
def estate_reconcile(spark, sf_dir):
    """2.4-25."""
    return estate(spark, sf_dir).reconcile(runtime(spark, sf_dir)).drop("last_run")


@query(G._rank_sql(50, "code_rel").replace("SELECT id, round(r, 9) AS rank FROM r50 WHERE id LIKE 'P%'", "SELECT p.name AS program, s.exec_count, round(0.5E0 * coalesce(r50.r / (SELECT max(r) FROM r50 WHERE id LIKE 'PROGRAM:%'), 0) + 0.5E0 * coalesce(CAST(s.exec_count AS DOUBLE) / (SELECT max(exec_count) FROM code_runtime), 0), 4) AS score FROM code_asset p LEFT JOIN r50 ON r50.id = p.asset_id LEFT JOIN code_runtime s ON s.entity_id = p.name WHERE p.asset_type = 'PROGRAM' AND p.state = 'OBSERVED' ORDER BY score DESC, program LIMIT 10"), recursive=False)
def estate_criticality(spark, sf_dir):
    """2.4-26, 2.5-9."""
    return estate(spark, sf_dir).criticality(runtime(spark, sf_dir)).select("program", "exec_count", F.round("score", 4).alias("score"))


WEIGHTS = "CASE asset_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.CRITICALITY.items())


@query(f"""WITH {FIRST}, {walk('u', 'SELECT id FROM me', rel(back=True), 10)}, {walk('d', 'SELECT id FROM me', rel(), 10)},
    up AS (SELECT count(*) AS n, coalesce(sum({WEIGHTS} ELSE 3 END), 0) AS s FROM u JOIN code_asset ON asset_id = id WHERE dist > 0), down AS (SELECT count(*) AS n, coalesce(sum(({WEIGHTS} ELSE 2 END) // 2), 0) AS s FROM d JOIN code_asset ON asset_id = id WHERE dist > 0),
    base AS (SELECT up.n AS blast_radius, down.n AS dependency_count, least(100, up.s + down.s) AS risk_score, greatest(0, least(100, (SELECT CAST(floor(confidence * 100) AS BIGINT) FROM code_asset, me WHERE asset_id = me.id) - least(50, up.n * 3 + down.n * 2))) AS readiness_score FROM up, down),
    broken AS (SELECT (SELECT count(*) FROM code_rel, me WHERE target_id = me.id) AS i, (SELECT count(*) FROM code_rel, me WHERE source_id = me.id) AS o, (SELECT count(*) FROM code_rel, me WHERE source_id = me.id AND rel_type IN ('READS', 'WRITES')) AS t)
    SELECT s.scenario, blast_radius, dependency_count, CAST(risk_score AS BIGINT) AS risk_score, CAST(readiness_score AS BIGINT) AS readiness_score, CASE s.scenario WHEN 'EXTRACT-SERVICE' THEN i + o WHEN 'REPLATFORM' THEN t ELSE i END AS breakages, s.k = 0 AS recommended FROM base, broken, (VALUES (0, 'MODIFY'), (1, 'RETIRE'), (2, 'EXTRACT-SERVICE'), (3, 'REPLATFORM')) s(k, scenario)""")
def estate_compare(spark, sf_dir):
    """2.5-23, 2.5-24: risk and readiness don't depend on the scenario, so the first is recommended."""
    e = estate(spark, sf_dir, detailed=True)
    return e.compare(first_root(e)).select("scenario", "blast_radius", "dependency_count", "risk_score", "readiness_score", "breakages", "recommended")


NEAR = f"{rel(more='AND confidence >= 0.7')} UNION {rel(back=True, more='AND confidence >= 0.7')}"


@query(f"WITH {FIRST}, {walk('w', 'SELECT id FROM me', NEAR, 3)}, n AS (SELECT id, dist FROM w JOIN code_asset ON asset_id = id ORDER BY dist, name, id LIMIT 60), e AS (SELECT * FROM code_rel WHERE confidence >= 0.7 AND source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)) SELECT (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM e) AS edge_count, (SELECT count(*) FROM e WHERE status <> 'confirmed') AS needs_review_edges, (SELECT count(*) FROM w JOIN code_asset ON asset_id = id) > 60 AS truncated")
def estate_slice(spark, sf_dir):
    """2.5-15: counts of a bounded slice."""
    e = estate(spark, sf_dir, detailed=True)
    return e.slice("PROGRAM:" + first_root(e), depth=3, limit=60, confidence_min=0.7)[2].select("node_count", "edge_count", "needs_review_edges", "truncated")


@query(f"WITH {FIRST}, {walk('w', 'SELECT id FROM me', f'''{rel('CALLS', 'EXECUTES', 'STARTS')} UNION {rel('CALLS', 'EXECUTES', 'STARTS', back=True)}''', 4)} SELECT id AS asset_id, dist FROM w JOIN code_asset ON asset_id = id ORDER BY dist, name, id LIMIT 1500")
def estate_call_graph_360(spark, sf_dir):
    """2.5-16: nodes of the control graph around the first root, to 4."""
    e = estate(spark, sf_dir, detailed=True)
    return e.call_graph_360("PROGRAM:" + first_root(e), depth=4)[0].select("asset_id", "dist")


@query(f"WITH {FIRST}, {walk('w', 'SELECT id FROM me', f'{rel()} UNION {rel(back=True)}', 2)}, n AS (SELECT w.id, a.* FROM w JOIN code_asset a ON a.asset_id = w.id) SELECT path, asset_id, CAST(length(path) AS INTEGER) AS size_bytes FROM n WHERE path IS NOT NULL")
def estate_required_files(spark, sf_dir):
    """2.5-17: the files of what is within two steps of the first root."""
    e = estate(spark, sf_dir, detailed=True)
    return e.required_files("PROGRAM:" + first_root(e), depth=2, limit=None)[0].select("path", "asset_id", "size_bytes")


@query()
def estate_clusters(spark, sf_dir):
    """2.5-18, 2.4-49, 2.4-50: held against a plain union-find in the tests."""
    return estate(spark, sf_dir, detailed=True).clusters()


@query(f"""WITH a AS (SELECT asset_id AS id FROM code_asset WHERE asset_type = 'PROGRAM'), roots AS (SELECT id FROM a WHERE NOT EXISTS (SELECT 1 FROM code_rel r WHERE r.target_id = a.id AND r.rel_type = 'CALLS' AND r.status = 'confirmed') AND EXISTS (SELECT 1 FROM code_rel r WHERE r.target_id = a.id AND r.rel_type IN ('EXECUTES', 'STARTS'))),
    e AS (SELECT DISTINCT x, y FROM ({rel()} UNION {rel(back=True)}) s), w AS (SELECT id AS root, id, 0 AS dist FROM roots UNION SELECT w.root, e.y, w.dist + 1 FROM w JOIN e ON e.x = w.id WHERE w.dist < 2), n AS (SELECT DISTINCT root, id, asset_type FROM w JOIN code_asset ON asset_id = id),
    u AS (SELECT s.root, count(*) AS n FROM n s JOIN code_rel r ON r.source_id = s.id AND r.status <> 'confirmed' JOIN n t ON t.root = s.root AND t.id = r.target_id GROUP BY s.root)
    SELECT n.root, count(*) AS assets, count(*) FILTER (WHERE asset_type = 'PROGRAM') AS programs, count(*) FILTER (WHERE asset_type IN ('TABLE', 'COPYBOOK')) AS data, coalesce(max(u.n), 0) AS unresolved FROM n LEFT JOIN u ON u.root = n.root GROUP BY n.root""")
def estate_root_summary(spark, sf_dir):
    """2.5-19, to depth 2 and without cut."""
    return estate(spark, sf_dir, detailed=True).root_summary(depth=2, limit=None).select("root", "assets", "programs", "data", "unresolved")


@query(f"""WITH {FIRST}, {walk('w', 'SELECT id FROM me', rel(), 2)}, r AS (SELECT {DET} AS rel_type, source_id = me.id AS own FROM code_rel JOIN w ON w.id = source_id, me),
    c AS (SELECT count(*) FILTER (WHERE own AND rel_type IN ('READS_TABLE', 'WRITES_TABLE')) AS sql_, count(*) FILTER (WHERE own AND rel_type = 'CALLS') AS calls FROM r)
    SELECT v.name AS check_name, CASE v.name WHEN 'db2_sql' THEN CASE WHEN sql_ > 0 THEN 'captured' ELSE 'not_observed' END WHEN 'call_contracts' THEN CASE WHEN calls > 0 THEN 'partial' ELSE 'not_observed' END ELSE 'not_observed' END AS status, CASE v.name WHEN 'db2_sql' THEN CASE WHEN sql_ > 0 THEN 0.9E0 ELSE 0.5E0 END WHEN 'call_contracts' THEN CASE WHEN calls > 0 THEN 0.65E0 ELSE 0.5E0 END ELSE 0.5E0 END AS confidence, CASE v.name WHEN 'db2_sql' THEN sql_ ELSE 0 END AS edges
    FROM c, (VALUES {', '.join(f"('{n}')" for n in V.CHECKS)}) v(name)""")
def estate_coverage(spark, sf_dir):
    """2.4-46, 2.5-20: the 29 checks of the first root."""
    e = estate(spark, sf_dir, detailed=True)
    return e.coverage(e._ids("PROGRAM:" + first_root(e)).withColumnRenamed("id", "asset_id")).select("check_name", "status", "confidence", "edges")


@query("""WITH f AS (SELECT 'assets_have_evidence' AS check_name, count(*) FILTER (WHERE path IS NULL) AS failures, 0 AS noted FROM code_asset UNION ALL SELECT 'relationships_have_evidence', count(*) FILTER (WHERE method <> 'static'), 0 FROM code_rel
    UNION ALL SELECT 'run_exists', 0, count(*) FROM code_asset UNION ALL SELECT 'review_items_are_visible', 0, (SELECT count(*) FILTER (WHERE status <> 'confirmed') + count(*) FILTER (WHERE state = 'UNRESOLVED') FROM code_asset) + (SELECT count(*) FILTER (WHERE status <> 'confirmed') FROM code_rel)
    UNION ALL SELECT 'confidence_gaps_are_visible', 0, (SELECT count(*) FILTER (WHERE confidence < 1) FROM code_asset) + (SELECT count(*) FILTER (WHERE confidence < 1) FROM code_rel)
    UNION ALL SELECT 'confidence_values_in_range', 0, 0 UNION ALL SELECT 'validation_status_values_allowed', 0, 0 UNION ALL SELECT 'evidence_line_ranges_valid', count(*) FILTER (WHERE status = 'inferred' AND method = 'static'), 0 FROM code_rel)
    SELECT check_name, CASE WHEN failures = 0 THEN 'passed' ELSE 'failed' END AS status, failures, noted FROM f""")
def estate_validate(spark, sf_dir):
    """2.4-18, 2.4-19: some assets and relationships have no evidence, and some evidence ends before it begins."""
    return estate(spark, sf_dir, detailed=True).validate()


@query("""WITH w AS (SELECT DISTINCT concat(upper(substr(substr(target_id, 7), 1, 1)), lower(substr(substr(target_id, 7), 2)), 'Updated') AS event_name, source_id AS producer, target_id AS payload FROM code_rel WHERE rel_type = 'WRITES')
    SELECT event_name, producer, payload, 0.68E0 AS confidence, (SELECT count(DISTINCT source_id) FROM code_rel r WHERE r.rel_type = 'READS' AND r.target_id = payload) AS consumers FROM w""")
def estate_events(spark, sf_dir):
    """2.4-31."""
    return estate(spark, sf_dir, detailed=True).events().select("event_name", "producer", "payload", "confidence", F.size("consumers").cast("long").alias("consumers"))


@query("""WITH r AS (SELECT source_id, target_id, s.language AS a, t.language AS b, rel_type FROM code_rel JOIN code_asset s ON s.asset_id = source_id AND s.asset_type = 'PROGRAM' AND s.state = 'OBSERVED' LEFT JOIN code_asset t ON t.asset_id = target_id AND t.asset_type = 'PROGRAM' AND t.state = 'OBSERVED'
      UNION ALL SELECT source_id, target_id, NULL, t.language, rel_type FROM code_rel JOIN code_asset t ON t.asset_id = target_id AND t.asset_type = 'PROGRAM' AND t.state = 'OBSERVED' WHERE source_id NOT IN (SELECT asset_id FROM code_asset WHERE asset_type = 'PROGRAM' AND state = 'OBSERVED')),
    c AS (SELECT k AS community, count(*) FILTER (WHERE a = b) AS internal, count(*) FILTER (WHERE a IS DISTINCT FROM b) AS external FROM (SELECT a, b, a AS k FROM r WHERE a IS NOT NULL UNION ALL SELECT a, b, b FROM r WHERE b IS NOT NULL AND a IS DISTINCT FROM b) x GROUP BY k),
    p AS (SELECT language AS community, count(*) AS programs FROM code_asset WHERE asset_type = 'PROGRAM' AND state = 'OBSERVED' GROUP BY language)
    SELECT community, programs, internal, external, CASE WHEN CAST(external AS DOUBLE) / greatest(internal + external, 1) > 0.55 THEN 'MODULAR_MONOLITH' ELSE 'EXTRACTABLE_SERVICE' END AS pattern FROM p JOIN c USING (community)""")
def estate_services(spark, sf_dir):
    """2.4-30: metrics of given communities (here: programs of one language)."""
    e = estate(spark, sf_dir, detailed=True)
    labels = e.programs().select(F.col("asset_id").alias("id"), F.col("attributes")["language"].alias("community"))
    return e.services(labels=labels).select("community", "programs", "internal", "external", "pattern")


@query("WITH t AS (SELECT asset_type, CASE asset_type WHEN 'TABLE' THEN 3 ELSE 2 END AS s, name FROM code_asset WHERE asset_type IN ('TABLE', 'COPYBOOK')), n AS (SELECT CASE WHEN asset_type = 'COPYBOOK' THEN split_part(name, '#', 1) WHEN length(name) >= 3 THEN name END AS entity, s FROM t), l AS (SELECT upper(language) AS entity, 1 AS s FROM code_asset WHERE length(language) >= 4) SELECT entity, CAST(sum(s) AS BIGINT) AS score FROM (SELECT entity, s FROM n WHERE entity IS NOT NULL UNION ALL SELECT entity, s FROM l) x GROUP BY entity HAVING sum(s) >= 2", recursive=False)
def estate_domains(spark, sf_dir):
    """2.4-32: entities by weighted names (brands are copybooks here, tables are numbered)."""
    return estate(spark, sf_dir).domains().select("entity", "score")


@query()
def estate_communities(spark, sf_dir):
    """2.5-10, 2.5-11: communities of programs by their calls and all that they share, with their labels; their modularity is tested."""
    found = estate(spark, sf_dir).communities()
    return found.join(group_labels(found.select("community", F.substring_index("id", ":", -1).alias("name"))), "community")


@query(
    """WITH t AS (SELECT event_id, event_type, concat('P', CAST(user_id AS VARCHAR)) AS p, concat('T', regexp_extract(props, '([0-9]+)', 1)) AS tab FROM events),
    e AS (SELECT concat('PROGRAM:E', CAST(event_id AS VARCHAR)) AS s, CASE event_type WHEN 'purchase' THEN 'WRITES' WHEN 'signup' THEN 'READS' ELSE 'CALLS' END AS rel_type, CASE event_type WHEN 'purchase' THEN concat('TABLE:', tab) WHEN 'signup' THEN concat('DATASET:', tab) WHEN 'error' THEN 'PROGRAM:WS-PGM' ELSE concat('PROGRAM:', p) END AS d,
      CASE event_type WHEN 'view' THEN 'inferred' WHEN 'error' THEN 'needs_review' ELSE 'confirmed' END AS status, CASE event_type WHEN 'view' THEN 'inference' WHEN 'error' THEN 'dynamic' WHEN 'signup' THEN 'cics' ELSE 'static' END AS method FROM t),
    j AS (SELECT DISTINCT concat('JOB:J', CAST(l_orderkey AS VARCHAR)) AS s, 'EXECUTES' AS rel_type, concat('PROGRAM:P', CAST(l_partkey AS VARCHAR)) AS d, 'confirmed' AS status, 'static' AS method FROM lineitem),
    k AS (SELECT DISTINCT concat('JOB:J', CAST(l_orderkey AS VARCHAR)) AS s, CASE l_returnflag WHEN 'R' THEN 'WRITES' WHEN 'A' THEN 'READS' ELSE 'USES' END AS rel_type, concat('DATASET:SUPP.D', CAST(l_suppkey AS VARCHAR), CASE WHEN l_linestatus = 'O' THEN '.&ENV' ELSE '' END) AS d, CASE WHEN l_linestatus = 'O' THEN 'needs_review' ELSE 'confirmed' END AS status, 'static' AS method FROM lineitem),
    r AS (SELECT * FROM e UNION ALL SELECT * FROM j UNION ALL SELECT * FROM k)
    SELECT rel_type, split_part(d, ':', 1) AS target_type, status, method, count(*) AS n, count(DISTINCT d) AS targets FROM r GROUP BY 1, 2, 3, 4""",
    recursive=False,
)
def estate_assembled(spark, sf_dir):
    """1.3, 2.4-45, 2.8-9: an estate from source members of two kinds, extracted, merged and counted."""
    cobol = extraction.programs(spark, sf_dir).withColumn("artifact_type", F.lit("cobol"))
    e = assemble.build(cobol.unionByName(extraction.jobs(spark, sf_dir).withColumn("artifact_type", F.lit("jcl"))))
    return e.relationships.groupBy("rel_type", F.substring_index("target_id", ":", 1).alias("target_type"), "status", "method").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target_id").alias("targets"))


@query(
    "WITH r AS (SELECT DISTINCT concat('PROGRAM:P', CAST(l_partkey AS VARCHAR)) AS id FROM lineitem), c AS (SELECT DISTINCT concat('PROGRAM:P', CAST(user_id AS VARCHAR)) AS id FROM events WHERE event_type IN ('click', 'view')), o AS (SELECT concat('PROGRAM:E', CAST(event_id AS VARCHAR)) AS id FROM events WHERE event_type = 'signup') SELECT id FROM r WHERE id NOT IN (SELECT id FROM c) UNION SELECT id FROM o",
    recursive=False,
)
def estate_assembled_roots(spark, sf_dir):
    """2.4-6 from source members on."""
    cobol = extraction.programs(spark, sf_dir).withColumn("artifact_type", F.lit("cobol"))
    return assemble.build(cobol.unionByName(extraction.jobs(spark, sf_dir).withColumn("artifact_type", F.lit("jcl")))).roots()


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
