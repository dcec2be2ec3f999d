"""One estate as a graph: questions with parameters, each answered by a DataFrame.

Estate holds three frames, of one run:

  assets         asset_id, asset_type, name, state (OBSERVED, or UNRESOLVED for a name without a source), confidence,
                 status, path, attributes (map of strings)
  relationships  relationship_id, source_id, rel_type, target_id, confidence, status, method, path, line, attributes
  evidence       entity_kind (ASSET, RELATIONSHIP), entity_id, path, line_start, line_end, confidence, status

and members (path, sha256, size_bytes, artifact_type, ...), if they are known.  Ids are `TYPE:NAME`.  A relationship's
source depends on its target.  Traversals are breadth-first, so a depth limit never loses a shorter way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans import vocabulary as V
from . import condense
from . import graph as G

RISKY = ("inferred", "needs_review")


def asset_id(kind: str, name: str) -> str:
    return f"{kind.upper()}:{name.upper().strip()}"


def name_words(name: Column) -> Column:
    """The words that parts of a program's name stand for, in order of place; the name itself if there are none."""
    found = F.array(*[F.struct(F.instr(name, part).alias("at"), F.lit(word).alias("word")) for part, word in V.NAME_WORDS.items()])
    words = F.array_distinct(F.transform(F.array_sort(F.filter(found, lambda x: x["at"] > 0)), lambda x: x["word"]))
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(name)


def group_labels(members: DataFrame) -> DataFrame:
    """(community, label) of members (community, name): the two words that most names' parts stand for."""
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(part).alias("part"), F.lit(word).alias("word")) for k, (part, word) in enumerate(V.NAME_WORDS.items())])
    hits = members.select("community", "name", F.explode(F.filter(parts, lambda p: F.instr("name", p["part"]) > 0)).alias("p"))
    counted = hits.groupBy("community", F.col("p.word").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("name", "p.k")).alias("first"))
    top = counted.withColumn("k", F.row_number().over(W.partitionBy("community").orderBy(F.desc("n"), "first"))).where("k <= 2")
    named = top.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " / ").alias("label"))
    return members.select("community").distinct().join(named, "community", "left").select("community", F.coalesce("label", F.lit("Unlabeled")).alias("label"))


class Estate:
    """Assets and evidence may be given as functions, which are called once, when a question asks for them.

    written: relationships lie in files, so that reading them again costs no more than reading a copy of them.
    """

    def __init__(self, assets: DataFrame | Callable[[], DataFrame], relationships: DataFrame, evidence: DataFrame | Callable[[], DataFrame] | None = None, members: DataFrame | None = None, written: bool = False):
        self.spark, self._assets, self.relationships, self._evidence, self.members, self.written = relationships.sparkSession, assets, relationships, evidence, members, written

    def _reached(self, edges: DataFrame, seeds: DataFrame, **how) -> DataFrame:
        """reached() over edges that are some of the relationships."""
        return G.reached(edges, seeds, held=self.written, **how)

    @property
    def assets(self) -> DataFrame:
        self._assets = self._assets() if callable(self._assets) else self._assets
        return self._assets

    @assets.setter
    def assets(self, given: DataFrame | Callable[[], DataFrame]) -> None:
        self._assets = given

    @property
    def evidence(self) -> DataFrame | None:
        self._evidence = self._evidence() if callable(self._evidence) else self._evidence
        return self._evidence

    # --- parts -------------------------------------------------------------------------------------------------------
    def _ids(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def _rel(self, *types: str, confirmed: bool = False) -> DataFrame:
        found = self.relationships.where(F.col("rel_type").isin(*types)) if types else self.relationships
        return found.where("status = 'confirmed'") if confirmed else found

    def _of(self, kind: str) -> DataFrame:
        return self.assets.where(F.col("asset_type") == kind)

    def programs(self) -> DataFrame:
        """Programs that have a source."""
        return self._of("PROGRAM").where("state = 'OBSERVED'")

    def named(self, ids: DataFrame, column: str = "id") -> DataFrame:
        """ids with the type and name of each."""
        return ids.join(self.assets.select(F.col("asset_id").alias(column), "asset_type", "name"), column, "left")

    # --- lookups -----------------------------------------------------------------------------------------------------
    def find(self, name: str, kind: str | None = None) -> DataFrame:
        """Assets of a name, whatever its case: those with a source before placeholders."""
        found = self.assets.where(F.upper("name") == name.upper().strip())
        return (found.where(F.col("asset_type") == kind.upper()) if kind else found).orderBy(F.col("state") != "OBSERVED", "asset_type", "asset_id")

    def resolve(self, name: str, kind: str | None = None) -> str:
        got = self.find(name, kind).select("asset_id").first()
        if got is None:
            raise KeyError(f"asset not found: {name}")
        return got[0]

    def jobs_executing(self, program: str) -> DataFrame:
        return self._rel("EXECUTES").where(F.col("target_id") == asset_id("PROGRAM", program)).select(F.col("source_id").alias("job_id")).distinct()

    def program_calls(self, program: str) -> DataFrame:
        return self._rel("CALLS").where(F.col("source_id") == asset_id("PROGRAM", program)).select("target_id", "confidence", "status", "method", "path", "line")

    def program_dependencies(self, program: str) -> DataFrame:
        return self.relationships.where(F.col("source_id") == asset_id("PROGRAM", program)).select("rel_type", "target_id", "confidence", "status", "path", "line")

    def callers(self, program: str) -> DataFrame:
        return self._rel("CALLS", "EXECUTES").where(F.col("target_id") == asset_id("PROGRAM", program)).select("source_id", "rel_type", "confidence", "status")

    def relationships_of(self, asset: str, direction: str = "both", types: Iterable[str] = (), confidence_min: float = 0.0, limit: int = 500) -> DataFrame:
        """An asset's relationships with both ends' names, the surest first; limit: 5,000 at most."""
        out, into = F.col("source_id") == asset, F.col("target_id") == asset
        found = self._rel(*[t.upper() for t in types]).where({"out": out, "in": into}.get(direction, out | into)).where(F.col("confidence") >= confidence_min)
        a = self.assets.select("asset_id", "asset_type", "name")
        s, t = (a.toDF(f"{end}_id", f"{end}_type", f"{end}_name") for end in ("source", "target"))
        return found.join(s, "source_id").join(t, "target_id").orderBy(F.desc("confidence"), "rel_type", "source_name", "target_name", "relationship_id").limit(min(max(limit, 1), 5000))

    def first_evidence(self, types: Iterable[str] = ()) -> DataFrame:
        """Relationships with path, line_start and line_end of their first evidence."""
        first = self.evidence.where("entity_kind = 'RELATIONSHIP'").groupBy(F.col("entity_id").alias("relationship_id")).agg(F.min(F.struct("line_start", "path", "line_end")).alias("e"))
        return self._rel(*types).drop("path", "line").join(first, "relationship_id", "left").select("relationship_id", "source_id", "rel_type", "target_id", "confidence", "status", F.col("e.path").alias("path"), F.col("e.line_start").alias("line_start"), F.col("e.line_end").alias("line_end"))

    def evidence_for(self, kind: str, entity: str) -> DataFrame:
        return self.evidence.where((F.col("entity_kind") == kind) & (F.col("entity_id") == entity)).orderBy("path", "line_start")

    def search(self, text: str, limit: int = 25) -> DataFrame:
        """(kind, id, score): a name that is the text 100, that begins with it 50, that holds it 10."""
        q = F.lit(text.upper().strip())
        score = F.when(F.upper("name") == q, 100).when(F.upper("name").startswith(q), 50).when(F.upper("name").contains(q), 10).otherwise(0)
        return self.assets.groupBy(F.col("asset_type").alias("kind"), F.col("name").alias("id")).agg(F.max(score).alias("score")).where("score > 0").orderBy(F.desc("score"), "kind", "id").limit(limit)

    def nodes(self, scope: str = "all", text: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
        """Assets by scope (all, roots, programs that are no roots, or a type), by name; a page of them."""
        found = self.assets
        if scope in ("roots", "normal_programs"):
            found = found.where("asset_type = 'PROGRAM'").join(self.entry_points().select(F.col("id").alias("asset_id")), "asset_id", "left_semi" if scope == "roots" else "left_anti")
        elif scope != "all":
            found = found.where(F.col("asset_type") == scope.upper())
        return found.where(F.upper("name").contains(text.upper())).orderBy("name", "asset_id").offset(offset).limit(limit)

    # --- roots, dead code, overviews ---------------------------------------------------------------------------------
    def roots(self) -> DataFrame:
        """(id) of programs that a job executes, a transaction starts or that issue online commands, and nothing calls."""
        entered = self._rel("EXECUTES", "STARTS").where(F.col("target_id").startswith("PROGRAM:")).select(F.col("target_id").alias("id"))
        online = self.relationships.where("method = 'cics'").select(F.col("source_id").alias("id"))
        return entered.union(online).distinct().join(self._rel("CALLS").select(F.col("target_id").alias("id")).distinct(), "id", "left_anti")

    def root_programs(self) -> DataFrame:
        """(id) of programs that nothing calls, and that are entered or that nothing points to at all."""
        into = self.relationships.groupBy(F.col("target_id").alias("id")).agg(F.bool_or(F.col("rel_type") == "CALLS").alias("called"), F.bool_or(F.col("rel_type").isin("EXECUTES", "STARTS_PROGRAM", "TRIGGERS")).alias("entered"))
        return self._of("PROGRAM").select(F.col("asset_id").alias("id")).join(into, "id", "left").where("called IS NULL OR (NOT called AND entered)").select("id")

    def entry_points(self) -> DataFrame:
        """(id) of programs that are entered and that no confirmed call reaches."""
        into = self.relationships.groupBy(F.col("target_id").alias("id")).agg(
            F.count_if(F.col("rel_type").isin("CALLS", "DYNAMIC_CALL", "OBSERVED_CALLS") & (F.col("status") == "confirmed")).alias("callers"), F.count_if(F.col("rel_type").isin("EXECUTES", "STARTS_PROGRAM", "TRIGGERS")).alias("entries"))
        return self._of("PROGRAM").select(F.col("asset_id").alias("id")).join(into, "id").where("callers = 0 AND entries > 0").select("id")

    def dead_code(self) -> DataFrame:
        """(id) of programs that no root reaches over confirmed executions and calls."""
        live = self._reached(self._rel("EXECUTES", "CALLS", confirmed=True), self.roots())
        return self.programs().select(F.col("asset_id").alias("id")).join(live.select("id"), "id", "left_anti")

    def _flagged(self, ids: DataFrame) -> DataFrame:
        """ids with is_root and is_dead."""
        flag = lambda df, name: df.select("id", F.lit(True).alias(name))
        return ids.join(flag(self.roots(), "is_root"), "id", "left").join(flag(self.dead_code(), "is_dead"), "id", "left").withColumn("is_root", F.coalesce("is_root", F.lit(False))).withColumn("is_dead", F.coalesce("is_dead", F.lit(False)))

    def programs_overview(self) -> DataFrame:
        """Each program with its language, lines, path, calls out and in, and whether it is a root or dead."""
        p = self.programs().select(F.col("asset_id").alias("id"), "name", "attributes", "path")
        out = self._rel("CALLS").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("calls_out"))
        into = self._rel("CALLS", "EXECUTES").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("called_by"))
        both = self._flagged(p.join(out, "id", "left").join(into, "id", "left"))
        return both.select(F.col("name").alias("program_id"), F.col("attributes")["language"].alias("language"), F.col("attributes")["line_count"].cast("long").alias("line_count"), "path", F.coalesce("calls_out", F.lit(0)).alias("calls_out"), F.coalesce("called_by", F.lit(0)).alias("called_by"), "is_root", "is_dead")

    def jobs_overview(self) -> DataFrame:
        """Each job with its steps (step, program) in order."""
        step = F.struct(F.col("attributes")["order"].cast("long").alias("k"), F.col("attributes")["step"].alias("step"), F.substring_index("target_id", ":", -1).alias("program"))
        held = self._rel("EXECUTES").groupBy(F.col("source_id").alias("asset_id")).agg(F.array_sort(F.collect_list(step)).alias("s"))
        return self._of("JOB").join(held, "asset_id", "left").select(F.col("name").alias("job_id"), F.coalesce(F.transform("s", lambda x: F.struct(x["step"].alias("step"), x["program"].alias("program"))), F.array().cast("array<struct<step:string,program:string>>")).alias("steps"))

    def call_graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes (id, asset_type, is_root, is_dead) and edges of calls and executions; targets without a source stay."""
        edges = self._rel("CALLS", "EXECUTES").select("source_id", "target_id", "rel_type", "status", "confidence", "path", "line", "method")
        own = self.programs().select(F.col("asset_id").alias("id")).union(self._of("JOB").select("asset_id")).union(edges.select("target_id")).distinct()
        return self._flagged(own).withColumn("asset_type", F.substring_index("id", ":", 1)), edges

    def summary(self) -> DataFrame:
        """One row: members, programs, jobs, steps, edges, edges by status, roots and dead programs."""
        r = self.relationships.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("status") == "needs_review").alias("needs_review_edges"), F.count_if(F.col("status") == "inferred").alias("inferred_edges"), F.count_if(F.col("rel_type") == "EXECUTES").alias("steps"))
        a = self.assets.agg(F.count_if((F.col("asset_type") == "PROGRAM") & (F.col("state") == "OBSERVED")).alias("programs"), F.count_if(F.col("asset_type") == "JOB").alias("jobs"))
        one = r.crossJoin(a).crossJoin(self.roots().agg(F.count(F.lit(1)).alias("roots"))).crossJoin(self.dead_code().agg(F.count(F.lit(1)).alias("dead_code")))
        if self.members is None:
            return one
        kinds = self.members.groupBy("artifact_type").agg(F.count(F.lit(1)).alias("n"))
        return one.crossJoin(kinds.agg(F.sum("n").alias("artifacts"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("artifact_type", "n")))).alias("by_type")))

    def insights(self) -> tuple[DataFrame, DataFrame]:
        """The five programs called most, and the edges of calls and executions that aren't confirmed."""
        most = self._rel("CALLS").groupBy("target_id").agg(F.count(F.lit(1)).alias("called_by")).orderBy(F.desc("called_by"), "target_id").limit(5)
        return most, self._rel("CALLS", "EXECUTES").where("status <> 'confirmed'").select("source_id", "target_id", "rel_type", "status")

    # --- capabilities ------------------------------------------------------------------------------------------------
    def capability_members(self) -> DataFrame:
        """(root, id, rootless): programs that each root reaches over confirmed calls; the others by groups that call each other.

        A row for each root and program that it reaches, which is the answer's own size.
        """
        have = self.programs().select(F.col("asset_id").alias("id"))
        calls = self._rel("CALLS", confirmed=True)
        rounds = G.Rounds(self.spark, "led")
        # written once each, and not sent to all: a table hashed by names takes a page of 64 MB
        led = rounds.write(G.bfs(G.best_edges(calls), self.roots()).join(have, "id", "left_semi").select("root", "id")).shuffled
        orphans = rounds.write(have.join(led.select("id").distinct().hint("merge"), "id", "left_anti")).shuffled
        near = self._rel("CALLS").select("source_id", "target_id").join(orphans.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(orphans.select(F.col("id").alias("target_id")), "target_id", "left_semi")
        grouped = orphans.join(G.components(near), "id", "left").select(F.coalesce("component", "id").alias("root"), "id")
        return led.withColumn("rootless", F.lit(False)).unionByName(grouped.withColumn("rootless", F.lit(True)))

    def capability_sizes(self) -> DataFrame:
        """(root, programs, tables, copybooks): how many each root's capability holds, without a row for each member.

        Counts are those of capability_members() of roots, and of what these use, by sets over the condensed graph.
        """
        have = self.programs().select(F.col("asset_id").alias("id"))
        use = self._rel("READS", "WRITES", "USES").select(F.col("source_id").alias("id"), F.when(F.col("rel_type") == "USES", "copybooks").otherwise("tables").alias("kind"), F.col("target_id").alias("item"))
        held = have.select("id", F.lit("programs").alias("kind"), F.col("id").alias("item")).unionByName(use.join(have, "id", "left_semi"))
        got = condense.reach_counts(self._rel("CALLS", confirmed=True), held, self.roots())
        kinds = ("programs", "tables", "copybooks")
        counts = got.groupBy("root").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("long").alias(k) for k in kinds])
        return counts.where("programs > 0")

    def rings(self) -> DataFrame:
        """(ring, id) of programs that call each other in a ring, however long; ring is the least of them."""
        at = condense.strong_components(self._rel("CALLS"))
        many = at.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return at.join(many, "component", "left_semi").select(F.col("component").alias("ring"), "id")

    def capabilities(self) -> DataFrame:
        """A row for each capability: label, root, rootless, confidence, jobs, programs, tables, copybooks."""
        m = self.capability_members()
        use = self._rel("READS", "WRITES", "USES").select(F.col("source_id").alias("id"), F.when(F.col("rel_type") == "USES", "copybook").otherwise("table").alias("kind"), "target_id").distinct()
        data = m.join(use, "id").groupBy("root").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("target_id")))).alias(f"{k}s") for k in ("table", "copybook")])
        jobs = self._rel("EXECUTES").groupBy(F.col("target_id").alias("root")).agg(F.array_sort(F.collect_set("source_id")).alias("jobs"))
        none = F.array().cast("array<string>")
        held = m.groupBy("root", "rootless").agg(F.array_sort(F.collect_list("id")).alias("programs")).join(data, "root", "left").join(jobs, "root", "left")
        return held.select(name_words(F.substring_index("root", ":", -1)).alias("capability"), "root", "rootless", F.when(F.col("rootless"), 0.3).otherwise(0.5).alias("confidence"), F.lit("inferred").alias("status"), F.when(F.col("rootless"), none).otherwise(F.coalesce("jobs", none)).alias("jobs"), "programs", F.coalesce("tables", none).alias("tables"), F.coalesce("copybooks", none).alias("copybooks"))

    def capability_detail(self, name: str) -> DataFrame:
        """(part, id, detail) of the first capability of a label or a root's name: triggers, programs with their calls, tables with access, copybooks."""
        key = F.lit(name.strip().lower())
        own = self.capabilities().where((F.lower("capability") == key) | (F.lower(F.substring_index("root", ":", -1)) == key)).orderBy("rootless", "root").limit(1)
        own = G.Rounds(self.spark, "capability").write(own)
        m = own.select("root", F.explode("programs").alias("id"))
        calls = self._rel("CALLS").groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("target_id")), ",").alias("detail"))
        use = m.join(self._rel("READS", "WRITES", "USES").withColumnRenamed("source_id", "id"), "id")
        row = lambda df, part, i, d: df.select(F.lit(part).alias("part"), F.col(i).alias("id"), d.alias("detail"))
        parts = [
            row(own.select(F.explode("jobs").alias("j")), "trigger", "j", F.lit("batch job")),
            row(own.select("root").join(self._rel("STARTS"), F.col("root") == F.col("target_id")), "trigger", "source_id", F.lit("online transaction (CICS)")),
            row(m.join(calls, "id", "left"), "program", "id", F.coalesce("detail", F.lit(""))),
            use.where("rel_type <> 'USES'").groupBy(F.col("target_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("rel_type")), ",").alias("detail")).select(F.lit("table").alias("part"), "id", "detail"),
            use.where("rel_type = 'USES'").select(F.lit("copybook").alias("part"), F.col("target_id").alias("id"), F.lit("").alias("detail")).distinct(),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def executing_jobs(self, program: str) -> DataFrame:
        """(job_id) that execute a program or a caller of it, however far up."""
        up = self._reached(self._rel("CALLS"), self._ids(asset_id("PROGRAM", program)), reverse=True)
        return self._rel("EXECUTES").join(up.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("job_id")).distinct()

    def program_profile(self, program: str) -> DataFrame:
        """One row: what a program is, needs and is needed by, the jobs that run it and its capability."""
        own = asset_id("PROGRAM", program)
        listed = lambda df, *c: df.agg(F.array_sort(F.collect_set(F.struct(*c) if len(c) > 1 else F.col(c[0]))))
        one = self._of("PROGRAM").where(F.col("asset_id") == own).select(F.col("name").alias("program_id"), F.col("attributes")["language"].alias("language"), F.col("attributes")["line_count"].cast("long").alias("line_count"), "path")
        cap = self.capabilities().where(F.array_contains("programs", own)).agg(F.min_by("capability", F.struct("rootless", "root")).alias("capability"))
        return one.crossJoin(listed(self.program_dependencies(program), "rel_type", "target_id").toDF("dependencies")).crossJoin(listed(self.callers(program), "rel_type", "source_id").toDF("callers")).crossJoin(listed(self.jobs_executing(program), "job_id").toDF("direct_jobs")).crossJoin(listed(self.executing_jobs(program), "job_id").toDF("executing_jobs")).crossJoin(cap)

    # --- traces and impact -------------------------------------------------------------------------------------------
    def trace(self, program: str, direction: str = "both", depth: int = 8, include_data: bool = True) -> DataFrame:
        """(direction, source_id, rel_type, target_id, dist, repeated, confidence, status, method, path, line): each edge of the trace once.

        Down: calls go on, executions, starts and data are leaves.  Up: control alone, and only programs go on.  dist is
        the distance of the end further from the program; repeated: that end is nearer by another way.
        """
        own = asset_id("PROGRAM", program)
        types = (*V.TRACE_CONTROL, *(V.TRACE_DATA if include_data else ()))
        keys = ["source_id", "rel_type", "target_id"]
        one = self._rel(*types).groupBy(*keys).agg(F.min_by(F.struct("confidence", "status", "method", "path", "line"), F.struct("path", "line", "relationship_id")).alias("e"))
        out = None
        for side, wanted in (("down", direction in ("both", "down")), ("up", direction in ("both", "up"))):
            if not wanted:
                continue
            near, far = ("source_id", "target_id") if side == "down" else ("target_id", "source_id")
            goes_on = self._rel("CALLS") if side == "down" else self._rel(*V.TRACE_CONTROL).where(F.col("source_id").startswith("PROGRAM:"))
            at = self._reached(goes_on, self._ids(own), reverse=side == "up", depth=depth)
            from_ = at.where(F.col("dist") < depth).select(F.col("id").alias(near), (F.col("dist") + 1).alias("dist"))
            edges = (one if side == "down" else one.where(F.col("rel_type").isin(*V.TRACE_CONTROL))).join(from_, near)
            first = edges.join(at.select(F.col("id").alias(far), F.col("dist").alias("first")), far, "left")
            got = first.select(F.lit(side).alias("direction"), *keys, "dist", F.coalesce(F.col("first") < F.col("dist"), F.lit(False)).alias("repeated"), "e.*")
            out = got if out is None else out.unionByName(got)
        return out

    def trace_nodes(self, trace: DataFrame, program: str) -> DataFrame:
        """(id, asset_type, name) of a trace's nodes, the program itself among them."""
        ids = trace.select(F.col("source_id").alias("id")).union(trace.select("target_id")).union(self._ids(asset_id("PROGRAM", program))).distinct()
        return ids.select("id", F.substring_index("id", ":", 1).alias("asset_type"), F.substring_index("id", ":", -1).alias("name"))

    @staticmethod
    def trace_stats(trace: DataFrame) -> DataFrame:
        """One row: edges, unresolved ones, tables read and written."""
        table = lambda rel: F.array_sort(F.collect_set(F.when(F.col("rel_type") == rel, F.col("target_id"))))
        return trace.agg(F.count(F.lit(1)).alias("edge_count"), F.count_if(F.col("status") != "confirmed").alias("unresolved_count"), table("READS").alias("reads"), table("WRITES").alias("writes"))

    def blast_radius(self, target: str) -> DataFrame:
        """(side, id, dist, confidence, review): what a change to target reaches (impacted), and what target depends on."""
        best = G.best_edges(self.relationships)
        side = lambda name, reverse: G.bfs(best, self._ids(target), reverse=reverse).where("dist > 0").select(F.lit(name).alias("side"), "id", "dist", "confidence", "review")
        return side("impacted", True).unionByName(side("depends_on", False))

    @staticmethod
    def blast_score(radius: DataFrame) -> DataFrame:
        """One row: the confidence-weighted reach, and how many impacted need review."""
        hit = F.col("side") == "impacted"
        return radius.agg(F.round(F.coalesce(F.sum(F.when(hit, F.col("confidence"))), F.lit(0.0)), 2).alias("blast_radius_score"), F.count_if(hit).alias("impacted"), F.count_if(~hit).alias("depends_on"), F.count_if(hit & F.col("review")).alias("review"))

    def impact(self, name: str, kind: str | None = None, max_depth: int = 8, types: Iterable[str] = V.IMPACT) -> DataFrame:
        """(id, dist): dependents over dependency relationships, and the steps that a container on the way owns."""
        back = self._rel(*types).select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
        owned = self._rel("CONTAINS_STEP").select("source_id", "target_id")
        return self._reached(back.union(owned), self._ids(self.resolve(name, kind)), depth=max_depth).where("dist > 0")

    def lineage(self, name: str, direction: str = "downstream", max_depth: int = 8) -> DataFrame:
        return self._reached(self.relationships, self._ids(self.resolve(name)), reverse=direction.lower() == "upstream", depth=max_depth).where("dist > 0")

    def metrics(self) -> DataFrame:
        """One row: nodes, edges (parallel ones count) and weakly connected components, lone nodes among them."""
        joined = G.components(self.relationships.select("source_id", "target_id"))
        parts = joined.agg(F.count_distinct("component").alias("c"), F.count(F.lit(1)).alias("n"))
        return self.assets.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(self.relationships.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(parts).select("nodes", "edges", (F.col("c") + F.col("nodes") - F.col("n")).alias("components"))

    def root_driver_chain(self, root: str, max_depth: int = 12, types: Iterable[str] = V.CHAIN) -> tuple[DataFrame, DataFrame]:
        """Assets (id, dist) that a driver reaches, and every relationship that leaves one of them above the depth."""
        held = self._rel(*types)
        at = self._reached(held, self._ids(self.resolve(root)), depth=max_depth)
        return at, held.join(at.where(F.col("dist") < max_depth).select(F.col("id").alias("source_id")), "source_id", "left_semi")

    def neighbors(self, seeds: DataFrame, max_depth: int = 4) -> DataFrame:
        """(id, dist): the distance to the nearest seed (id), relationships taken in either direction."""
        ends = self.relationships.select("source_id", "target_id")
        return self._reached(ends, seeds, depth=max_depth, both=True)

    def capability_search(self, capability: str, max_depth: int = 4) -> DataFrame:
        """(asset_id, score): 10 for each key word that a token begins with or that begins with a token, 25 for the phrase, else 12 / distance.

        Tokens and key words meet by equal beginnings; key words are few (those of a question).
        """
        said = set(filter(None, "".join(c if c.isalnum() else " " for c in capability.upper()).split()))
        words = said | {a for w in said for a in V.ABBREVIATIONS.get(w, ())}
        plain = capability.lower().strip()
        for name, keys in V.CAPABILITY_WORDS.items():
            if plain in name or name in plain or said & set(keys):
                words |= set(keys)
        text = F.concat_ws(" ", "name", F.array_join(F.map_values("attributes"), " "))
        tokens = F.array_distinct(F.filter(F.split(F.upper(text), "[^A-Z0-9]+"), lambda t: t != ""))
        met = lambda w: F.exists(tokens, lambda t: t.startswith(w) | F.lit(w).startswith(t)).cast("int")
        hits = sum(map(met, sorted(words)), F.lit(0))
        phrase = F.regexp_replace(F.lower(text), "[-_]", "").contains(plain.replace(" ", "")) if plain else F.lit(False)
        own = self.assets.select("asset_id", (hits * 10 + F.when(phrase, 25).otherwise(0)).cast("double").alias("score")).where("score > 0")
        near = self.neighbors(own.select(F.col("asset_id").alias("id")), max_depth).where("dist > 0").select(F.col("id").alias("asset_id"), F.greatest(F.lit(1.0), 12.0 / F.col("dist")).alias("score"))
        return own.unionByName(near).select("asset_id", F.round(F.least("score", F.lit(100.0)), 2).alias("score"))

    # --- ranks and communities ---------------------------------------------------------------------------------------
    def centrality(self, top: int = 10, turns: int = 50) -> DataFrame:
        """(program, rank): PageRank over calls and executions, programs alone."""
        got = G.pagerank(self._rel("CALLS", "EXECUTES"), turns).where(F.col("id").startswith("PROGRAM:"))
        return got.select(F.col("id").alias("program"), "rank").orderBy(F.desc("rank"), "program").limit(top)

    def calls_and_uses(self, call: int = 2, types: Iterable[str] = ("USES", "READS", "WRITES")) -> tuple[DataFrame, DataFrame]:
        """(a, b, w) of calls between programs, and (id, resource) of what programs use."""
        p = self.programs().select(F.col("asset_id").alias("id"))
        own = lambda df, c: df.join(p.select(F.col("id").alias(c)), c, "left_semi")
        calls = own(own(self._rel("CALLS", "DYNAMIC_CALL"), "source_id"), "target_id").where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), F.lit(call).alias("w"))
        return calls, own(self._rel(*types), "source_id").select(F.col("source_id").alias("id"), F.col("target_id").alias("resource")).distinct()

    def coupling(self, call: int = 2, shared: int = 1, types: Iterable[str] = ("USES", "READS", "WRITES")) -> DataFrame:
        """(a, b, w): how programs hang together, pair by pair: `call` for each call, `shared` for each thing that both use."""
        calls, use = self.calls_and_uses(call, types)
        pairs = use.alias("x").join(use.alias("y"), "resource").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(shared).alias("w"))
        return calls.unionByName(pairs).groupBy("a", "b").agg(F.sum("w").alias("w"))

    def communities(self, coupling: DataFrame | None = None, call: int = 2, shared: int = 1, types: Iterable[str] = ("USES", "READS", "WRITES")) -> DataFrame:
        """(id, community) of programs by modularity of their coupling; programs that nothing couples are alone.

        Without a coupling given, what programs share counts by resource and community, and no pairs are formed.
        """
        nodes = self.programs().select(F.col("asset_id").alias("id"))
        if coupling is not None:
            return G.communities(coupling, nodes)
        calls, use = self.calls_and_uses(call, types)
        return G.communities(calls, nodes, uses=use, shared=float(shared))

    def services(self, minimum: int = 1, labels: DataFrame | None = None) -> DataFrame:
        """A row for each community: relationships inside and across, cohesion, coupling, fitness, confidence, pattern, shared data."""
        labels = labels if labels is not None else self.communities(call=3, types=[t for t in V.COUPLING if "CALL" not in t])
        end = lambda side: labels.select(F.col("id").alias(f"{side}_id"), F.col("community").alias(f"{side}_c"))
        r = self.relationships.select("source_id", "rel_type", "target_id").join(end("source"), "source_id", "left").join(end("target"), "target_id", "left")
        inside = F.coalesce(F.col("source_c") == F.col("target_c"), F.lit(False))
        touched = r.select(F.explode(F.array_distinct(F.array_compact(F.array("source_c", "target_c")))).alias("community"), inside.alias("inside"))
        counts = touched.groupBy("community").agg(F.count_if("inside").alias("internal"), F.count_if(~F.col("inside")).alias("external"))
        used = r.where(F.col("rel_type").isin(*V.DATA_ACCESS) & F.col("source_c").isNotNull()).groupBy(F.col("source_c").alias("community"), "target_id").agg(F.count(F.lit(1)).alias("n"))
        top = used.withColumn("k", F.row_number().over(W.partitionBy("community").orderBy(F.desc("n"), "target_id"))).where("k <= 10")
        data = top.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "target_id"))), lambda x: x["target_id"]).alias("shared_data"))
        size = labels.groupBy("community").agg(F.count(F.lit(1)).alias("programs")).where(F.col("programs") >= minimum)
        all_ = size.join(counts, "community", "left").join(data, "community", "left").fillna(0, ["internal", "external"])
        total = F.greatest(F.col("internal") + F.col("external"), F.lit(1))
        all_ = all_.withColumn("cohesion", F.col("internal") / total).withColumn("coupling", F.col("external") / total)
        fitness = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + F.col("cohesion") * 50 - F.col("coupling") * 20))
        return all_.select("community", "programs", "internal", "external", F.round("cohesion", 3).alias("cohesion"), F.round("coupling", 3).alias("coupling"), F.round(fitness, 2).alias("fitness"), F.round(F.least(F.lit(0.95), 0.55 + F.col("programs") * 0.04 + F.col("cohesion") * 0.2), 2).alias("confidence"), F.when(F.col("coupling") > 0.55, "MODULAR_MONOLITH").otherwise("EXTRACTABLE_SERVICE").alias("pattern"), F.coalesce("shared_data", F.array().cast("array<string>")).alias("shared_data"))

    # --- runtime -----------------------------------------------------------------------------------------------------
    def correlate(self, runtime: DataFrame) -> DataFrame:
        """Programs, jobs and transactions against a feed (entity_type, entity_id, exec_count, last_run, avg_elapsed_ms); null stays unknown."""
        static = self.programs().select(F.lit("program").alias("type"), F.col("name").alias("id")).union(self._of("JOB").select(F.lit("job"), "name")).union(self._of("TRANSACTION").join(self.relationships.select(F.col("source_id").alias("asset_id")).distinct(), "asset_id", "left_semi").select(F.lit("transaction"), "name"))
        static = static.groupBy("id").agg(F.min_by("type", F.array_position(F.array(*map(F.lit, ("program", "job", "transaction"))), F.col("type"))).alias("type"))
        m = runtime.select(F.col("entity_id").alias("id"), F.col("entity_type").alias("kind"), "exec_count", "last_run", "avg_elapsed_ms", F.lit(True).alias("seen"))
        n = F.col("exec_count")
        return static.join(m, "id", "full").select(F.coalesce("type", "kind").alias("type"), "id", F.col("type").isNotNull().alias("in_static"), n.alias("exec_count"), "last_run", "avg_elapsed_ms", runtime_status(n).alias("runtime_status"), F.when(F.col("seen"), 1.0).otherwise(0.0).alias("confidence"), F.when(n.isNotNull(), "confirmed").otherwise("needs_review").alias("status"))

    def reconcile(self, runtime: DataFrame) -> DataFrame:
        """(bucket, program, exec_count, last_run, confidence, status, known_target): where the code and the feed disagree."""
        p = self.programs().select(F.col("name").alias("program"), F.col("asset_id").alias("id")).join(self.dead_code().withColumn("dead", F.lit(True)), "id", "left").drop("id")
        m = runtime.where("entity_type = 'program'").select(F.col("entity_id").alias("program"), "exec_count", "last_run")
        known = self.relationships.select(F.substring_index("target_id", ":", -1).alias("program"), F.lit(True).alias("target")).distinct()
        both = p.withColumn("static", F.lit(True)).join(m, "program", "full").join(known, "program", "left")
        dead, n = F.coalesce("dead", F.lit(False)), F.col("exec_count")
        kind = F.when(F.col("static"), F.when(dead & (n > 0), "static-dead but ran").when(dead & (n == 0), "confirmed-dead").when(~dead & (n == 0), "cold-but-reachable")).when(n > 0, "static-miss")
        sure = F.create_map(*[F.lit(x) for x in ("static-dead but ran", 0.9, "confirmed-dead", 0.85, "cold-but-reachable", 0.5, "static-miss", 0.9)])
        return both.withColumn("bucket", kind).where("bucket IS NOT NULL").select("bucket", "program", "exec_count", "last_run", sure[F.col("bucket")].alias("confidence"), F.when(F.col("bucket") == "confirmed-dead", "inferred").otherwise("needs_review").alias("status"), F.coalesce("target", F.lit(False)).alias("known_target"))

    def criticality(self, runtime: DataFrame, top: int = 10, turns: int = 50) -> DataFrame:
        """(program, pagerank, exec_count, runtime_status, score): half the rank and half the executions, each as a share of the most."""
        rank = G.pagerank(self._rel("CALLS", "EXECUTES"), turns).where(F.col("id").startswith("PROGRAM:"))
        m = runtime.where("entity_type = 'program'").select(F.col("entity_id").alias("name"), "exec_count")
        most = rank.agg(F.max("rank").alias("most_rank")).crossJoin(m.agg(F.max("exec_count").alias("most_runs")))
        p = self.programs().select("name", F.col("asset_id").alias("id")).join(rank, "id", "left").join(m, "name", "left").crossJoin(F.broadcast(most))
        a, b = F.coalesce(F.try_divide("rank", "most_rank"), F.lit(0.0)), F.coalesce(F.try_divide("exec_count", "most_runs"), F.lit(0.0))
        return p.select(F.col("name").alias("program"), F.coalesce("rank", F.lit(0.0)).alias("pagerank"), "exec_count", runtime_status(F.col("exec_count")).alias("runtime_status"), (0.5 * a + 0.5 * b).alias("score")).orderBy(F.desc(F.round("score", 4)), "program").limit(top)

    # --- change ------------------------------------------------------------------------------------------------------
    @property
    def between_assets(self) -> DataFrame:
        """Relationships between assets, without those of what they hold inside."""
        inner = lambda c: F.substring_index(c, ":", 1).isin(*V.INNER_TYPES)
        return self.relationships.where(~inner("source_id") & ~inner("target_id"))

    def _reach_of_change(self, own: str, max_depth: int) -> DataFrame:
        """One row: counts and weights of what depends on an asset and of what it depends on, and the scores they give."""
        weight = lambda other: F.coalesce(F.create_map(*[F.lit(x) for kv in V.CRITICALITY.items() for x in kv])[F.col("asset_type")], F.lit(other))
        reach = lambda reverse: self.named(self._reached(self.between_assets, self._ids(own), reverse=reverse, depth=max_depth).where("dist > 0")).where("name IS NOT NULL")
        up = reach(True).agg(F.count(F.lit(1)).alias("blast_radius"), F.coalesce(F.sum(weight(3)), F.lit(0)).alias("up"))
        down = reach(False).agg(F.count(F.lit(1)).alias("dependency_count"), F.coalesce(F.sum(F.floor(weight(2) / 2)), F.lit(0)).alias("down"))
        sure = self.assets.where(F.col("asset_id") == own).select(F.floor(F.col("confidence") * 100).alias("sure"))
        one = up.crossJoin(down).crossJoin(sure).crossJoin(self.between_assets.agg(F.count(F.lit(1)).alias("edges")))
        ready = F.greatest(F.lit(0), F.least(F.lit(100), F.col("sure") - F.least(F.lit(50), F.col("blast_radius") * 3 + F.col("dependency_count") * 2)))
        return one.withColumn("risk_score", F.least(F.lit(100), F.col("up") + F.col("down")).cast("long")).withColumn("readiness_score", ready.cast("long"))

    def compare(self, target: str, scenarios: Iterable[str] = ("modify", "retire", "extract-service", "replatform"), max_depth: int = 10) -> DataFrame:
        """A row for each scenario of a change to target: blast radius, dependencies, risk, readiness, breakages, what to do.

        recommended: the most readiness less risk, the first of equal ones.  Both ways are walked once for all scenarios.
        """
        own = self.resolve(target)
        broken = None
        for k, s in enumerate(scenarios):
            one = self.breakages(own, s).agg(F.count(F.lit(1)).alias("breakages")).select(F.lit(k).alias("k"), F.lit(s.upper()).alias("scenario"), "breakages")
            broken = one if broken is None else broken.unionByName(one)
        all_ = broken.crossJoin(self._reach_of_change(own, max_depth))
        advice = F.when(F.col("risk_score") >= 75, "staged coexistence with human approval").when(F.col("readiness_score") < 40, "improve metadata, tests and isolation first").otherwise("controlled pilot with equivalence gates")
        # a row a scenario, so one task's window
        first = F.row_number().over(W.orderBy(F.col("risk_score") - F.col("readiness_score"), "k")) == 1
        return all_.select("scenario", F.lit(own).alias("target"), "blast_radius", "dependency_count", "risk_score", "readiness_score", "breakages", advice.alias("recommendation"), F.round(F.least(F.lit(0.98), 0.55 + F.least("edges", F.lit(100)) / 500), 2).alias("confidence"), first.alias("recommended"))

    def simulate(self, target: str, scenario: str = "modify", max_depth: int = 10) -> DataFrame:
        """compare() for one scenario."""
        return self.compare(target, (scenario,), max_depth).drop("recommended")

    def breakages(self, own: str, scenario: str) -> DataFrame:
        """(type, rel_type, peer): what breaks next to an asset if it is retired, extracted, moved or changed."""
        into, out = F.col("target_id") == own, F.col("source_id") == own
        rows = lambda where, kind, peer: self.between_assets.where(where).select(F.lit(kind).alias("type"), "rel_type", F.col(peer).alias("peer"))
        match scenario.lower():
            case "retire":
                return rows(into, "BROKEN_CONSUMER", "source_id")
            case "extract-service":
                return rows(into, "CONTRACT_REQUIRED", "source_id").unionAll(rows(out, "CONTRACT_REQUIRED", "target_id"))
            case "replatform":
                return rows(out & F.col("rel_type").isin(*V.DATA_ACCESS), "DATA_COMPATIBILITY", "target_id")
            case _:
                return rows(into, "REGRESSION_RISK", "source_id")

    def change_paths(self, target: str, reverse: bool = True, max_depth: int = 10, limit: int = 200) -> DataFrame:
        """(dist, route): ways to each edge that leaves what is reached, the shortest first; a vertex keeps its first way."""
        a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
        steps = self.between_assets.select(F.col(a).alias("id"), F.col(b).alias("to"))
        front = self._ids(self.resolve(target)).withColumn("route", F.array("id"))
        seen, out, rounds = front.select("id"), None, G.Rounds(self.spark, "paths")
        for dist in range(1, max_depth + 1):
            found = rounds.write(front.join(steps, "id").select("to", F.concat("route", F.array("to")).alias("route")))
            out = found.select(F.lit(dist).alias("dist"), "route") if out is None else out.unionByName(found.select(F.lit(dist).alias("dist"), "route"))
            front = rounds.write(found.groupBy(F.col("to").alias("id")).agg(F.min("route").alias("route")).join(seen, "id", "left_anti"))
            if front.isEmpty():
                break
            seen = seen.union(front.select("id"))
        return out.orderBy("dist", "route").limit(limit)

    # --- slices ------------------------------------------------------------------------------------------------------
    def slice(self, root: str, direction: str = "both", depth: int = 1, limit: int | None = 500, types: Iterable[str] = (), confidence_min: float = 0.0, deepest: int = 8, most: int = 1500) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes (asset_id, dist, ...) nearest to root, the relationships among them, and one row of counts with truncated.

        depth, limit and confidence are brought into their bounds; nodes are taken by distance, then name; all with limit=None.
        """
        depth, limit = min(max(depth, 0), deepest), None if limit is None else min(max(limit, 1), most)
        found = self._rel(*[t.upper() for t in types]).where(F.col("confidence") >= min(max(confidence_min, 0.0), 1.0))
        ends = found.select("source_id", "target_id")
        way = {"upstream": {"reverse": True}, "downstream": {}}.get(direction, {"both": True})
        at = self._reached(ends, self._ids(root), depth=depth, **way).withColumnRenamed("id", "asset_id").join(self.assets, "asset_id")
        rounds = G.Rounds(self.spark, "slice")
        if limit is None:
            ranked = nodes = rounds.write(at)
        else:
            # one row over the limit tells whether there are more
            ranked = rounds.write(at.orderBy("dist", "name", "asset_id").limit(limit + 1))
            nodes = rounds.write(ranked.orderBy("dist", "name", "asset_id").limit(limit))
        end = lambda c: nodes.select(F.col("asset_id").alias(c))
        edges = found.join(end("source_id"), "source_id", "left_semi").join(end("target_id"), "target_id", "left_semi")
        stats = edges.agg(F.count(F.lit(1)).alias("edge_count"), F.count_if(F.col("status").isin(*RISKY)).alias("needs_review_edges"), F.count_if(F.col("target_id") == root).alias("upstream_edges"), F.count_if(F.col("source_id") == root).alias("downstream_edges"))
        return nodes, edges, nodes.agg(F.count(F.lit(1)).alias("node_count")).crossJoin(stats).crossJoin(ranked.agg((F.count(F.lit(1)) > F.lit(limit) if limit is not None else F.lit(False)).alias("truncated"))).withColumn("depth", F.lit(depth)).withColumn("limit", F.lit(limit).cast("int"))

    def call_graph_360(self, root: str, direction: str = "both", depth: int = 8, limit: int = 1500):
        return self.slice(root, direction, depth, limit, V.CALL_GRAPH, deepest=12, most=10_000)

    def dependency_graph(self, root: str, direction: str = "both", depth: int = 4, limit: int | None = 1500):
        return self.slice(root, direction, depth, limit, V.DEPENDENCY, deepest=12, most=10_000)

    def required_files(self, root: str, depth: int = 8, limit: int | None = 5000, evidence_limit: int | None = 2000) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Files that an asset's dependencies come from, the evidence of what is in the slice, what kinds it holds, and its counts.

        The first `evidence_limit` pieces of evidence are given, as in the reference, all with None; evidence_truncated tells
        whether there are more.
        """
        nodes, edges, stats = self.dependency_graph(root, depth=depth, limit=limit)
        files = nodes.where("path IS NOT NULL").join(self.members, "path") if self.members is not None else nodes.where("path IS NOT NULL")
        ids = nodes.select(F.col("asset_id").alias("entity_id")).union(edges.select("relationship_id"))
        proof, cut = None, F.lit(False)
        if self.evidence is not None:
            proof = every = self.evidence.join(ids, "entity_id", "left_semi")
            if evidence_limit is not None:
                proof = every.orderBy("path", "line_start").limit(evidence_limit)
                stats, cut = stats.crossJoin(every.agg((F.count(F.lit(1)) > evidence_limit).alias("more"))), F.col("more")
        stats = stats.withColumn("evidence_truncated", cut).drop("more")
        kind = F.when(F.col("asset_type").isin("PROGRAM", "JOB", "COPYBOOK"), F.lower("asset_type")).when(F.col("asset_type").isin("TABLE", "FILE", "DATASET", "MQ_QUEUE", "MAP"), "data_asset")
        kinds = nodes.select(F.explode(F.array_compact(F.array(kind, F.when(F.col("status").isin(*RISKY), "unresolved")))).alias("kind"), "name")
        return files, proof, kinds, stats

    def _top_folder(self) -> Column:
        parts = F.split(F.regexp_replace(F.replace(F.coalesce("path", F.lit("")), F.lit("\\"), F.lit("/")), "^/+|/[^/]*$|^[^/]*$", ""), "/")
        return F.nullif(F.when((F.lower(parts[0]) == "app") & (F.size(parts) > 1), F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(parts[0]), F.lit(""))

    def clusters(self, types: Iterable[str] = V.DEPENDENCY) -> DataFrame:
        """A row for each group of assets that dependencies or a common top folder hold together."""
        r = self._rel(*types).select("source_id", "target_id")
        homes = self.assets.select(F.col("asset_id").alias("id"), self._top_folder().alias("folder")).where("folder IS NOT NULL")
        star = homes.groupBy("folder").agg(F.min("id").alias("hub"))
        same = homes.join(star, "folder").where("id <> hub").select(F.col("hub").alias("source_id"), F.col("id").alias("target_id"))
        at = G.components(r.union(same))
        rounds = G.Rounds(self.spark, "clusters")
        of = rounds.write(self.assets.select(F.col("asset_id").alias("id"), "asset_type", "name").join(at, "id", "left").withColumn("component", F.coalesce("component", "id")))
        end = of.select(F.col("id").alias("source_id"), F.col("component").alias("c"))
        inside = self.relationships.join(end, "source_id").join(of.select(F.col("id").alias("target_id"), F.col("component").alias("d")), "target_id").where("c = d")
        held = inside.groupBy(F.col("c").alias("component")).agg(F.count(F.lit(1)).alias("relationships"), F.count_if(F.col("status").isin(*RISKY)).alias("unresolved"), cluster_confidence().alias("sure"))
        size = of.groupBy("component").agg(F.count(F.lit(1)).alias("assets"), F.count_if(F.col("asset_type") == "PROGRAM").alias("programs"), F.count_if(F.col("asset_type").isin("TABLE", "FILE", "DATASET", "COPYBOOK", "MQ_QUEUE", "MAP")).alias("data"))
        score = inside.select(F.col("c").alias("component"), F.col("source_id").alias("id"), F.lit(2).alias("s")).union(inside.select("c", "target_id", F.lit(1))).groupBy("component", "id").agg(F.sum("s").alias("s"))
        root = self.entry_points().withColumn("entry", F.lit(True))
        rank = F.struct((~F.coalesce("entry", F.lit(False))).alias("a"), (~F.col("asset_type").isin("PROGRAM", "JOB", "TRANSACTION", "SCHEDULE")).alias("b"), (-F.coalesce("s", F.lit(0))).alias("s"), "name")
        best = of.join(root, "id", "left").join(score, ["component", "id"], "left").groupBy("component").agg(F.min_by("id", rank).alias("root_asset_id"))
        all_ = size.join(held, "component", "left").join(best, "component").fillna(0, ["relationships", "unresolved"])
        return all_.select("component", "root_asset_id", "assets", "programs", "data", "relationships", "unresolved", F.round(F.least(F.lit(1.0), F.col("unresolved") * 0.08 + F.col("assets") / 3000.0), 3).alias("risk"), F.round(F.coalesce("sure", F.lit(0.45)), 3).alias("confidence"))

    def root_summary(self, depth: int = 8, limit: int | None = 1500) -> DataFrame:
        """For each entry point: assets, programs and data near it (to the depth, the nearest `limit`), unresolved edges and risk.

        truncated tells whether more is near than the limit, which is the reference's; with None all counts.
        """
        if limit is None:
            kinds = self.assets.where("name IS NOT NULL").select(F.col("asset_id").alias("id"), F.col("asset_type").alias("kind"))
            unsure = self.relationships.where(F.col("status").isin(*RISKY))
            held = condense.near_counts(self.relationships, kinds, F.col("kind") == "PROGRAM", F.col("kind").isin(*V.DATA_TYPES), self.entry_points(), unsure, depth)
            held = held.where("assets > 0").withColumnRenamed("links", "unresolved").withColumn("truncated", F.lit(False))
        else:
            held = self._nearest_counts(depth, limit)
        return held.withColumn("label", name_words(F.substring_index("root", ":", -1))).withColumn("risk", F.round(F.least(F.lit(1.0), F.col("unresolved") * 0.08 + F.col("assets") / 3000.0), 3))

    def _nearest_counts(self, depth: int, limit: int) -> DataFrame:
        """(root, assets, programs, data, truncated, unresolved) of the `limit` nearest to each entry point."""
        ends = self.relationships.select("source_id", "target_id", "confidence", "status")
        flip = ends.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "confidence", "status")
        at = self.named(G.bfs(G.best_edges(ends.unionByName(flip)), self.entry_points(), depth=depth).select("root", "id", "dist")).where("name IS NOT NULL")
        rounds = G.Rounds(self.spark, "roots")
        near = rounds.write(at.withColumn("k", F.row_number().over(W.partitionBy("root").orderBy("dist", "name", "id"))).where(F.col("k") <= limit + 1))
        cut = near.where(F.col("k") > limit).select("root", F.lit(True).alias("truncated"))
        near = near.where(F.col("k") <= limit).drop("k")
        edges = self.relationships.join(near.select("root", F.col("id").alias("source_id")), "source_id").join(near.select("root", F.col("id").alias("target_id")), ["root", "target_id"], "left_semi")
        unsure = edges.groupBy("root").agg(F.count_if(F.col("status").isin(*RISKY)).alias("unresolved"))
        held = near.groupBy("root").agg(F.count(F.lit(1)).alias("assets"), F.count_if(F.col("asset_type") == "PROGRAM").alias("programs"), F.count_if(F.col("asset_type").isin(*V.DATA_TYPES)).alias("data"))
        held = held.join(cut, "root", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
        return held.join(unsure, "root", "left").fillna(0, ["unresolved"])

    def node_degree(self) -> DataFrame:
        count = lambda c, n: self.relationships.groupBy(F.col(c).alias("asset_id")).agg(F.count(F.lit(1)).alias(n))
        return self.assets.select("asset_id").join(count("target_id", "in_degree"), "asset_id", "left").join(count("source_id", "out_degree"), "asset_id", "left").fillna(0)

    def heatmap(self, left: str, right: str, rel: str) -> DataFrame:
        a = self.assets.select("asset_id", "asset_type", "name")
        s, t = a.where(F.col("asset_type") == left.upper()), a.where(F.col("asset_type") == right.upper())
        r = self._rel(rel.upper()).select("source_id", "target_id")
        return r.join(s.select(F.col("asset_id").alias("source_id"), F.col("name").alias("left_name")), "source_id").join(t.select(F.col("asset_id").alias("target_id"), F.col("name").alias("right_name")), "target_id").groupBy("left_name", "right_name").agg(F.count(F.lit(1)).alias("weight")).orderBy(F.desc("weight"), "left_name", "right_name").limit(5000)

    def run_insights(self, examples: int = 20) -> DataFrame:
        """(kind, title, detail) that a run says of itself: its inventory, its entry points (how many, and the first by id) and its gaps."""
        kinds = self.assets.groupBy("asset_type").agg(F.count(F.lit(1)).alias("n")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset_type", "n"))))).alias("detail"))
        first = self.entry_points().orderBy("id").limit(examples).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("detail"))
        roots = self.entry_points().agg(F.count(F.lit(1)).alias("n")).crossJoin(first)
        gaps = self.relationships.agg(F.count_if(F.col("status").isin(*RISKY)).alias("n")).crossJoin(self.assets.agg(F.count_if(F.col("state") == "UNRESOLVED").alias("u")))
        row = lambda df, kind, title, detail: df.select(F.lit(kind).alias("kind"), title.alias("title"), detail.alias("detail"))
        return row(kinds, "INVENTORY", F.lit("assets by type"), F.col("detail")).unionByName(row(roots, "ROOT", F.concat(F.col("n"), F.lit(" entry points")), F.col("detail"))).unionByName(row(gaps, "GAPS", F.concat(F.col("n"), F.lit(" relationships need review")), F.concat(F.col("u"), F.lit(" assets without a source"))))

    # --- coverage and validation -------------------------------------------------------------------------------------
    def coverage(self, roots: DataFrame, depth: int = 3, limit: int | None = 600) -> DataFrame:
        """(asset_id, k, check_name, status, confidence, edges) for each of roots (asset_id): 29 checks on what leaves it within the depth.

        The nearest `limit` vertices of each root count, as in the reference, and `truncated` tells whether there are more; all
        count with limit=None.  Attributes of the asset that the checks read: parser,
        parser_status, copies, copies_unresolved, data_items, field_flows, business_rules.
        """
        best = G.best_edges(self.relationships)
        at = G.bfs(best, roots.select(F.col("asset_id").alias("id")), depth=depth - 1).select(F.col("root").alias("asset_id"), F.col("id").alias("source_id"), "dist")
        cut = at.limit(0).select("asset_id").withColumn("truncated", F.lit(True))
        if limit is not None:
            at = G.Rounds(self.spark, "coverage").write(at.withColumn("n", F.row_number().over(W.partitionBy("asset_id").orderBy("dist", "source_id"))).where(F.col("n") <= limit + 1))
            cut = at.where(F.col("n") > limit).select("asset_id", F.lit(True).alias("truncated"))
            at = at.where(F.col("n") <= limit)
        out = at.select("asset_id", "source_id", (F.col("dist") == 0).alias("own")).join(self.relationships, "source_id").select("asset_id", "own", "rel_type", "attributes", F.substring_index("source_id", ":", 1).alias("s"), F.substring_index("target_id", ":", 1).alias("t"))
        a = F.col("attributes")
        end = lambda *kinds: F.col("s").isin(*kinds) | F.col("t").isin(*kinds)
        extra = {
            "jcl_dd_binding": end("JCL_DD"),
            "assembler": F.upper(a["language"]) == "ASSEMBLER",
            "pli": F.upper(a["language"]) == "PLI",
            "cics": F.lower(a["cics_kind"]) == "cics",
            "interface_contract_model": end("INTERFACE_CONTRACT"),
            "commarea_contracts": (F.col("rel_type") == "CONTRACT_USES_FIELD") & (a["contract_role"] == "commarea"),
            "dataset_identity": end("DATASET_IDENTITY"),
            "file_io_semantics": F.col("s").isin("FILE_IO_OPERATION", "FILE_RECORD"),
            "statement_ordering": end("STATEMENT"),
            "sort_merge": end("SORT_MERGE_OPERATION"),
        }
        hit = {name: F.col("rel_type").isin(*V.COVERED_BY[name]) if name in V.COVERED_BY else F.lit(False) for name in {*V.COVERED_BY, *extra}}
        hit = {name: F.coalesce(h | extra[name], h) if name in extra else h for name, h in hit.items()}
        hit["db2_sql"] &= F.col("own")
        hit["bounded_copybook_layout"] = F.col("rel_type").isin(*V.COPYBOOK_FIELDS) & (F.coalesce(a["bounded_copybook_layout"] == "true", F.lit(False)) | end("COPY_SITE"))
        hit["runtime_observations"] = F.col("rel_type") == "OBSERVED_CALLS"
        hit["calls"] = F.col("own") & F.col("rel_type").isin("CALLS", "DYNAMIC_CALL")
        hit["calls_using"] = F.col("own") & (F.col("rel_type") == "CALLS") & (F.coalesce(a["using"], F.lit("")) != "")
        counts = out.groupBy("asset_id").agg(*[F.count_if(h).alias(f"n_{name}") for name, h in hit.items()])
        own = self.assets.select("asset_id", F.col("attributes").alias("o")).join(roots.select("asset_id").distinct(), "asset_id", "left_semi").join(counts, "asset_id", "left").fillna(0)
        held = lambda key: F.coalesce(F.col("o")[key].try_cast("long"), F.lit(0))
        n = lambda name: F.col(f"n_{name}")
        found = lambda count: F.when(count > 0, "captured").otherwise("not_observed")
        special = {
            "parser": (F.lit(0), F.when(F.col("o")["parser"].isNull(), "not_observed").when(F.col("o")["parser"] == "parse-error", "needs_review").otherwise("captured")),
            "copybooks": (held("copies"), F.when(held("copies_unresolved") > 0, "needs_review").otherwise(found(held("copies")))),
            "call_contracts": (n("interface_contract_model") + n("calls_using"), F.when(n("calls_using") + n("interface_contract_model") > 0, "captured").when(n("calls") + n("runtime_observations") > 0, "partial").otherwise("not_observed")),
            "data_dictionary": (held("data_items"), found(held("data_items"))),
            "field_lineage": (held("field_flows"), found(held("field_flows"))),
            "business_rules": (held("business_rules"), found(held("business_rules"))),
        }
        rows = []
        for k, name in enumerate(V.CHECKS):
            count, status = special.get(name) or (n(name), found(n(name)))
            rows.append(F.struct(F.lit(k).alias("k"), F.lit(name).alias("check_name"), status.alias("status"), count.cast("long").alias("edges")))
        sure = F.create_map(*[F.lit(x) for kv in V.COVERAGE_CONFIDENCE.items() for x in kv])
        each = own.select("asset_id", F.explode(F.array(*rows)).alias("c")).select("asset_id", "c.*")
        each = each.join(cut, "asset_id", "left")
        return each.select("asset_id", "k", "check_name", "status", sure[F.col("status")].alias("confidence"), "edges", F.coalesce("truncated", F.lit(False)).alias("truncated"))

    def validate(self) -> DataFrame:
        """(check_name, status, failures, noted): the checks of a run; those that only make visible pass with what they note."""
        bad = lambda c: (F.col(c) < 0) | (F.col(c) > 1)
        odd = ~F.col("status").isin(*V.STATUSES)
        proof = self.evidence.select("entity_kind", "entity_id").distinct()
        bare = lambda df, kind, key: df.join(proof.where(F.col("entity_kind") == kind), df[key] == proof["entity_id"], "left_anti").agg(F.count(F.lit(1)))
        count = lambda df, p, *how: df.agg(F.count_if(bad("confidence")).alias(f"{p}_range"), F.count_if(odd).alias(f"{p}_status"), *how)
        visible = lambda p: (F.count_if(F.col("status") != "confirmed").alias(f"{p}_review"), F.count_if(F.col("confidence") < 1).alias(f"{p}_low"))
        one = count(self.assets, "a", *visible("a"), F.count_if(F.col("state") == "UNRESOLVED").alias("unresolved"), F.count(F.lit(1)).alias("n"))
        one = one.crossJoin(count(self.relationships, "r", *visible("r"))).crossJoin(count(self.evidence, "e", F.count_if(F.col("line_start") > F.col("line_end")).alias("e_lines")))
        one = one.crossJoin(bare(self.assets, "ASSET", "asset_id").toDF("a_bare")).crossJoin(bare(self.relationships, "RELATIONSHIP", "relationship_id").toDF("r_bare"))
        total = lambda *cs: sum((F.col(c) for c in cs[1:]), F.col(cs[0]))
        checks = [
            ("run_exists", (F.col("n") == 0).cast("long"), F.col("n")),
            ("assets_have_evidence", F.col("a_bare"), F.lit(0)),
            ("relationships_have_evidence", F.col("r_bare"), F.lit(0)),
            ("review_items_are_visible", F.lit(0), total("a_review", "r_review", "unresolved")),
            ("confidence_gaps_are_visible", F.lit(0), total("a_low", "r_low")),
            ("confidence_values_in_range", total("a_range", "r_range", "e_range"), F.lit(0)),
            ("validation_status_values_allowed", total("a_status", "r_status", "e_status"), F.lit(0)),
            ("evidence_line_ranges_valid", F.col("e_lines"), F.lit(0)),
        ]
        rows = F.array(*[F.struct(F.lit(name).alias("check_name"), F.when(f == 0, "passed").otherwise("failed").alias("status"), f.cast("long").alias("failures"), noted.cast("long").alias("noted")) for name, f, noted in checks])
        return one.select(F.explode(rows).alias("c")).select("c.*")

    # --- domain ------------------------------------------------------------------------------------------------------
    def events(self) -> DataFrame:
        """(event_name, producer, trigger, payload, confidence, consumers): what writes stand for; of one name and producer the last counts."""
        words = F.filter(F.split(F.upper(F.substring_index("target_id", ":", -1)), "[^A-Z0-9]+"), lambda w: (w != "") & ~w.isin(*V.EVENT_NOISE))
        subject = F.array_join(F.transform(words, F.initcap), "")
        verb, sure = (F.create_map(*[F.lit(x) for k, v in V.EVENT_VERBS.items() for x in (k, v[i])]) for i in (0, 1))
        made = self._rel(*V.EVENT_VERBS).select(F.concat(subject, verb[F.col("rel_type")]).alias("event_name"), F.col("source_id").alias("producer"), "rel_type", "target_id", "path", "line", "relationship_id")
        last = made.groupBy("event_name", "producer").agg(F.max_by(F.struct("rel_type", "target_id"), F.struct("path", "line", "relationship_id")).alias("e"))
        used = self._rel(*V.EVENT_READS).groupBy(F.col("target_id").alias("payload")).agg(F.array_sort(F.collect_set("source_id")).alias("consumers"))
        rows = last.select("event_name", "producer", F.col("e.rel_type").alias("trigger"), F.col("e.target_id").alias("payload"), sure[F.col("e.rel_type")].alias("confidence"))
        return rows.join(used, "payload", "left").select("event_name", "producer", "trigger", "payload", "confidence", F.coalesce("consumers", F.array().cast("array<string>")).alias("consumers"))

    @staticmethod
    def _tokens(text: Column) -> Column:
        return F.filter(F.split(F.upper(text), "[^A-Z0-9]+"), lambda t: t != "")

    @classmethod
    def _entity(cls, text: Column) -> Column:
        """The token that names an entity: the first that isn't noise and, if there is such a one, no suffix."""
        words = F.filter(cls._tokens(text), lambda t: ~t.isin(*V.DOMAIN_STOP) & (F.length(t) >= 3))
        return F.coalesce(F.try_element_at(F.filter(words, lambda t: ~t.isin(*V.DOMAIN_SUFFIXES)), F.lit(1)), F.try_element_at(words, F.lit(1)))

    def domains(self, minimum: int = 2) -> DataFrame:
        """(entity, score, attributes, confidence): entities that names of tables (3), files, copybooks and fields (2) and attributes (1) speak for."""
        named = self.assets.where(F.col("asset_type").isin("TABLE", "FILE", "COPYBOOK", "DATA_FIELD")).select(self._entity(F.col("name")).alias("entity"), self._tokens(F.col("name")).alias("tokens"), F.when(F.col("asset_type") == "TABLE", 3).otherwise(2).alias("score")).where("entity IS NOT NULL")
        said = self.assets.select(F.explode(F.flatten(F.transform(F.map_values("attributes"), lambda v: self._tokens(F.coalesce(v, F.lit("")))))).alias("entity")).where((F.length("entity") >= 4) & ~F.col("entity").isin(*V.DOMAIN_STOP)).select("entity", F.lit(1).alias("score"))
        score = named.select("entity", "score").unionByName(said).groupBy("entity").agg(F.sum("score").alias("score")).where((F.col("score") >= minimum) & ~F.col("entity").isin(*V.DOMAIN_STOP))
        parts = named.select("entity", F.explode("tokens").alias("t")).where((F.col("t") != F.col("entity")) & (F.col("t").isin(*V.DOMAIN_SUFFIXES) | (F.length("t") > 3)))
        attributes = parts.groupBy("entity").agg(F.array_sort(F.collect_set("t")).alias("attributes"))
        return score.join(attributes, "entity", "left").select("entity", "score", F.coalesce("attributes", F.array().cast("array<string>")).alias("attributes"), F.round(F.least(F.lit(0.99), 0.45 + F.col("score") * 0.08), 2).alias("confidence"))

    def associations(self, entities: DataFrame) -> DataFrame:
        """(a, b, n): how many relationships join assets of two entities."""
        e = lambda c: self._entity(F.substring_index(c, ":", -1))
        pairs = self.relationships.select(e("source_id").alias("x"), e("target_id").alias("y")).where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        return pairs.join(entities.select(F.col("entity").alias("a")), "a", "left_semi").join(entities.select(F.col("entity").alias("b")), "b", "left_semi")

    def rules(self, capability: str = "") -> DataFrame:
        """(rule_id, rule_kind, expression, implemented_by): business rules, with the programs that implement each."""
        by = self._rel("IMPLEMENTS_RULE").groupBy(F.col("target_id").alias("asset_id")).agg(F.array_sort(F.collect_set("source_id")).alias("implemented_by"))
        said = F.coalesce(F.col("attributes")["expression"], "name")
        kind = F.coalesce(*[F.when(F.upper("expression").rlike("|".join(words)), name) for name, words in V.RULE_KINDS], F.lit("DECISION"))
        rows = self._of("BUSINESS_RULE").where("state = 'OBSERVED'").join(by, "asset_id", "left").select(F.col("name").alias("rule_id"), said.alias("expression"), F.coalesce("implemented_by", F.array().cast("array<string>")).alias("implemented_by"))
        key = capability.upper()
        return rows.where(F.upper("rule_id").contains(key) | F.upper("expression").contains(key) | F.exists("implemented_by", lambda p: F.upper(p).contains(key))).select("rule_id", kind.alias("rule_kind"), "expression", "implemented_by")


def runtime_status(count: Column) -> Column:
    """confirmed-at-runtime, cold, or unknown where there is no count."""
    return F.when(count > 0, "confirmed-at-runtime").when(count == 0, "cold").otherwise("unknown")


def cluster_confidence() -> Column:
    """An aggregate over a cluster's relationships."""
    n = F.count(F.lit(1))
    return F.least(F.lit(0.95), 0.35 + F.avg("confidence") * 0.35 + F.count_if(F.col("status") == "confirmed") / n * 0.20 + F.least(n, F.lit(25)) / 250)
