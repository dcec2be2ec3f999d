"""Questions in words: the first intent whose pattern fits answers with a frame and says how it got there."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import best_edges, bfs

Answer = tuple[DataFrame, dict]


class Router:
    """Answers over programs (program_id) and edges (source_id, rel_type, target_id, confidence, status)."""

    def __init__(self, programs: DataFrame, edges: DataFrame):
        self.programs, self.edges = programs, edges
        self.intents: list[tuple[str, str, Callable[..., DataFrame], str]] = [
            ("dead_code", r"\b(?:dead|unused|unreachable)\b", self.dead, "programs less what jobs reach over confirmed calls"),
            ("callers", r"\bwho calls\s+(\S+)|\bcallers of\s+(\S+)", lambda x: self.near(x, "target_id", "CALLS"), "edges CALLS into it"),
            ("callees", r"\bwhat does\s+(\S+)\s+call\b|\bcallees of\s+(\S+)", lambda x: self.near(x, "source_id", "CALLS"), "edges CALLS out of it"),
            ("jobs", r"\b(?:which|what) jobs? (?:run|execute)s?\s+(\S+)", lambda x: self.near(x, "target_id", "EXECUTES"), "edges EXECUTES into it"),
            ("impact", r"\b(?:impact|blast radius|depends on)\b.*?\b(?:of|on)?\s*(\S+)$", lambda x: self.walk(x, True), "ancestors over all edges"),
            ("lineage", r"\b(?:trace|lineage|downstream)\b.*?(?:of|from)?\s*(\S+)$", lambda x: self.walk(x, False), "descendants over all edges"),
            ("writers", r"\b(?:who|what) (?:writes|updates)\s+(?:to\s+)?(\S+)", lambda x: self.near(x, "target_id", "WRITES"), "edges WRITES into it"),
            ("readers", r"\b(?:who|what) reads\s+(?:from\s+)?(\S+)", lambda x: self.near(x, "target_id", "READS"), "edges READS into it"),
            ("unsure", r"\b(?:unconfirmed|needs? review|gaps?)\b", lambda: self.edges.where("status <> 'confirmed'"), "edges that aren't confirmed"),
            ("inventory", r"\b(?:how many|count|inventory|list)\b", lambda: self.edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n")), "edges counted by type"),
        ]

    def near(self, name: str, side: str, rel: str) -> DataFrame:
        return self.edges.where((F.upper(side) == name) & (F.col("rel_type") == rel)).select("source_id", "rel_type", "target_id", "confidence", "status").distinct()

    def walk(self, name: str, up: bool) -> DataFrame:
        seed = self.edges.sparkSession.createDataFrame([(name,)], "id string")
        return bfs(best_edges(self.edges), seed, reverse=up).where("dist > 0").select("id", "dist", "confidence")

    def dead(self) -> DataFrame:
        control = self.edges.where("rel_type IN ('CALLS', 'EXECUTES') AND status = 'confirmed'")
        jobs = self.edges.where("rel_type = 'EXECUTES'").select(F.col("source_id").alias("id")).distinct()
        return self.programs.join(bfs(best_edges(control), jobs).select(F.col("id").alias("program_id")).distinct(), "program_id", "left_anti")

    def ask(self, question: str) -> Answer:
        """The answer and its trace {intent, steps, evidence, reason}; an unknown question gives no rows."""
        q = question.strip().rstrip("?. ")
        tried = []
        for name, pattern, answer, evidence in self.intents:
            tried.append(name)
            if m := re.search(pattern, q, re.I):
                args = [g.upper().strip("'\"") for g in m.groups() if g][:1]
                return answer(*args), {"intent": name, "steps": tried, "evidence": evidence, "reason": f"matched {m[0]!r}"}
        return self.edges.limit(0), {"intent": "unknown", "steps": tried, "evidence": "", "reason": "no pattern fits"}


class EstateRouter(Router):
    """The same over an Estate, with the questions that need one."""

    def __init__(self, estate):
        programs = estate.programs().select(F.col("name").alias("program_id"))
        edges = estate.relationships.select(F.substring_index("source_id", ":", -1).alias("source_id"), "rel_type", F.substring_index("target_id", ":", -1).alias("target_id"), "confidence", "status")
        super().__init__(programs, edges)
        own = [
            ("dead_code", r"\b(?:dead|unused|unreachable)\b", estate.dead_code, "programs less what roots reach over confirmed edges"),
            ("roots", r"\b(?:roots?|entry points?|drivers?)\b(?!.*\bchain\b)", estate.roots, "executed, started or online programs that nothing calls"),
            ("chain", r"\bchain\b.*?\b(?:of|from|for)\s+(\S+)", lambda x: estate.root_driver_chain(x)[0], "what a driver reaches"),
            ("capability", r"\bcapabilit(?:y|ies)\b(?:.*?\b(?:of|for|about)\s+(.+))?", lambda *x: estate.capability_search(x[0]) if x else estate.capabilities(), "roots with their closures, or assets by key words"),
            ("rules", r"\brules?\b(?:.*?\b(?:of|for|in|about)\s+(\S+))?", lambda *x: estate.rules(*x), "business rules and what implements them"),
            ("stats", r"\b(?:stat(?:s|istics)?|summary|overview)\b", estate.summary, "counts of the run"),
            ("validate", r"\b(?:valid(?:ate|ation)?|quality)\b", estate.validate, "checks of the run"),
        ]
        self.intents = own + self.intents[1:]
