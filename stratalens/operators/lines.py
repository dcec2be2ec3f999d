"""Facts that one line, one statement or one command holds: tables of patterns, applied in one pass by built-in functions.

Every extractor takes members (path, text) and returns facts:
(path, line, source, rel_type, target_type, target, confidence, status).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FACT = "path string, line int, source string, rel_type string, target_type string, target string, confidence double, status string"

N = r"[A-Z0-9$#@_-]+"  # a name
# Per kind of member, patterns on one line: (pattern, group of the source or 0 for the member's own name,
# relation, type of target, group of target, confidence).  The own name is the nearest earlier line that OWNERS fits.
LINES = {
    "jcl": [(rf"^//({N})\s+EXEC\s+PGM=({N})", 0, "EXECUTES", "program", 2, 1.0), (rf"^//({N})\s+EXEC\s+(?:PROC=)?({N})(?:,|\s|$)", 0, "EXECUTES_PROC", "proc", 2, 0.78), (rf"^//\s+INCLUDE\s+MEMBER=({N})", 0, "INCLUDES", "member", 1, 0.78)],
    "assembler": [(rf"^\s+(?:CALL|LINK\s+EP=|XCTL\s+EP=)\s*({N})", 0, "CALLS", "program", 1, 0.8), (rf"^\s+COPY\s+({N})", 0, "USES", "copybook", 1, 0.8), (rf"^({N})\s+DSECT\b", 0, "DEFINES", "dsect", 1, 0.8)],
    "pl1": [(rf"\bCALL\s+({N})", 0, "CALLS", "program", 1, 0.8), (rf"%INCLUDE\s+({N})", 0, "USES", "copybook", 1, 0.9)],
    "bms": [(rf"^({N})\s+DFHMDI\b", 0, "CONTAINS", "map", 1, 0.9)],
    "ims": [(rf"\bSEGM\s+NAME=\(?({N})", 0, "CONTAINS", "segment", 1, 0.9), (rf"\bSEGM\s+NAME=\(?({N}).*PARENT=\(*({N})", 1, "CHILD_OF", "segment", 2, 0.85), (rf"\bPCB\s+TYPE=DB.*DBDNAME=({N})", 0, "USES", "database", 1, 0.9), (rf"\bSENSEG\s+NAME=({N})", 0, "USES", "segment", 1, 0.85)],
    "mq": [(r"\bDEFINE\s+Q(?:LOCAL|REMOTE|ALIAS)\s*\(\s*'?([A-Z0-9._]+)", 0, "DEFINES", "queue", 1, 0.8), (r"\bMQPUT1?\b.*?'([A-Z0-9._]+)'", 0, "WRITES", "queue", 1, 0.72), (r"\bMQGET\b.*?'([A-Z0-9._]+)'", 0, "READS", "queue", 1, 0.72), (r"\bMQOPEN\b.*?'([A-Z0-9._]+)'", 0, "USES", "queue", 1, 0.45)],
    "ddl": [(r"\bCREATE\s+(?:UNIQUE\s+)?INDEX\s+([A-Z0-9_.]+)\s+ON\s+([A-Z0-9_.]+)", 1, "INDEXES", "table", 2, 0.9), (r"\bCREATE\s+TABLE\s+([A-Z0-9_.]+)", 0, "DEFINES", "table", 1, 1.0), (r"\bCREATE\s+VIEW\s+([A-Z0-9_.]+)", 0, "DEFINES", "view", 1, 0.95), (r"\bREFERENCES\s+([A-Z0-9_.]+)", 0, "REFERENCES", "table", 1, 0.9), (r"\bDECLARE\s+([A-Z0-9_.]+)\s+TABLE\b", 0, "DECLARES", "table", 1, 0.9)],
    "scheduler": [(rf"^\s*({N})\|RUNS_BEFORE\|({N})", 1, "TRIGGERS", "job", 2, 0.9)],
    "cobol": [(rf"\bCOPY\s+({N})", 0, "USES", "copybook", 1, 1.0), (rf"\bSELECT\s+(?:OPTIONAL\s+)?({N})\s+ASSIGN\s+(?:TO\s+)?({N})", 1, "USES_DATASET", "dataset", 2, 0.9), (rf"^\s*FD\s+({N})", 0, "DEFINES_FILE", "file", 1, 0.9), (rf"\bOPEN\s+INPUT\s+({N})", 0, "READS", "file", 1, 0.85), (rf"\bOPEN\s+(?:OUTPUT|EXTEND|I-O)\s+({N})", 0, "WRITES", "file", 1, 0.85)],
}
# What names a member of each kind.
OWNERS = {"jcl": rf"^//({N})\s+JOB\b", "cobol": rf"PROGRAM-ID\s*\.\s*({N})", "assembler": rf"^({N})\s+(?:CSECT|START)\b", "pl1": rf"^\s*({N})\s*:\s*PROC", "bms": rf"^({N})\s+DFHMSD\b", "ims": rf"\b(?:DBD\s+NAME=|PSBGEN.*PSBNAME=)({N})"}
# What CICS commands do: (commands, option that names the object, relation, type).
COMMANDS = [
    (["LINK", "XCTL"], "PROGRAM", "CALLS", "program"),
    (["READ", "READNEXT", "STARTBR"], "FILE|DATASET", "READS", "dataset"),
    (["WRITE", "REWRITE", "DELETE"], "FILE|DATASET", "WRITES", "dataset"),
    (["SEND", "RECEIVE"], "MAP", "USES", "screen"),
    (["READQ"], "QUEUE|QNAME", "READS", "queue"),
    (["WRITEQ"], "QUEUE|QNAME", "WRITES", "queue"),
    (["START"], "TRANSID", "STARTS", "transaction"),
]
# A table's name, with its schema.
TABLE_NAME = r"[A-Z$#@][A-Z0-9_$#@]*(?:\.[A-Z$#@][A-Z0-9_$#@]*)*"
COMMENT = {"cobol": r"^(?:.{6}[*/]|\s*\*)", "jcl": r"^//\*", "assembler": r"^\*", "ddl": r"^\s*--"}


def status(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "confirmed").when(confidence >= 0.5, "inferred").otherwise("needs_review")


def code(text: Column, kind: str) -> Column:
    """text with the lines that are comments empty, so that line numbers hold."""
    if kind not in COMMENT:
        return text
    bare = F.array_join(F.transform(T.lines(text), lambda x: F.when(x.rlike(COMMENT[kind]), "").otherwise(x)), "\n")
    # most members have neither comments nor line ends of other kinds, and stay as they are without being taken apart
    return F.when(text.rlike(rf"(?m){COMMENT[kind]}|\r"), bare).otherwise(text)


def owner(text: Column, path: Column, kind: str) -> Column:
    stem = F.upper(F.regexp_extract(path, r"([^/.]*)(?:\.[^/]*)?$", 1))
    return F.coalesce(F.nullif(F.upper(F.regexp_extract(text, f"(?mi){OWNERS[kind]}", 1)), F.lit("")), stem) if kind in OWNERS else stem


def line_facts(members: DataFrame, kind: str) -> DataFrame:
    """The facts of LINES[kind]: each member's lines are exploded once, and all patterns tried on each."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = members.select("path", owner(text, F.col("path"), kind).alias("own"), F.posexplode(T.lines(code(text, kind))).alias("k", "l"))
    tried = [F.when(F.col("l").rlike(f"(?i){rx}"), F.struct((F.col("own") if src == 0 else F.upper(F.regexp_extract("l", f"(?i){rx}", src))).alias("source"), F.lit(rel).alias("rel_type"), F.lit(kind_to).alias("target_type"), F.upper(F.regexp_extract("l", f"(?i){rx}", dst)).alias("target"), F.lit(c).alias("confidence"))) for rx, src, rel, kind_to, dst, c in LINES[kind]]
    hit = lines.select("path", (F.col("k") + 1).alias("line"), F.explode(F.array_compact(F.array(*tried))).alias("f"))
    return hit.select("path", "line", "f.*").where(F.col("target") != "").withColumn("status", status(F.col("confidence")))


def bodies(text: Column, language: str) -> Column:
    """array of struct(line, body) of each EXEC language ... END-EXEC of code()."""
    parts = _lined(F.split(text, rf"(?i)\bEXEC\s+{language}\b", -1))
    ended = F.filter(parts, lambda p: (p["k"] > 0) & p["part"].rlike("(?i)END-EXEC"))
    return F.transform(ended, lambda p: F.struct(p["line"].alias("line"), F.regexp_extract(p["part"], r"(?is)^(.*?)END-EXEC", 1).alias("body")))


def blocks(members: DataFrame, language: str) -> DataFrame:
    """(path, own, line, body) of each EXEC language ... END-EXEC outside comments."""
    text = code(F.coalesce(F.col("text"), F.lit("")), "cobol")
    return members.select("path", owner(text, F.col("path"), "cobol").alias("own"), F.explode(bodies(text, language)).alias("p")).select("path", "own", "p.line", "p.body")


def _lined(parts: Column) -> Column:
    """array of struct(k, line, part): where each part of a text begins, counted along in one pass."""
    breaks = lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))
    start = F.struct(F.lit(0).alias("k"), F.lit(1).alias("line"), F.array().cast("array<struct<k:int,line:int,part:string>>").alias("out"))
    step = lambda s, p: F.struct((s["k"] + 1).alias("k"), (s["line"] + breaks(p)).alias("line"), F.array_append(s["out"], F.struct(s["k"].alias("k"), s["line"].alias("line"), p.alias("part"))).alias("out"))
    return F.aggregate(parts, start, step, lambda s: s["out"])


def _between(text: Column, start: str, end: str) -> Column:
    """What stands after the first word start, up to the next word end or the end of text; null without start."""
    after = F.regexp_replace(text, rf"^(?s).*?\b{start}\b", "\u0001")
    return F.when(after.startswith("\u0001"), F.trim(F.regexp_replace(F.substr(after, F.lit(2)), rf"(?s)\b(?:{end})\b.*$", "")))


def _listed(text: Column) -> Column:
    """The parts of a list, in parentheses or not."""
    return F.transform(F.split(F.regexp_replace(text, r"^\s*\(|\)\s*$", ""), ","), lambda x: F.trim(x))


def sql_lineage(members: DataFrame) -> DataFrame:
    """(path, line, source, target, kind): host variables and the columns that they meet, by place or by assignment.

    Columns and variables are met by place as far as both go; what is no plain variable (an expression) meets nothing.
    """
    b = F.upper(F.col("body"))
    table = F.regexp_extract(b, rf"(?:\bINTO|\bUPDATE|\bFROM)\s+({TABLE_NAME})", 1)
    variable = lambda x: F.regexp_extract(x, r"^:\s*([A-Z][A-Z0-9_-]*)", 1)
    verb = F.regexp_extract(b, r"^\s*([A-Z]+)", 1)

    def met(columns: Column, variables: Column) -> Column:
        n = F.least(F.size(columns), F.size(variables))
        both = F.zip_with(F.slice(columns, F.lit(1), n), F.slice(variables, F.lit(1), n), lambda c, v: F.struct(c.alias("c"), variable(v).alias("v")))
        return F.filter(both, lambda x: (x["v"] != "") & x["c"].rlike(rf"^{TABLE_NAME}$"))

    def flows(pairs: Column, read: bool) -> Column:
        column = lambda x: F.concat_ws(".", table, x["c"])
        return F.transform(pairs, lambda x: F.struct((column(x) if read else x["v"]).alias("source"), (x["v"] if read else column(x)).alias("target"), F.lit("sql-read" if read else "sql-write").alias("kind")))

    asked, into = _between(b, "SELECT", "INTO|FROM"), _between(b, "INTO", "FROM|WHERE")
    named = F.regexp_extract(b, rf"\bINTO\s+{TABLE_NAME}\s*\(([^)]*)\)", 1)
    given = F.regexp_replace(_between(b, "VALUES", "ON|WHEN"), r"^\s*\(|\).*$", "")
    set_ = F.transform(_listed(_between(b, "SET", "WHERE|FROM")), lambda a: F.split(a, r"\s*=\s*", 2))
    found = (
        F.when((verb == "SELECT") & into.isNotNull(), flows(met(_listed(asked), _listed(into)), True))
        .when((verb == "INSERT") & given.isNotNull(), flows(met(_listed(named), _listed(given)), False))
        .when(verb == "UPDATE", flows(met(F.transform(set_, lambda a: a[0]), F.transform(set_, lambda a: F.coalesce(F.get(a, F.lit(1)), F.lit("")))), False))
    )
    return blocks(members, "SQL").select("path", "line", F.explode(found).alias("f")).select("path", "line", "f.*")


def cics_facts(members: DataFrame) -> DataFrame:
    """What CICS commands call, read, write, use and start; a target in a variable needs review."""
    b = F.col("body")
    verb = F.upper(F.regexp_extract(b, r"^\s*([A-Za-z]+)", 1))
    arg = lambda option: F.regexp_extract(b, rf"(?i)\b(?:{option})\s*\(\s*('[^']*'|\"[^\"]*\"|[A-Za-z][\w-]*)\s*\)", 1)
    tried = F.coalesce(*[F.when(verb.isin(verbs), F.struct(F.lit(rel).alias("rel_type"), F.lit(kind).alias("target_type"), arg(option).alias("raw"))) for verbs, option, rel, kind in COMMANDS])
    literal = F.col("f.raw").rlike("^['\"]")
    each = blocks(members, "CICS").select("path", "line", F.col("own").alias("source"), tried.alias("f")).where("f.raw <> ''")
    return each.select("path", "line", "source", "f.rel_type", "f.target_type", F.upper(T.unquoted(F.col("f.raw"))).alias("target"), F.when(literal, 1.0).otherwise(0.3).alias("confidence"), F.when(literal, "confirmed").otherwise("needs_review").alias("status"))


def csd_facts(members: DataFrame) -> DataFrame:
    """Transactions and the programs that they start."""
    parts = F.split(F.coalesce("text", F.lit("")), r"(?i)(?=DEFINE\s)", -1)
    each = members.select("path", F.explode(_lined(parts)).alias("p"))
    name = lambda rx: F.upper(F.regexp_extract("p.part", rf"(?is){rx}\s*\(\s*([A-Z0-9$#@]+)\s*\)", 1))
    return each.select("path", F.col("p.line"), name(r"^DEFINE\s+TRANSACTION").alias("source"), F.lit("STARTS").alias("rel_type"), F.lit("program").alias("target_type"), name(r"\bPROGRAM").alias("target"), F.lit(1.0).alias("confidence"), F.lit("confirmed").alias("status")).where("source <> '' AND target <> ''")


def data_items(members: DataFrame) -> DataFrame:
    """(path, line, level, name, pic, usage, redefines, occurs, bytes): a layout's items in order.

    A line is an entry if, after a sequence number if there is one, its first word is a level number (two digits) and
    the second a name; clauses are read from the words that follow.
    """
    bare = F.regexp_replace("l", r"^[0-9]{6}(?= |$)", "")
    words = F.split(F.regexp_replace(F.trim(F.upper(bare)), r"\.\s*$", ""), r"\s+")
    each = members.select("path", F.posexplode(T.lines(code(F.coalesce("text", F.lit("")), "cobol"))).alias("k", "l")).select("path", "k", words.alias("w"))
    each = each.where((F.size("w") > 1) & F.get("w", F.lit(0)).rlike("^[0-9]{2}$") & F.get("w", F.lit(1)).rlike(r"^[A-Z][A-Z0-9_-]*$"))

    def after(*marks: str) -> Column:
        """The word after the first of marks, past IS; null without."""
        at = F.array_position(F.transform("w", lambda x: x.isin(*marks)), True).cast("int")
        nxt = F.get("w", at)
        return F.when(at > 0, F.when(nxt == "IS", F.get("w", at + 1)).otherwise(nxt))

    usage = F.get(F.filter("w", lambda x: x.isin("BINARY", "COMP", "COMPUTATIONAL", *[f"{c}-{k}" for c in ("COMP", "COMPUTATIONAL") for k in range(1, 6)])), F.lit(0))
    pic = after("PIC", "PICTURE")
    return each.select("path", (F.col("k") + 1).alias("line"), F.get("w", F.lit(0)).cast("int").alias("level"), F.get("w", F.lit(1)).alias("name"), pic.alias("pic"), usage.alias("usage"), after("REDEFINES").alias("redefines"), after("OCCURS").try_cast("int").alias("occurs"), T.pic_length(pic, usage).alias("bytes"))


def with_parents(items: DataFrame) -> DataFrame:
    """data_items() with the group that each stands in: the nearest item above of a lower level; 01 and 77 have none.

    A member's items are one record's: one fold over them keeps the stack of open groups, of lower levels only.
    """
    entry = "struct<level:int,name:string>"
    start = F.struct(F.array().cast(f"array<{entry}>").alias("open"), F.array().cast("array<struct<line:int,parent:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        above = F.filter(s["open"], lambda g: g["level"] < x["level"])
        parent = F.when(~x["level"].isin(1, 77), F.try_element_at(above, F.lit(-1))["name"])
        return F.struct(F.array_append(above, F.struct(x["level"].alias("level"), x["name"].alias("name"))).alias("open"), F.array_append(s["out"], F.struct(x["line"].alias("line"), parent.alias("parent"))).alias("out"))

    held = items.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "level", "name"))).alias("all"))
    found = held.select("path", F.explode(F.aggregate("all", start, step, lambda s: s["out"])).alias("x"))
    return items.join(found.select("path", "x.line", "x.parent"), ["path", "line"])


def record_lengths(items: DataFrame) -> DataFrame:
    """Estimated bytes of each member's records: elementary items that don't redefine others."""
    counts = F.col("pic").isNotNull() & F.col("redefines").isNull() & (F.col("level") != 88)
    return items.groupBy("path").agg(F.sum(F.when(counts, F.col("bytes")).otherwise(0)).alias("bytes"), F.count(F.lit(1)).alias("items"))
