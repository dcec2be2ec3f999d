"""A stream of members: new, changed, unchanged, binary and gone ones, and a batch that runs again."""

import os
import time

from pyspark.sql import functions as F

from stratalens.operators import members
from stratalens.streaming import rescan


def _put(folder, name, text, when):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    os.utime(path, (when, when))


def _program(*calls):
    return "PROGRAM-ID. P.\nPROCEDURE DIVISION.\nA-PARA.\n" + "".join(f"    CALL '{c}'.\n" for c in calls)


def test_rescans_replace_what_a_member_said(spark, tmp_path):
    src, table, ck, log = (str(tmp_path / n) for n in ("src", "table", "ck", "log"))
    os.makedirs(src)
    listener = rescan.Progress(spark, log)
    spark.streams.addListener(listener)

    def calls():
        return sorted((os.path.basename(r.path), r.target) for r in rescan.facts(spark, table, members.FACTS).where("kind = 'CALLS'").collect())

    def run():
        rescan.keep(rescan.arriving(spark, src), table, ck, members.cobol_facts, members.FACTS).awaitTermination()
        return {os.path.basename(r.path): (r.state, r.batch) for r in rescan.states(spark, table).collect()}

    t = time.time() - 1000
    _put(src, "a.cbl", _program("X", "Y"), t)
    _put(src, "b.cbl", _program("Z"), t)
    _put(src, "bin", bytes(range(256)) * 4, t)
    first = run()
    assert {k: v[0] for k, v in first.items()} == {"a.cbl": "materialized", "b.cbl": "materialized", "bin": "unsupported"}
    assert calls() == [("a.cbl", "X"), ("a.cbl", "Y"), ("b.cbl", "Z")]
    os.makedirs(os.path.join(src, "more"))
    _put(src, "more/c.cbl", _program("W"), t + 10)
    second = run()
    assert second["a.cbl"] == first["a.cbl"] and second["c.cbl"][1] > first["a.cbl"][1] and ("c.cbl", "W") in calls()
    # a batch given directly: a changed, b as it was; and the same batch again
    rows = [(next(r.path for r in rescan.states(spark, table).collect() if r.path.endswith(n)), s) for n, s in (("a.cbl", _program("NEW")), ("b.cbl", _program("Z")))]
    batch = spark.createDataFrame([(p, s.encode()) for p, s in rows], "path string, content binary").withColumn("modified", F.current_timestamp())
    for _ in range(2):
        rescan.merge(batch, 7, table, members.cobol_facts, members.FACTS)
        got = {os.path.basename(r.path): (r.state, r.batch, r.facts) for r in rescan.states(spark, table).collect()}
        assert got["a.cbl"][:2] == ("materialized", 7) and got["b.cbl"][1] == first["b.cbl"][1] and got["a.cbl"][2] > 0
        assert calls() == [("a.cbl", "NEW"), ("b.cbl", "Z"), ("c.cbl", "W")]
    left = rescan.states(spark, table).where("path NOT LIKE '%b.cbl'").select("path")
    assert rescan.purge(spark, table, left) == 1 and rescan.purge(spark, table, left) == 0
    assert calls() == [("a.cbl", "NEW"), ("c.cbl", "W")]
    rescan.merge(batch, 9, table, members.cobol_facts, members.FACTS)
    assert ("b.cbl", "Z") in calls()
    spark.streams.removeListener(listener)
    seen = {(r.phase, r.rows > 0) for r in rescan.progress(spark, log).collect()}
    assert ("started", False) in seen and ("ended", False) in seen and ("addBatch", True) in seen and ("triggerExecution", True) in seen
    assert rescan.states(spark, str(tmp_path / "nothing")).count() == 0 and rescan.purge(spark, str(tmp_path / "nothing"), left) == 0
