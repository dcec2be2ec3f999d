"""What is near many roots is counted by bits: same counts as by rows, and no row for a root and a vertex."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalens.operators import condense
from stratalens.operators import graph as G
from stratalens.operators.estate_graph import Estate

COUNTS = ("root", "assets", "programs", "data", "unresolved", "risk")


@pytest.fixture
def estate(spark):
    deal = random.Random(7)
    rows = [(f"JOB:J{i}", "EXECUTES", f"PROGRAM:P{i}", 1.0, "confirmed") for i in range(150)]
    rows += [(f"PROGRAM:P{i}", "USES_COPYBOOK", f"COPYBOOK:C{i % 3}", 1.0, "confirmed") for i in range(300)]
    rows += [(f"PROGRAM:P{deal.randrange(300)}", "READS_TABLE", f"TABLE:T{deal.randrange(40)}", 1.0, "confirmed") for _ in range(200)]
    # some calls twice, one of itself, some of what is no asset
    rows += [(f"PROGRAM:P{deal.randrange(300)}", "CALLS", f"PROGRAM:P{150 + deal.randrange(160)}", 0.5, deal.choice(("inferred", "needs_review"))) for _ in range(300)] * 2
    rows += [("PROGRAM:P9", "CALLS", "PROGRAM:P9", 0.5, "inferred"), (None, "CALLS", "PROGRAM:P8", 0.5, "inferred")]
    r = spark.createDataFrame(rows, "source_id string, rel_type string, target_id string, confidence double, status string")
    ids = {x for row in rows for x in (row[0], row[2]) if x and not (x.startswith("PROGRAM:P3") and len(x) == 12)}
    assets = spark.createDataFrame([(x, x.split(":")[0], x.split(":")[1]) for x in sorted(ids)] + [("PROGRAM:LONE", "PROGRAM", "LONE")], "asset_id string, asset_type string, name string")
    return Estate(assets, r)


@pytest.mark.parametrize("depth", (0, 1, 2, 3))
def test_counts_by_bits_are_those_of_rows(estate, monkeypatch, depth):
    monkeypatch.setattr(condense, "BLOCK", 64)
    monkeypatch.setattr(condense, "LIST", 20)
    monkeypatch.setattr(condense, "CHUNK", 64)
    # the way by rows, where the limit cuts nothing
    want = estate.root_summary(depth=depth, limit=100_000).select(*COUNTS)
    got = estate.root_summary(depth=depth, limit=None).select(*COUNTS)
    assert want.count() > 64 and sorted(got.collect()) == sorted(want.collect())


def test_no_row_is_written_for_a_root_and_a_vertex(estate, monkeypatch):
    rows, real = [], G.Rounds.write

    def write(self, df):
        back = real(self, df)
        rows.append(back.rows)
        return back

    monkeypatch.setattr(G.Rounds, "write", write)
    near = estate.root_summary(depth=2, limit=None).agg(F.sum("assets")).first()[0]
    assert near > 8 * max(rows)


def test_no_roots_no_rows(spark, estate):
    estate.relationships = estate.relationships.where("rel_type <> 'EXECUTES'")
    assert estate.root_summary(depth=2, limit=None).isEmpty()


@pytest.mark.parametrize("vertices", (10_000, 10_000_000, 400_000_000))
def test_a_blocks_bits_keep_within_their_bound(vertices):
    width = condense._width(2_000_000, vertices, 12, 2)
    assert width % 64 == 0 and (width == 64 or width // 8 * vertices <= condense.HELD) and condense._width(2_000_000, vertices, 12, 8) <= width


@pytest.mark.parametrize("last", (False, True))
def test_a_task_holds_a_blocks_bits_once(last):
    vertices, words, most = 1_200_000, 16, condense.LIST
    lists = [list(range(k, min(k + most, vertices + 1))) for k in range(0, vertices + 1, most)]
    col = lambda x, t: pa.array([x] * len(lists), t)
    near = pa.RecordBatch.from_arrays([col(0, pa.int64()), col(1, pa.int32()), col(0, pa.int64()), col(b"\xff" * 8 * words, pa.binary()), pa.array(lists, pa.list_(pa.int32())), col([], pa.list_(pa.int32()))], names=["b", "part", "x", "bits", "ys", "zs"])
    tracemalloc.start()
    got = sum(b.num_rows for b in condense._walked(vertices, words, [(0, 0, vertices)], last)(iter([near])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    held = (vertices + 1) * words * 8 * (1 if last else 2)
    assert got == (64 * words if last else vertices + 1) and peak < 1.5 * held
