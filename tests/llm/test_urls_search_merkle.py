"""Redirect equivalence, windowed search and the Merkle manifest against plain versions and on hard inputs."""

import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalens.llm import merkle, search, urls
from stratalens.llm.components import components
from stratalens.llm.common import Stages

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("bad.example", "/", "block"), ("ok.example", "/", "allow")]


def _judged(spark, rows, rules=RULES, redirects=None):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, node string, links string")
    known = spark.createDataFrame(redirects, "from_url string, to_url string") if redirects else None
    out = urls.judge(pages, spark.createDataFrame(rules, "host string, path string, action string"), known).collect()
    return {r.page_id: r for r in out}


def _pages(*pairs):
    return [(k, u, h, "x", "y", "z") for k, (u, h) in enumerate(pairs)]


def canon(u):
    return f'<html><head><link href="{u}" rel="canonical"></head>'


def test_rules_fit_by_host_and_path(spark):
    got = _judged(spark, _pages(("http://A.Example.NET/en/1", None), ("http://example.net/de/1", ""), ("https://x.org/fr", ""), ("https://x.org/fr/?q=/de/", ""), ("http://notexample.com/de/", ""), ("http://example.com/de/?a", ""), ("http://net", ""), (None, ""), ("mailto:a", ""), ("//net/x", "")))
    assert [got[k].verdict for k in range(10)] == ["allow", "block", "allow", "allow", "allow", "block", "allow", "allow", "allow", "allow"]
    assert [got[k].rule for k in range(10)] == ["example.net/en/", "net/", None, "org/fr/", None, "example.com/de/", None, None, None, None]
    assert (got[0].host, got[0].path, got[6].host, got[6].path, got[7].host, got[8].path) == ("a.example.net", "/en/1", "net", "", "", "")


def test_longest_rule_and_both_ways(spark):
    rules = [("a.b", "/x", "block"), ("b", "/x/yy", "allow"), ("c", "/", "block"), ("c", "/", "allow"), (None, "/", "block"), ("", "/", "block"), ("e", None, "block"), ("d.e", "/x", "allow"), ("e", "/x/f", "block")]
    got = _judged(spark, _pages(("h://a.b/x/yy", ""), ("h://a.b/x/y", ""), ("h://c/", ""), ("h://d.e/x/f", "")), rules)
    # of a.b/x (5) and b/x/yy (6) the longer decides; of d.e/x and e/x/f (5 each) that of the longer host
    assert [(got[k].rule, got[k].verdict) for k in range(4)] == [("b/x/yy", "allow"), ("a.b/x", "block"), ("c/", "allow"), ("d.e/x", "allow")]


def test_blocks_go_to_aliases_and_allows_stay(spark):
    rows = _pages(
        ("http://a.test/1", canon("http://BAD.example/home")),  # its canonical address is blocked
        ("http://b.test/2", '<META CONTENT="0; URL=\'http://a.test/1#top\'" HTTP-EQUIV=Refresh>'),  # leads to that page
        ("http://ok.example/3", canon("http://a.test/1")),  # allowed by rule, in the same component
        ("http://c.test/4", "<!-- " + canon("http://bad.example/") + " --> <script>" + canon("http://bad.example/") + "</script>"),
        ("http://c.test/5", canon("/4")),
        ("http://c.test/6", canon("../4?x=1&amp;y=2")),
        ("http://d.test", canon("http://d.test/")),
        ("http://e.test/8", canon("http://ok.example/9")),  # an allow isn't carried, nor is a block by way of nothing
        ("http://f.test/9", "<link rel=stylesheet href=http://bad.example/>"),
        ("http://f.test/10", canon("http://[bad")),
        ("http://g.test/11#here", None),
    )
    got = _judged(spark, rows, redirects=[("http://g.test/11", "http://c.test/6"), (None, "http://x"), ("http://c.test/4?x=1&y=2", "http://b.test/2")])
    assert [got[k].verdict for k in range(11)] == ["block", "block", "allow", "allow", "allow", "block", "allow", "allow", "allow", "allow", "block"]
    assert got[0].component == got[10].component is not None and got[4].component == got[3].component != got[0].component
    assert got[6].component is None and got[0].rule is None


def test_a_hub_and_a_chain_of_aliases(spark):
    hub = [(f"http://s{k}.test/", canon("http://hub.test/")) for k in range(300)]
    chain = [(f"http://t.test/{k}", canon(f"http://t.test/{k + 1}")) for k in range(60)]
    got = _judged(spark, _pages(*hub, *chain, ("http://hub.test/", canon("http://bad.example/x")), ("http://t.test/60", canon("http://bad.example/"))))
    assert {r.verdict for r in got.values()} == {"block"} and len(got) == 362


def test_components_of_strings(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "e"), ("f", "f")], "a string, b string")
    assert {r.v: r.comp for r in components(edges, Stages(spark, "t")).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}


def test_no_pages_no_rules(spark):
    assert _judged(spark, []) == {}
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert urls.judge(pages, spark.createDataFrame([], "host string, path string, action string"), html=None).collect()[0].verdict == "allow"


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k=10):
    split = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(split(t))) for i, t in docs if split(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            n = sum(c.values())
            m = 25 + 75 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in split(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [8, 8192])
def test_search_as_plainly_ranked(spark, window):
    rng = random.Random(3)
    words = [*(f"w{k}" for k in range(30)), "Été", "été", "ÉTÉ", "İ", "A1", "a1", "naïve-ly", "漢字"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + rng.choice(["", ".", "!x", "\u0085"])
    ids = [*range(-5, 60), 10**15, 10**15 + 1, -(10**12), None, None, *[7] * 40]
    docs = [(i, text(rng.randint(0, 40))) for i in ids] + [(99, None), (98, ""), (97, "?!"), (96, "w1 " * 5000), (None, "w2 w3")]
    docs += [(3, "same same w5")] * 15
    items = [(k, text(rng.randint(1, 8))) for k in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (None, "w2 w2 same")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string").repartition(5)
    found = search.top_documents(df, spark.createDataFrame(items, "item_id long, text string"), window=window)
    got = sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == plain_search(docs, items)


def test_search_of_nothing_and_blocks_of_items(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "d")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (1, "c"), (2, "b")], "item_id long, text string")
    assert search.top_documents(docs.limit(0), items).count() == 0
    assert search.top_documents(docs, items.limit(0)).count() == 0
    monkeypatch.setattr("stratalens.llm.decontam.BLOCK_CHARS", 1)
    rows = search.top_documents(docs, items).collect()
    assert sorted((r.item_row, r.item_id, r.rank, r.doc_id) for r in rows) == [(0, 1, 1, 1), (1, 1, 1, 2), (2, 2, 1, 1), (2, 2, 2, 2)]


def test_windows_are_cut_by_range_and_size():
    batch = pa.RecordBatch.from_arrays([pa.array([-1, 0, 1, 1, 1, 1, 1, 9, 10, None], pa.int64())], names=["id"])
    assert [[b.column(0).to_pylist() for b in w] for w in search.windows(iter([batch.slice(0, 4), batch.slice(4)]), 10, 3)] == [[[-1]], [[0, 1, 1]], [[1, 1, 1]], [[9]], [[10]], [[None]]]


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def framed(*fields):
    return H("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(leaves):
    """(root, siblings of each leaf with their sides)."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for p, i in zip(paths, at, strict=True):
            if i ^ 1 < len(level):
                p.append(level[i ^ 1])
        level = [H("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], paths


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, framed(r[0], r[1], r[2], r[3], r[4])))
    trees, order = {}, sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[g] = plain_tree([d for _, d in groups[g]])
    root, above = plain_tree([trees[g][0] for g in order])
    return sorted(((r[0], d, trees[g][0], root, H("".join(p + up))) for g, up in zip(order, above, strict=True) for (r, d), p in zip(groups[g], trees[g][1], strict=True)), key=repr)


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_as_plainly_built(spark, height):
    rng = random.Random(5)
    langs = [None, "", "de", "é", "\U0001f642", "\uffff", "zz"]
    rows = [(rng.choice([None, *range(-3, 40)]), rng.choice([None, "s", "t:1"]), rng.choice(langs[:5] + ["de"] * 8), rng.choice([None, 5, 2**63 - 1]), rng.choice([None, "", "é漢", "x" * 3000])) for _ in range(150)]
    rows += [(1, "s", "de", 5, "copy")] * 40 + [(2, "s", "\uffff", 1, "alone"), (3, None, "zz", 1, "a"), (4, None, "zz", 2, "b"), (5, None, "zz", 2, "c")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g string").repartition(3)
    leaf = merkle.leaf_of(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text")))
    m = merkle.manifest(df, "doc_id", "lang", leaf, F.when(F.col("doc_id") == 1, F.lit("0" * 64)), height)
    out = m.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("p"), merkle.folded(F.col("leaf"), F.col("path")).alias("f"), merkle.folded(F.coalesce("forged", "leaf"), F.col("path")).alias("bad")).collect()
    assert sorted((tuple(r)[:5] for r in out), key=repr) == plain_manifest(rows)
    assert all(r.f == r.root and (r.bad == r.root) == (r.doc_id != 1) for r in out)


def test_manifest_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, lang string")
    r = merkle.manifest(df, "doc_id", "lang", merkle.leaf_of(F.col("doc_id"))).collect()
    assert len(r) == 1 and r[0].leaf == r[0].subroot == r[0].root == H("1:1") and list(r[0].path) == []
    assert merkle.manifest(df.limit(0), "doc_id", "lang", merkle.leaf_of(F.col("doc_id"))).count() == 0
