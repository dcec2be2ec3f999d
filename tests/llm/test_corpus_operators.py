"""Operators over whole corpora, and the pipeline."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm import decontam, jaccard, langid, sharding, toxicity
from stratalens.llm.common import Stages
from stratalens.llm.components import components

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "so", "ve", "no") for b in ("n", "ra", "li", "st", "mo", "de", "ku", "pe", "x", "rt")]


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _sets(rows, n):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(n, len(w))
        out.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()))
    return out


def _brute(rows, n, num, den):
    sets = _sets(rows, n)
    comp = list(range(len(sets)))
    for _ in sets:
        was = comp[:]
        for x in range(len(sets)):
            for y in range(x):
                a, b = sets[x][1], sets[y][1]
                if a and b and den * len(a & b) >= num * len(a | b):
                    comp[x] = comp[y] = min(comp[x], comp[y])
        if comp == was:
            break
    least = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[comp[k] if s else -1 - k].append(i)
    return sorted(((i, len(s), min(least[comp[k] if s else -1 - k], default=None)) for k, (i, s) in enumerate(sets)), key=str)


def _families(rng):
    texts = []
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    for size in (2, 3, 30):
        base = [rng.choice(WORDS) for _ in range(rng.randint(15, 160))]
        for _ in range(size):
            t = base[:]
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(WORDS)
            texts.append(" ".join(t))
    texts += [texts[0]] * 3 + [passage + " " + " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 30))) for _ in range(12)]
    texts += ["", " \n", "one", "ONE", "one two", "Two one", "the\vquick\x0cbrown fox", "the quick brown fox"]
    return texts + [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 80))) for _ in range(40)]


@pytest.mark.parametrize("n,num,chunk", [(3, 90, 512), (5, 80, 512), (3, 90, 7)])
def test_components_are_those_of_brute_force(spark, monkeypatch, n, num, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)  # small chunks: hot groups are cut
    rng = random.Random(n)
    texts = _families(rng)
    rng.shuffle(texts)
    rows = [*enumerate(texts), (500, None), (3, texts[3]), (None, texts[5]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash"))
    got = jaccard.similarity_components(df, n=n, num=num, den=100, part=10 if n == 3 else 16).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == _brute(rows, n, num, 100)


def test_empty_tables(spark):
    empty = _docs(spark, ["x"]).limit(0)
    assert jaccard.similarity_components(empty).count() == 0
    assert sharding.shard(empty, ["doc_id"]).count() == 0
    assert decontam.find_leaks(empty, spark.createDataFrame([(1, "some item")], "item_id long, text string")).count() == 0


def test_tree_bound_never_loses_a_link():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 120)).astype(np.uint64) * np.uint64(7919)) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[2:], s[:1]])) for s in sets if len(s) > 3]
    points = np.stack([jaccard.count_vector(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = jaccard.CountTree(points, sizes)
    for i, s in enumerate(sets):
        found = set(tree.near(points[i], len(s), 80, 100).tolist())
        want = {j for j, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= 80 * len(np.union1d(s, o))}
        assert want <= found
        assert {j for j in found if jaccard.linked(s, sets[j], 80, 100)} == want


def test_drop_near_duplicates_keeps_one(spark):
    rng = random.Random(9)
    texts = _families(rng)
    rows = [*enumerate(texts), (0, texts[0]), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", F.lit(1))
    kept = jaccard.drop_near_duplicates(df)
    want = {c for _, _, c in _brute(list(enumerate(texts)), 5, 80, 100)}
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_components_of_paths_and_stars(spark):
    path = list(range(0, 40))
    random.Random(1).shuffle(path)
    edges = [(a, b) for a, b in zip(path, path[1:], strict=False)] + [(100, x) for x in range(101, 130)] + [(7, 7)]
    got = {r.v: r.comp for r in components(spark.createDataFrame(edges, "a long, b long"), Stages(spark, "test")).collect()}
    assert len({got[x] for x in range(40)}) == 1 and len({got[x] for x in range(100, 130)}) == 1 and got[0] != got[100]


def _distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        now = [i]
        for j, t in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (p != t)))
        row = now
    return min(row)


def test_myers_is_the_edit_distance():
    rng = random.Random(4)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 20)))
        t = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))
        masks = {c: sum(1 << i for i, x in enumerate(p) if x == c) for c in set(p)}
        assert decontam.myers_best(masks, len(p), t)[0] == _distance(p, t)


def test_leaks_within_the_budget_are_found(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(30))) for k in range(6)]
    docs, want = [], set()
    for d in range(40):
        text = " ".join(rng.choice(WORDS) for _ in range(80))
        if d % 3 == 0:
            k = rng.randrange(6)
            t = list(items[k][1])
            for _ in range(rng.randint(0, len(t) * 5 // 100)):
                x = rng.randrange(len(t))
                t[x : x + 1] = rng.choice(["", "q", "zz"[:1]])
            text = f"{text[:50]}\n {''.join(t).upper()}  {text[50:]}"
        docs.append(text)
    for d, text in enumerate(docs):
        for k, t in items:
            if _distance(decontam.fold(t), decontam.fold(text)) <= decontam.budget(len(decontam.fold(t)), 5):
                want.add((d, k))
    df = _docs(spark, [*docs, None, ""])
    bench = spark.createDataFrame([*items, (6, None), (7, "short")], "item_id long, text string")
    assert len(want) >= 14
    for size in (decontam.BLOCK_CHARS, 300):  # one block and many
        monkeypatch.setattr(decontam, "BLOCK_CHARS", size)
        assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench).collect()} == want
        left = decontam.without_leaks(df.withColumn("item_id", F.lit("clash")), bench)
        assert {r.doc_id for r in left.collect()} == set(range(42)) - {d for d, _ in want}


def test_rows_law_and_reproducible_places(spark):
    for n, same in ((0, 0), (1, 0), (3, 0), (100, 0), (50, 300), (1030, 0)):
        rows = [(i, f"t{i}") for i in range(n)] + [(None, None)] * same
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash"))
        got = sharding.shard(df, ["doc_id"], shards=8).collect()
        assert len(got) == n + same
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        sizes = [len(by[k]) for k in range(8)]
        assert max(sizes) - min(sizes) <= 1
        again = sharding.shard(df.repartition(3), ["doc_id"], shards=8).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))


def test_place_is_computable_from_the_row_number(spark):
    got = spark.range(997).select("id", sharding.permute(F.col("id"), F.lit(997), 5).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(997)) and sum(r.id == r.p for r in got) < 20


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    bad = ["idiot", "moron", "scum"]
    rows, labels = [], []
    for d in range(600):
        w = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
        toxic = d % 4 == 0
        if toxic:
            x = rng.choice(bad)
            w[rng.randrange(len(w))] = rng.choice([x, x.upper() + "!!", x.replace("i", "1").replace("o", "0"), x.replace("o", "о")])
        rows.append((d, " ".join(w)))
        labels.append((d, int(toxic)))
    rows += [(700, None), (701, ""), (702, "trash can " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms, curve = toxicity.learn(docs, spark.createDataFrame([*labels, (5, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs.withColumn("score", F.lit("clash")), terms, curve).select("doc_id", "score", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    out = [d for d in range(600) if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].h for d in out) and all((got[d].score >= 0.5) == (d % 4 == 0) for d in out)
    assert got[700].score == got[701].score < 0.5
    assert toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int")) == ({}, [])
    assert all(r.score == 0.0 for r in toxicity.score(docs, {}, []).collect())


def test_exception_phrases_and_folding():
    lex = toxicity.Lexicon({" trash ": 5.0, " idio": 4.0})
    assert lex.weigh("the trash can is full")[:2] == (0.0, 0)
    assert lex.weigh("you TRASH, 1d10tic")[:2] == (9.0, 2)
    assert toxicity.fold("ＭО0N $cum 2024 3") == " moon scum 2024 3 "


def test_language_evidence(spark):
    rng = random.Random(7)
    own = {"de": ["und", "nicht", "schiff", "haus"], "en": ["the", "ship", "house", "with"], "fr": ["avec", "maison", "bateau", "une"]}
    rows = [(i, " ".join(rng.choice(own[lang]) for _ in range(12)), lang) for i, lang in enumerate(sorted(own) * 40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", sorted(own))
    known = [(i, t, "a.example.fr" if lang == "fr" else "b.example.com", lang) for i, t, lang in rows]
    odd = [(900, "", "a.example.fr", None), (901, None, None, "de-DE"), (902, None, "x.at", None), (903, "the house with the ship", "a.example.fr", None), (904, None, None, None), (905, "", "c.example.fr", None)]
    df = spark.createDataFrame(known + odd, "doc_id long, text string, host string, declared string").withColumn("post", F.lit("clash"))
    got = {r.doc_id: r.language for r in langid.identify(df, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    assert (got[900], got[901], got[902], got[903], got[905]) == ("fr", "de", "de", "en", "fr") and got[904] in own
    assert langid.identify(df.limit(0), model).count() == 0
