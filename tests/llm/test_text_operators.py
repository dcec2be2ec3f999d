"""Operators on single texts against their libraries and brute force."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from stratalens.llm import bpe, quality, tokenbin

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
HARD = [
    "", " ", "  ", "a  b", "a   b", " \n a", "foo\n bar", "foo\n\n bar", "foo \nbar", "foo  ", "foo\n ", "\n \n", "x  y", "tab\t next", "it's we'll 'tis", "ünïcödé 漢字 🙂🙂", "12 345,6", "a" * 3000,
    "ab" * 1500 + " end", "<|endoftext|> is text", "   x", "z\x1c y", "\u0085 x", "é" * 700,
]


def _rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_encode_as_the_library_and_back(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("ab é\n\t .'1漢 ") for _ in range(60)) for _ in range(300)]
    got = bpe.encode_decode(_rows(spark, [*texts, None]), RANKS, P.PATTERN).orderBy("doc_id").collect()
    for r, t in zip(got, [*texts, ""], strict=True):
        assert r.token_ids == library.encode_ordinary(t), repr(t[:50])
        assert bytes(r.decoded) == t.encode()
    again = bpe.decode(bpe.encode(_rows(spark, HARD), RANKS, P.PATTERN), RANKS, P.PATTERN).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in again] == HARD


def test_segment_tree_merges_leftmost_lowest():
    ranks = {bytes([c]): c for c in range(97, 100)} | {b"aa": 200, b"ab": 201, b"aaa": 202}
    assert bpe.merge_piece(b"aaab", ranks) == [200, 201]
    assert bpe.merge_piece(b"aaa", ranks) == [202]
    assert bpe.merge_piece(b"cab", ranks) == [99, 201]


def test_digests_and_clashing_columns(spark):
    df = _rows(spark, ["one two", None]).withColumn("token_ids", F.lit("x")).withColumn("decoded", F.lit(3)).withColumn("extra", F.lit("e"))
    out = bpe.digests(bpe.encode_decode(df, RANKS, P.PATTERN)).orderBy("doc_id").collect()
    assert out[0].extra == "e" and out[0].decoded_sha256 == hashlib.sha256(b"one two").hexdigest()
    assert (out[1].n_tokens, out[1].ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.encode_decode(df.limit(0), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("n,letters", [(0, 5), (1, 1), (7, 1), (513, 3), (5000, 300), (2048, 70_000)])
def test_wavelet_matrix(n, letters):
    rng = np.random.default_rng(n)
    tokens = rng.integers(0, letters, n).astype(np.uint32)
    shard = tokenbin.Shard(tokenbin.dump([1, None], [n // 2, n - n // 2], tokens))
    m = shard.matrix
    assert (m.tokens() == tokens).all() and shard.ids == [1, None] and shard.starts.tolist() == [0, n // 2, n]
    for i in range(0, n, max(1, n // 40)):
        t = int(tokens[i])
        assert m.access(i) == t
        assert m.rank(t, i) == int((tokens[:i] == t).sum())
        assert m.select(t, m.rank(t, i)) == i
    if 0 < n < 1000:
        t = int(tokens[0])
        assert m.occurrences(t) == np.flatnonzero(tokens == t).tolist() and m.count(t) == int((tokens == t).sum())
    assert m.count(letters + 5) == 0


def test_shards_hold_the_librarys_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    rows = [(i * 3 % 41, t) for i, t in enumerate(HARD)] + [(50, None), (50, "twice"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    manifest, folder = tokenbin.token_shards(df, JSON, shard_tokens=50)
    assert manifest.count() > 3
    got = sorted(tokenbin.read_shards(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == sorted([r[0] for r in rows], key=lambda i: -1 if i is None else i)
    at, left = 0, Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    by = Counter((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in left.elements())
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert Counter((r.id, r.n_tokens, r.ids_crc32) for r in got) == by
    empty, folder = tokenbin.token_shards(df.limit(0), JSON)
    assert tokenbin.read_shards(empty, folder).count() == 0


def test_measures_against_brute_force():
    import re

    rng = random.Random(2)
    texts = ["", " \n ", "a", "a a a a", "A B!\nA B!\n \nA B!", "# $ x\v\fy", *("".join(rng.choice("ab \n#é") for _ in range(80)) for _ in range(200))]
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t) if w else 0, dup, len(cover))
        assert quality.measure(t)[:5] == want, repr(t)
    assert quality.measure(None) == quality.measure("")


PROSE = "The committee met on Tuesday to discuss the budget. Several members asked about roads, schools and water. No vote was taken, and they will meet again. "


def _prose(rng):
    words = PROSE.split()
    return " ".join(rng.choice(words) + str(rng.randint(0, 99)) * (rng.random() < 0.7) for _ in range(90)) + ".\nIt ended late."


def test_rules_are_weighed_and_junk_goes(spark):
    rng = random.Random(3)
    good = [_prose(rng) for _ in range(80)]
    symbols = [" ".join(w + "***" for w in _prose(rng).split()) for _ in range(8)]
    shouts = [_prose(rng).upper() for _ in range(12)]
    df = _rows(spark, [*good, *symbols, *shouts, None, "short"]).withColumn("quality", F.lit("label")).withColumn("n_words", F.lit(-1))
    kept = [r.doc_id for r in quality.keep_good(df).orderBy("doc_id").collect()]
    assert kept == list(range(80))
    assert quality.keep_good(df).columns == df.columns
    base = {r.doc_id: r.base_failed for r in quality.judge(df).collect()}
    assert base[100] and base[101] and not base[0]
    assert quality.judge(df.limit(0)).count() == 0
    post, info = quality.fit_votes(np.empty((0, 8)), np.empty(0))
    assert len(post) == 0 and info["share_good"] == pytest.approx(0.8)
