"""Token ids in binary shards, each a wavelet matrix (operator 6).

A shard holds documents in ascending order of id.  Its token ids are numbered by frequency, and the numbers' bits are
kept in planes, highest first; below each plane the sequence is parted stably into zeros and ones.  With a count of ones
before each 512 bits, a plane answers rank and select, and so the shard answers: the token at a place, how often a token
occurs before a place, and where its k-th occurrence is, from the one file.

File, all numbers little-endian: 8 bytes `WAVEMTX1`; 4 bytes, the length of a JSON head; the head (`tokens`, `docs`,
`planes`, and for each section its length, compressed with zstandard); then the sections `ids` (int64), `nulls` (uint8),
`lengths` (uint32), `alphabet` (uint32, in order of number) and, for each plane, `zeros` in the head and its packed bits.

Edge cases: a null or empty text holds the end id alone; null ids come first; a text of any length stays in one shard;
repeated rows are documents of their own, rows of one id are ordered by hash of the text; extra columns of any name are
left out; an empty table has no shard and gives an empty result.
"""

from __future__ import annotations

import gc
import json
import os
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import RUNS
from .common import Stages, small_batches

MAGIC = b"WAVEMTX1"
BLOCK = 512
#: A shard is closed once it holds so many tokens.
SHARD_TOKENS = 2_000_000


class WaveletMatrix:
    """A sequence of token ids as bit planes."""

    def __init__(self, alphabet: np.ndarray, planes: list[np.ndarray], zeros: list[int], n: int):
        self.alphabet, self.planes, self.zeros, self.n = alphabet, planes, zeros, n
        self.number = None
        self.ones: list[np.ndarray] | None = None

    @classmethod
    def build(cls, tokens: np.ndarray) -> WaveletMatrix:
        count = np.bincount(tokens) if len(tokens) else np.empty(0, np.int64)
        used = np.flatnonzero(count)
        alphabet = used[np.argsort(-count[used], kind="stable")].astype(np.uint32)
        number = np.zeros(len(count), np.uint32 if len(alphabet) > 1 << 16 else np.uint16)
        number[alphabet] = np.arange(len(alphabet))
        now = number[tokens] if len(tokens) else np.empty(0, np.uint16)
        planes, zeros = [], []
        for k in range(max(0, len(alphabet) - 1).bit_length() - 1, -1, -1):
            bit = (now & now.dtype.type(1 << k)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            # by places, as picking by truth values costs twice as much where these follow no order
            low, high = np.flatnonzero(~bit), np.flatnonzero(bit)
            zeros.append(len(low))
            now = np.concatenate([now.take(low), now.take(high)])
        return cls(alphabet, planes, zeros, len(tokens))

    def tokens(self) -> np.ndarray:
        """The whole sequence, plane by plane from below."""
        now = np.zeros(self.n, np.uint32 if len(self.planes) > 16 else np.uint16)
        for k, (plane, z) in enumerate(zip(self.planes[::-1], self.zeros[::-1], strict=True)):
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            up = np.empty_like(now)
            up[np.flatnonzero(~bit)] = now[:z]
            up[np.flatnonzero(bit)] = now[z:] | (1 << k)
            now = up
        return self.alphabet[now] if self.n else np.empty(0, np.uint32)

    def _index(self) -> None:
        if self.ones is None:
            self.ones = []
            for plane in self.planes:
                padded = np.zeros(-(-self.n // BLOCK) * BLOCK // 8, np.uint8)
                padded[: len(plane)] = plane
                self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64))]))
            self.number = {int(t): i for i, t in enumerate(self.alphabet)}

    def _rank(self, k: int, i: int) -> int:
        """Ones before place i of plane k."""
        b, plane = i // BLOCK, self.planes[k]
        full = plane[b * BLOCK // 8 : i // 8]
        more = int(plane[i // 8] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0
        return int(self.ones[k][b]) + int(np.bitwise_count(full).sum()) + more

    def _select(self, k: int, bit: int, j: int) -> int:
        """The place of the j-th (from 0) such bit of plane k."""
        lo, hi = 0, self.n - 1
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank(k, mid + 1)
            if (ones if bit else mid + 1 - ones) > j:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        """The token at place i."""
        self._index()
        code = 0
        for k, z in enumerate(self.zeros):
            bit = int(self.planes[k][i // 8]) >> i % 8 & 1
            ones = self._rank(k, i)
            i = z + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _walk(self, token: int, i: int) -> tuple[int, int] | None:
        self._index()
        code = self.number.get(token)
        if code is None:
            return None
        lo = 0
        for k, z in enumerate(self.zeros):
            a, b = self._rank(k, lo), self._rank(k, i)
            if code >> (len(self.zeros) - 1 - k) & 1:
                lo, i = z + a, z + b
            else:
                lo, i = lo - a, i - b
        return lo, i

    def rank(self, token: int, i: int) -> int:
        """How often token occurs before place i."""
        got = self._walk(token, i)
        return got[1] - got[0] if got else 0

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """The place of the j-th (from 0) occurrence of token."""
        if not 0 <= j < self.count(token):
            raise IndexError(j)
        at, code = self._walk(token, self.n)[0] + j, self.number[token]
        for k in range(len(self.zeros) - 1, -1, -1):
            bit = code >> (len(self.zeros) - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, j) for j in range(self.count(token))]


def dump(ids: list[int | None], lengths: list[int], tokens: np.ndarray) -> bytes:
    """A shard file."""
    m = WaveletMatrix.build(tokens)
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [np.array([i or 0 for i in ids], "<i8"), np.array([i is None for i in ids], "u1"), np.array(lengths, "<u4"), m.alphabet.astype("<u4"), *m.planes]
    packed = [pack(p.tobytes()) for p in parts]
    head = json.dumps({"tokens": m.n, "docs": len(ids), "planes": len(m.planes), "zeros": m.zeros, "sections": [len(p) for p in packed]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *packed])


class Shard:
    """A shard file's content: ids, starts of documents, and the matrix."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard file")
        at = 12 + int.from_bytes(data[8:12], "little")
        head = json.loads(data[12:at])
        parts = []
        for size in head["sections"]:
            parts.append(zstandard.ZstdDecompressor().decompress(data[at : at + size]))
            at += size
        nulls = np.frombuffer(parts[1], "u1")
        self.ids = [None if x else int(i) for i, x in zip(np.frombuffer(parts[0], "<i8"), nulls, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(parts[2], "<u4").astype(np.int64))])
        self.matrix = WaveletMatrix(np.frombuffer(parts[3], "<u4"), [np.frombuffer(p, np.uint8) for p in parts[4:]], head["zeros"], head["tokens"])


def store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it shows, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + n for n, b in enumerate(hidden)}


BYTE_LETTERS = byte_letters()


class TwoAges:
    """Packed ids by piece, in two generations: when the young one has `limit` entries, it becomes the old one."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def have(self, pieces: list[str]) -> list[bytes | None]:
        got = list(map(self.young.get, pieces))
        miss = [i for i, g in enumerate(got) if g is None]
        for i, g in zip(miss, list(map(self.old.get, [pieces[i] for i in miss])), strict=True):
            if g is not None:
                got[i] = self.young[pieces[i]] = g
        return got

    def keep(self, pieces: list[str], ids: list[bytes]) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young.update(zip(pieces, ids, strict=True))


class CachedTokenizer:
    """The tokenizers library, asked once for each piece of the chunks between spaces.

    No match of the pattern goes on from a character that isn't white space into white space, nor from letters into
    signs or back, so a chunk's ids are those of its parts: lines, and a word of letters and the signs after it.  Texts in
    which a run of white space would be cut, or with a special token's string, are given to the library whole.
    """

    def __init__(self, path: str, cache: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pre = json.loads(self.tokenizer.to_str())
        #: Whether a word of letters, with a space before it or none, is one piece whose bytes go to the model as they are.
        self.bare = pre["normalizer"] is None and pre["pre_tokenizer"]["type"] == "ByteLevel" and not pre["pre_tokenizer"]["add_prefix_space"]
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced, self.first, self.signs = TwoAges(cache), TwoAges(cache // 4), TwoAges(20_000)

    def _pack(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _pieces(self, ages: TwoAges, pieces: list[str], space: str) -> dict[str, bytes]:
        """The ids of distinct pieces, each with `space` before it."""
        got = ages.have(pieces)
        new = [p for p, g in zip(pieces, got, strict=True) if g is None]
        words = [p for p in new if self.bare and p.isalpha()]
        # all new words in one go to the letters that stand for their bytes
        letters = "\n".join(words).encode().decode("latin-1").translate(BYTE_LETTERS | {10: 10}).split("\n") if words else []
        lead, model = space.translate(BYTE_LETTERS), self.model.tokenize
        made = [array("I", [t.id for t in model(lead + x)]).tobytes() for x in letters]
        others = [p for p in new if not (self.bare and p.isalpha())]
        made += [self._pack(space + p) for p in others]
        ages.keep(words + others, made)
        return dict(zip(pieces, got, strict=True)) | dict(zip(words + others, made, strict=True))

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks, each with a space before it."""
        got = list(map(self.spaced.young.get, chunks))
        plan, heads, tails, signs = [], {}, {}, {"\n": None}
        for i, g in enumerate(got):
            if g is None:
                parts = []
                for k, line in enumerate(chunks[i].split("\n")):
                    body = line.rstrip(string.punctuation)
                    if not body.isalpha():
                        body = line
                        if line.split() != [line]:
                            # white space at a line's end or within may be one match with the line's end
                            parts, body = [], ""
                            break
                    (tails if k else heads)[body] = None
                    after = line[len(body) :]
                    if after:
                        signs[after] = None
                    parts.append((body, after))
                if not parts:
                    heads[chunks[i]] = None
                    parts = [(chunks[i], "")]
                plan.append((i, parts))
        head, tail, sign = (self._pieces(ages, list(want), space) for ages, want, space in ((self.spaced, heads, " "), (self.first, tails, ""), (self.signs, signs, "")))
        end = sign["\n"]
        for i, parts in plan:
            body, after = parts[0]
            ids = head[body] + sign[after] if after else head[body]
            for body, after in parts[1:]:
                ids += end + tail[body] + (sign[after] if after else b"")
            got[i] = ids
        return got

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all texts.  A chunk is looked up once a batch, not at each place."""
        whole = {k: self._pack(t) for k, t in enumerate(texts) if t and (RUNS.search(t) or any(s in t for s in self.special))}
        words = pc.split_pattern(pa.array(["" if k in whole else t or "" for k, t in enumerate(texts)], pa.string()), " ")
        starts, chunks = words.offsets.to_numpy(), words.flatten().dictionary_encode()
        at = chunks.indices.to_numpy().copy()
        packed = self._chunks(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
        # a text's first chunk has no space before it
        at[starts[:-1]] = np.arange(len(texts)) + len(packed)
        firsts = words.flatten().take(pa.array(starts[:-1])).to_pylist()
        packed += [whole[k] if k in whole else self._pack(w) if w else b"" for k, w in enumerate(firsts)]
        size = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
        flat, first = np.frombuffer(b"".join(packed), "<u4"), np.cumsum(size) - size
        each = size[at]
        end = np.cumsum(each)
        places = np.repeat(first[at] - (end - each), each) + np.arange(end[-1] if len(end) else 0)
        return np.diff(np.concatenate([[0], end])[starts]), flat[places]


_tokenizers: dict[str, CachedTokenizer] = {}


def tasks_for(df: DataFrame, task_bytes: int = 512 << 20, most: int = 100_000) -> int:
    """How many tasks df's rows go to: the session's shuffle partitions, and more where the plan's size asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most, size // task_bytes))


def write_shards(df: DataFrame, folder: str, tokenizer_path: str, end_id: int, id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write df's shards under folder; a row for each: part, seq (their order), path, n_docs, n_tokens.

    Files carry the attempt's number, so a task that is run again never changes a file that a row names.  The result
    must be written before use: working it out twice writes twice.
    """
    spark = df.sparkSession
    small_batches(spark)
    parts = tasks_for(df)
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = CachedTokenizer(tokenizer_path)
        own, context = _tokenizers[tokenizer_path], TaskContext.get()
        fs, base = store(folder)
        fs.create_dir(base, recursive=True)
        part, seq, end = context.partitionId(), 0, np.array([end_id], "<u4")
        ids, lengths, held, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            path = f"{base}/shard-{part:06d}-{seq:05d}-{context.taskAttemptId()}.wm"
            with fs.open_output_stream(path) as f:
                f.write(dump(ids, lengths, np.concatenate(held)))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([path]), pa.array([len(ids)], pa.int64()), pa.array([size], pa.int64())], names=["part", "seq", "path", "n_docs", "n_tokens"])

        collects = gc.isenabled()
        gc.disable()  # a batch makes many short-lived lists and no cycles; looking for those costs a fifth of the time
        try:
            for batch in batches:
                sizes, tokens = own.encode(batch.column(1).to_pylist())
                upto = np.cumsum(sizes)
                for i, n, e in zip(batch.column(0).to_pylist(), sizes.tolist(), upto.tolist(), strict=True):
                    ids.append(i)
                    lengths.append(n + 1)
                    held += [tokens[e - n : e], end]
                    size += n + 1
                    if size >= shard_tokens:
                        yield close()
                        ids, lengths, held, size = [], [], [], 0
                        seq += 1
        finally:  # also if the task fails or its rows aren't all asked for: a worker is used again
            if collects:
                gc.enable()
        if ids:
            yield close()

    return rows.mapInArrow(run, "part int, seq int, path string, n_docs long, n_tokens long")


def with_starts(manifest: DataFrame) -> DataFrame:
    """manifest with start, the tokens of all shards before.  Sums go by part, and then over parts, which are few."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n_tokens")
    return manifest.join(before, "part").withColumn("start", F.col("before") + own).drop("before")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = store(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(path) as f:
                    shard = Shard(f.read())
                data, s = memoryview(shard.matrix.tokens().astype("<u4").tobytes()), shard.starts
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(s[:-1].tolist(), s[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.ids, pa.int64()), pa.array(s[:-1] + start), pa.array(np.diff(s)), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    # manifest is written: a row a file, of some megabytes each
    parts = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.count() // 64)
    return manifest.repartition(parts, "path").select("path", "start").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def token_shards(df: DataFrame, tokenizer_path: str, end_id: int = 2, id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, str]:
    """The written manifest (with start) of df's shards, and their folder."""
    stages = Stages(df.sparkSession, "tokens")
    folder = stages.folder("shards")
    return with_starts(stages.write(write_shards(df, folder, tokenizer_path, end_id, id, text, shard_tokens), "manifest")), folder
