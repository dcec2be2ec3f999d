"""Byte-level BPE encoding and decoding (operator 1).

A piece is merged over its byte positions.  A segment tree holds, for each position where a live part begins,
rank * width + position of the pair that begins there, so that the root is the leftmost pair of the lowest rank.
A merge changes at most three leaves: the merged part, the part swallowed, and the live neighbour to the left.

Edge cases: a null or empty text has no ids and decodes to no bytes; a text of any length is encoded whole;
repeated rows are encoded alike; columns named like the outputs are replaced, the text's own too; an empty table stays empty.
"""

from __future__ import annotations

import base64
import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, replaced, small_batches

NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * width)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank * width + i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            k >>= 1
            if other < value:
                value = other
            if tree[k] == value:
                return
            tree[k] = value

    after = list(range(1, n + 1))  # where the part that begins here ends, and the next live part begins
    before = list(range(-1, n - 1))
    while (best := tree[1]) != NONE:
        i = best % width
        j = after[i]
        end = after[i] = after[j]
        put(j, NONE)
        if end < n:
            before[end] = i
            rank = ranks.get(piece[i : after[end]])
            put(i, NONE if rank is None else rank * width + i)
        else:
            put(i, NONE)
        left = before[i]
        if left >= 0:
            rank = ranks.get(piece[left:end])
            put(left, NONE if rank is None else rank * width + left)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Generations(dict):
    """A bounded cache in two generations: when the young one is full, it becomes the old one."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: Where cutting a text before each space could part a run of white space.
RUNS = re.compile(r"\s (?:\s|\Z)")


class ChunkIds(dict):
    """Packed ids of the chunk between two spaces, with the space before it (or without, if `space` is empty).

    No match of the pattern goes on from a character that isn't white space into white space, nor from letters into
    signs or back, so a chunk's ids are those of its parts: lines, and a word of letters and the signs after it.
    Chunks but for those of more lines are kept, in two generations of `limit` entries.
    """

    def __init__(self, make, space: str, limit: int):
        super().__init__()
        self.make, self.space, self.limit, self.old, self.signs = make, space, limit, {}, {}
        self.line: ChunkIds | None = None if space == "" else ChunkIds(make, "", limit // 8)

    def _tail(self, signs: str) -> bytes:
        if len(self.signs) > 10_000:
            self.signs.clear()
        got = self.signs.get(signs)
        if got is None:
            got = self.signs[signs] = self.make(signs)
        return got

    def __missing__(self, chunk: str) -> bytes:
        value = self.old.get(chunk)
        if value is None:
            if "\n" in chunk:
                lines = chunk.split("\n")
                if self.line is not None and all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                    end = self._tail("\n")
                    return end.join([self[lines[0]], *map(self.line.__getitem__, lines[1:])])
            else:
                body = chunk.rstrip(string.punctuation)
                if len(body) < len(chunk) and body.isalpha():
                    value = self[body] + self._tail(chunk[len(body) :])
            if value is None:
                value = self.make(self.space + chunk)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[chunk] = value
        return value

    def text(self, text: str) -> bytes | None:
        """The text's packed ids; None if a cut could fall into a run of white space."""
        if RUNS.search(text):
            return None
        first, *rest = text.split(" ")
        return self.line[first] + b"".join(map(self.__getitem__, rest)) if first else b"".join(map(self.__getitem__, rest))


class BytePairCodec:
    """Encodes each match of the pattern separately, without special tokens; decodes ids to bytes."""

    def __init__(self, rank_path: str, pattern: str, cache: int = 300_000):
        self.ranks = load_ranks(rank_path)
        self.pattern = regex.compile(pattern)
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.chunks = ChunkIds(self._pack, " ", cache)

    def _pack(self, chunk: str) -> bytes:
        ids = array("i")
        for piece in self.pattern.findall(chunk):
            ids.extend(merge_piece(piece.encode(), self.ranks))
        return ids.tobytes()

    def encode_packed(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if not text:
            return b""
        packed = self.chunks.text(text)
        return self._pack(text) if packed is None else packed

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<i4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple, BytePairCodec] = {}


def codec(rank_path: str, pattern: str) -> BytePairCodec:
    """One codec for each Python worker."""
    key = (rank_path, pattern)
    if key not in _codecs:
        _codecs[key] = BytePairCodec(rank_path, pattern)
    return _codecs[key]


def encode_decode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """df with its text's ids (array of int) and the bytes that these ids decode to."""
    small_batches(df.sparkSession)
    keep, (own_text,) = replaced(df, [ids, decoded], text)
    schema = T.StructType([*keep.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_path, pattern)
        for batch in batches:
            packed = [own.encode_packed(t) for t in batch.column(own_text).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int64)
            flat = np.frombuffer(b"".join(packed), "<i4")
            back = [own.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(back, pa.binary())], names=[*batch.schema.names, ids, decoded])

    out = keep.mapInArrow(run, schema)
    return out if own_text == text else out.drop(own_text)


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with its text's ids."""
    back = fresh("decoded", *df.columns, ids)
    return encode_decode(df, rank_path, pattern, text, ids, back).drop(back)


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes of its ids; null ids are no ids."""
    small_batches(df.sparkSession)
    keep, (own_ids,) = replaced(df, [decoded], ids)
    schema = T.StructType([*keep.schema.fields, T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_path, pattern)
        for batch in batches:
            back = [own.decode(x or ()) for x in batch.column(own_ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], names=[*batch.schema.names, decoded])

    out = keep.mapInArrow(run, schema)
    return out if own_ids == ids else out.drop(own_ids)


def digests(encoded: DataFrame, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """n_tokens and the digests of the ids and of the decoded bytes, in place of both."""
    return encoded.select(
        *[c for c in encoded.columns if c not in (ids, decoded)],
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col(ids).cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
