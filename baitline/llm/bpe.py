"""Byte-level BPE encoding and decoding (operator 6).

Each match of the pre-tokenising pattern is merged on its own. A segment tree
over the byte positions of the piece, 16 children to a node, holds in every node
the smallest (rank, position) of the pairs that start below it, so the root is
the leftmost pair of the lowest rank. A merge drops the right part and changes the pairs of
two live neighbours and its own: three point updates of logarithmic cost, so a
piece of n bytes takes O(n log n) even when it is one very long run.

Ranks are a fixed vocabulary file read once on the driver (about 1 MB) and sent
with the task; documents are never shuffled. Pieces repeat, so each Python
worker keeps the ids of pieces it has met, packed, up to a fixed number of short ones.

Null text is the empty text: no tokens, the hash of the empty string. Rows are
independent, so repeated rows, ties and other columns do not matter; columns
named like an output are replaced.
"""
from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

NO_RANK = 1 << 62
#: Children of a tree node.
WIDTH = 16
#: Pieces of at most CACHED_LENGTH characters are kept, CACHED_PIECES of them.
CACHED_LENGTH, CACHED_PIECES = 64, 400_000
#: Type of the packed ids.
PACKED = "I"
#: Pieces that are encoded in one go; texts of over LONG characters are not cut into all of theirs at once.
PIECES, LONG = 1 << 12, 1 << 20


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 token and rank per line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []  # a byte without a rank is a KeyError
    shift = n.bit_length()  # an entry is rank << shift | position, the least one the leftmost pair of the lowest rank
    low = (1 << shift) - 1
    ends = list(range(1, n + 1))    # of the live part that starts here
    before = list(range(-1, n - 1))  # start of the live part to the left
    rank_of = ranks.get
    leaves = [NO_RANK if (r := rank_of(piece[i:i + 2])) is None else r << shift | i for i in range(n - 1)]
    tree = [leaves]
    while len(tree[-1]) > WIDTH:
        below = tree[-1]
        tree.append([min(below[k:k + WIDTH]) for k in range(0, len(below), WIDTH)])
    inner, top = list(zip(tree, tree[1:])), tree[-1]

    while (best := min(top)) != NO_RANK:
        i = best & low
        j = ends[i]
        end = ends[i] = ends[j]
        left = before[i]
        r = None
        if end < n:
            before[end] = i
            r = rank_of(piece[i:ends[end]])
        leaves[i] = NO_RANK if r is None else r << shift | i
        if j < n - 1:
            leaves[j] = NO_RANK
        if left >= 0:
            r = rank_of(piece[left:end])
            leaves[left] = NO_RANK if r is None else r << shift | left
        if inner:
            for k in (min(j, n - 2), i, max(left, 0)):
                for level, above in inner:
                    k //= WIDTH
                    value = min(level[k * WIDTH:(k + 1) * WIDTH])
                    if above[k] == value:
                        break
                    above[k] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:ends[i]]])
        i = ends[i]
    return out


class Pieces(dict):
    """Piece -> its ids, packed four bytes each; made on demand, bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        got = array(PACKED, merge(piece.encode(), self.ranks)).tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = got
        return got


class Codec:
    """Encoder and decoder of one vocabulary; one per Python worker."""

    _made: dict[tuple[str, str], "Codec"] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, compiled = ranks, regex.compile(pattern)
        self.find, self.find_each = compiled.findall, compiled.finditer
        self.bytes = {i: b for b, i in ranks.items()}
        self.names = {i: str(i) for i in self.bytes}
        self.known = Pieces(ranks)

    @classmethod
    def of(cls, raw: bytes, pattern: str) -> "Codec":
        key = (hashlib.sha256(raw).hexdigest(), pattern)
        if key not in cls._made:
            cls._made[key] = cls(read_ranks(raw), pattern)
        return cls._made[key]

    def parts(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, those of so many pieces at a time."""
        found = iter(self.find(text)) if len(text) <= LONG else (m.group() for m in self.find_each(text))
        while part := list(islice(found, PIECES)):
            yield array(PACKED, b"".join(map(self.known.__getitem__, part))).tolist()

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for i in part]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def digests(self, text: str) -> tuple[int, str, str]:
        """The number of ids, and the digests of the ids and of the bytes they decode to."""
        n, listed, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.parts(text):
            if n:
                listed.update(b",")
            n += len(ids)
            listed.update(",".join(map(self.names.__getitem__, ids)).encode())
            decoded.update(self.decode(ids))
        return n, listed.hexdigest(), decoded.hexdigest()


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(text: Column, path: str, pattern: str) -> Column:
    """``array<int>``: the ids of each text."""
    raw = _vocabulary(path)

    @F.arrow_udf("array<int>")
    def ids(t: pa.Array) -> pa.Array:
        codec = Codec.of(raw, pattern)
        return pa.array([codec.encode(x) for x in texts(t)], pa.list_(pa.int32()))

    return ids(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """``binary``: the bytes that the ids stand for (null: none)."""
    raw = _vocabulary(path)

    @F.arrow_udf("binary")
    def data(x: pa.Array) -> pa.Array:
        codec = Codec.of(raw, pattern)
        return pa.array([codec.decode(row or []) for row in x.to_pylist()], pa.binary())

    return data(ids)


def digests(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256 of each whole text.

    Encodes and decodes in one Python stage, text by text and for a long one part by part,
    so few ids are held and none leave the worker; use ``encode`` and ``decode`` for the ids and bytes themselves.
    """
    raw = _vocabulary(path)

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def both(t: pa.Array) -> pa.Array:
        codec = Codec.of(raw, pattern)
        counts, listed, decoded = [], [], []
        for x in t:  # one text at a time: a batch holds thousands
            for out, value in zip((counts, listed, decoded), codec.digests(x.as_py() or "")):
                out.append(value)
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())],
            ["n_tokens", "ids_sha256", "decoded_sha256"])

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [c for c in df.columns if c.lower() not in names]
    got = df.select(*kept, both(F.col(text_col)).alias("__bpe"))
    return got.select(*kept, *[F.col(f"__bpe.{n}").alias(n) for n in names])
