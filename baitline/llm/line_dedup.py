"""Line dedup (operator 9).

1. Every document gives the 128-bit hash (two 64-bit halves) of each distinct
   line key it holds; an aggregate with map-side combine counts documents and
   finds the largest doc_id per key. Keys in at least ``min_docs`` documents
   are the *repeated* keys.
2. Repeated keys are dealt to shards of about ``SHARD_KEYS`` keys. A task builds
   the shard's minimal perfect hash (levels of bit arrays, rank gives the
   index) and the arrays it indexes: 64-bit fingerprint, document count, keeper.
3. Documents probe the arrays; lines are never joined. A probe is a 16-byte
   hash and a doc_id. Probes are dealt by shard and *part* - about ``PART_PROBES``
   probes a part, whatever the number of shards - and each part gets a copy of its
   shard's arrays (bounded by ``SHARD_KEYS``). They meet sorted, so that the arrays
   come first and the probes stream by in batches.
   Hot keys - those with at least 1 / HOT_KEYS of all occurrences of repeated
   keys, so never more than HOT_KEYS of them - form one shard of bounded size
   that is broadcast, and their probes never leave the document's task.
4. The hits of a document come back to its text, and the lines go.

Rows are documents: rows that repeat a doc_id count each, and all rows of the
largest doc_id keep the line. A null doc_id is smaller than any other. Null
text is one empty line. An empty table gives an empty result. Other columns are
kept (``drop_lines``); those named like an output are replaced.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, signed, splitmix, texts

SHARD_KEYS = 16_384
PART_PROBES = 1 << 18
HOT_KEYS = 1_000
_SPACE = b" \t\n\r\x0b\x0c"
_NO_DOC = -(1 << 63)
_ARRAYS = "shard int, sizes binary, bits binary, prints binary, counts binary, keepers binary"


def line_key(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """The hash of a line's key as two signed halves; None for short keys."""
    if len(line) < min_chars:
        return None
    key = line.strip(_SPACE).lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    h = xxhash.xxh3_128_intdigest(key)
    return signed(h >> 64), signed(h & (1 << 64) - 1)


# --- minimal perfect hash -------------------------------------------------

def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = splitmix(h1 + splitmix(h2 + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15)))
    return (mixed % np.uint64(size)).astype(np.int64)


def build(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level sizes, bits of all levels, index of each key) for distinct keys."""
    sizes, levels, index = [], [], np.full(len(h1), -1, dtype=np.int64)
    left, level, base = np.arange(len(h1)), 0, 0
    while len(left):
        size = 2 * len(left) + 1
        at = _place(h1[left], h2[left], level, size)
        once = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(once) - 1
        mine = once[at]
        index[left[mine]] = base + rank[at[mine]]
        base += int(once.sum())
        sizes.append(size)
        levels.append(once)
        left, level = left[~mine], level + 1
    bits = np.concatenate(levels) if levels else np.zeros(0, dtype=bool)
    return np.array(sizes, dtype=np.int64), bits, index


class Shard:
    """A minimal perfect hash and the arrays it indexes."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, prints: np.ndarray,
                 counts: np.ndarray, keepers: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.prints, self.counts, self.keepers = prints, counts, keepers
        self.rank = np.cumsum(bits) - 1

    @classmethod
    def of(cls, h1, h2, counts, keepers) -> "Shard":
        h1, h2 = np.asarray(h1, np.int64).view(np.uint64), np.asarray(h2, np.int64).view(np.uint64)
        sizes, bits, index = build(h1, h2)
        prints, n, keep = np.empty(len(h1), np.uint64), np.empty(len(h1), np.int64), np.empty(len(h1), np.int64)
        prints[index], n[index], keep[index] = h2, counts, keepers
        return cls(sizes, bits, prints, n, keep)

    @classmethod
    def load(cls, sizes: bytes, bits: bytes, prints: bytes, counts: bytes, keepers: bytes) -> "Shard":
        level = np.frombuffer(sizes, np.int64)
        return cls(level, np.unpackbits(np.frombuffer(bits, np.uint8), count=int(level.sum())).astype(bool),
                   np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.int64),
                   np.frombuffer(keepers, np.int64))

    def dump(self) -> list[bytes]:
        return [self.sizes.tobytes(), np.packbits(self.bits).tobytes(), self.prints.tobytes(),
                self.counts.tobytes(), self.keepers.tobytes()]

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Index of each key in the arrays, -1 for keys the shard does not hold."""
        h1, h2 = np.asarray(h1, np.int64).view(np.uint64), np.asarray(h2, np.int64).view(np.uint64)
        found = np.full(len(h1), -1, dtype=np.int64)
        left, base = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _place(h1[left], h2[left], level, int(size)) + base
            hit = self.bits[at]
            slot = self.rank[at[hit]]
            same = self.prints[slot] == h2[left[hit]]
            found[left[hit][same]] = slot[same]
            left, base = left[~hit], base + int(size)
        return found


# --- the operator -----------------------------------------------------------

def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2): one row per row of ``docs`` and distinct key in it."""
    @F.arrow_udf("array<struct<h1: bigint, h2: bigint>>")
    def keys(t: pa.Array) -> pa.Array:
        out = []
        for x in texts(t):
            found = {line_key(line, min_chars) for line in x.encode().split(b"\n")}
            found.discard(None)
            out.append([{"h1": a, "h2": b} for a, b in found])
        return pa.array(out, pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64())])))

    return (docs.select("doc_id", keys("text").alias("k"))
            .select("doc_id", F.explode("k").alias("k")).select("doc_id", "k.h1", "k.h2"))


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n, keeper) of the keys in at least ``min_docs`` documents."""
    return (lines.groupBy("h1", "h2")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.max(F.coalesce("doc_id", F.lit(_NO_DOC))).alias("keeper"))
            .where(F.col("n") >= min_docs))


def _shard_of(n_shards: int):
    return F.pmod(F.xxhash64("h1", "h2"), F.lit(n_shards)).cast("int")


def shard_arrays(repeated: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard that holds keys: its minimal perfect hash and arrays."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def close():
            t = pa.Table.from_batches(held)
            made = Shard.of(*[t[c].to_numpy() for c in ("h1", "h2", "n", "keeper")])
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int32()), *[pa.array([x], pa.binary()) for x in made.dump()]],
                ["shard", "sizes", "bits", "prints", "counts", "keepers"])

        for batch in batches:
            ids = batch["shard"].to_numpy()
            cuts = np.flatnonzero(np.diff(ids)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                if lo == hi:
                    continue
                if held and ids[lo] != current:
                    yield close()
                    held = []
                current = int(ids[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield close()

    return (repeated.withColumn("shard", _shard_of(n_shards))
            .repartition("shard").sortWithinPartitions("shard").mapInArrow(rows, _ARRAYS))


def probe_shards(probes: DataFrame, arrays: DataFrame, n_shards: int, n_parts: int = 1) -> DataFrame:
    """Hits (doc_id, h1, h2): lines of documents that must go. ``n_parts``: parts of a shard's probes."""
    payload = ["sizes", "bits", "prints", "counts", "keepers"]
    part = F.pmod(F.xxhash64("doc_id", "h1"), F.lit(n_parts)).cast("int")
    asked = probes.select(_shard_of(n_shards).alias("shard"), part.alias("part"), F.lit(1).alias("kind"),
                          "doc_id", "h1", "h2", *[F.lit(None).cast("binary").alias(c) for c in payload])
    held = arrays.select("shard", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), F.lit(0).alias("kind"),
                         *[F.lit(None).cast("bigint").alias(c) for c in ("doc_id", "h1", "h2")], *payload)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            ids, kind = batch["shard"].to_numpy(), batch["kind"].to_numpy()
            heads = np.flatnonzero(kind == 0)
            cuts = sorted({0, len(ids), *(np.flatnonzero(np.diff(ids)) + 1).tolist(), *heads.tolist(),
                           *(heads + 1).tolist()})
            for lo, hi in zip(cuts, cuts[1:]):
                if kind[lo] == 0:
                    at, shard = ids[lo], Shard.load(*[batch[c][int(lo)].as_py() for c in payload])
                elif shard is not None and ids[lo] == at:
                    part = batch.slice(lo, hi - lo)
                    h1, h2 = part["h1"].to_numpy(), part["h2"].to_numpy()
                    found = shard.probe(h1, h2)
                    ok = found >= 0
                    doc = part["doc_id"].to_numpy()
                    ok[ok] = shard.keepers[found[ok]] != doc[ok]
                    if ok.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x[ok], pa.int64()) for x in (doc, h1, h2)], ["doc_id", "h1", "h2"])

    return (asked.unionAll(held).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
            .mapInArrow(rows, "doc_id bigint, h1 bigint, h2 bigint"))


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with its text less the repeated lines, and n_lines (before) and n_dropped."""
    source = docs.select("doc_id", "text")
    lines = materialise(line_hashes(source, min_chars)
                        .withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_DOC))), "lines")
    repeated = materialise(repeated_keys(lines, min_docs), "repeated")
    n, total = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    least_hot = total / HOT_KEYS
    hot_rows = repeated.where(F.col("n") >= least_hot).collect()  # each has 1 / HOT_KEYS of the total
    hot = Shard.of(*[np.array([r[c] for r in hot_rows], np.int64) for c in ("h1", "h2", "n", "keeper")])
    dumped = hot.dump()

    @F.arrow_udf("boolean")
    def is_hot(h1: pa.Array, h2: pa.Array) -> pa.Array:
        return pa.array(Shard.load(*dumped).probe(h1.to_numpy(), h2.to_numpy()) >= 0)

    cold = repeated.where(F.col("n") < least_hot)
    n_shards = max(1, math.ceil(n / SHARD_KEYS))
    n_parts = max(1, math.ceil(lines.count() / n_shards / PART_PROBES))
    hits = probe_shards(lines.where(~is_hot(F.col("h1"), F.col("h2"))), shard_arrays(cold, n_shards), n_shards, n_parts)
    per_doc = hits.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("__hits"))

    @F.arrow_udf("struct<text: string, n_lines: bigint, n_dropped: bigint>")
    def rest(t: pa.Array, doc: pa.Array, hit: pa.Array) -> pa.Array:
        held = Shard.load(*dumped)
        kept_text, before, dropped = [], [], []
        for x, d, h in zip(texts(t), doc.to_pylist(), hit.to_pylist()):
            rows = x.encode().split(b"\n")
            keys = [line_key(r, min_chars) for r in rows]
            named = [k for k in dict.fromkeys(keys) if k is not None]
            gone = {(y["h1"], y["h2"]) for y in h or ()}
            if named and len(held.prints):
                at = held.probe(np.array([k[0] for k in named], np.int64), np.array([k[1] for k in named], np.int64))
                gone.update(k for k, i in zip(named, at) if i >= 0 and held.keepers[i] != d)
            stay = [r for r, k in zip(rows, keys) if k is None or k not in gone]
            kept_text.append(b"\n".join(stay).decode())
            before.append(len(rows))
            dropped.append(len(rows) - len(stay))
        return pa.StructArray.from_arrays(
            [pa.array(kept_text, pa.string()), pa.array(before, pa.int64()), pa.array(dropped, pa.int64())],
            ["text", "n_lines", "n_dropped"])

    others = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "__hits", "__doc")]
    joined = (docs.select(*others).withColumn("__doc", F.coalesce("doc_id", F.lit(_NO_DOC)))
              .join(per_doc.withColumnRenamed("doc_id", "__doc"), "__doc", "left"))
    got = joined.withColumn("__rest", rest("text", "__doc", "__hits"))
    return got.select(*[F.col("__rest.text").alias(c) if c == "text" else F.col(c) for c in others],
                      F.col("__rest.n_lines").alias("n_lines"), F.col("__rest.n_dropped").alias("n_dropped"))
