"""SimHash near-dedup (operator 8).

Fingerprint: the majority bit over XXH64 hashes of a document's word shingles.
Two fingerprints link when at most ``max_bits`` (3) bits differ.

Links are searched among *distinct* fingerprints, so thousands of exact copies
are one. Four blocks of 16 bits: with 3 differing bits at least one block is
equal; of the other 48 bits, four parts of 12: again at least one is equal. A
fingerprint therefore goes to 16 *shards*, each named by 28 of its bits, and
every linked pair meets in one of them. A task builds a BK-tree of the shard
(children keyed by their distance to the parent) and follows, for each
fingerprint, only edges whose key is within ``max_bits`` of its own distance.
Trees are placed by a shuffle on the shard name, not by a broadcast: their
total size grows with the corpus, so no bound for a broadcast can be proven.

A shard of more than ``TREE`` fingerprints (a hot source of slightly different copies) is
cut into blocks; each pair of blocks is a unit of its own, so a tree holds two blocks at
most, however large its shard is, and every pair of the shard still meets in a unit.

A tree does not emit pairs. It joins what it finds in a local union-find and
emits one link per fingerprint, to the smallest of its local group; connected
components over these links give the classes.

Null text has no words: fingerprint zero, linked like any other. Rows that
repeat a doc_id are rows of their own with the same result. A null doc_id never
names a component unless no other id is in it. An empty table gives an empty
result. Columns named like an output are replaced.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, signed, texts
from .components import connected_components

MAX_BITS = 3
_BLOCK, _PART = 16, 12
#: Fingerprints of a block; a task's tree holds two blocks at most.
TREE = 20_000
#: Shingles hashed at a time, so a very long text needs bounded memory.
_CHUNK = 65_536


def fingerprint_of(text: str, words_per_shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of one text."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i:i + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: Column, words_per_shingle: int = 3) -> Column:
    """``bigint``: the fingerprint of each text (null: of no words)."""
    @F.arrow_udf("bigint")
    def bits(t: pa.Array) -> pa.Array:
        return pa.array([signed(fingerprint_of(x, words_per_shingle)) for x in texts(t)], pa.int64())

    return bits(text)


def shard_names(fp: Column) -> Column:
    """The 16 shards of a fingerprint, each 28 of its bits and which they are."""
    def of(block: int, part: int) -> Column:
        rotated = F.shiftleft(fp, _BLOCK * block).bitwiseOR(F.shiftrightunsigned(fp, 64 - _BLOCK * block)) \
            if block else fp
        head = F.shiftrightunsigned(rotated, 64 - _BLOCK)
        piece = F.shiftrightunsigned(rotated, _PART * part).bitwiseAND(F.lit((1 << _PART) - 1))
        return (F.lit(4 * block + part).cast("bigint") * (1 << _BLOCK + _PART)
                + F.shiftleft(head, _PART).bitwiseOR(piece))

    return F.array(*[of(b, p) for b in range(4) for p in range(4)])


class BKTree:
    """Fingerprints in a tree; a child's key is its Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int, radius: int) -> list[int]:
        """Add a new value; returns the indexes of earlier values within ``radius``."""
        near: list[int] = []
        me = len(self.values)
        if me:
            values, children = self.values, self.children
            stack = [0]
            while stack:
                k = stack.pop()
                d = (values[k] ^ value).bit_count()
                if d <= radius:
                    near.append(k)
                kids = children[k]
                if kids:
                    stack.extend(kids[e] for e in range(d - radius, d + radius + 1) if e in kids)
            k = 0
            while True:
                d = (values[k] ^ value).bit_count()
                nxt = children[k].get(d)
                if nxt is None:
                    children[k][d] = me
                    break
                k = nxt
        self.values.append(value)
        self.children.append({})
        return near


def group_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, smallest value of its local group) for distinct values of a shard."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, v in enumerate(values):
        for k in tree.insert(v, radius):
            a, b = root(i), root(k)
            if a != b:
                parent[max(a, b, key=values.__getitem__)] = min(a, b, key=values.__getitem__)
    return [(v, values[root(i)]) for i, v in enumerate(values) if root(i) != i]


def units(fps: DataFrame) -> DataFrame:
    """(shard, x, y, fp): each fingerprint in its 16 shards, and in a large shard once for each
    block (x <= y, its own among them) that it is held against."""
    placed = materialise(fps.select("fp", F.explode(shard_names(F.col("fp"))).alias("shard")), "shards")
    large = (placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TREE)
             .select("shard", F.ceil(F.col("n") / TREE).cast("int").alias("blocks")))
    dealt = placed.join(large, "shard", "left").withColumn(
        "mine", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("blocks").cast("bigint")).cast("int"), F.lit(0)))
    return (dealt.select("shard", "fp", "mine", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other"))
            .select("shard", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "fp"))


def links(fps: DataFrame, radius: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within ``radius``."""
    if not 0 <= radius <= 3:
        raise ValueError("the shards find differences of at most 3 bits")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def close(out: list[tuple[int, int]]) -> None:
            if len(held) > 1:
                out.extend(group_links(held, radius))

        for batch in batches:
            keys = [batch[c].to_numpy() for c in ("shard", "x", "y")]
            fp = batch["fp"].to_numpy().view(np.uint64)
            turns = np.logical_or.reduce([np.diff(k) != 0 for k in keys])
            cuts = np.concatenate([[0], np.flatnonzero(turns) + 1, [len(fp)]])
            # units of one fingerprint that neither continue nor may go on need no tree
            wide = np.flatnonzero((np.diff(cuts) > 1) | (np.arange(len(cuts) - 1) == 0)
                                  | (np.arange(len(cuts) - 1) == len(cuts) - 2)) if len(fp) else []
            out: list[tuple[int, int]] = []
            for k in wide:
                lo, hi = int(cuts[k]), int(cuts[k + 1])
                unit = tuple(int(x[lo]) for x in keys)
                if unit != name:
                    close(out)
                    name, held = unit, []
                held.extend(fp[lo:hi].tolist())
            if out:
                yield _pairs(out)
        out = []
        close(out)
        if out:
            yield _pairs(out)

    def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in zip(*out))
        return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    return (units(fps).repartition("shard", "x", "y").sortWithinPartitions("shard", "x", "y", "fp")
            .mapInArrow(rows, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``."""
    fps = materialise(docs.select("doc_id", fingerprint(F.col("text"), words_per_shingle).alias("fp")), "fps")
    least = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("doc")), "distinct")
    comps = connected_components(links(least.select("fp"), max_bits))
    named = (least.join(comps, least["fp"] == comps["node"], "left")
             .select("fp", "doc", F.coalesce("component", "fp").alias("component")))
    first = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    of_fp = named.join(first, "component").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, words_per_shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component (null doc_id: kept only if alone).

    Rows that repeat the kept doc_id all stay: they are one document.
    """
    found = near_duplicates(docs, words_per_shingle, max_bits)
    keep = (found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("__kept")).distinct())
    return docs.join(keep, docs["doc_id"].eqNullSafe(F.col("__kept")), "left_semi")
