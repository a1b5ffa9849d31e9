"""Pieces that the two trained text scorers share: sampling rows and hashing n-grams."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, splitmix

#: Hex digits of the hash prefixes by which a sample's reach is counted (4,096 prefixes a class).
_SLOT_DIGITS = 3


def is_held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 = 0: rows that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int],
           max_chars: int) -> list[tuple[int, str]]:
    """At most ``per_class[y]`` (label y, text) rows of each class, in a fixed order.

    Rows are drawn by the hash of doc_id from labelled rows of at most
    ``max_chars`` characters, so the sample's bytes are bounded too. A document
    with contradicting labels is left out; of rows that repeat a doc_id the smallest text
    counts. Ids are drawn before texts: counts per hash prefix tell how far the sample
    reaches, only ids up to there come to the driver, and one scan with these ids
    broadcast (at most ``sum(per_class)``) fetches their texts. No text is shuffled but
    those of the sample, and what is collected does not grow with the corpus.
    """
    marked = (labels.where(f"{label} IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id")
              .agg(F.min(label).cast("int").alias("y"), F.max(label).alias("y2")).where("y = y2").select("doc_id", "y"))
    short = docs.where(F.length("text").between(1, max_chars))
    drawn = materialise(marked.join(short.select("doc_id"), "doc_id", "left_semi")
                        .withColumn("at", F.sha2(F.col("doc_id").cast("string"), 256)), "labelled")
    slot = F.substring("at", 1, _SLOT_DIGITS)
    held: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for r in drawn.groupBy("y", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect():
        held[r["y"]][r["slot"]] = r["n"]
    ids: list[tuple[int, int]] = []
    for y in (0, 1):
        reach, last = 0, ""
        for last in sorted(held[y]):
            reach += held[y][last]
            if reach >= per_class[y]:
                break
        near = drawn.where((F.col("y") == y) & (slot <= last)).orderBy("at").limit(per_class[y])
        ids += [(y, r["doc_id"]) for r in near.select("doc_id").collect()]
    wanted = docs.sparkSession.createDataFrame([(i,) for _, i in ids], "doc_id bigint")
    found = {r["doc_id"]: r["text"] for r in short.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
             .join(F.broadcast(wanted), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    return [(y, found[i]) for y, i in ids if i in found]


def byte_grams(data: bytes, low: int, high: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of a text, as (one row per n) x (start).

    Words are separated by spaces; a gram may begin or end with a space (the
    word's edge) but has none inside. The second array tells which grams count.
    """
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    blank = b == 32
    h = np.full(n, 2166136261, np.uint32)
    inside = np.zeros(n, bool)  # a space strictly inside the gram so far
    ids, valid = np.zeros((high - low + 1, n), np.int32), np.zeros((high - low + 1, n), bool)
    for k in range(1, high + 1):
        m = n - k + 1
        if m <= 0:
            break
        h[:m] = (h[:m] ^ b[k - 1:]) * np.uint32(16777619)
        if k > 2:
            inside[:m] |= blank[k - 2:n - 1]
        if k >= low:
            x = h[:m] ^ (h[:m] >> np.uint32(15))
            ids[k - low, :m] = (x * np.uint32(2246822519)) >> np.uint32(32 - size.bit_length() + 1)
            valid[k - low, :m] = ~inside[:m]
    return ids, valid


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a space-separated text."""
    live = np.concatenate([[False], np.frombuffer(data, np.uint8) != 32, [False]])
    turns = np.flatnonzero(live[1:] != live[:-1])
    return turns[::2], turns[1::2]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    at = np.arange(len(b), dtype=np.int64)
    longest = int((ends - starts).max())
    powers = np.ones(longest, np.uint64)
    with np.errstate(over="ignore"):
        powers[1:] = np.cumprod(np.full(longest - 1, 0x100000001B3, np.uint64))
        word = np.cumsum(np.bincount(starts, minlength=len(b))) - 1
        live = b != 32
        terms = (b[live].astype(np.uint64) + np.uint64(1)) * powers[at[live] - starts[word[live]]]
        heads = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
        return splitmix(np.add.reduceat(terms, heads))


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of the calibrated probability sigmoid(a z + b), classes weighted alike.

    Newton steps on the logistic loss with Platt's softened targets.
    """
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    scale = max(float(z.std()), 1e-9)
    x = np.stack([z / scale, np.ones_like(z)], axis=1)
    t = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(x @ t)
        grad = x.T @ (w * (p - goal)) + 1e-4 * t
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        t -= move * min(1.0, 2.0 / max(1e-12, np.abs(move).max()))
    return float(t[0] / scale), float(t[1])
