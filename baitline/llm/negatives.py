"""Hard-negative mining by a secondary-sort shuffle (operator 13).

Vectors become integers, floor(256 * x); a score is an integer inner product. Anchors
are a stated query set; every anchor is scored against every row, block by block.

The work is a grid: anchors in groups of about ``GROUP``, rows in splits of about
``SPLIT``. A task holds one cell, a group and a split, so its memory does not depend on
the table. Two passes over the grid:

1. each cell keeps an anchor's best rows of the same label; the best of all cells are
   its positives;
2. each cell keeps, for each positive's score window, the first rows of another label.

What the cells keep is packed into (anchor, descending score, positives first, id) keys,
repartitioned by anchor and sorted within partitions. A streaming iterator reads the
keys in order: a positive opens its window, a row of another label is emitted to every
open window that its score fits and that is not full. An anchor is never held whole: the
iterator holds its open windows, at most ``POSITIVES``.

Rows with a null id, label, vector or component, or a component that is not finite,
take no part. Of rows that repeat a vec_id one counts: the smallest label, then the
smallest vector. Missing components of a shorter vector are 0. Scores are exact within
64 bits (beyond, they are held at the ends of that range). A positive with a negative
score has an empty window; with score 0 a window of 0 only. An empty table gives an
empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95
#: Anchors and rows of a cell.
GROUP, SPLIT = 4096, 8192
#: Anchors scored at a time against the rows of a cell.
_ANCHORS = 256
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, one per vec_id."""
    usable = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
              & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    one = F.min(F.struct(F.col("label").cast("bigint").alias("label"),
                         F.col("embedding").cast("array<double>").alias("vector")))
    return (vectors.where(usable).groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(one.alias("row"))
            .select("vec_id", "row.label", "row.vector"))


def swap_labels(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Labels moved on by one where vec_id is divisible by ``every`` (a planted confusion)."""
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels)
                           .otherwise(F.col("label")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """One row of floor(256 * x) per vector, padded with 0."""
    column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy()
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.floor(256.0 * column.flatten().to_numpy())
    return out


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products (anchors x rows) as int64."""
    d = min(anchors.shape[1], rows.shape[1])
    anchors, rows = anchors[:, :d], rows[:, :d]
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    if np.abs(anchors).max() * np.abs(rows).max() * d < _EXACT:  # every partial sum is exact
        return (anchors @ rows.T).astype(np.int64)
    ints = [[int(x) for x in v] for v in rows]
    return np.array([[min(max(sum(map(int.__mul__, a, v)), -_LONG), _LONG) for v in ints]
                     for a in ([int(x) for x in v] for v in anchors)], np.int64)


def first(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) indexes of each anchor's first ``k`` allowed rows by falling score, then row."""
    n = score.shape[1]
    if n > k:  # rows that reach the k-th largest allowed score, ties included
        low = np.where(allowed, score, -_LONG - 1)
        bar = np.partition(low, n - k, axis=1)[:, n - k:n - k + 1]
        allowed = allowed & (score >= bar)
    a, r = np.nonzero(allowed)
    order = np.lexsort((r, -score[a, r], a))
    a, r = a[order], r[order]
    at = np.arange(len(a)) - np.searchsorted(a, a)
    return a[at < k], r[at < k]


def _fits(negative: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """LOW * positive <= 100 * negative <= HIGH * positive, by integer bounds that cannot overflow."""
    whole, rest = np.divmod(positive, 100)
    low = whole * LOW - (-rest * LOW) // 100
    high = whole * HIGH + rest * HIGH // 100
    return (negative >= low) & (negative <= high)


def _grid(rows: DataFrame, anchors: DataFrame, keep: Callable) -> DataFrame:
    """(anchor, id, score) that ``keep(score, anchor part, row labels, row ids)`` picks in each cell.

    A cell is a group of anchors by a split of rows; both are dealt by hash, so a cell
    has a bounded size whatever the labels and vectors are.
    """
    n_rows, n_anchors = rows.count(), anchors.count()
    groups = -(-n_anchors // GROUP) or 1
    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splits = max(-(-n_rows // SPLIT), wide // groups, 1)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")

    left = anchors.select("vec_id", "label", "vector", "bounds", F.lit(0).alias("kind"),
                          dealt(groups, 1).alias("g"), every(splits).alias("s"))
    right = rows.select("vec_id", "label", "vector", F.lit(None).cast("array<bigint>").alias("bounds"),
                        F.lit(1).alias("kind"), every(groups).alias("g"), dealt(splits, 2).alias("s"))

    def close(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        cell = pa.Table.from_batches(parts).combine_chunks()
        kind = cell["kind"].to_numpy()
        n = int((kind == 0).sum())
        held, stream = cell.slice(0, n), cell.slice(n)
        if not n or not stream.num_rows:
            return
        ids, labels, matrix = stream["vec_id"].to_numpy(), stream["label"].to_numpy(), _matrix(stream["vector"])
        for at in range(0, n, _ANCHORS):
            part = held.slice(at, _ANCHORS)
            score = scores(_matrix(part["vector"]), matrix)
            a, r = keep(score, part, labels, ids)
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part["vec_id"].to_numpy()[a]), pa.array(ids[r]), pa.array(score[a, r])],
                    ["anchor", "id", "score"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts = None, []
        for batch in batches:
            g, s = batch["g"].to_numpy(), batch["s"].to_numpy()
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(s) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(g)]):
                if lo < hi:
                    if (g[lo], s[lo]) != name:
                        yield from close(parts)
                        name, parts = (g[lo], s[lo]), []
                    parts.append(batch.slice(int(lo), int(hi - lo)))
        yield from close(parts)

    return (left.unionByName(right).repartition(F.col("g"), F.col("s"))
            .sortWithinPartitions("g", "s", "kind", "vec_id")
            .mapInArrow(cells, "anchor bigint, id bigint, score bigint"))


def positives(rows: DataFrame, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """(anchor, id, score): each anchor's first ``k`` other rows of its label."""
    def keep(score: np.ndarray, part: pa.Table, labels: np.ndarray, ids: np.ndarray):
        same = part["label"].to_numpy()[:, None] == labels
        return first(score, same & (part["vec_id"].to_numpy()[:, None] != ids), k)

    near = _grid(rows, anchors.withColumn("bounds", F.lit(None).cast("array<bigint>")), keep)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    return near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")


def _candidates(rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(anchor, id, score): a cell's first ``k`` rows of another label in each window of its anchors."""
    def keep(score: np.ndarray, part: pa.Table, labels: np.ndarray, ids: np.ndarray):
        other = part["label"].to_numpy()[:, None] != labels
        bounds = part["bounds"].to_pylist()
        found = [np.empty(0, np.int64)]
        for j in range(max(map(len, bounds))):
            has = np.array([len(b) > j for b in bounds])[:, None]
            bound = np.array([b[j] if len(b) > j else 0 for b in bounds], np.int64)[:, None]
            a, r = first(score, other & has & _fits(score, bound), k)
            found.append(a * len(ids) + r)
        return np.divmod(np.unique(np.concatenate(found)), len(ids))

    return _grid(rows, anchors, keep)


def _mined(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Negatives of each (anchor, positive) from keys in (anchor, score falling, positives first, id) order."""
    anchor, open_windows = None, []
    for batch in batches:
        out = []
        for a, down, kind, i in zip(*(batch[c].to_pylist() for c in ("anchor", "down", "kind", "id"))):
            score = -down
            if a != anchor:
                anchor, open_windows = a, []
            if kind == 0:
                open_windows.append([i, score, 0])
                continue
            for window in open_windows:
                if window[2] < k and LOW * window[1] <= 100 * score <= HIGH * window[1]:
                    window[2] += 1
                    out.append((a, window[0], window[2], i, window[1], score))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if n == 2 else pa.int64()) for n, c in enumerate(zip(*out))],
                ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def hard_negatives(rows: DataFrame, anchors: Column, n_positives: int = POSITIVES,
                   n_negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows
    (vec_id, label, vector) that ``anchors`` picks; see ``clean`` for the rows."""
    rows = materialise(rows, "vectors")
    chosen = rows.where(anchors)
    found = materialise(positives(rows, chosen, n_positives), "positives")
    windows = found.groupBy(F.col("anchor").alias("vec_id")).agg(F.collect_list("score").alias("bounds"))
    near = _candidates(rows, chosen.join(windows, "vec_id"), n_negatives)
    keys = (found.withColumn("kind", F.lit(0)).unionByName(near.withColumn("kind", F.lit(1)))
            .select("anchor", (-F.col("score")).alias("down"), "kind", "id"))
    return (keys.repartition("anchor").sortWithinPartitions("anchor", "down", "kind", "id")
            .mapInArrow(lambda batches: _mined(batches, n_negatives),
                        "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
                        "positive_score bigint, negative_score bigint"))
