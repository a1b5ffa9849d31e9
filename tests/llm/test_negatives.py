"""Hard negatives against a loop over all pairs."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from baitline.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def naive(rows):
    best = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, list(np.float32(v).astype(float)))
        best[i] = min(best.get(i, row), row)
    table = {i: ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
             for i, (label, v) in best.items()}
    out = []
    for a, (label, v) in table.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in table.items() if i != a)
        for p, i, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(a, i, rank, j, -p, -s) for rank, (s, j, _) in enumerate(fits, 1)]
    return sorted(out)


def found(df, **wide):
    rows = negatives.swap_labels(negatives.clean(df))
    return sorted(map(tuple, negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0).collect()))


def vectors(n=400, seed=1, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(8)] for _ in range(labels)]
    rows = [(i, [c + rng.gauss(0, 0.15) for c in centres[i % labels]], i % labels) for i in range(n)]
    same = [0.25] * 8
    rows += [(1000 + i, same, i % 3) for i in range(120)]                       # ties: one vector, three labels
    rows += [(2000, None, 1), (2050, [0.1] * 7 + [None], 1), (2100, [0.1] * 7 + [float("nan")], 2),
             (2150, [0.1] * 7 + [float("inf")], 2), (2200, [0.2] * 8, None), (None, [0.2] * 8, 1)]
    rows += [(2250, [0.0] * 8, 1), (2300, [], 2), (2350, [0.3, 0.2], 1)]         # zero, empty and short vectors
    rows += [(50, rows[50][1], rows[50][2]), (50, [0.9] * 8, 9)]                # repeated ids
    return rows


def test_matches_a_loop_over_all_pairs(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA)
    expected = naive(rows)
    assert len(expected) > 100
    assert found(df) == expected
    wide = df.select("*", *[F.lit(1).alias(c) for c in ("anchor", "score", "kind", "g", "s", "id", "bounds", "row")])
    assert found(wide.repartition(3)) == expected


def test_small_cells_give_the_same_rows(spark, monkeypatch):
    rows = vectors(200, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    for name, value in (("GROUP", 2), ("SPLIT", 16), ("_ANCHORS", 1)):
        monkeypatch.setattr(negatives, name, value)
    assert found(df) == naive(rows)


def test_few_labels_and_empty_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(i, [0.1, 0.2], 1) for i in range(1, 60)], SCHEMA)) == \
        naive([(i, [0.1, 0.2], 1) for i in range(1, 60)])
    lone = [(50, [0.5], 1), (51, [0.4], 2)]
    assert found(spark.createDataFrame(lone, SCHEMA)) == []


@pytest.mark.parametrize("big", [1.0, 1e9, 1e14])
def test_scores_are_exact_within_64_bits(big):
    rng = np.random.default_rng(3)
    a, b = (np.floor(rng.normal(size=(3, 5)) * big) for _ in "ab")
    exact = [[sum(int(x) * int(y) for x, y in zip(v, w)) for w in b] for v in a]
    clipped = [[min(max(x, -negatives._LONG), negatives._LONG) for x in r] for r in exact]
    assert negatives.scores(a, b).tolist() == clipped


def test_window_bounds_are_exact():
    for p in [*range(-120, 400), 2**62 + 1, 2**63 - 1]:
        span = range(min(p // 2 - 3, p - 3), max(p // 2, p) + 3) if abs(p) < 500 else [p // 2, p // 2 + 1, p // 20 * 19]
        for n in span:
            got = negatives._fits(np.array([n], np.int64), np.array([p], np.int64))[0]
            assert got == (50 * p <= 100 * n <= 95 * p), (n, p)


def test_anchors_are_read_as_a_stream():
    """The iterator holds open windows only: batches of one key each give the same rows."""
    import pyarrow as pa
    keys = [(1, -100, 0, 7), (1, -96, 1, 3), (1, -95, 1, 4), (1, -90, 0, 8), (1, -85, 1, 5), (1, -80, 1, 6),
            (1, -70, 1, 9), (2, -10, 1, 1)]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*keys)], ["anchor", "down", "kind", "id"])
    read = [r for b in negatives._mined(iter([whole.slice(i, 1) for i in range(len(keys))]), 3) for r in b.to_pylist()]
    assert [(r["positive_id"], r["rank"], r["negative_id"]) for r in read] == \
        [(7, 1, 4), (7, 2, 5), (8, 1, 5), (7, 3, 6), (8, 2, 6), (8, 3, 9)]
