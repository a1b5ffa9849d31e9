"""Toxicity (operator 3): subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (bytes of the lower-cased word, edges
included), each hashed to a row of an embedding table. A *passage* of ``PASSAGE`` words is the average of the rows
of all its subwords; a linear softmax over {clean, toxic} scores it, and a text
is as toxic as its most toxic passage - in a long text a few insults would
vanish in one average. Embeddings and softmax are trained jointly in numpy
(Adagrad, then a calibrated scale and bias): in each round every toxic text gives the passage that scores
highest, every clean text the one that scores highest and a random one. A
misspelt or unseen word shares n-grams, and so rows, with words that were seen.

Learns from a bounded sample of labelled rows (``FIT_ROWS`` clean and toxic ones, texts
of at most ``FIT_CHARS`` characters) outside the held-out fifth. Scoring runs on
every whole text in Arrow batches: a two-class softmax is a sigmoid of a
difference, so the model is shipped as one number per bucket.

Null or empty texts and texts without words get the score of an empty average
(the prior share of toxic rows). Without labels of both classes that prior is
all that is learnt. Rows are independent: ties and repeats score alike.
Columns named like an output are replaced.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .linear import byte_grams, is_held_out, platt, sample, sigmoid, word_spans

BUCKETS, DIM, PASSAGE = 1 << 17, 12, 16
LOW, HIGH = 3, 6
FIT_ROWS, FIT_CHARS, SEED = (3_000, 1_500), 10_000, 7
#: Rounds of training, and the least number of gradient steps in each.
ROUNDS, STEPS = 9, 24
#: ASCII characters that no word holds.
_BREAKS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str) -> bytes:
    """The lower-cased words of a text, with a space on either side of each.

    A word said several times in a row counts once, or it would fill a passage.
    """
    words = text.lower().encode().translate(_BREAKS).split()
    return b" %b " % b" ".join([w for w, before in zip(words, [None, *words]) if w != before])


def passages(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the passages: PASSAGE words each, the last one moved back to fit."""
    starts, ends = word_spans(data)
    first = np.arange(0, len(starts), PASSAGE)
    first = np.minimum(first, max(0, len(starts) - PASSAGE))
    return starts[first], ends[np.minimum(first + PASSAGE, len(starts)) - 1]


@dataclass
class Model:
    """``weight``: (toxic - clean) of each bucket; a passage scores by their mean plus ``bias``."""
    weight: np.ndarray
    bias: float
    prior: float

    def margins(self, data: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        ids, valid = byte_grams(data, LOW, HIGH, BUCKETS)
        total = np.concatenate([[0.0], np.cumsum((self.weight[ids] * valid).sum(axis=0, dtype=np.float64))])
        count = np.concatenate([[0], np.cumsum(valid.sum(axis=0))])
        return (total[hi] - total[lo - 1]) / np.maximum(count[hi] - count[lo - 1], 1) + self.bias

    def score(self, text: str) -> float:
        data = plain(text)
        lo, hi = passages(data)
        return float(sigmoid(self.margins(data, lo, hi).max())) if len(lo) else self.prior


def train(rows: list[tuple[int, str]]) -> Model:
    """Fit on (label, text) rows."""
    prior = (sum(y for y, _ in rows) + 1) / (len(rows) + 2)
    found = [(y, data, *passages(data)) for y, data in ((y, plain(t)) for y, t in rows)]
    found = [x for x in found if len(x[2])]
    if not {0, 1} <= {x[0] for x in found}:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))), prior)
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    g_table, g_soft, g_bias = (np.full(shape, 1e-6, np.float32)
                               for shape in (BUCKETS, soft.shape, 2))

    def now() -> Model:
        return Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), prior)

    def step(part: list[tuple[int, np.ndarray]], share: float, rate: float) -> None:
        y = np.array([p[0] for p in part])
        ids, per_bag = np.concatenate([p[1] for p in part]), np.array([len(p[1]) for p in part])
        bag = np.repeat(np.arange(len(part)), per_bag)
        avg = np.add.reduceat(table[ids], np.cumsum(per_bag) - per_bag, axis=0) / per_bag[:, None].astype(np.float32)
        z = avg @ soft + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1  # the softmax's gradient, classes weighted alike
        p *= np.where(y == 1, 0.5 / share, 0.5 / (1 - share))[:, None] / len(y)
        d_soft, d_bias = avg.T @ p, p.sum(axis=0)
        d_avg = (p @ soft.T / per_bag[:, None]).astype(np.float32)
        order = np.argsort(ids, kind="stable")
        which, heads = np.unique(ids[order], return_index=True)
        d_rows = np.add.reduceat(d_avg[bag[order]], heads, axis=0)
        g_table[which] += (d_rows ** 2).mean(axis=1)
        table[which] -= rate * d_rows / np.sqrt(g_table[which])[:, None]
        for value, grad, seen in ((soft, d_soft, g_soft), (bias, d_bias, g_bias)):
            seen += grad ** 2
            value -= rate * grad / np.sqrt(seen)

    tops: list[int] = []
    for turn in range(ROUNDS):
        if turn >= 2 and turn % 2 == 0:
            model = now()
            tops = [int(model.margins(data, lo, hi).argmax()) for _, data, lo, hi in found]
        chosen = []
        for row, (y, data, lo, hi) in enumerate(found):
            some = {int(rng.integers(len(lo)))}
            if not tops:
                some.add(int(rng.integers(len(lo))))
            else:
                some = {tops[row]} if y else some | {tops[row]}
            for k in sorted(some):
                ids, valid = byte_grams(data[lo[k] - 1:hi[k] + 1], LOW, HIGH, BUCKETS)
                if valid.any():
                    chosen.append((y, ids[valid]))
        share = min(max(sum(y for y, _ in chosen) / max(1, len(chosen)), 0.01), 0.99)
        order = rng.permutation(len(chosen))
        for part in np.array_split(order, max(STEPS, len(order) // 256)):
            if len(part):
                step([chosen[k] for k in part], share, 0.1)
    model = now()
    best = np.array([model.margins(data, lo, hi).max() for _, data, lo, hi in found])
    a, b = platt(best, np.array([x[0] for x in found]))
    a = max(a, 0.0)  # calibration never turns the order round
    return Model(a * model.weight, a * model.bias + b, prior)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: tuple[int, int] = FIT_ROWS,
        fit_chars: int = FIT_CHARS) -> Model:
    """Train on a bounded sample of labelled rows outside the held-out fifth."""
    seen = labels.where(~is_held_out(F.col("doc_id")))
    return train(sample(docs, seen, "toxic", fit_rows, fit_chars))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on)."""
    @F.arrow_udf("double")
    def of(t: pa.Array) -> pa.Array:
        return pa.array([model.score(x) for x in texts(t)], pa.float64())

    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted", "__score")]
    return (docs.select(*kept, of(F.col(text_col)).alias("__score"))
            .select(*kept, F.col("__score").alias("score"),
                    (F.col("__score") >= 0.5).cast("int").alias("predicted")))
